import re

from pyspark.sql import functions as F

from scenemill.llm import licenses
from scenemill.llm.queries import queries


def brute(text):
    ids = []
    for s in re.split(r"\r?\n|[.!?;:]+(?:[\x20\x09]+|$)", text or ""):
        ids += [licenses.SENTENCES[k] for k in [re.sub("[^a-z0-9]+", " ", s.lower()).strip()] if k in licenses.SENTENCES]
    named = []
    for name, rules in licenses.RULES.items():
        for rule in rules:
            it = iter(ids)
            if all(x in it for x in rule):
                named.append(name)
                break
    return ",".join(ids), ",".join(named)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in queries()["op10_license_scan"](spark, sf_dir).collect()}
    assert got == {d: brute(t) for d, t in texts.items()} and any(v[1] for v in got.values())


def test_rules_need_their_order(spark):
    a, b = "You may not use this file except in compliance with the License.", "You may obtain a copy of the License at: http://x"
    texts = [None, "", a + " " + b, b + " " + a, a + "\nsome other words\n" + b, "RELEASED under the  MIT license", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "x " * 50000 + "\n" + a]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licenses", F.lit("own"))
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(7)] == ["", "", "Apache-2.0", "", "Apache-2.0", "MIT", "CC-BY-NC-4.0,MIT"]
    assert licenses.scan(df.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
VERBATIM = {
    MIT: ("mit-grant,mit-notice,mit-as-is", "MIT"),
    BSD: ("bsd-grant,bsd-source,bsd-binary", "BSD"),
    APACHE: ("apache2-note,apache2-comply,apache2-copy", "Apache-2.0"),
    GPL: ("gpl-free,gpl3-later", "GPL-3.0"),
    GPL.replace("Foundation,", "Foundation;"): ("gpl-free,gpl3-later", "GPL-3.0"),
    GPL.replace("Foundation,", "Foundation;").replace("General", "Affero General"): ("gpl-free,agpl3-later", "AGPL-3.0"),
    GPL.replace("General", "Affero General"): ("gpl-free,agpl3-later", "AGPL-3.0"),
    "                                 Apache License\n                           Version 2.0, January 2004\n": ("apache2-title", "Apache-2.0"),
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": ("gpl3-title", "GPL-3.0"),
    "This project is released under the MIT License.": ("mit-note", "MIT"),
    BSD + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES": ("bsd-grant,bsd-source,bsd-binary,bsd-endorse,bsd-as-is", "BSD,BSD-3-Clause"),
    """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""": ("mpl2-subject,mpl2-obtain", "MPL-2.0"),
    """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY""": ("isc-grant,isc-as-is", "ISC"),
    """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""": ("lgpl-free,lgpl21-later", "LGPL-2.1"),
    GPL.replace("version 3", "version 2"): ("gpl-free,gpl2-later", "GPL-2.0"),
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ("cc-by-sa-note", "CC-BY-SA-4.0"),
    "The data are licensed under CC BY 4.0.": ("cc-by-note", "CC-BY-4.0"),
    "This is free and unencumbered software released into the public domain.": ("unlicense-grant", "Unlicense"),
    "It was never released under the MIT License.": ("", ""),
    "It is provided with permission of the software\n\nReleased under\n\nthe MIT License": ("", ""),
}


def test_verbatim_texts_wrapped_and_unwrapped(spark):
    ways = [
        lambda t: t, lambda t: "Copyright (c) 2020 Someone.\r\n\r\n" + t.replace("\n", "\r\n"),
        lambda t: re.sub(r"(?<!\n)\n(?!\n) *", " ", t), lambda t: "\n".join(" * " + line for line in t.split("\n")),
        lambda t: re.sub(r"(?<=\w) (?=\w)", "\n", t) if "\n\n" not in t else t,
    ]
    rows = [(i * len(ways) + k, way(t)) for i, t in enumerate(VERBATIM) for k, way in enumerate(ways)]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = list(VERBATIM.values())
    assert got == {i: want[i // len(ways)] for i, _ in rows}


def test_table_is_whole():
    ids = set(licenses.SENTENCES.values())
    assert all(set(rule) <= ids for rules in licenses.RULES.values() for rule in rules)
    assert all(re.search(licenses.PRESENT, s) and re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in licenses.SENTENCES)


def test_repeats_and_rows_without_id(spark):
    df = spark.createDataFrame([(1, MIT), (1, MIT), (None, MIT), (None, None), (2, MIT + "\n\n" + APACHE)], "doc_id long, text string")
    got = sorted((r.licenses for r in licenses.scan(df).collect()))
    assert got == ["", "Apache-2.0,MIT", "MIT", "MIT", "MIT"]
