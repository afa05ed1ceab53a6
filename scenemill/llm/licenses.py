"""License scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences and normalised (lower case, letters and digits, single blanks; line ends and
the signs of comments are blanks too, so wrapped lines are joined). Known wordings are mapped to identifiers:
notes and titles wherever they stand, all others where a sentence or a line begins; a sentence may go on after
them. A license is a rule: a sequence of identifiers that must occur in this order among a document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised wordings and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-note",
    "licensed under the mit license": "mit-note",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice",
    "the software is provided as is without warranty of any kind": "mit-as-is",
    "licensed under the apache license version 2 0": "apache2-note",
    "released under the apache license version 2 0": "apache2-note",
    "apache license version 2 0 january 2004": "apache2-title",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-note",
    "licensed under the gnu general public license version 2": "gpl2-note",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-note",
    "licensed under the gnu lesser general public license version 3": "lgpl3-note",
    "licensed under the gnu affero general public license version 3": "agpl3-note",
    "this program is free software": "gpl-free",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "licensed under cc by nc 4 0": "cc-by-nc-note",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-note",
    "licensed under cc by 4 0": "cc-by-note",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-note",
    "licensed under cc by sa 4 0": "cc-by-sa-note",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-note",
    "licensed under cc by nd 4 0": "cc-by-nd-note",
    "licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-note",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-note",
    "licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-note",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "this software is provided by the copyright holders and contributors as is": "bsd-as-is",
    "licensed under the bsd 2 clause license": "bsd2-note",
    "licensed under the bsd 3 clause license": "bsd3-note",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-obtain",
    "licensed under the mozilla public license version 2 0": "mpl2-note",
    "mozilla public license version 2 0": "mpl2-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software": "isc-as-is",
    "licensed under the isc license": "isc-note",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost-grant",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-grant",
}
#: Licenses, by the sequences of identifiers that show them.
RULES = {
    "0BSD": [["bsd0-grant", "isc-as-is"]],
    "AGPL-3.0": [["agpl3-note"], ["agpl3-title"], ["gpl-free", "agpl3-later"]],
    "Apache-2.0": [["apache2-note"], ["apache2-title"], ["apache2-comply", "apache2-copy"]],
    "BSD": [["bsd-grant", "bsd-source"], ["bsd-source", "bsd-binary"]],
    "BSD-2-Clause": [["bsd2-note"]],
    "BSD-3-Clause": [["bsd3-note"], ["bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-4-Clause": [["bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]],
    "BSL-1.0": [["boost-title"], ["boost-grant"]],
    "CC-BY-4.0": [["cc-by-note"]],
    "CC-BY-NC-4.0": [["cc-by-nc-note"]],
    "CC-BY-NC-SA-4.0": [["cc-by-nc-sa-note"]],
    "CC-BY-ND-4.0": [["cc-by-nd-note"]],
    "CC-BY-SA-4.0": [["cc-by-sa-note"]],
    "EPL-2.0": [["epl2-grant"]],
    "GPL-2.0": [["gpl2-note"], ["gpl2-title"], ["gpl-free", "gpl2-later"]],
    "GPL-3.0": [["gpl3-note"], ["gpl3-title"], ["gpl-free", "gpl3-later"]],
    "ISC": [["isc-note"], ["isc-grant", "isc-as-is"]],
    "LGPL-2.1": [["lgpl21-note"], ["lgpl21-title"], ["lgpl-free", "lgpl21-later"]],
    "LGPL-3.0": [["lgpl3-note"], ["lgpl3-title"], ["gpl-free", "lgpl3-later"], ["lgpl-free", "lgpl3-later"]],
    "MIT": [["mit-note"], ["mit-grant", "mit-notice"], ["mit-grant", "mit-as-is"]],
    "MPL-2.0": [["mpl2-note"], ["mpl2-title"], ["mpl2-subject", "mpl2-obtain"]],
    "Unlicense": [["unlicense-grant"]],
    "Zlib": [["zlib-as-is", "zlib-grant"]],
}
#: Sentences of a lower-case text end at a mark before a blank or the end, or at a line without a-z and 0-9; the
#: GPL's note goes on after "Foundation;".
ENDS = r"(?:[.!?:]|(?<!foundation);)[.!?;:]*(?:\s+|$)|\r?\n[^a-z0-9\n]*(?=\r?\n)"
#: What a text must hold for any wording to be in it.
PRESENT = "licen|permi|redistribut|software|mpl|neither the|all advertising"
#: A note that is denied is none.
DENIED = r"(?<!\b(?:not|never|isn[ \n]t|no[ \n]longer)[ \n](?:be[ \n]|been[ \n])?)"
#: Where a sentence or a line begins, behind its number if it has one.
BEGIN = r"(?:(?<=[\x01\n])|(?<=[\x01\n][0-9a-z]{1,3}[ ]))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known wordings, in order."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    low = F.lower(text)
    clean = F.concat(F.lit("\x01"), F.regexp_replace(low, ENDS, "\x01"))  # no wording reaches over this sign
    for signs, one in ((r"[^a-z0-9\n\x01]*\n[^a-z0-9\x01]*", "\n"), (r"[^a-z0-9\n\x01]+", " "), (r"[ \n]*\x01[ \n\x01]*", "\x01")):
        clean = F.regexp_replace(clean, signs, one)
    either = lambda inside: "|".join(s.replace(" ", r"[ \n]") for s, i in sorted(SENTENCES.items(), key=lambda x: -len(x[0])) if i.endswith(("-note", "-title")) == inside)
    any_of = rf"\b(?:{DENIED}(?:{either(True)})|{BEGIN}(?:{either(False)}))\b"
    found = F.regexp_extract_all(clean, F.lit(any_of), F.lit(0))
    return F.when(low.rlike(PRESENT), F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " "))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses) of each row: identifiers joined by ",", licenses in order of name.

    Null and empty texts have neither, shown as empty strings. Texts are read whole, however long. Rows keep
    their number, repeated or without an id or not; other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    ids = F.coalesce(sentence_ids(F.col(text_col).cast("string")), F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_join(ids, ",").alias("sentence_ids"))
    said = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    matches = lambda rule: said.rlike("," + ",(?:[^,]+,)*?".join(rule) + ",")
    names = []
    for name, rules in RULES.items():
        one = F.lit(False)
        for rule in rules:
            one = one | matches(rule)
        names.append(F.when(one, F.lit(name)))
    return rows.withColumn("licenses", F.array_join(F.array_compact(F.array(*names)), ","))
