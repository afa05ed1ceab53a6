import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scenemill.llm import fingerprint as fp
from scenemill.llm.queries import queries


def brute(rows):
    texts = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for i, (d, t) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + follow[:n]
        a, b, c = fp.of_paragraphs(t), fp.of_paragraphs(edited), fp.of_paragraphs(follow)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.show(a), fp.show(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries()["op9_fingerprints"](spark, sf_dir).collect()))
    assert got == brute(rows)
    long = [r for r in got if r[1] > 200]
    assert sum(r[5] > r[6] for r in long) > 0.98 * len(long)


def test_multiset_of_paragraphs():
    one, two = "alpha beta gamma\n\ndelta epsilon\nalpha beta gamma", "delta epsilon\nalpha beta gamma\n  \nalpha beta gamma"
    f = fp.show(fp.of_paragraphs(one))
    assert f == fp.show(fp.of_paragraphs(two)) and f != fp.show(fp.of_paragraphs("alpha beta gamma\ndelta epsilon"))
    more = fp.add(f, "zeta eta")
    assert more == fp.show(fp.of_paragraphs(one + "\nzeta eta")) and fp.remove(more, "zeta eta") == f
    assert fp.likeness(fp.read(f), fp.read(f)) == 1.0


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, "a"), (6, "word " * 20000), (5, "é𝄞x\ny"), (4, "same"), (4, "same"), (3, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_bucket": F.lit(1), "n_chars": F.lit(2)})
    assert sorted(map(tuple, fp.fingerprint_edits(df).collect())) == brute(rows)
    assert sorted(map(tuple, fp.fingerprint_edits(df, ranges=2).collect())) == brute(rows)
    alone = fp.fingerprint_edits(df.where("doc_id = 7")).first()
    assert alone.near_next == 1.0 and fp.fingerprint_edits(df.limit(0)).count() == 0
    assert fp.fingerprint_edits(df.union(df.limit(1).selectExpr("null", "'no id'", "1", "2"))).where("doc_id is null").count() == 1


def test_one_id_for_all_rows(spark):
    """Without ids (or with one), rows are still dealt out; equal rows follow each other."""
    rng = np.random.default_rng(2)
    texts = [f"line {i}\n" + " ".join(f"w{x}" for x in rng.integers(0, 50, 40)) for i in range(300)] + ["hot text here"] * 25_000 + [None, ""]
    for doc_id in (None, 7):
        df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
        got = fp.fingerprint_edits(df)
        assert got.rdd.getNumPartitions() > 32
        order = sorted((t or "" for t in texts), key=lambda t: hashlib.md5(t.encode()).digest())
        want = Counter()
        vector = {t: fp.of_paragraphs(t) for t in set(order)}
        for i, t in enumerate(order):
            follow = order[(i + 1) % len(order)]
            n = len(t) // 3
            edited = t[: len(t) - n] + follow[:n]
            want[doc_id, hashlib.sha256(edited.encode()).hexdigest(), fp.show(vector[t]), fp.likeness(vector[t], vector[follow])] += 1
        assert Counter((r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in got.collect()) == want


def test_keys_sort_as_ids_do_downwards(spark):
    ids = [2**63 - 1, 5, 1, 0, -1, -(2**63) + 1, -(2**63), None]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    got = [r.doc_id for r in df.orderBy(fp.order_key(F.col("doc_id"), F.col("text"))).collect()]
    assert got == ids
