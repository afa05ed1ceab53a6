import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.llm import fill_middle as fim
from scenemill.llm.queries import oracle_sql, queries
from tests.oracle import connect, differences


def brute(doc_id, text, seed=1, percent=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, len(text), "plain", None, None, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return (doc_id, len(text), form, a, b - a, out)


def test_query_same_as_sql_and_restored(spark, sf_dir):
    name = "op13_fill_in_middle"
    got = queries()[name](spark, sf_dir).toPandas()
    assert not differences(got, connect(sf_dir).execute(oracle_sql()[name]).df())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(hashlib.sha256(texts[d].encode()).hexdigest() == s for d, s in zip(got["doc_id"], got["restored_sha256"], strict=True))
    assert set(got["form"]) == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "x<P>y"), (5, "<S>"), (6, "é𝄞\n" * 7000), (7, "<M"), (None, "no id"), (2**62 + 1, "big id"), (8, "퟿<p><s>"), (9, "a" * 200_000)]
    rows += [(100 + i, "ab𝄞é" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit(2), "output": F.lit(3), "h1": F.lit(4)})
    out = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted((brute(d, t) for d, t in rows), key=repr)
    texts = sorted((d or -1, t or "") for d, t in rows)
    assert sorted((r.doc_id or -1, r.back) for r in out) == texts
    assert fim.transform(df.limit(0)).count() == 0
    other = fim.transform(df, seed=7, percent=50, spm_percent=60).collect()
    assert sorted((tuple(r)[:6] for r in other), key=repr) == sorted((brute(d, t, 7, 50, 60) for d, t in rows), key=repr)


def test_words(spark):
    df = spark.createDataFrame([(i, "  One two\tthree é four  ") for i in range(50)], "doc_id long, text string")
    for r in fim.transform(df, unit="word").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert r.back == "  One two\tthree é four  " and r.n == 5
        if r.form == "psm":
            middle = r.output.split("<M>")[1]
            assert len(middle.split()) == r.middle_units
    with pytest.raises(ValueError):
        list(fim.boundaries(b"a", "line"))


@pytest.mark.parametrize("error", [1, 7, fim.ERROR])
def test_index_gives_every_boundary(error):
    rng = np.random.default_rng(error)
    letters = np.array(list("aé€𝄞"))
    text = "".join(letters[np.minimum(rng.geometric(0.5, 90_000) - 1, 3)]) + "a" * 70_000 + "𝄞" * 20_000 + "".join(letters[rng.integers(0, 4, 300)])
    raw = text.encode()
    index = fim.RankIndex(raw, error=error)
    want = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    assert index.n == len(text) and [index.cut(r) for r in range(0, len(text) + 1, 37)] == want[::37].tolist()
    assert abs(index.residuals.astype(int)).max() <= error + 1
    assert len(index.first) < (30 if error == fim.ERROR else 60_000)


def test_index_of_small_texts():
    for text in ("", "a", "𝄞", "aé", "é" * 3):
        index = fim.RankIndex(text.encode())
        assert [index.cut(r) for r in range(index.n + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    with pytest.raises(ValueError):
        fim.RankIndex(b"a", error=200)
