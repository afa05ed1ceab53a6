import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenemill.llm import substrings as sub
from scenemill.llm.queries import oracle_sql, queries
from scenemill.llm.words import words_of
from tests.oracle import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(id, words, removed, kept) of rows (id, tie, text)."""
    first, out = {}, []
    texts = sorted((d is None, d or 0, tie, t or "") for d, tie, t in rows)
    for *key, text in texts:
        w = WORD.findall(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (tuple(key), i))
    for *key, text in texts:
        w = WORD.findall(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (tuple(key), i):
                gone.update(range(i, i + window))
        out.append((None if key[0] else key[1], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def corpus(seed, n, vocabulary=30):
    """Texts of few words with shared passages, periodic stretches and near copies."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]
    passages, rows = [word(int(rng.integers(15, 70))) for _ in range(6)], []
    for i in range(n):
        w = word(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            cut = int(rng.integers(0, len(p)))
            w += p[cut if rng.random() < 0.4 else 0 :] + word(int(rng.integers(0, 9)))
        if rng.random() < 0.2:
            w += word(int(rng.integers(1, 4))) * int(rng.integers(5, 60))
        if rows and rng.random() < 0.2:
            w = rows[int(rng.integers(0, len(rows)))][1].split()
            if w and rng.random() < 0.7:
                w[int(rng.integers(0, len(w)))] = "other"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot", [sub.HOT, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sub, "HOT", hot)  # 2: windows of most keys are dealt one by one
    monkeypatch.setattr(sub, "SHARD", 2000)
    rows = corpus(5, 260)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sub.without_repeats(df)
    assert got(out) == brute([(d, 0, t) for d, t in rows])
    for r in out.limit(40).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_other_windows(spark):
    rows = corpus(6, 80)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for window in (10, 24):
        assert got(sub.without_repeats(df, window)) == brute([(d, 0, t) for d, t in rows], window)
    for window in (9, 25):
        with pytest.raises(ValueError):
            sub.without_repeats(df, window)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 7919}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, passage), (5, f"  é𝄞 {passage.replace(' ', chr(10))}\x0b"), (6, "a " * 50), (7, "a " * 20), (8, "a " * 19)]
    rows += [(9, long), (None, passage), (10, f"{passage.replace('p7', 'P7')}"), (11, f"a b {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "tie": F.lit(2), "start": F.lit(3), "key": F.lit("k")})
    assert got(sub.without_repeats(df)) == brute([(d, 0, t) for d, t in rows])
    assert sub.without_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sub.without_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_one_id_for_many_documents(spark):
    """Documents of one id are ordered by a hash of their texts; equal rows are one document."""
    rows = corpus(7, 60)
    for doc_id in (None, 3):
        same = [(doc_id, t) for _, t in rows] + [(doc_id, rows[5][1])] * 3
        df = spark.createDataFrame(same, "doc_id long, text string")
        tie = {r.text: r.tie for r in df.select("text", F.xxhash64("text", F.col("doc_id").isNull()).alias("tie")).collect()}
        want = brute([(doc_id, tie[t], t) for t in {t for _, t in same}])
        by_kept = {r.kept for r in sub.without_repeats(df).collect()}
        assert sub.without_repeats(df).count() == len(same) and by_kept == {w[3] for w in want}


def test_hot_passage_is_spread(spark, monkeypatch):
    """A passage that every document has, amid own words: its borders are as many segments of one key."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 30)) + f" {passage} " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(sub, "HOT", 1000)
    out = got(sub.without_repeats(df))
    assert out == brute([(d, 0, t) for d, t in rows]) and sum(r[2] >= 40 for r in out) == 2999


def test_same_as_sql(spark, sf_dir):
    name = "op11_substring_dedup"
    assert not differences(queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(oracle_sql()[name]).df())


def test_index_counts_and_earliest():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 4, 600), 0)
    index = sub.FMIndex(text)
    for _ in range(300):
        a = int(rng.integers(0, 590))
        pattern = text[a : a + int(rng.integers(1, 12))]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.step(np.array([symbol]), low, high)
        there = [i for i in range(len(text) - len(pattern)) if (text[i : i + len(pattern)] == pattern).all()]
        assert high[0] - low[0] == len(there) and index.earliest(low, high)[0] == there[0]
    tree = sub.WaveletTree(text, 3)
    for i in (0, 1, 63, 64, 65, 300, len(text)):
        for s in range(5):
            assert tree.rank(np.array([s]), np.array([0]), np.array([i]))[1][0] == (text[:i] == s).sum()


def test_ranges_keep_every_key_that_is_not_alone():
    """Segments sorted out in batches of any size: repeats, keys of several segments, edges of the range."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"key": rng.integers(0, 60, 200), "digest": rng.integers(0, 3, 200), "doc": rng.integers(0, 50, 200), "tie": 0, "start": 0, "windows": 1, "inner": False})
    rows = rows.sort_values(["key", "digest", "doc"]).reset_index(drop=True)
    for size in (1, 3, 50, 200):
        out = pd.concat(sub._sort_out(iter([rows.iloc[i : i + size] for i in range(0, 200, size)])))
        distinct = rows.drop_duplicates(["key", "digest", "doc"])
        leads = distinct.drop_duplicates(["key", "digest"])
        several = leads.groupby("key")["digest"].transform("size") > 1
        edge = leads["key"].isin([rows["key"].iloc[0], rows["key"].iloc[-1]])
        wanted = out[out["wanted"].astype(bool)]
        must = leads[several | edge]
        assert set(map(tuple, must[["key", "doc"]].to_numpy())) <= set(map(tuple, wanted[["key", "doc"]].to_numpy())) and len(wanted) <= len(must) + 1
        again = distinct[distinct.duplicated(["key", "digest"])]
        repeats = out[~out["wanted"].astype(bool)].drop_duplicates(["key", "doc"])
        assert set(map(tuple, again[["key", "doc"]].to_numpy())) == set(map(tuple, repeats[["key", "doc"]].to_numpy()))


def test_digests_tell_stretches_apart():
    w = words_of(["a b c a b c b a c"])
    at = np.array([0, 3, 6])
    d = sub._digests(w.hash, at, at + 3)
    assert d[0] == d[1] != d[2] and len(hashlib.sha256(d.tobytes()).hexdigest()) == 64
