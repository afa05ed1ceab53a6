import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.llm import common
from scenemill.llm import near_dedup as nd
from scenemill.llm.queries import queries


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(queries()["op1_minhash_near_dedup"](spark, sf_dir)) == brute(rows)


def test_groups_chains_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 10**9))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(80)], []
    for i in range(90):  # near copies of one text
        own = list(base)
        own[rng.integers(0, 150)] = word()
        rows.append((i, " ".join(own)))
    drift = [word() for _ in range(120)]
    for i in range(100, 120):  # a chain: neighbours are alike, ends are not
        drift[(i * 17) % 120] = word()
        rows.append((i, " ".join(drift)))
    for i in range(200, 280):  # a passage that many documents share
        rows.append((i, " ".join(passage + [word() for _ in range(25)])))
    assert result(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "One  two", "b"), (5, "one two", None), (6, "one", "c"), (7, "a b c d e", "c"), (7, "a b c d e", "c"), (None, "a b c d e", "c"), (8, "x " * 20000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string").withColumns({"key": F.lit(1), "rep": F.lit(2), "left": F.lit(3)})
    got = sorted(map(tuple, nd.near_dedup(df).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 8, True), (None, 1, None, True)]
    assert got == sorted(want, key=repr)
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_sketch_fills_every_bin_and_estimates(spark):
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))])
    bins = nd.sketches([a, b, a[:1], np.empty(0, np.uint64)])
    top = np.iinfo(np.uint64).max
    assert (bins[:3] != top).all() and (bins[3] == top).all()
    assert abs((bins[0] == bins[1]).mean() - 800 / 1200) < 0.12


def test_pairs_between_80_and_85_percent():
    assert nd.banding(85) == (8, 32) and nd.banding(80) == (7, 36)


def near_pair(rng, same, own):
    """Two texts whose sets have ``same`` shingles in common and ``own`` each of their own."""
    words = [f"w{x}" for x in rng.integers(0, 10**9, same + 4)]
    tail = lambda: [f"t{x}" for x in rng.integers(0, 10**9, own)]
    return " ".join(words + tail()), " ".join(words + tail())


def test_drop_copies_at_80_percent(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i, (same, own) in enumerate([(160, 20), (161, 19), (159, 21), (164, 16), (171, 15)] * 6):  # 0.80 exactly, above, below
        a, b = near_pair(rng, same, own)
        rows += [(2 * i, a), (2 * i + 1, b)]
    want = brute(rows, 80)
    got = {r.doc_id for r in nd.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, (_, _, kept) in want.items() if kept} and len(got) < len(rows)


def test_drop_copies_of_odd_rows(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(5, text, "a"), (5, text, "a"), (None, text, "b"), (None, other, "c"), (None, other, "d"), (7, other + " x", None), (8, None, "e"), (8, None, "e"), (9, "", "f"), (None, None, "g"), (None, "z " * 30000, "h"), (6, text, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"_id": F.lit(1), "_text": F.lit("x"), "kept": F.lit(False)})
    got = nd.drop_copies(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(5, text), (None, other), (7, other + " x"), (8, None), (9, ""), (None, None), (None, "z " * 30000)], key=repr)
    assert nd.drop_copies(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, text)] * 50 + [(None, text)] * 50, "doc_id long, text string")
    assert [r.doc_id for r in nd.drop_copies(one).collect()] == [1]


def test_many_families_in_common_buckets(spark):
    """Template pages: alike within a family at over 0.9, across families at about 0.8: no link between families."""
    rng = np.random.default_rng(11)
    template, rows = [f"t{x}" for x in rng.integers(0, 10**9, 400)], []
    for family in range(30):
        own = list(template)
        for at in rng.integers(0, 400, 9):
            own[at] = f"f{family}_{at}"
        for member in range(10):
            page = list(own)
            page[rng.integers(0, 400)] = f"m{family}_{member}"
            rows.append((family * 10 + member, " ".join(page)))
    assert result(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in common.components(path).collect()} == {0}
    with pytest.raises(RuntimeError, match="still changing"):
        common.components(path, max_rounds=2)
    assert common.components(path.limit(0)).count() == 0


def test_local_masters():
    assert common.is_local("local") and common.is_local("local[8]") and not common.is_local("local-cluster[3,2,1024]")
