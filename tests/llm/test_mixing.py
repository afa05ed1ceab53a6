from collections import defaultdict

from pyspark.sql import functions as F

from scenemill.llm import mixing, queries
from tests.oracle import connect, differences


def targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_same_as_sql(spark, sf_dir):
    sql = queries.oracle_sql()["op4_source_mixing"]
    assert not differences(queries.queries()["op4_source_mixing"](spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df())


def test_targets_and_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "y"), (4, "w " * 1000, ""), (5, "q " * 10, "z"), (5, "q " * 10, "z"), (6, "p " * 7, "zz"), (None, "r s", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(9), "target": F.lit(8), "row": F.lit(7)})
    got = mixing.budget(df).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-9 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert {s: int(want[s]) for s in sizes} == dict(taken)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert {s: n for s, n in taken.items() if n} == dict(words)
    assert mixing.budget(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.budget(d).collect())) for d in (docs, docs.repartition(7, "text")))
    assert one == two


def test_one_id_and_one_source_for_all_rows(spark):
    """Equal rows are dealt to many ranges, and the budget is cut exactly among them."""
    rows = [(None, "a b c", "x")] * 3000 + [(4, "d e", "x")] * 3000 + [(5, "f", "y")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.budget(df).collect()
    assert len(got) == len(rows)
    want = targets({"x": 15_000, "y": 10})
    for name in want:
        assert sum(r.taken for r in got if r.source == name) == int(want[name])
    assert max(r.taken / r["size"] for r in got) <= 2 and sum(r.partial not in (0, r["size"]) for r in got) <= 2  # a cut text a source
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.budget(df.repartition(3)).collect()), key=repr)
