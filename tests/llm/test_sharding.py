from collections import defaultdict

from pyspark.sql import functions as F

from scenemill.llm import queries, sharding
from tests.oracle import connect, differences


def test_same_as_sql(spark, sf_dir):
    sql = queries.oracle_sql()["op8_extendible_sharding"]
    assert not differences(queries.queries()["op8_extendible_sharding"](spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df())


def split(rows, limit, shard=""):
    total = sum(n for _, n in rows)
    if total <= limit or len(shard) == sharding.MOST_BITS:
        return {shard: total} if rows else {}
    return {k: v for b in "01" for k, v in split([r for r in rows if r[0].startswith(shard + b)], limit, shard + b).items()}


def test_directory(spark):
    rows = [(i, "x" * (i % 50)) for i in range(2000)] + [(5000, "y" * 3000), (5001, None), (5002, ""), (None, "zz"), (7, "é" * 400), (7, "é" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "bits": F.lit(2), "bytes": F.lit(3)})
    got = sharding.shards(df, 700).collect()
    bits = {r.doc_id: r.b for r in df.select("doc_id", sharding.bits_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("b")).collect()}
    want = split([(bits[d], len((t or "").encode())) for d, t in rows], 700)
    assert len(got) == len(rows) and all(bits[r.doc_id].startswith(r.shard) and want[r.shard] == r.shard_bytes for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.bytes
    assert {k: v for k, v in want.items() if k in sums} == dict(sums)
    assert {r.doc_id for r in got if not r.fits} == {5000, 7}
    assert sharding.shards(df.limit(0), 700).count() == 0


def test_one_id_for_all_rows(spark):
    """Rows without ids, and copies of one row, are split like any others."""
    for doc_id in (None, 3):
        rows = [(doc_id, f"text {i}") for i in range(500)] + [(doc_id, "the same")] * 500 + [(8, "z" * 50), (8, "z" * 950)]
        got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
        assert len(got) == len(rows) and {r.doc_id for r in got if not r.fits} == {8}
        sums = defaultdict(int)
        for r in got:
            sums[r.shard] += r.bytes
        assert all(sums[r.shard] == r.shard_bytes for r in got) and len(sums) > 20
        assert all(r.shard_bytes <= 400 for r in got if r.fits)


def test_long_texts_of_one_line_and_repeats(spark):
    rows = [(1, "word " * 40_000), (2, "word " * 40_000), (2, "word " * 40_000), (4, None)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 250_000).collect()
    assert all(r.fits for r in got) and len({r.shard for r in got if r.doc_id in (1, 2)}) == 3


def test_reruns_agree_for_rows_of_one_id(spark, monkeypatch):
    """However rows are dealt to tasks, and however equal ones are numbered in parts."""
    rows = [(3, f"text {i % 200}") for i in range(600)] + [(None, "the same")] * 300 + [(i, "x" * i) for i in range(100)] + [(9, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts, copies in ((2, 10_000), (7, 10_000), (3, 13)):
        monkeypatch.setattr(sharding, "COPIES", copies)
        found.append(sorted(map(tuple, sharding.shards(df.repartition(parts), 300).collect()), key=repr))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
