import numpy as np
from pyspark.sql import functions as F

from scenemill.llm import neighbours
from scenemill.llm.queries import queries


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries()["op2_permutation_index"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = ids[ids % 50 == 0]
    assert set(got) == set(asked.tolist()) and all(len(v) == 5 for v in got.values())
    hits = 0
    for q in asked:
        s = unit @ unit[ids == q][0]
        near = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        hits += len(set(near) & {i for i, _ in got[q]})
        assert all(abs(score - s[ids == i][0]) < 1e-12 for i, score in got[q])
    assert hits >= 0.9 * 5 * len(asked)


def test_ties_and_unusable(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"near": F.lit(1), "pivot": F.lit("x")})
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 1.0), (0, 4, 7, 0.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_a_very_common_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(3000)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 6, 9, 12, 15]


def recall(rows, got, asked, k=5):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in asked:
        s = unit @ unit[q]
        near = [i for i in ids[np.lexsort((ids, -s))] if i != q][:k]
        hits += len(set(near) & got[q])
    return hits / (k * len(asked))


def found(spark, rows, every):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def test_recall_where_the_ranking_decides(spark):
    """30,000 random directions: about 235 rows a file, of which 19 are reranked."""
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.normal(size=(30_000, 64))))
    assert recall(rows, found(spark, rows, 200), range(0, 30_000, 200)) >= 0.9


def test_recall_beside_a_hot_cluster(spark):
    """A third of all rows lie close together: queries inside and outside keep their neighbours."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(i, centre + 0.05 * rng.normal(size=64) if i % 3 == 0 else rng.normal(size=64)) for i in range(24_000)]
    got = found(spark, rows, 100)
    inside = [q for q in got if q % 3 == 0]
    assert recall(rows, got, [q for q in got if q % 3]) >= 0.9 and recall(rows, got, inside) >= 0.9


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = list(enumerate(rng.normal(size=(3000, 8))))
    one = found(spark, rows, 10)
    monkeypatch.setattr(neighbours, "QUERIES", 50)
    assert found(spark, rows, 10) == one


def test_other_dimensions_take_no_part(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(10 + i, [1.0, 2.0, 3.0]) for i in range(6)] + [(50, [1.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert {r.vec_id for r in got} <= {0, 1, 2, 3, 4, 5, 50}
