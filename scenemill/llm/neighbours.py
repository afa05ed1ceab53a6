"""Approximate nearest neighbours by a permutation index.

``pivots`` spread-out vectors come from a bounded sample: each next one is the farthest from those chosen. A
vector is represented by the order of its pivots, nearest first, and posted in the inverted file of the
nearest one; files are split into chunks of about ``CHUNK`` rows. A query reads the files of its ``probes``
nearest pivots. In each chunk, vectors are ranked by footrule distance of the pivot orders, and the best share
``keep`` of them (k at least) are reranked by exact cosine; only the chunk's best k go on. Queries meet a
chunk in blocks of about ``QUERIES``. Vectors are shuffled once for each block of queries, queries once for
each chunk they read.

Where vectors have no structure (random directions in many dimensions), no index can leave out much: the
defaults read 62% of all vectors for such a query, a byte for each pivot, and rerank 5% of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, tidy

PIVOTS, PROBES, KEEP, CHUNK, QUERIES, SAMPLE = 128, 80, 0.08, 2048, 16384, 4096


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.array(rows.tolist(), np.float64).reshape(len(rows), dim)


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _ranks(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    near = (x / np.maximum(_length(x), 1e-300)[:, None]) @ pivots.T
    order = np.argsort(-np.round(near, 9), axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :].repeat(len(x), 0), axis=1)
    return ranks.astype(np.uint8)


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the rows (of length 1): the first, then always the farthest from all before."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-9:  # only copies are left
            break
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


def search(asked: pd.DataFrame, posted: pd.DataFrame, dim: int, k: int, keep: float) -> pd.DataFrame:
    """The k best of a chunk for each query: ranked by footrule, the first of them reranked by cosine."""
    found: tuple = ([], [], [])
    if len(asked) and len(posted):
        posted = posted.sort_values("vec_id", kind="stable")
        ids, x = posted["vec_id"].to_numpy(), _matrix(posted["v"], dim)
        ranks = np.ascontiguousarray(np.frombuffer(b"".join(posted["ranks"]), np.uint8).reshape(len(ids), -1).T)
        size, most = _length(x), max(k, int(np.ceil(keep * len(ids))))
        for q, v, r in zip(asked["query_id"], _matrix(asked["v"], dim), asked["ranks"], strict=True):
            own = np.frombuffer(r, np.uint8)[:, None]
            foot = (np.maximum(ranks, own) - np.minimum(ranks, own)).sum(axis=0, dtype=np.uint16)
            best = np.argsort(foot, kind="stable")[: most + 1]
            best = best[ids[best] != q][:most]
            score = (x[best] * v).sum(axis=1) / (size[best] * _length(v[None, :])[0])  # row by row alike: equal vectors have equal scores
            top = np.lexsort((ids[best], -score))[:k]
            for all_, one in zip(found, (np.full(len(top), q), ids[best][top], score[top]), strict=True):
                all_.append(one)
    query, vec, score = (np.concatenate(c) if c else np.zeros(0) for c in found)
    return pd.DataFrame({"query_id": query.astype(np.int64), "vec_id": vec.astype(np.int64), "score": score.astype(float)})


def usable(vector: Column) -> Column:
    """Neither null, nor zero, nor holding null, NaN or infinite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, pivots: int = PIVOTS, probes: int = PROBES, keep: float = KEEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``queries`` holds.

    Nearness is cosine on the original vectors in double precision, ties go to the smaller id. Vectors that
    are not ``usable``, have a null id, or another dimension than most (of two as frequent, the smaller) take
    no part; of rows with one id the least vector stands. Other columns are ignored, whatever their names. An
    empty table gives an empty result. At most 255 pivots.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")
    )
    empty = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = dims["d"]
    rows = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("r")).select("vec_id", "r.v", "r.q")
    picked = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 8 * pivots)).collect()])
    centre = spread_out(picked / _length(picked)[:, None], pivots)
    probes = min(probes, len(centre))

    @tidy
    def represent(batches):
        for b in batches:
            ranks = _ranks(_matrix(b["v"], dim), centre)
            first = np.argsort(ranks, axis=1, kind="stable")[:, :probes]
            yield b.assign(ranks=[r.tobytes() for r in ranks], near=list(first.astype(np.int32)))

    known = table(rows.mapInPandas(represent, "vec_id long, v array<double>, q boolean, ranks binary, near array<int>"))
    chunk_of = {r["pivot"]: -(-r["n"] // CHUNK) for r in known.groupBy(F.col("near")[0].alias("pivot")).agg(F.count("*").alias("n")).collect()}
    chunks = F.array(*[F.lit(int(chunk_of.get(p, 0))) for p in range(len(centre))])  # one number for each pivot
    blocks = max(1, -(-dims["asked"] // QUERIES))
    post = known.select("vec_id", "v", "ranks", F.col("near")[0].alias("pivot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    post = post.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.get(chunks, F.col("pivot"))).cast("int"))
    ask = known.where("q").select(F.col("vec_id").alias("query_id"), "v", "ranks", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode("near").alias("pivot"))
    ask = ask.where(F.get(chunks, F.col("pivot")) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("pivot")) - 1)))
    group = ["pivot", "chunk", "block"]
    found = ask.groupBy(*group).cogroup(post.groupBy(*group)).applyInPandas(lambda a, p: search(a, p, dim, k, keep), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
