"""Helpers that the corpus operators share: durable cuts of lineage, distributed prefix sums, components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"


def is_local(master: str) -> bool:
    """Driver and executors are one process; not so for local-cluster[...]."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows in a batch that Python workers get, where the session says nothing: texts of a few KB each, so a few MB.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS, where they are at Spark's default: batches of 10,000 texts
    take hundreds of MB beside the executors' heaps, as their buffers are doubled while they fill."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: for wide rows, which it keeps compressed and readable by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hands back what this worker has freed: workers are used again, and would keep it beside the executor's heap."""
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(fn: Callable) -> Callable:
    """``fn`` over a task's batches, with ``release`` at its end."""

    @functools.wraps(fn)
    def own(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return own


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one in (bucket, order) within its group.

    ``bucket`` spreads a group over many tasks (it must agree with the order): only one total per bucket
    meets the other buckets of its group. ``df`` is read twice, so it should be cut before.
    """
    base = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    totals = totals.select(group, bucket, F.coalesce(F.sum("_total").over(base), F.lit(0)).alias("_base"))
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(totals, [group, bucket]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the
    nodes; each round is cut. The least neighbours are a table of their own, so that Spark can split what the
    root of a large component, one key of both joins, brings to the other side. Only two numbers a round come
    to the driver. A graph that is still changing after ``max_rounds`` is an error.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        pairs = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components: the graph was still changing after {max_rounds} rounds")
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
