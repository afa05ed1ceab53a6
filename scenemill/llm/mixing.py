"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Rows are range-sorted by source and key, equal rows by a number of their
own, so that neither a hot source nor a hot id stays in one range. The word counts before a document in its
source are its range's base (a prefix sum over the ranges' totals) plus those before it in the range. A source's budget is its whole epochs
and a remainder; the remainder is cut exactly at that many words, inside a document where need be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, n_words, prefix_sums, table


def source_targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source_key, source_size), one row for each source.

    Sources in the order of source_key weigh ``weights``, repeating. ``share`` of all sizes is shared out by
    weight; no source gets over ``most`` times its size, and the excess goes to the others by weight until
    none is above. That ends at one level: sources whose cap per weight is lowest are full, the others get
    level * weight. There is a row for each source here, so these windows see no documents.
    """
    everything = W.partitionBy(F.lit(0))
    ordered = everything.orderBy("source_key")
    listed = sources.withColumn("_i", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_cap = everything.orderBy(F.col("_cap") / F.col("_w"), "source_key")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    upto = by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)
    goal = F.sum("source_size").over(everything) * F.lit(float(share))
    left = goal - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weigh = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    levelled = listed.withColumn("_level", left / weigh)
    full = F.col("_cap") / F.col("_w") <= F.col("_level")
    level = F.min(F.when(~full, F.struct(F.col("_cap") / F.col("_w"), "source_key", "_level"))).over(everything)["_level"]
    levelled = levelled.withColumn("_open", full).withColumn("_final", level)
    return levelled.withColumn(
        "target", F.when(F.col("_open") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.col("_final") * F.col("_w"))
    ).drop("_i", "_w", "_cap", "_level", "_open", "_final")


def _source_key(source: Column) -> Column:
    """Orders by code point, null last, and tells null from an empty name."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the blanks before them."""
    word_ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, word_ends), 1, n.cast("int")), "")


def budget(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    whole_rows: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, partial, taken) for each row of ``docs``.

    size: words of the text (null, empty: 0). epochs: times the whole text is taken; partial: words of it
    taken once more; taken = epochs * size + partial. A null id has the key of an empty id. Rows with one
    id are ordered by size and text hash; equal rows are interchangeable. The words taken of a source are
    floor(target), all 0 for a source without words. The table of sources (names, not documents) is levelled in
    one task. An empty table gives an empty result. ``whole_rows`` adds the row of ``docs`` as the struct ``row``.
    """
    text = F.col(text_col).cast("string")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    order = ["_key", "size", "_tie", "_own"]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("source_key"),
        n_words(text).alias("size"), key.alias("_key"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_own"),
        *([F.struct(*docs.columns).alias("row")] if whole_rows else []),
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, "source_key", *order).withColumn("_bucket", F.spark_partition_id())
    rows = table(rows) if whole_rows else cut(rows)  # the ranges are fixed from here on
    sources = source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most)
    placed = prefix_sums(rows, "source_key", "_bucket", order, "size", "_before")
    placed = placed.join(sources, "source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("epochs", epochs.cast("long"))
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("_before")
    placed = placed.withColumn("partial", F.greatest(F.lit(0), F.least(rest, F.col("size"))).cast("long"))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("partial")).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "partial", "taken", *(["row"] if whole_rows else [])
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each time that a text is taken.

    The row that crosses its source's budget holds its first words only, and its n_chars, where there is
    such a column, follows. Documents that are not taken go. Options are those of ``budget``.
    """
    rows = budget(docs, id_col=id_col, source_col=source_col, text_col=text_col, whole_rows=True, **options)
    words = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(F.col("partial") > 0, F.array("partial")).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.where("taken > 0").select("row", "size", F.explode(words).alias("_words"))
    text = F.col("row")[text_col]
    head = F.when(F.col("_words") >= F.col("size"), text).otherwise(first_words(text, F.col("_words")))
    rows = rows.withColumn("_head", head)
    new = {text_col: F.col("_head"), "n_chars": F.length("_head").cast("long")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
