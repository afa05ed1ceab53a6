"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash. It starts as one bucket; a bucket over the byte
limit, and only such a one, splits on its next bit. So a document's shard is the shortest prefix of its
hash whose bucket fits. Byte counts are summed once for each step of ``STEP`` bits, over what is not placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

STEP, MOST_BITS = 8, 48
#: Equal rows that a task numbers at most.
COPIES = 10_000


def bits_of(key: Column) -> Column:
    """The first 48 bits of the key's MD5, as text."""
    number = F.conv(F.substring(F.md5(key), 1, 12), 16, 2)
    return F.lpad(number, MOST_BITS, "0")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, from 0 on among equal rows. These are counted first, and written anew in parts of COPIES."""
    counts = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    few = counts.where(F.col("n") <= COPIES).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    parts = counts.where(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    parts = parts.repartition(*rows.columns, "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    many = parts.withColumn("number", F.explode(F.sequence(F.col("part") * COPIES, last)))
    return few.drop("n").unionByName(many.drop("n", "part"))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, shard_bytes, fits) of each row.

    shard: the bits of its bucket ("" if all fits in one). Null texts have 0 bytes, a null id the key of an
    empty one. Rows of one id, which its 48 bits can't tell apart, go on with 48 bits of their own (of the text
    and, for rows equal in id and text, a number from 0 on) where each of them fits, so reruns agree. Where one row is over the limit by itself, its bucket ends
    after the id's 48 bits with fits = false. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("bytes"), bits_of(key).alias("id_bits"), text.alias("text"))
    rows = numbered(rows)
    rows = cut(rows.select("doc_id", "bytes", F.concat("id_bits", bits_of(F.concat_ws(" ", "text", "number"))).alias("bits")))
    end = 2 * MOST_BITS
    first = F.substring("bits", 1, MOST_BITS).alias("bits")
    open_, found = rows.groupBy(first).agg(F.sum("bytes").alias("b"), F.max("bytes").alias("top")), None
    for low in range(0, end, STEP):
        high = low + STEP
        # a row for each prefix of up to `high` bits, then one for each of its own prefixes
        folded = open_.groupBy(F.expr(f"substring(bits, 1, {high})").alias("p")).agg(F.sum("b").alias("b"), F.max("top").alias("top"))
        closing = high in (MOST_BITS, end)  # the last bits of the id, and of the row
        depths = range(low, high + closing)
        levels = folded.select(F.explode(F.array(*[F.substring("p", 1, d) for d in depths])).alias("shard"), "b", "top")
        sums = levels.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.max("top").alias("top"))
        parent = sums.select(F.col("shard").alias("_up"), F.col("shard_bytes").alias("_up_bytes"))
        ends = (F.length("shard") == end) | ((F.length("shard") == MOST_BITS) & (F.col("top") > limit))
        small = sums.where((F.col("shard_bytes") <= limit) | ends).withColumn("_len", F.length("shard"))
        small = small.withColumn("_up", F.expr("substring(shard, 1, greatest(_len - 1, 0))"))
        # a bucket of the directory: it fits, and the bucket that it was split from does not; the bucket of
        # `low` bits is here a second time, and over the limit, if its own step closed
        again = (F.col("_len") == low) if low != MOST_BITS else F.lit(False)
        fits = small.join(parent, "_up", "left").where(again | (F.col("_up_bytes") > limit))
        fits = cut(fits.select("shard", "shard_bytes", "_len"))
        found = fits if found is None else found.unionByName(fits)
        if high == end:
            break
        last = high if closing else high - 1
        over = cut(sums.where((F.col("shard_bytes") > limit) & (F.length("shard") == last) & ((F.lit(last) != MOST_BITS) | (F.col("top") <= limit))).select("shard"))
        if over.isEmpty():
            break
        if closing:
            open_ = rows.groupBy("bits").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("top"))
        open_ = open_.join(over, F.expr(f"substring(bits, 1, {last})") == F.col("shard"), "left_semi")
    lengths = sorted(r["_len"] for r in found.select("_len").distinct().collect())  # at most 97
    prefixes = F.array(*[F.substring("bits", 1, int(n)) for n in lengths or [0]])
    placed = rows.withColumn("shard", F.explode(prefixes)).join(found, "shard")  # one match for each row
    return placed.select("doc_id", "bytes", "shard", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))
