"""Row numbers and percentiles of groups of any size: range-sorted, counted by range, added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions.storage import cut, kept


def _ranges(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` range-sorted and kept, with the number of its range as ``_range``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))


def _add_up(rows: DataFrame, keys: list[str], order: list, value: Column, name: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before in their group as ``name``, and over all as ``total``.

    Only one number for each range and group meets the others of its group."""
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(W.partitionBy(*keys)).alias(total))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, [*keys, "_range"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in")


def number_rows(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """Adds ``_i``, the place of a row in its group from 0 on, and ``_n``, the group's rows.

    ``order`` should tell rows apart; groups are spread over ranges of it, so none has to fit one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return _add_up(_ranges(df, keys, order), keys, order, F.lit(1).cast("long"), "_i", "_n")


def percentiles(df: DataFrame, key: str | list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, one column for each name of ``wanted``): exact percentiles of the values that are not null.

    wanted: name -> (definition, p) with the definitions ``rank`` (sorted[ceil(p n) - 1]), ``floor``
    (sorted[min(n - 1, floor(p n))]), ``linear`` (interpolated at (n - 1) p) and ``middle`` (as linear at 0.5). Equal values are counted before the shuffle
    and the distinct ones spread over ranges, so a dominant group needs no buffer of its own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    rows = _add_up(_ranges(counts, keys, [value]), keys, [value], F.col("_k"), "_i", "_n")

    return _picked(rows, keys, value, wanted)


def _place(how: str, p: float) -> Column:
    """The place, from 0 on, of ``rank`` and ``floor``; of the others the spot, which may lie between two places."""
    if how == "rank":
        return F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1)) - 1
    return F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))) if how == "floor" else (F.col("_n") - 1) * F.lit(0.5 if how == "middle" else p)


def _picked(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The percentiles, from distinct values with their times ``_k``, the rows before them ``_i`` and all rows ``_n``."""

    def at(place: Column) -> Column:
        """The value at a place from 0 on."""
        return F.max(F.when((F.col("_i") <= place) & (place < F.col("_i") + F.col("_k")), F.col(value)))

    found, out = [], []
    for name, (how, p) in wanted.items():
        if how in ("rank", "floor"):
            found.append(at(_place(how, p)).alias(name))
            out.append(F.col(name))
            continue
        spot = _place(how, p)
        low = F.floor(spot)
        found += [at(low).alias(f"_low_{name}"), at(F.ceil(spot)).alias(f"_high_{name}"), F.first(spot - low).alias(f"_part_{name}")]
        a, b, part = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_part_{name}")
        out.append(F.when(part == 0, a.cast("double")).otherwise((1 - part) * a + part * b).alias(name))
    return rows.groupBy(*keys).agg(*found).select(*keys, *out)


def _span(value: str) -> Column:
    """A number that never falls where the value rises: 128 to a doubling, whole numbers that few rows need."""
    v = F.col(value).cast("double")
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * 128).cast("long") + 200_000
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -size).otherwise(size)


def percentiles_twice(df: DataFrame, key: str | list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """As ``percentiles``, for numbers that are mostly distinct and rows that are cheap to read twice, as kept ones are.

    Rows are counted by spans of their values first; then only those in a span that holds a wanted place are sorted, so
    neither all rows nor all distinct values are shuffled. Still exact: where all are in one span, all are sorted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = df.where(F.col(value).isNotNull()).select(*keys, value, _span(value).alias("_span"))
    sums = own.groupBy(*keys, "_span").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_span"))
    sums = sums.withColumns({"_before": upto - F.col("_c"), "_n": F.sum("_c").over(W.partitionBy(*keys))})
    held = F.lit(False)
    for how, p in wanted.values():
        spot = _place(how, p)
        for place in (F.floor(spot), F.ceil(spot)):
            held = held | ((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")))
    spans = kept(sums.where(held).select(*keys, "_span", "_before", "_n"))
    counts = own.join(spans.select(*keys, "_span"), [*keys, "_span"]).groupBy(*keys, "_span", value).agg(F.count("*").alias("_k"))
    group = [*keys, "_span"]
    rows = _add_up(_ranges(counts, group, [value]), group, [value], F.col("_k"), "_i", "_in_span").join(spans, group)
    return _picked(rows.withColumn("_i", F.col("_i") + F.col("_before")), keys, value, wanted)


def percentiles_of(df: DataFrame, key: str, wanted: dict[str, dict[str, tuple[str, float]]]) -> DataFrame:
    """As ``percentiles`` of several columns at once: column -> name -> (definition, p); each column's values are rows of
    one table, which is sorted and counted once. Every column has the names of the first one."""
    columns = list(wanted)
    kinds = wanted[columns[0]]
    rows = df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])))
    found = percentiles(rows, [key, "_column"], "_value", kinds)
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_column") == c, F.col(k))).alias(name) for c in columns for k, name in zip(kinds, wanted[c], strict=True)])


def even_positions(n: Column, i: Column, limit: int) -> Column:
    """Whether place i of n is one of ``limit`` even positions, rounded half away from zero."""
    step = (n - 1) / F.lit(float(max(1, limit - 1)))
    slot = F.round(i / step)  # the only slots that can fall on this place are this one and its neighbours
    hit = n <= limit
    for k in (-1, 0, 1):
        hit = hit | ((slot + k >= 0) & (slot + k <= limit - 1) & (F.round((slot + k) * step) == i))
    return hit


def names(wanted: Sequence[float]) -> dict[str, tuple[str, float]]:
    """Nearest-rank percentiles named p10, p50 and so on."""
    return {f"p{round(100 * p)}": ("rank", p) for p in wanted}
