"""What an experiment's receipts say: whether its arms may be compared, what tells them apart, what lies outside its scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a receipt must tell of its renderer: names of its provenance.
RENDERER = ("sort_ordering", "renderer_source_sha256")
#: The grounds of refusal in order of precedence.
GROUNDS = (
    "duplicate_receipt", "duplicate_replicate", "missing_provenance", "renderer_mismatch", "missing_trainer", "trainer_mismatch",
    "scene_set_mismatch", "view_set_mismatch",
)
SCOPE = ("profile", "iterations", "seed", "holdout_every")


def _said(column: str, name: str) -> Column:
    """An entry of a map; null where it is missing or empty."""
    return F.nullif(F.try_element_at(F.col(column), F.lit(name)), F.lit(""))


def refusals(receipts: DataFrame, views: DataFrame, key: str = "experiment_id", fatal_renderer: bool = True, renderer: tuple[str, str] = RENDERER) -> DataFrame:
    """(key, place, reason, n) of every ground on which an experiment is refused; the least place is the reason given.

    receipts: (key, path, arm, scene, replicate, provenance map, trainer_sha256); views: (key, path, view_id), what a
    receipt has rows of. n counts what offends: paths, replicates or receipts; for mismatches the different values,
    the scenes that not all arms have, the views that not all runs of their scene have. Receipts of one path are
    one run to its views. Without ``fatal_renderer`` different renderers are no
    ground; ``renderer`` names the entries that tell of the order of drawing and of the renderer's source.
    """
    ordering, source = (_said("provenance", c) for c in renderer)
    own = receipts.select(key, "path", "arm", "scene", "replicate", "trainer_sha256", ordering.alias("_order"), source.alias("_source"))
    many = lambda *by: own.groupBy(key, *by).agg(F.count("*").alias("k")).where("k > 1").groupBy(key).agg(F.count("*").alias("n"))
    count = lambda what: F.count_if(what)
    whole = own.groupBy(key).agg(
        count(F.col("_order").isNull() | F.col("_source").isNull()).alias("missing_provenance"),
        F.greatest(F.count_distinct("_order"), F.count_distinct("_source")).alias("renderer_mismatch"),
        count(F.col("trainer_sha256").isNull()).alias("missing_trainer"),
        F.count_distinct("trainer_sha256").alias("trainer_mismatch"),
        F.count_distinct(F.coalesce("arm", F.lit("?"))).alias("arms"),
    )
    listed = [("missing_provenance", 0), ("missing_trainer", 0), ("trainer_mismatch", 1)] + ([("renderer_mismatch", 1)] if fatal_renderer else [])
    sums = whole.select(key, F.inline(F.array(*[F.struct(F.lit(reason).alias("reason"), F.col(reason).alias("n"), F.lit(most).alias("most")) for reason, most in listed])))
    out = sums.where("n > most").select(key, "reason", "n")
    scenes = own.select(key, "scene", F.coalesce("arm", F.lit("?")).alias("arm")).distinct().groupBy(key, "scene").agg(F.count("*").alias("k"))
    partial = scenes.join(whole.select(key, "arms"), key).where("k < arms").groupBy(key).agg(F.count("*").alias("n"))
    runs = own.select(key, "scene", "path").distinct()
    shared = runs.join(views.select(key, "path", "view_id").distinct(), [key, "path"]).groupBy(key, "scene", "view_id").agg(F.count("*").alias("k"))
    all_ = runs.groupBy(key, "scene").agg(F.count("*").alias("runs"))
    uneven = shared.join(all_, [key, "scene"]).where("k < runs").groupBy(key).agg(F.count("*").alias("n"))
    for reason, found in (("duplicate_receipt", many("path")), ("duplicate_replicate", many("arm", "scene", "replicate")), ("scene_set_mismatch", partial), ("view_set_mismatch", uneven)):
        out = out.unionByName(found.select(key, F.lit(reason).alias("reason"), "n"))
    place = F.array_position(F.array(*[F.lit(g) for g in GROUNDS]), F.col("reason")).cast("int")
    return out.select(key, place.alias("place"), "reason", "n")


def under_replicated(receipts: DataFrame, least: int, key: str = "experiment_id") -> DataFrame:
    """(key, arm, scene, n): arms of a scene with fewer runs; their numbers stand, but no verdict is given."""
    return receipts.groupBy(key, F.coalesce("arm", F.lit("?")).alias("arm"), "scene").agg(F.count("*").alias("n")).where(F.col("n") < least)


def arms_differ(receipts: DataFrame, key: str = "experiment_id") -> DataFrame:
    """(key, difference, names): what tells baseline and candidate apart: trainer binary, memory budget, environment (with
    the names whose values differ), or nothing.

    receipts: (key, arm, trainer_sha256, memory_budget_bytes, trainer_environment map). Arms differ where their runs'
    sets of values do; a variable that a run lacks is a value of its own. Rows of other arms don't count.
    """
    arms = ("baseline", "candidate")
    entries = F.array_sort(F.map_entries(F.coalesce("trainer_environment", F.create_map().cast("map<string,string>"))))
    own = receipts.where(F.col("arm").isin(*arms)).select(key, "arm", "trainer_sha256", "memory_budget_bytes", "trainer_environment", F.to_json(entries).alias("_all"))
    shown = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  a null is told from an empty text
    sets = lambda df, by, what: df.groupBy(*by).agg(*[F.array_sort(F.collect_set(F.when(F.col("arm") == a, what))).alias(a) for a in arms])
    apart = F.col("baseline") != F.col("candidate")
    out = None
    for name, c in (("trainer binary", "trainer_sha256"), ("memory budget", "memory_budget_bytes"), ("environment", "_all")):
        found = sets(own, [key], shown(c)).where(apart).select(key, F.lit(name).alias("difference"))
        out = found if out is None else out.unionByName(found)
    names = own.select(key, F.explode(F.map_keys("trainer_environment")).alias("name")).distinct()
    values = names.join(own, key).withColumn("value", F.try_element_at(F.col("trainer_environment"), F.col("name")))
    named = sets(values, [key, "name"], shown("value")).where(apart).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    out = out.join(named, key, "left").select(key, "difference", F.when(F.col("difference") == "environment", F.coalesce("names", F.lit(""))).alias("names"))
    alike = own.select(key).distinct().join(out, key, "left_anti").select(key, F.lit("nothing").alias("difference"), F.lit(None).cast("string").alias("names"))
    return out.unionByName(alike)


def out_of_scope(receipts: DataFrame, scope: dict, scenes: int, key: str = "experiment_id") -> DataFrame:
    """(key, path, problem): receipts that don't declare what they ran, or ran something else than ``scope`` allows, and
    experiments (path null) with fewer than ``scenes`` scenes. A field that is missing is out of scope, not exempt."""
    few = receipts.groupBy(key).agg(F.count_distinct("scene").alias("n")).where(F.col("n") < scenes)
    out = few.select(key, F.lit(None).cast("string").alias("path"), F.lit("scenes").alias("problem"))
    missing = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in SCOPE]
    other = [F.when(F.col(c) != F.lit(scope[c]), F.lit(f"other {c}")) for c in SCOPE]
    told = receipts.select(key, "path", F.explode(F.array_compact(F.array(*missing, *other))).alias("problem"))
    return out.unionByName(told)
