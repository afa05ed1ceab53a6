"""The subject of a splat scene: links between foreground splats, their components, and the choice of one.

All steps are joins and aggregates keyed by (scene, gaussian), so a large scene spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.operators import graph
from scenemill.operators.splats import LEAST_WEIGHT


def local_distance(neighbours: DataFrame, k: int = 16, key: str = "scene") -> DataFrame:
    """(scene, gaussian, local): median distance to the k neighbours; short lists are padded with the farthest."""
    at = lambda place: F.coalesce(F.max(F.when(F.col("place") == place, F.col("distance"))), F.max("distance"))
    return neighbours.groupBy(key, F.col("row_index").alias("gaussian")).agg(((at(k // 2) + at(k // 2 + 1)) / 2).alias("local"))


def work_views(reduced: DataFrame) -> DataFrame:
    """Observations that count: not held out, and visible enough."""
    return reduced.where(~F.col("held_out") & (F.col("visible") >= LEAST_WEIGHT))


def subject_edges(neighbours: DataFrame, reduced: DataFrame, classified: DataFrame, key: str = "scene") -> DataFrame:
    """(scene, a, b, distance, common, agree, against): linked foreground neighbours, a before b.

    Two splats are linked if they share two views or more and 60% of them agree, up to 2.5 times the larger
    local distance; or if both are surely foreground and no view contradicts, up to 1.5 times.
    """
    own = classified.where("kind = 'foreground'").select(key, "gaussian", "fg").join(local_distance(neighbours, key=key), [key, "gaussian"])
    end = lambda n: own.select(key, F.col("gaussian").alias(n), F.col("fg").alias(f"fg_{n}"), F.col("local").alias(f"local_{n}"))
    pairs = neighbours.select(key, F.least("row_index", "neighbour").alias("a"), F.greatest("row_index", "neighbour").alias("b"), "distance")
    pairs = pairs.groupBy(key, "a", "b").agg(F.min("distance").alias("distance")).join(end("a"), [key, "a"]).join(end("b"), [key, "b"])
    reach = F.greatest("local_a", "local_b")
    pairs = pairs.withColumn("_reach", reach).where(F.col("distance") <= 2.5 * F.col("_reach"))
    label = F.when(F.col("assigned"), F.col("label")).otherwise(0)
    seen = lambda n: work_views(reduced).select(key, "view_id", F.col("gaussian").alias(n), label.alias(f"l_{n}"))
    both = pairs.select(key, "a", "b").join(seen("a"), [key, "a"]).join(seen("b"), [key, "b", "view_id"])
    same, named = F.col("l_a") == F.col("l_b"), (F.col("l_a") != 0) & (F.col("l_b") != 0)
    counts = both.groupBy(key, "a", "b").agg(F.count("*").alias("common"), F.count_if(named & same).alias("agree"), F.count_if(named & ~same).alias("against"))
    out = pairs.join(counts, [key, "a", "b"], "left").fillna(0, ["common", "agree", "against"])
    shared = (F.col("common") >= 2) & (F.col("agree") >= 0.6 * F.col("common"))
    close = (F.col("fg_a") >= 0.8) & (F.col("fg_b") >= 0.8) & (F.col("against") == 0) & (F.col("distance") <= 1.5 * F.col("_reach"))
    return out.where(shared | close).select(key, "a", "b", "distance", "common", "agree", "against")


def rank_components(classified: DataFrame, edges: DataFrame, reduced: DataFrame, least: int = 64, share: float = 0.001, key: str = "scene") -> DataFrame:
    """(scene, component, size, retained, coverage, centrality, support, score, place): foreground components.

    A component is named by its smallest splat and needs ``least`` splats and ``share`` of the scene. Coverage
    is its share of the views, support its share of the foreground weight.
    """
    nodes = classified.where("kind = 'foreground'").select(key, F.col("gaussian").alias("node"))
    members = graph.components(nodes, edges, key).withColumnRenamed("node", "gaussian")
    sizes = members.groupBy(key, "root").agg(F.count("*").alias("size"))
    scenes = classified.groupBy(key).agg(F.count("*").alias("_n"))
    big = sizes.join(scenes, key).where((F.col("size") >= least) & (F.col("size") >= F.ceil(F.col("_n") * share)))
    views = reduced.where(~F.col("held_out"))
    totals = views.groupBy(key).agg(F.sum("foreground").alias("_fg"), F.count_distinct("view_id").alias("_views"))
    per = views.join(members, [key, "gaussian"]).groupBy(key, "root", "view_id").agg(
        F.sum("foreground").alias("f"), F.sum("visible").alias("v"), F.sum(F.col("centrality") * F.col("visible")).alias("c")
    )
    own = per.groupBy(key, "root").agg(F.count_if(F.col("f") >= LEAST_WEIGHT).alias("_seen"), F.sum("f").alias("f"), F.sum("v").alias("v"), F.sum("c").alias("c"))
    out = big.join(own, [key, "root"], "left").join(totals, key, "left")
    unit = lambda a, b: F.coalesce(F.when(b > 0, F.least(F.greatest(a / b, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))
    out = out.select(
        key, F.col("root").alias("component"), "size", (F.col("size") / F.col("_n")).alias("retained"), unit(F.col("_seen"), F.col("_views")).alias("coverage"),
        unit(F.col("c"), F.col("v")).alias("centrality"), unit(F.col("f"), F.col("_fg")).alias("support"),
    )
    # The weights of the score.
    out = out.withColumn("score", 0.5 * F.col("coverage") + 0.3 * F.col("centrality") + 0.2 * F.col("support"))
    order = W.partitionBy(key).orderBy(F.desc(F.round("score", 12)), F.desc("coverage"), "component")
    return out.withColumn("place", F.row_number().over(order))


def choose_subject(scenes: DataFrame, ranked: DataFrame, anchors: DataFrame | None = None, key: str = "scene") -> DataFrame:
    """(scene, component, lead, outcome): selected, ambiguous, or noSubject where nothing covers 30% of the views.

    anchors: (scene, component, weight) of a component that a user has pointed at; the heaviest wins. Without
    one the first needs 60% coverage, a lead of 0.15 and between 0.1% and 90% of the scene.
    """
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    best = ranked.groupBy(key).agg(
        *[first(c).alias(f"_{c}") for c in ("component", "coverage", "retained", "score")], F.max(F.when(F.col("place") == 2, F.col("score"))).alias("_second"), F.max("coverage").alias("_any")
    )
    out = scenes.select(key).distinct().join(best, key, "left").withColumn("lead", F.coalesce(F.round(F.col("_score") - F.col("_second"), 12), F.lit(1.0)))
    auto = (F.col("_coverage") >= 0.6) & (F.col("lead") >= 0.15) & F.col("_retained").between(0.001, 0.9)
    pointed = F.lit(None).cast(ranked.schema["component"].dataType)
    if anchors is not None:
        pick = F.max(F.struct("weight", (-F.col("component")).alias("n")))
        known = anchors.join(ranked.select(key, "component"), [key, "component"]).where("weight > 0").groupBy(key).agg((-pick["n"]).alias("_pointed"))
        out, pointed = out.join(known, key, "left"), F.col("_pointed")
    chosen = F.when(F.coalesce(F.col("_any"), F.lit(0.0)) >= 0.3, F.coalesce(pointed, F.when(auto, F.col("_component"))))
    out = out.withColumn("component", chosen)
    outcome = F.when(F.coalesce(F.col("_any"), F.lit(0.0)) < 0.3, "noSubject").when(F.col("component").isNull(), "ambiguous").otherwise("selected")
    return out.select(key, "component", "lead", outcome.alias("outcome"))
