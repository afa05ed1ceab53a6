"""Experiments: held-out splits, paired statistics, verdicts, gates and suite aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions import ranks, stats


def holdout(images: DataFrame, every: int, key: str = "scene", name: str = "name") -> DataFrame:
    """Adds ``held_out``: every n-th image by name within its scene, from the first on."""
    placed = ranks.number_rows(images, key, [name])
    return placed.withColumn("held_out", F.col("_i") % every == 0).drop("_i", "_n")


def sparse_views(images: DataFrame, k: int, every: int, key: str = "scene", name: str = "name") -> DataFrame:
    """(key, slot, name): k training images at even spacing, positions rounded half to even."""
    train = holdout(images, every, key, name).where("not held_out")
    placed = ranks.number_rows(train.select(key, name), key, [name]).withColumnsRenamed({"_i": "place", "_n": "n"})
    at = lambda s: F.bround(s * (F.col("n") - 1) / max(1, k - 1)).cast("int")
    slots = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: at(s) == F.col("place"))
    return placed.where(F.col("n") >= k).select(key, F.explode(slots).alias("slot"), name)


def _pooled(var_a: str, n_a: str, var_b: str, n_b: str) -> Column:
    part = lambda v, n: F.when(F.col(n) > 1, (F.col(n) - 1) * F.col(v)).otherwise(F.lit(0.0))
    free = F.col(n_a) + F.col(n_b) - 2
    return F.when(free > 0, F.sqrt((part(var_a, n_a) + part(var_b, n_b)) / free))


def _two_arms(values: DataFrame, keys: list[str]) -> DataFrame:
    arm = lambda a, x: F.when(F.col("arm") == a, x)
    v = F.col("value")
    return values.groupBy(*keys).agg(
        F.avg(arm("baseline", v)).alias("baseline"), F.avg(arm("candidate", v)).alias("candidate"),
        F.var_samp(arm("baseline", v)).alias("_va"), F.var_samp(arm("candidate", v)).alias("_vb"),
        F.count(arm("baseline", v)).alias("n_baseline"), F.count(arm("candidate", v)).alias("n_candidate"),
    ).where("n_baseline > 0 and n_candidate > 0")


def melt(run_views: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form: a row (metric, value) for each metric that is not null."""
    keys = [c for c in run_views.columns if c not in metrics]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return run_views.select(*keys, F.inline(pairs)).where("value is not null")


def melt_all(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """As ``melt``, with the rows of metrics that are null."""
    keys = [c for c in rows.columns if c not in metrics]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(*keys, F.inline(pairs))


def scene_stats(long: DataFrame) -> DataFrame:
    """Per scene and metric: arm means over runs, delta, pooled repeat SD, its standard error and |delta| / SD."""
    runs = long.groupBy("scene", "metric", "arm", "replicate").agg(F.avg("value").alias("value"))
    out = _two_arms(runs, ["scene", "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline"))
    out = out.withColumn("pooled_sd", _pooled("_va", "n_baseline", "_vb", "n_candidate"))
    return out.withColumn("delta_se", F.col("pooled_sd") * F.sqrt(1 / F.col("n_baseline") + 1 / F.col("n_candidate"))).withColumn(
        "sd_multiple", F.when(F.col("pooled_sd") > 0, F.abs("delta") / F.col("pooled_sd"))
    ).drop("_va", "_vb")


def view_stats(long: DataFrame) -> DataFrame:
    """Per scene, view and metric: mean delta, paired median delta and the SD of the veto.

    Runs pair by start time, if both arms have as many and their start times alternate; otherwise the paired
    median is null. The veto's SD is the larger of the view's pool and the scene's pool.
    """
    runs = long.select("scene", "arm", "replicate", "started_at").distinct()
    by_time = W.partitionBy("scene").orderBy("started_at", "arm")
    steps = runs.withColumn("_same", F.coalesce(F.lag("arm").over(by_time) == F.col("arm"), F.lit(False)))
    paired = steps.groupBy("scene").agg(
        (~F.bool_or("_same") & (F.count_if(F.col("arm") == "baseline") == F.count_if(F.col("arm") == "candidate"))
         & (F.count_if(F.col("started_at").isNull()) == 0)).alias("paired")
    )
    ranked = runs.withColumn("_k", F.row_number().over(W.partitionBy("scene", "arm").orderBy("started_at", "replicate")))
    keys = ["scene", "view_id", "metric"]
    out = _two_arms(long, keys).withColumn("_local", _pooled("_va", "n_baseline", "_vb", "n_candidate"))
    part = F.coalesce("_va", F.lit(0.0)) * (F.col("n_baseline") - 1) + F.coalesce("_vb", F.lit(0.0)) * (F.col("n_candidate") - 1)
    pool = out.groupBy("scene", "metric").agg((F.sqrt(F.sum(part) / F.nullif(F.sum(F.col("n_baseline") + F.col("n_candidate") - 2), F.lit(0)))).alias("_pool"))
    placed = long.join(ranked, ["scene", "arm", "replicate", "started_at"]).groupBy(*keys, "_k").agg(
        F.max(F.when(F.col("arm") == "baseline", F.col("value"))).alias("_a"), F.max(F.when(F.col("arm") == "candidate", F.col("value"))).alias("_b")
    )
    medians = placed.groupBy(*keys).agg(F.median(F.col("_b") - F.col("_a")).alias("_median"))
    out = out.join(pool, ["scene", "metric"]).join(medians, keys).join(paired, "scene")
    return out.select(
        *keys, "paired", (F.col("candidate") - F.col("baseline")).alias("mean_delta"), F.when(F.col("paired"), F.col("_median")).alias("paired_median_delta"),
        F.greatest(F.coalesce("_local", F.lit(0.0)), F.coalesce("_pool", F.lit(0.0))).alias("veto_sd"),
    )


def ab_verdict(scenes: DataFrame, views: DataFrame, contract: dict[str, float]) -> DataFrame:
    """One row: equal-weight medians over scenes, vetoes, whether the gate lets it advance, and the verdict.

    Contract keys: psnr_veto, ssim_veto, veto_multiple, lpips_gain, lpips_multiple, psnr_loss, ssim_loss.
    """
    pick = lambda m, c: F.median(F.when(F.col("metric") == m, F.col(c)))
    whole = scenes.agg(
        pick("psnr", "delta").alias("psnr"), pick("ssim", "delta").alias("ssim"), pick("lpips", "delta").alias("lpips"), pick("lpips", "sd_multiple").alias("lpips_multiple")
    )
    limit = F.when(F.col("metric") == "psnr", F.lit(-contract["psnr_veto"])).when(F.col("metric") == "ssim", F.lit(-contract["ssim_veto"]))
    past = F.col("paired_median_delta") < limit
    sure = F.abs("paired_median_delta") > F.lit(contract["veto_multiple"]) * F.col("veto_sd")
    vetoes = views.agg(
        F.count_if(past & (F.col("veto_sd") > 0) & sure).alias("vetoes"), F.count_if(past & (F.col("veto_sd") <= 0)).alias("veto_candidates")
    )
    gate = F.when(F.col("lpips").isNotNull(), (-F.col("lpips") >= contract["lpips_gain"]) & F.coalesce(F.col("lpips_multiple") >= contract["lpips_multiple"], F.lit(False)))
    keeps = (-F.col("psnr") <= contract["psnr_loss"]) & (-F.col("ssim") <= contract["ssim_loss"])
    verdict = (
        F.when(F.col("vetoes") > 0, "veto").when(F.col("psnr").isNull() | F.col("ssim").isNull() | F.col("advance").isNull(), "not_evaluable")
        .when(~F.col("advance"), "does_not_advance").when(keeps, "accept").otherwise("reject")
    )
    both = whole.withColumn("_k", F.lit(1)).join(vetoes.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return both.withColumn("advance", gate).withColumn("verdict", verdict)


def ab_tail(views: DataFrame) -> DataFrame:
    """Per metric: number of views, how many lose over 0.5 and 1, floor-index percentiles, the worst view."""
    places = ranks.percentiles(views, "metric", "mean_delta", {"p01": ("floor", 0.01), "p05": ("floor", 0.05), "p10": ("floor", 0.1)})
    counts = views.groupBy("metric").agg(
        F.count("*").alias("views"), F.count_if(F.col("mean_delta") < -0.5).alias("below_half"), F.count_if(F.col("mean_delta") < -1).alias("below_one"),
        F.min_by(F.concat_ws("/", "scene", "view_id"), F.struct("mean_delta", "scene", "view_id")).alias("worst"),
    )
    return counts.join(places, "metric", "left").select("metric", "views", "below_half", "below_one", "p01", "p05", "p10", "worst")


def worst_views(views: DataFrame, k: int = 10) -> DataFrame:
    """The k views of each metric that lose most; ties by scene and view."""
    order = W.partitionBy("metric").orderBy("mean_delta", "scene", "view_id")
    return views.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("metric", "place", "scene", "view_id", "mean_delta")


def ab_refusals(runs: DataFrame) -> DataFrame:
    """(scene, reason) of every ground on which a comparison is refused, in order of precedence.

    runs: one row for each run and view (scene, arm, replicate, started_at, view_id).
    """
    dup = runs.groupBy("scene", "arm", "replicate", "view_id").count().where("count > 1").select("scene", F.lit("1 duplicate_replicate").alias("reason"))
    sets = runs.groupBy("scene", "arm", "replicate").agg(F.array_sort(F.collect_set("view_id")).alias("views"))
    differ = sets.groupBy("scene").agg(F.count_distinct("views").alias("n")).where("n > 1").select("scene", F.lit("3 view_sets_differ").alias("reason"))
    arms = runs.groupBy("scene").agg(F.count_distinct("arm").alias("n")).where("n < 2").select("scene", F.lit("2 scene_sets_differ").alias("reason"))
    few = runs.groupBy("scene", "arm").agg(F.count_distinct("replicate").alias("n")).where("n < 2").select("scene", F.lit("4 under_replicated").alias("reason"))
    return dup.unionByName(arms).unionByName(differ).unionByName(few).distinct()


def suite_performance(results: DataFrame) -> DataFrame:
    """Per category and over all: geometric mean and median of speed-ups, rows of ordered traits."""
    mean = F.exp(F.avg(F.log("speedup")))
    return results.rollup("category").agg(
        mean.alias("geo_mean"), stats.middle("speedup").alias("median"), F.count_if(F.col("trait") == "ordered").alias("ordered"), F.count("*").alias("scenes")
    ).withColumn("category", F.coalesce("category", F.lit("all")))


def suite_quality(results: DataFrame, limit: float) -> DataFrame:
    """Median residual over all and by category, from one pass over grouping sets, against a limit."""
    med = results.groupingSets([[], ["category"]], "category").agg(stats.middle("residual").alias("median"), F.count("residual").alias("n"))
    state = F.when(F.col("n") == 0, "blocked").when(F.col("median") <= limit, "passed").otherwise("failed")
    return med.select(F.coalesce("category", F.lit("all")).alias("category"), "median", "n", state.alias("status"))


def suite_summary(results: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(count("passed"), count("failed"), count("blocked"), F.exp(F.avg(F.log("wall"))).alias("geo_mean_wall"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(scene_id, status, reasons): a missing metric blocks, a bad value fails, and failure wins. A value that is
    no finite number is a bad one.

    metrics: (scene_id, metric, value); thresholds: (metric, low, high), few rows, either bound null.
    """
    seen = metrics.join(thresholds, "metric")  # Spark broadcasts the limits where they are few
    bad = seen.where("value is null or isnan(value) or value < low or value > high").select(
        "scene_id", F.when(F.col("value").isNull(), F.concat(F.lit("missing "), "metric")).otherwise(F.concat(F.lit("out of range "), "metric")).alias("reason"), F.col("value").isNull().alias("missing")
    )
    found = bad.groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"), F.bool_and("missing").alias("only_missing"))
    scenes = metrics.select("scene_id").distinct()
    status = F.when(F.col("reasons").isNull(), "passed").when(F.col("only_missing"), "blocked").otherwise("failed")
    return scenes.join(found, "scene_id", "left").select("scene_id", status.alias("status"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def isolation_gate(captures: DataFrame, large: int = 500_000) -> DataFrame:
    """One row: enough captures, none wrong, quality percentiles and times of captures up to ``large`` splats."""
    own = captures.select("wrong", "iou", "f1", F.when(F.col("gaussians") <= large, F.col("seconds")).alias("seconds"), F.lit(0).alias("_all"))
    sums = own.groupBy("_all").agg(F.count("*").alias("captures"), F.count_if("wrong").alias("wrong"), F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1"))
    shares = ranks.percentiles(own, "_all", "iou", {"p10_iou": ("linear", 0.1)})
    times = ranks.percentiles(own, "_all", "seconds", {"p50_seconds": ("linear", 0.5), "p95_seconds": ("linear", 0.95)})
    out = sums.join(shares, "_all", "left").join(times, "_all", "left").select("captures", "wrong", "mean_iou", "p10_iou", "mean_f1", "p50_seconds", "p95_seconds")
    # The release limits.
    ok = (F.col("captures") >= 15) & (F.col("wrong") == 0) & (F.col("mean_iou") >= 0.80) & (F.col("p10_iou") >= 0.65) & (F.col("mean_f1") >= 0.75) & (F.col("p50_seconds") <= 15) & (F.col("p95_seconds") <= 30)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def leaderboard(per_scene: DataFrame, subset: list[str]) -> DataFrame:
    """Means over all scenes and over a subset, for each method and metric."""
    return per_scene.groupBy("method", "metric").agg(
        F.avg("value").alias("mean_all"), F.avg(F.when(F.col("scene").isin(subset), F.col("value"))).alias("mean_subset"), F.count("*").alias("scenes")
    )


def edge_jaccard(edges: DataFrame, canonical: str) -> DataFrame:
    """(variant, common, jaccard) of each variant's distinct edges (variant, a, b) against the canonical's."""
    own = edges.select("variant", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    base = own.where(F.col("variant") == canonical).select("a", "b", F.lit(1).alias("_hit"))
    size = base.agg(F.count("*").alias("_base"))
    counts = own.join(base, ["a", "b"], "left").groupBy("variant").agg(F.count("*").alias("edges"), F.count("_hit").alias("common"))
    both = counts.withColumn("_k", F.lit(1)).join(size.withColumn("_k", F.lit(1)), "_k")  # one row
    return both.select("variant", "edges", "common", (F.col("common") / (F.col("edges") + F.col("_base") - F.col("common"))).alias("jaccard"))


def compare_trials(trials: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(scene, trial, losses and deltas, reasons, accepted): candidate against reference trials of one scene.

    trials: one row for each (scene, trial, arm) with registered_views, point_count, observation_count,
    median_residual, p90_residual and conditioned. limits: view_loss, view_loss_share, point_loss,
    observation_loss, median_delta, p90_delta, median_residual and p90_residual.
    """
    facts = ["registered_views", "point_count", "observation_count", "median_residual", "p90_residual", "conditioned"]
    arm = lambda name, tag: trials.where(F.col("arm") == name).select("scene", "trial", *[F.col(c).alias(f"{tag}_{c}") for c in facts])
    both = arm("reference", "r").join(arm("candidate", "c"), ["scene", "trial"])
    short = lambda c: F.greatest(F.lit(0.0), (F.col(f"r_{c}") - F.col(f"c_{c}")).cast("double"))
    over = lambda c: F.greatest(F.lit(0.0), F.col(f"c_{c}") - F.col(f"r_{c}"))
    both = both.withColumns({
        "view_loss": short("registered_views"), "point_loss": short("point_count") / F.col("r_point_count"), "observation_loss": short("observation_count") / F.col("r_observation_count"),
        "median_delta": over("median_residual"), "p90_delta": over("p90_residual"),
    })
    views = F.least(F.lit(float(limits["view_loss"])), F.col("r_registered_views") * limits["view_loss_share"])
    tests = [("conditioning", ~(F.col("r_conditioned") & F.col("c_conditioned"))), ("view_loss", F.col("view_loss") > views + 1e-12)]
    tests += [(c, F.col(c) > limits[c] + 1e-12) for c in ("point_loss", "observation_loss", "median_delta", "p90_delta")]
    tests += [(c, F.col(f"c_{c}") > limits[c]) for c in ("median_residual", "p90_residual")]
    reasons = F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in tests])
    out = both.withColumn("reasons", reasons).withColumn("accepted", F.col("reasons") == "")
    return out.select("scene", "trial", "view_loss", "point_loss", "observation_loss", "median_delta", "p90_delta", "reasons", "accepted")


def trial_medians(trials: DataFrame, value: str, count: int = 4) -> DataFrame:
    """(scene, arm, trials, median): median of ``value``; null unless an arm has exactly ``count`` trials."""
    out = trials.groupBy("scene", "arm").agg(F.count("*").alias("trials"), F.median(value).alias("median"))
    return out.withColumn("median", F.when(F.col("trials") == count, F.col("median")))


def merge_lanes(records: DataFrame, lanes: list[str]) -> DataFrame:
    """(scene_id, scale, status): invalid, failed, blocked, or gated, when the gates decide.

    records: (scene_id, scale, lane, kind, digest). Each lane must be there exactly once, a scene has one input
    digest and no two scenes share one. An execution failure outweighs rejected and infrastructure records.
    """
    spread = records.groupBy("scene_id").agg(F.count_distinct("digest").alias("_digests"))
    shared = records.groupBy("digest").agg(F.count_distinct("scene_id").alias("n")).where("n > 1")
    taken = records.join(shared, "digest", "left_semi").select("scene_id").distinct().withColumn("_shared", F.lit(True))
    known = F.col("lane").isin(lanes)
    own = records.groupBy("scene_id", "scale").agg(
        F.count("*").alias("_n"), F.count_distinct(F.when(known, F.col("lane"))).alias("_lanes"),
        F.bool_or(F.col("kind") == "execution_failed").alias("_failed"), F.bool_or(F.col("kind").isin("rejected", "infrastructure")).alias("_blocked"),
    )
    out = own.join(spread, "scene_id").join(taken, "scene_id", "left")
    bad = (F.col("_n") != len(lanes)) | (F.col("_lanes") != len(lanes)) | (F.col("_digests") != 1) | F.col("_shared").isNotNull()
    status = F.when(bad, "invalid").when(F.col("_failed"), "failed").when(F.col("_blocked"), "blocked").otherwise("gated")
    return out.select("scene_id", "scale", status.alias("status"))


def image_metrics(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """Replaces ``render`` and ``truth`` (arrays of height * width * 3 numbers from 0 to 1) by psnr and ssim.

    PSNR of equal images is infinite. SSIM is the mean over channels and pixels with an 11 by 11 Gaussian of
    sigma 1.5, padded with zeros.
    """
    import numpy as np
    import pandas as pd

    at = np.arange(11) - 5
    line = np.exp(-(at**2) / (2 * 1.5**2))
    line = line / line.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            edge = [(0, 0)] * x.ndim
            edge[axis] = (5, 5)
            padded = np.pad(x, edge)
            x = sum(w * np.take(padded, np.arange(k, k + x.shape[axis]), axis) for k, w in enumerate(line))
        return x

    def fn(batches):
        for b in batches:
            rows = []
            for one, other in zip(b["render"], b["truth"], strict=True):
                x, y = (np.asarray(i, float).reshape(height, width, 3) for i in (one, other))
                error = float(((x - y) ** 2).mean())
                mx, my = blur(x), blur(y)
                vx, vy, both = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
                near = (2 * mx * my + 0.01**2) * (2 * both + 0.03**2) / ((mx * mx + my * my + 0.01**2) * (vx + vy + 0.03**2))
                rows.append((float("inf") if error == 0 else -10 * float(np.log10(error)), float(near.mean())))
            yield pd.concat([b.drop(columns=["render", "truth"]).reset_index(drop=True), pd.DataFrame(rows, columns=["psnr", "ssim"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("render", "truth"))
    return pairs.mapInPandas(fn, f"{kept}, psnr double, ssim double")


def invalid_scene(runs: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason`` to runs over scenes that must fail.

    runs: (exit_code, termination_reason, cancelled, failure_type, corrupt_ply, expected_failure). Without whole
    evidence a run is blocked; one that succeeds, was cancelled, fails in another way or leaves a corrupt file
    has failed; the others passed. Several reasons are joined by "; ".
    """
    failed = F.array_compact(F.array(
        F.when(~F.col("failure_type").eqNullSafe(F.col("expected_failure")), "wrong failure type"), F.when(F.col("corrupt_ply"), "corrupt output"),
    ))
    known = F.col("termination_reason").isin("exit", "signal", "cancelled")
    reason = (
        F.when(F.col("exit_code").isNull(), "no exit code").when(F.col("exit_code") == 0, "unexpected success").when(F.col("cancelled"), "cancelled")
        .when(F.coalesce(F.trim("failure_type"), F.lit("")) == "", "no failure type").when(F.col("corrupt_ply").isNull() | F.col("cancelled").isNull(), "no output evidence")
        .when(~F.coalesce(known, F.lit(False)), "no termination reason").otherwise(F.array_join(failed, "; "))
    )
    blocked = F.col("reason").isin("no exit code", "no failure type", "no output evidence", "no termination reason")
    return runs.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "passed").when(blocked, "blocked").otherwise("failed"))
