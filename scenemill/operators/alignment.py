"""Alignment of camera poses: oriented similarity, moved poses, checks of rotations, anchors, deviation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemill.functions import geometry, ranks
from scenemill.functions.storage import cut
from scenemill.operators.models import LARGEST, MOST_ERROR, SMALLEST, estimate_sim3
from scenemill.operators.orientation import turning

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def _matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ], 1).reshape(-1, 3, 3)


def _turned_sums(key: str):
    """Of each key's moments its rotation: the proper one nearest to the sum of all views', turned on so that the longest
    baseline of the sources points as that of the targets does."""

    def fn(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                u, _, vt = np.linalg.svd(np.array([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)]))
                mean = u @ np.diag([1.0, 1.0, np.linalg.det(u @ vt)]) @ vt
                here, there = (np.array([r[p + c] for c in "xyz"]) for p in ("bs", "bd"))
                here = mean @ here
                q = turning(here / np.linalg.norm(here), there / np.linalg.norm(there))
                out.append((r[key], (_matrices(np.array([q]))[0] @ mean).reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=[key, "rotation"])

    return fn


def estimate_oriented_sim3(matched: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, n, scale, rotation, translation, rmse, status) from two common views on, by their rotations too.

    The rotation is the chordal mean, turned on along the longest baseline; the scale is the median of the ratios of
    baselines (over 1e-8) between all pairs of a key's views, the translation the median over views, axis by axis;
    rmse is relative to the targets' spread. matched: (key, image_id, s and d each before the names of a pose), image
    ids unique in a key. status: ok, unavailable (fewer than two views), no_baseline, implausible_scale, poor_fit.

    Sums, ratios and residuals are rows and aggregates, so a window's views need not be in one task; its pairs are as
    many rows as half the square of its views. Only moments and one baseline a key meet Python.
    """
    parts = []
    for p in "sd":
        size = F.sqrt(sum((F.col(p + c) * F.col(p + c) for c in POSE[:4]), F.lit(0.0)))
        rows = geometry.rotation(*[F.col(p + c) / size for c in POSE[:4]])
        centre = geometry.centre(rows, tuple(F.col(p + c) for c in POSE[4:]))
        parts.append((rows, {f"{p}{c}": centre[i] for i, c in enumerate("xyz")}))
    (rs, cs), (rd, cd) = parts
    product = {f"m{i}{j}": sum((rd[n][i] * rs[n][j] for n in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)}
    own = cut(matched.select(key, "image_id", *[v.alias(k) for k, v in (product | cs | cd).items()]))
    sums = own.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in product])
    side = lambda n: own.select(key, F.col("image_id").alias(n), *[F.col(p + c).alias(n + p + c) for p in "sd" for c in "xyz"])
    long = lambda p: F.sqrt(sum(((F.col(f"b{p}{c}") - F.col(f"a{p}{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    pairs = side("a").join(side("b"), key).where("a < b").withColumns({"_s": long("s"), "_d": long("d")}).where("_s > 1e-8 and _d > 1e-8")
    pairs = cut(pairs.select(key, "a", "b", "_s", (F.col("_d") / F.col("_s")).alias("_ratio"), *[(F.col(f"b{p}{c}") - F.col(f"a{p}{c}")).alias(f"b{p}{c}") for p in "sd" for c in "xyz"]))
    scale = ranks.percentiles(pairs, key, "_ratio", {"scale": ("middle", 0.5)})
    base = pairs.groupBy(key).agg(F.max_by(F.struct(*[f"b{p}{c}" for p in "sd" for c in "xyz"]), F.struct("_s", -F.col("a"), -F.col("b"))).alias("_b")).select(key, "_b.*")
    fit = cut(sums.join(base, key).mapInPandas(_turned_sums(key), f"{key} long, rotation array<double>").join(scale, key))
    r = lambda i: tuple(F.get("rotation", F.lit(3 * i + j)) for j in range(3))
    turned = [F.col("scale") * geometry.dot(r(i), tuple(F.col("s" + c) for c in "xyz")) for i in range(3)]
    moved = cut(own.join(fit, key).select(key, *[turned[i].alias(f"_t{c}") for i, c in enumerate("xyz")], "dx", "dy", "dz"))
    gaps = moved.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_axis"), (F.col("d" + c) - F.col("_t" + c)).alias("_gap")) for i, c in enumerate("xyz")])))
    shift = ranks.percentiles(gaps, [key, "_axis"], "_gap", {"_at": ("middle", 0.5)}).groupBy(key)
    shift = shift.agg(F.transform(F.array_sort(F.collect_list(F.struct("_axis", "_at"))), lambda x: x["_at"]).alias("translation"))  # three numbers
    off = sum(((F.col("_t" + c) + F.get("translation", F.lit(i)) - F.col("d" + c)) ** 2 for i, c in enumerate("xyz")), F.lit(0.0))
    spread = sum((F.var_pop("d" + c) for c in "xyz"), F.lit(0.0))
    error = moved.join(shift, key).groupBy(key).agg((F.sqrt(F.avg(off)) / F.greatest(F.sqrt(spread), F.lit(np.finfo(float).eps))).alias("rmse"))
    out = sums.select(key, "n").join(fit, key, "left").join(shift, key, "left").join(error, key, "left")
    wrong = F.when(F.col("n") < 2, "unavailable").when(F.col("scale").isNull(), "no_baseline").when(~F.col("scale").between(SMALLEST, LARGEST), "implausible_scale")
    out = out.withColumn("status", wrong.when(F.col("rmse") > MOST_ERROR, "poor_fit").otherwise("ok"))
    known = F.col("status").isin("ok", "poor_fit")
    return out.select(key, "n", *[F.when(known, F.col(c)).alias(c) for c in ("scale", "rotation", "translation", "rmse")], "status")


def align_poses(poses: DataFrame, sim3: DataFrame, key: str = "model_id") -> DataFrame:
    """Poses (key, q*, t*) moved by the similarity of their key; those without one stay."""
    own = poses.join(sim3.where("status = 'ok'").select(key, "scale", "rotation", "translation"), key, "left")
    s = lambda i, j: F.get("rotation", F.lit(3 * i + j))
    rows = geometry.rotation(*[F.col(c) for c in POSE[:4]])
    centre = geometry.centre(rows, tuple(F.col(c) for c in POSE[4:]))
    # in steps: each column is used several times by the next ones
    turned = {f"_r{i}{j}": geometry.dot(rows[i], (s(j, 0), s(j, 1), s(j, 2))) for i in range(3) for j in range(3)}
    moved = {f"_c{i}": F.col("scale") * geometry.dot((s(i, 0), s(i, 1), s(i, 2)), centre) + F.get("translation", F.lit(i)) for i in range(3)}
    own = own.withColumns(turned | moved)
    r = tuple(tuple(F.col(f"_r{i}{j}") for j in range(3)) for i in range(3))
    own = own.withColumn("_q", geometry.quaternion(r))
    new = {c: F.get("_q", F.lit(i)) for i, c in enumerate(POSE[:4])} | {c: -geometry.dot(r[i], tuple(F.col(f"_c{k}") for k in range(3))) for i, c in enumerate(POSE[4:])}
    return own.select(*[F.when(F.col("scale").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in poses.columns])


def _turn(a: str, b: str):
    """Degrees between the rotations of two unit quaternions, by their column prefixes."""
    dot = sum((F.col(a + c) * F.col(b + c) for c in POSE[:4]), F.lit(0.0))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot))))


def check_rotations(aligned: DataFrame, accepted: DataFrame, key: str = "window_id", most: float = 15.0) -> DataFrame:
    """(key, views, worst, ok): the largest angle between both rotations of a common view, at most ``most``.

    Both: (key, image_id, qw, qx, qy, qz), unit quaternions. Fewer than two common views are not ok.
    """
    other = accepted.select(key, "image_id", *[F.col(c).alias("o" + c) for c in POSE[:4]])
    worst = aligned.join(other, [key, "image_id"]).groupBy(key).agg(F.count("*").alias("views"), F.max(_turn("", "o")).alias("worst"))
    return worst.withColumn("ok", (F.col("views") >= 2) & (F.col("worst") <= most))


def select_anchors(centres: DataFrame, key: str = "window_id") -> DataFrame:
    """(key, a, b, c, area): the three views whose centres span the largest triangle, the first on ties.

    centres: (key, image_id, x, y, z), the common views of a window: a few. Null views where there are fewer
    than three or all are in line.
    """
    mean = centres.groupBy(key).agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    off = F.sqrt(sum(((F.col(c) - F.col("m" + c)) ** 2 for c in "xyz"), F.lit(0.0)))
    spread = centres.join(mean, key).groupBy(key).agg(F.max(off).alias("_spread"))
    one = lambda p: centres.select(key, F.col("image_id").alias(p), *[F.col(c).alias(p + c) for c in "xyz"])
    u, v = ([F.col(p + c) - F.col("a" + c) for c in "xyz"] for p in "bc")
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    # merged, so triples come in the order of their windows and are never sorted or held
    triples = one("a").join(one("b").hint("merge"), key).where("a < b").join(one("c").hint("merge"), key).where("b < c")
    area = 0.5 * F.sqrt(geometry.dot(cross, cross))
    best = triples.withColumn("area", area).groupBy(key).agg(F.max(F.struct("area", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (-F.col("c")).alias("c"))).alias("m"))
    out = spread.join(best, key, "left")
    fine = F.col("m.area") > F.greatest(F.lit(1e-12), F.col("_spread") * F.col("_spread") * 1e-8)
    return out.select(key, *[F.when(fine, -F.col(f"m.{c}")).alias(c) for c in "abc"], F.when(fine, F.col("m.area")).alias("area"))


def pose_deviation(reference: DataFrame, candidate: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, n, status, centre_p95, rotation_p95) after one similarity from the candidate to the reference.

    Poses (key, name, q*, t*) are bound by name. centre_p95 is relative to the largest distance of a common
    reference centre from their mean, rotation_p95 in degrees, both by nearest rank; null unless status is ok,
    poor_fit or reflection (unavailable: fewer than three names in common; degenerate: centres in line).
    """

    def placed(df: DataFrame, p: str) -> DataFrame:
        rows = geometry.rotation(*[F.col(c) for c in POSE[:4]])
        centre = geometry.centre(rows, tuple(F.col(c) for c in POSE[4:]))
        return df.select(key, "name", *[F.col(c).alias(p + c) for c in POSE[:4]], *[centre[i].alias(p + c) for i, c in enumerate("xyz")])

    both = cut(placed(candidate, "s").join(placed(reference, "d"), [key, "name"]))  # read several times
    fit = estimate_sim3(both.select(key, *[p + c for p in "sd" for c in "xyz"]), key)
    moved = both.join(fit.where("rotation is not null").select(key, "scale", "rotation", "translation"), key)
    s = lambda i, j: F.get("rotation", F.lit(3 * i + j))
    at = [F.col("scale") * geometry.dot((s(i, 0), s(i, 1), s(i, 2)), tuple(F.col("s" + c) for c in "xyz")) + F.get("translation", F.lit(i)) for i in range(3)]
    gap = F.sqrt(sum(((a - F.col("d" + c)) ** 2 for a, c in zip(at, "xyz", strict=True)), F.lit(0.0)))
    rows = geometry.rotation(*[F.col("s" + c) for c in POSE[:4]])
    ours = geometry.rotation(*[F.col("d" + c) for c in POSE[:4]])
    turned = [[geometry.dot(rows[i], (s(j, 0), s(j, 1), s(j, 2))) for j in range(3)] for i in range(3)]
    trace = sum((turned[i][j] * ours[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    # of the chord, which is exact for small angles where the arc cosine is not
    chord = F.sqrt(F.greatest(F.lit(0.0), (3 - trace) * 2))
    angle = F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / F.lit(8.0**0.5))))
    mean = both.groupBy(key).agg(*[F.avg("d" + c).alias("m" + c) for c in "xyz"])
    off = F.sqrt(sum(((F.col("d" + c) - F.col("m" + c)) ** 2 for c in "xyz"), F.lit(0.0)))
    radius = both.join(mean, key).groupBy(key).agg(F.max(off).alias("_radius"))
    found = cut(moved.select(key, gap.alias("_gap"), angle.alias("_angle")))
    far = ranks.percentiles(found, key, "_gap", {"_gap95": ("rank", 0.95)}).join(ranks.percentiles(found, key, "_angle", {"rotation_p95": ("rank", 0.95)}), key)
    out = fit.select(key, "n", "status").join(far, key, "left").join(radius, key, "left")
    return out.select(key, "n", "status", (F.col("_gap95") / F.col("_radius")).alias("centre_p95"), "rotation_p95")
