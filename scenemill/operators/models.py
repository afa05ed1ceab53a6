"""Sparse camera models: residuals, integrity, support, orientation and alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemill.functions import geometry, ranks
from scenemill.functions.storage import kept

#: The scales and the relative error that a similarity may have.
SMALLEST, LARGEST, MOST_ERROR = 0.05, 20.0, 0.05


def point_key(points: DataFrame) -> list[str]:
    """What points are found by: their id, within a model unless they are all models' points."""
    return ["model_id", "point_id"] if "model_id" in points.columns else ["point_id"]


def residuals(observations: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``residual`` (pixels), ``angle`` and ``range`` to observations of points in front of their camera.

    cameras: one row for each image with its pose and camera (image_id, model, params, focal, q*, t*). The
    large join is on (model_id, point_id), so a dominating model spreads over all tasks. Points without a column
    model_id are those of every model. Cameras with their centre (cx, cy, cz) also give the ray from it to the point,
    as rx, ry and rz.
    """
    rows = geometry.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    p = tuple(F.col(c) for c in ("px", "py", "pz"))
    at = tuple(geometry.dot(rows[i], p) + F.col(t) for i, t in enumerate(("tx", "ty", "tz")))
    joined = observations.join(cameras, ["model_id", "image_id"]).join(points, point_key(points))
    placed = joined.withColumns(dict(zip(("_x", "_y", "_z"), at, strict=True))).where("_z > 1e-12")
    u, v = geometry.project(F.col("model"), F.col("params"), F.col("_x") / F.col("_z"), F.col("_y") / F.col("_z"))
    off = F.hypot(F.col("x") - u, F.col("y") - v)
    out = placed.withColumn("residual", off).withColumn("range", F.sqrt(sum((F.col(c) * F.col(c) for c in ("_x", "_y", "_z")), F.lit(0.0))))
    rays = [(F.col(f"p{c}") - F.col(f"c{c}")).alias(f"r{c}") for c in "xyz"] if "cx" in cameras.columns else []
    return out.withColumn("angle", F.atan(F.col("residual") / F.col("focal"))).select(*observations.columns, "residual", "angle", "range", *rays)


def residual_summary(found: DataFrame) -> DataFrame:
    """Per model: count, mean, median and nearest-rank 90% of the residual, and images measured."""
    found = kept(found.select("model_id", "image_id", "residual"))  # read twice
    sums = found.groupBy("model_id").agg(F.count("*").alias("observations"), F.avg("residual").alias("mean"), F.count_distinct("image_id").alias("images"))
    return sums.join(ranks.percentiles_twice(found, "model_id", "residual", {"median": ("middle", 0.5), "p90": ("rank", 0.9)}), "model_id", "left").select(
        "model_id", "observations", "mean", "median", "p90", "images"
    )


def integrity(observations: DataFrame, tracks: DataFrame, points: DataFrame) -> DataFrame:
    """(model_id, reason, n): duplicate or unmatched observations and tracks, and points that are missing.

    Observations and tracks meet once, dealt by their place in an image; what is left to look up of points is counted.
    """
    key = ["model_id", "image_id", "point2d_idx", "point_id"]
    sides = lambda df, seen: df.select(*key, F.lit(seen).alias("_seen"))
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()  # a null is the same as no other
    met = sides(observations, True).unionByName(sides(tracks, False)).repartition(*key[:3])
    met = met.groupBy(*key).agg(F.count_if("_seen").alias("_o"), F.count_if(~F.col("_seen")).alias("_t"))
    lone = lambda a, b: F.sum(F.when(~whole | (F.col(b) == 0), F.col(a)).otherwise(0))
    places = met.groupBy(*key[:3]).agg(F.sum("_o").alias("_n"), lone("_o", "_t").alias("_bare"), lone("_t", "_o").alias("_loose"))
    sums = places.groupBy("model_id").agg(F.count_if(F.col("_n") > 1).alias("duplicate_observation"), F.sum("_bare").alias("observation_without_track"), F.sum("_loose").alias("track_without_observation"))
    reasons = F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in sums.columns[1:]])
    asked = observations.groupBy("model_id", "point_id").agg(F.count("*").alias("_n")).join(points, point_key(points), "left_anti")
    missing = asked.groupBy("model_id").agg(F.sum("_n").alias("n")).select("model_id", F.lit("missing_point").alias("reason"), "n")
    return sums.select("model_id", F.inline(reasons)).where("n > 0").unionByName(missing)


def support_stats(observations: DataFrame, images: DataFrame, strong: int = 20) -> DataFrame:
    """Per model: mean distinct-view track length, nearest-rank observations per image, strongly measured images."""
    tracks = observations.groupBy("model_id", "point_id").agg(F.count_distinct("image_id").alias("length")).groupBy("model_id").agg(F.avg("length").alias("mean_track"))
    seen = observations.groupBy("model_id", "image_id").agg(F.count("*").alias("n"))
    per = images.join(seen, ["model_id", "image_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = per.groupBy("model_id").agg(F.min("n").alias("least"), F.count_if(F.col("n") >= strong).alias("strong"))
    shares = ranks.percentiles(per, "model_id", "n", ranks.names([0.1, 0.5, 0.9]))
    return own.join(shares, "model_id").join(tracks, "model_id", "left").select("model_id", "least", "p10", "p50", "p90", "strong", "mean_track")


def opening_camera(cameras: DataFrame, observations: DataFrame, ordered: bool = True) -> DataFrame:
    """(model_id, image_id): in an ordered capture the first camera with at least the median number of
    observations; else the one with most, of several the first (by name, where there is a column ``name``)."""
    n = observations.groupBy("model_id", "image_id").agg(F.count("*").alias("n"))
    name = F.col("name") if "name" in cameras.columns else F.col("image_id")
    own = cameras.select("model_id", "image_id", name.alias("_name")).join(n, ["model_id", "image_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.min(F.struct((-F.col("n")).alias("n"), "_name", "image_id"))["image_id"]
    if not ordered:
        return own.groupBy("model_id").agg(most.alias("image_id"))
    med = own.join(ranks.percentiles(own, "model_id", "n", {"_m": ("middle", 0.5)}), "model_id")
    return med.groupBy("model_id").agg(F.coalesce(F.min(F.when(F.col("n") >= F.col("_m"), F.col("image_id"))), most).alias("image_id"))


def score_models(points: DataFrame, images: DataFrame) -> DataFrame:
    """Per model: registered share, points, mean error, and whether it is accepted or a viable part.

    points: (model_id, error); images: (model_id, registered).
    """
    own = points.groupBy("model_id").agg(F.count("*").alias("points"), F.avg("error").alias("error"))
    seen = images.groupBy("model_id").agg(F.count("*").alias("images"), F.count_if("registered").alias("registered"))
    out = seen.join(own, "model_id", "left")
    # The acceptance limits.
    good = (F.col("registered") / F.col("images") >= 0.90) & (F.col("error") <= 2.5) & (F.col("points") > 0)
    state = F.when(good, "accepted").when((F.col("registered") >= 8) & (F.col("points") > 0), "partial").otherwise("rejected")
    return out.withColumn("status", state)


def remap_ids(images: DataFrame, database: DataFrame) -> DataFrame:
    """(model_id, image_id, new_id, name): model images bound to the database by name; new_id null if unknown."""
    return images.join(database.select("name", F.col("db_id").alias("new_id")), "name", "left").select("model_id", "image_id", "new_id", "name")


def topology_digest(tracks: DataFrame) -> DataFrame:
    """(model_id, points, digest) that ids, order and coordinates don't change. tracks: (model_id, point_id, name, idx).

    Points' hashes are sorted and hashed in buckets by their first three digits, then the buckets' hashes in
    order, so a bucket of the largest model holds a 4096th of it.
    """
    seen = F.array_sort(F.collect_list(F.struct("name", "idx")))
    point = tracks.groupBy("model_id", "point_id").agg(F.sha2(F.to_json(seen), 256).alias("h"))
    bucket = point.groupBy("model_id", F.substring("h", 1, 3).alias("_b")).agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("_h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: F.concat(x["_b"], x["_h"]))
    return bucket.groupBy("model_id").agg(F.sum("_n").alias("points"), F.sha2(F.array_join(whole, ""), 256).alias("digest"))


def sim3_sums(matched: DataFrame, key: str = "model_id") -> DataFrame:
    """Means and central moments of matched centres (sx, sy, sz) and (dx, dy, dz), combined before the shuffle.

    Spark's moments are updated about the running mean, so centres far from the origin lose nothing."""
    s, d = ("sx", "sy", "sz"), ("dx", "dy", "dz")
    sums = [F.avg(c).alias(c) for c in (*s, *d)]
    sums += [F.covar_pop(a, b).alias(f"{a}{b}") for own in ((s, d), (s, s), (d, d)) for a in own[0] for b in own[1]]
    return matched.groupBy(key).agg(F.count("*").alias("n"), *sums)


def estimate_sim3(matched: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, n, scale, rotation, translation, rmse, status) of the best similarity from source to target.

    From moments only, so a group of any size is one pass. Fewer than three matches: unavailable; a rank under
    two: degenerate. Reflections are not hidden: the rotation stays proper, the error shows them and so does the
    status ``reflection``. Others: implausible_scale (not 0.05 to 20), poor_fit (an error of over 5% of the
    targets' spread).
    """

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                ms, md = (np.array([r[c + x] for x in "xyz"]) for c in "sd")
                moments = lambda p, q: np.array([[r[f"{p}{a}{q}{c}"] for c in "xyz"] for a in "xyz"])  # noqa: B023, E731
                cross = moments("s", "d").T
                vs, vd = np.trace(moments("s", "s")), np.trace(moments("d", "d"))
                flat = [np.linalg.eigvalsh(moments(p, p)) for p in "sd"]
                u, w, vt = np.linalg.svd(cross)
                if r["n"] < 3 or vs <= 1e-18 or w[1] <= 1e-9 * max(w[0], 1e-300) or any(e[1] <= 1e-12 * max(e[2], 1e-300) for e in flat):
                    out.append((r[key], r["n"], None, None, None, None, "unavailable" if r["n"] < 3 else "degenerate"))
                    continue
                sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
                rot, scale = (u * sign) @ vt, float((w * sign).sum() / vs)
                error = max(0.0, vd - scale * float((w * sign).sum()))
                solid = all(e[0] > 1e-12 * e[2] for e in flat)
                state = "reflection" if solid and sign[2] < 0 else "implausible_scale" if not SMALLEST <= scale <= LARGEST else "poor_fit" if error > MOST_ERROR**2 * vd else "ok"
                out.append((r[key], r["n"], scale, rot.reshape(-1).tolist(), (md - scale * rot @ ms).tolist(), float(np.sqrt(error)), state))
            yield pd.DataFrame(out, columns=[key, "n", "scale", "rotation", "translation", "rmse", "status"])

    return sim3_sums(matched, key).mapInPandas(solve, f"{key} long, n long, scale double, rotation array<double>, translation array<double>, rmse double, status string")


def align_points(points: DataFrame, sim3: DataFrame, key: str = "model_id", names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points of each key moved by its similarity; without one they stay."""
    own = points.join(sim3.where("status = 'ok'").select(key, "scale", "rotation", "translation"), key, "left")
    p = tuple(F.col(c) for c in names)
    row = lambda i: geometry.dot(tuple(F.get("rotation", F.lit(3 * i + j)) for j in range(3)), p)
    moved = {f"_{c}": F.coalesce(F.col("scale") * row(i) + F.get("translation", F.lit(i)), p[i]) for i, c in enumerate(names)}
    out = own.withColumns(moved)
    return out.select(*[F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in points.columns])


def voxel_sizes(points: DataFrame, most: int, key: str = "capture_id") -> DataFrame:
    """(key, size): the edge at which a capture's bulk, from 1% to 99% on each axis, has about ``most`` voxels."""
    ends = ranks.percentiles_of(points, key, {c: {f"_l{c}": ("linear", 0.01), f"_h{c}": ("linear", 0.99)} for c in "xyz"})
    extent = [F.greatest(F.col(f"_h{c}") - F.col(f"_l{c}"), F.lit(0.0)) for c in "xyz"]
    widest = F.greatest(*extent, F.lit(float(np.finfo(float).eps)))
    volume = F.lit(1.0)
    for e in extent:
        volume = volume * F.greatest(e, widest * 0.01)
    return ends.select(key, F.greatest(F.cbrt(volume / F.lit(float(most))), widest / 4096).alias("size"))


def fuse_voxels(points: DataFrame, size: float | None, most: int, key: str = "capture_id") -> DataFrame:
    """(key, kx, ky, kz, n, weight, x, y, z): weighted means per voxel, the heaviest ``most`` of each capture.

    Voxels are counted from the least point of the capture on; without ``size`` it is that of ``voxel_sizes``.
    Rows that hold a null, NaN or infinity, or no weight over 0, don't count. Where there are columns r, g and b,
    their weighted means are added, rounded half to even and kept within 0 to 255. Of equal weights the voxel
    that comes first stays.
    """
    colours = [c for c in "rgb" if c in points.columns]
    fine = F.col("w") > 0
    for c in ("x", "y", "z", "w", *colours):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    own = points.where(fine)
    least = own.groupBy(key).agg(*[F.min(c).alias("_m" + c) for c in "xyz"])
    least = least.withColumn("_size", F.lit(float(size))) if size is not None else least.join(voxel_sizes(own, most, key).withColumnRenamed("size", "_size"), key)
    cell = {f"k{c}": F.floor((F.col(c) - F.col("_m" + c)) / F.col("_size")).cast("long") for c in "xyz"}
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    shade = [F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(mean(c)))).cast("int").alias(c) for c in colours]
    fused = own.join(least, key).withColumns(cell).groupBy(key, "kx", "ky", "kz").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), *[mean(c).alias(c) for c in "xyz"], *shade)
    return ranks.number_rows(fused, key, [F.desc("weight"), "kx", "ky", "kz"]).where(F.col("_i") < most).drop("_i", "_n")


def append_points(canonical: DataFrame, learned: DataFrame, key: str = "model_id") -> DataFrame:
    """Learned points after the canonical ones: ids go on from the largest, error is -1."""
    top = canonical.groupBy(key).agg(F.max("point_id").alias("_top"))
    new = ranks.number_rows(learned, key, ["x", "y", "z"]).join(top, key, "left")
    new = new.withColumn("point_id", F.coalesce("_top", F.lit(0)) + F.col("_i") + 1).withColumn("error", F.lit(-1.0))
    return canonical.unionByName(new.select(*canonical.columns))


def membership(registered: DataFrame, database: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, violations) of sub-models: members (model_order, image_id, name), those that bind to the database
    by id and name; violations (model_order, image_id, name, reason) of all others.

    registered: (model_order, image_id, name); database: (image_id, name). Reasons: duplicate_image_id,
    duplicate_image_name (in one model), unknown_image_id, other_name.
    """
    twice = lambda c: registered.groupBy("model_order", c).agg((F.count("*") > 1).alias(f"_{c}"))
    own = registered.join(twice("image_id"), ["model_order", "image_id"]).join(twice("name"), ["model_order", "name"])
    own = own.join(database.select("image_id", F.col("name").alias("_known")), "image_id", "left")
    reason = F.when(F.col("_image_id"), "duplicate_image_id").when(F.col("_name"), "duplicate_image_name").when(F.col("_known").isNull(), "unknown_image_id")
    own = own.withColumn("reason", reason.when(F.col("_known") != F.col("name"), "other_name"))
    columns = ["model_order", "image_id", "name"]
    return own.where("reason is null").select(*columns), own.where("reason is not null").select(*columns, "reason")


#: Fixed value: camera models without distortion.
UNDISTORTED = ("SIMPLE_PINHOLE", "PINHOLE")


def render_cameras(cameras: DataFrame, near: float = 0.01, far: float = 100.0) -> DataFrame:
    """Adds ``projection`` and ``view`` (16 numbers each, column by column) and ``refused`` to cameras.

    cameras: (scene, image_id, q*, t*, model, params, camera_width, camera_height, width, height). Intrinsics are
    scaled to the picture's size; the renderer looks along -z with y up. near and far are multiples of the largest
    distance of a centre from the scene's mean. Matrices are null in scenes where a camera has distortion.
    """
    p = lambda i: F.get("params", F.lit(i))
    simple = F.col("model") == "SIMPLE_PINHOLE"
    focal = (p(0), F.when(simple, p(0)).otherwise(p(1)))
    middle = (F.when(simple, p(1)).otherwise(p(2)), F.when(simple, p(2)).otherwise(p(3)))
    size = (F.col("width"), F.col("height"))
    scale = tuple(s / F.col("camera_" + c) for s, c in zip(size, ("width", "height"), strict=True))
    rows = geometry.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    t = tuple(F.col(c) for c in ("tx", "ty", "tz"))
    centre = geometry.centre(rows, t)
    placed = cameras.withColumns({f"_c{c}": centre[i] for i, c in enumerate("xyz")})
    mean = placed.groupBy("scene").agg(*[F.avg(f"_c{c}").alias(f"_m{c}") for c in "xyz"], F.max(~F.coalesce(F.col("model").isin(*UNDISTORTED), F.lit(False))).alias("refused"))
    off = F.sqrt(sum(((F.col(f"_c{c}") - F.col(f"_m{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    radius = placed.join(mean, "scene").groupBy("scene", "refused").agg(F.max(off).alias("_radius"))
    own = placed.join(radius, "scene")
    n, f = F.col("_radius") * near, F.col("_radius") * far
    depth, zero = f / (n - f), F.lit(0.0)
    focal = tuple(2 * a * s / e for a, s, e in zip(focal, scale, size, strict=True))
    shift = tuple(2 * m * s / e for m, s, e in zip(middle, scale, size, strict=True))
    projection = [focal[0], zero, zero, zero, zero, focal[1], zero, zero, 1 - shift[0], shift[1] - 1, depth, F.lit(-1.0), zero, zero, depth * n, zero]
    flip = (1, -1, -1)
    view = [x for j in range(3) for x in (*[rows[i][j] * flip[i] for i in range(3)], zero)] + [t[i] * flip[i] for i in range(3)] + [F.lit(1.0)]
    shown = lambda m: F.when(~F.col("refused"), F.array(*m))
    return own.withColumn("projection", shown(projection)).withColumn("view", shown(view)).select(*cameras.columns, "projection", "view", "refused")


def route_dataset(models: DataFrame, points: DataFrame, observations: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """(model_id, points, observations, unposed, route): adopt_direct with 100 points or more and any
    observation, else seed_triangulate from poses. unposed: files (model_id, name) without an image."""
    count = lambda df, name: df.groupBy("model_id").agg(F.count("*").alias(name))
    out = models.select("model_id").distinct().join(count(points, "points"), "model_id", "left").join(count(observations, "observations"), "model_id", "left")
    out = out.join(count(files.join(images, ["model_id", "name"], "left_anti"), "unposed"), "model_id", "left").fillna(0, ["points", "observations", "unposed"])
    ready = (F.col("points") >= 100) & (F.col("observations") > 0)
    return out.withColumn("route", F.when(ready, "adopt_direct").otherwise("seed_triangulate"))


def depth_points(samples: DataFrame, cameras: DataFrame, most: int, share: float = 0.4, key: str = "view_id") -> DataFrame:
    """(view_id, row_index, col_index, x, y, z, w): world points of a view's usable depth samples.

    samples: (view_id, row_index, col_index, depth, conf). Depths must be finite and over 0; from 32 samples on
    those outside 1% to 99% go; then those below the ``share`` quantile of confidence. At most ``most`` stay, at
    even positions by row and column. cameras: (view_id, fx, fy, px, py, q*, t*). A view has an image's pixels.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = samples.where(fine("depth") & (F.col("depth") > 0) & fine("conf"))
    ends = ranks.percentiles(rows, key, "depth", {"_l": ("linear", 0.01), "_h": ("linear", 0.99)}).join(rows.groupBy(key).agg(F.count("*").alias("_n")), key)
    rows = rows.join(ends, key).where((F.col("_n") < 32) | F.col("depth").between(F.col("_l"), F.col("_h"))).drop("_n", "_l", "_h")
    rows = rows.join(ranks.percentiles(rows, key, "conf", {"_c": ("linear", share)}), key).where("conf >= _c")
    rows = ranks.number_rows(rows, key, ["row_index", "col_index"])
    step = (F.col("_n") - 1) / F.lit(float(max(1, most - 1)))
    slot = F.ceil(F.col("_i") / step)  # or a neighbour, as quotients are rounded
    hit = (F.col("_i") == 0) | ((F.col("_i") == F.col("_n") - 1) if most > 1 else F.lit(False))
    for k in (-1, 0, 1):
        hit = hit | ((slot + k).between(0, most - 2) & (F.floor((slot + k) * step) == F.col("_i")))
    rows = rows.where((F.col("_n") <= most) | hit).join(cameras, key)
    z = F.col("depth")
    seen = ((F.col("col_index") - F.col("px")) * z / F.col("fx"), (F.col("row_index") - F.col("py")) * z / F.col("fy"), z)
    off = tuple(p - F.col(f"t{c}") for p, c in zip(seen, "xyz", strict=True))
    r = geometry.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    world = [geometry.dot((r[0][i], r[1][i], r[2][i]), off).alias(c) for i, c in enumerate("xyz")]
    return rows.select(key, "row_index", "col_index", *world, F.col("conf").alias("w"))
