"""Planning which images to match: temporal, exhaustive, retrieved and pose-near pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions import geometry, ranks


def clip_violations(manifest: DataFrame) -> DataFrame:
    """(capture_id, clip_id, reason) of a manifest (capture_id, clip_id, is_video, pos, image, t)."""
    mixed = manifest.groupBy("capture_id", "clip_id").agg(F.count_distinct("is_video").alias("n")).where("n > 1").select("capture_id", "clip_id", F.lit("mixed_kind").alias("reason"))
    again = manifest.groupBy("capture_id", "image").agg(F.count("*").alias("n"), F.min("clip_id").alias("clip_id")).where("n > 1").select("capture_id", "clip_id", F.lit("duplicate_image").alias("reason"))
    before = F.lag("t").over(W.partitionBy("capture_id", "clip_id").orderBy("pos"))
    back = manifest.withColumn("_b", before).where("is_video and (t is null or t <= _b)").select("capture_id", "clip_id", F.lit("time_not_increasing").alias("reason"))
    stamped = manifest.where("not is_video and t is not null").select("capture_id", "clip_id", F.lit("photo_with_time").alias("reason"))
    return mixed.unionByName(again).unionByName(back).unionByName(stamped).distinct()


def clips_of(manifest: DataFrame) -> DataFrame:
    """(capture_id, clip_id, place, is_video, images): a capture's clips in the order in which they first occur,
    by the position of their first image in the manifest (capture_id, clip_id, is_video, position)."""
    own = manifest.groupBy("capture_id", "clip_id").agg(F.min("position").alias("_first"), F.bool_or("is_video").alias("is_video"), F.count("*").alias("images"))
    place = F.row_number().over(W.partitionBy("capture_id").orderBy("_first", "clip_id")) - 1
    return own.select("capture_id", "clip_id", place.alias("place"), "is_video", "images")


def temporal_pairs(images: DataFrame, offsets: list[int]) -> DataFrame:
    """(capture_id, i, j, role): each image with those ``offsets`` after it in its clip, by an equi-join."""
    ahead = images.select("capture_id", "clip_id", F.col("i").alias("i"), F.explode(F.array(*[F.col("pos") + o for o in offsets])).alias("pos"))
    other = images.select("capture_id", "clip_id", "pos", F.col("i").alias("j"))
    return ahead.join(other, ["capture_id", "clip_id", "pos"]).select("capture_id", "i", "j", F.lit("local").alias("role"))


def exhaustive_pairs(images: DataFrame, most: int = 60) -> DataFrame:
    """All pairs i < j of captures with at most ``most`` images; larger ones have none."""
    small = images.groupBy("capture_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("capture_id")
    own = images.join(small, "capture_id", "left_semi").select("capture_id", "i")
    return own.join(own.withColumnRenamed("i", "j"), "capture_id").where("i < j").withColumn("role", F.lit("local"))


def query_images(images: DataFrame, stride: int) -> DataFrame:
    """Every stride-th image of each clip."""
    return images.where(F.col("pos") % stride == 0)


def merge_pairs(base: DataFrame, retrieved: DataFrame, images: DataFrame) -> DataFrame:
    """(capture_id, i, j, role): unordered edges once, base before retrieved, i < j.

    Retrieved pairs of one clip nearer than max(12, n / 10) go; pairs of unknown images or of one image too.
    """
    known = images.select("capture_id", "i", "clip_id")
    sizes = images.groupBy("capture_id").agg(F.count("*").alias("n"))
    edge = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
    both = base.select("capture_id", *edge, "role", F.lit(0).alias("_p")).unionByName(retrieved.select("capture_id", *edge, "role", F.lit(1).alias("_p")))
    first = both.where("i <> j").groupBy("capture_id", "i", "j").agg(F.min(F.struct("_p", "role")).alias("r"))
    ends = first.join(known, ["capture_id", "i"]).join(known.select("capture_id", F.col("i").alias("j"), F.col("clip_id").alias("_other")), ["capture_id", "j"]).join(sizes, "capture_id")
    near = (F.col("r._p") == 1) & (F.col("j") - F.col("i") < F.greatest(F.lit(12), F.floor(F.col("n") / 10))) & (F.col("clip_id") == F.col("_other"))
    return ends.where(~near).select("capture_id", "i", "j", F.col("r.role").alias("role"))


def admit_neighbours(ranked: DataFrame, base: DataFrame, cap: int, least_gap: int) -> DataFrame:
    """(capture_id, i, j): the first ``cap`` admitted neighbours of each query, once for each unordered edge.

    ranked: (capture_id, q, n, place). Pairs in base (capture_id, i, j), or nearer than the gap, are not.
    """
    own = ranked.withColumn("i", F.least("q", "n")).withColumn("j", F.greatest("q", "n")).where(F.col("j") - F.col("i") >= least_gap)
    fresh = own.join(base.select("capture_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), ["capture_id", "i", "j"], "left_anti")
    place = F.row_number().over(W.partitionBy("capture_id", "q").orderBy("place", "n"))
    return fresh.withColumn("_k", place).where(F.col("_k") <= cap).select("capture_id", "i", "j").distinct()


def pose_pairs(cameras: DataFrame, k: int = 8, exhaustive: int = 60, tile_rows: int = 2000) -> DataFrame:
    """(model_id, a, b): all pairs of models of up to ``exhaustive`` cameras; else each camera's k best by distance and
    view direction (ties: smaller id).

    Distance counts in median nearest-neighbour spacings, times 1.5 - 0.5 * cosine of the directions. Both searches
    go through tiles (``splats.knn``), so cameras of a large model meet those around them, not their whole model.
    Cameras of large models with a centre or direction that is no finite number take no part.
    cameras: (model_id, image_id, cx, cy, cz, fx, fy, fz), directions of unit length.
    """
    from scenemill.operators import splats

    own = cameras.join(cameras.groupBy("model_id").agg(F.count("*").alias("_n")), "model_id").withColumn("model_id", F.col("model_id").cast("long"))
    few = own.where(F.col("_n") <= exhaustive).select("model_id", "image_id")
    whole = few.withColumnRenamed("image_id", "a").join(few.withColumnRenamed("image_id", "b"), "model_id").where("a < b")
    large = own.where(F.col("_n") > exhaustive).select(F.col("model_id").alias("scene"), F.col("image_id").alias("row_index"), *[F.col(f"c{c}").alias(c) for c in "xyz"], "fx", "fy", "fz")
    spacing = ranks.percentiles(splats.knn(large, 1, tile_rows), "scene", "distance", {"_s": ("floor", 0.5)})
    spaced = large.join(spacing, "scene").withColumn("spacing", F.greatest("_s", F.lit(1e-12)))
    best = splats.knn(spaced, k, tile_rows, turned=True)
    kept = best.select(F.col("scene").alias("model_id"), F.least("row_index", "neighbour").alias("a"), F.greatest("row_index", "neighbour").alias("b")).distinct()
    return whole.select("model_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).unionByName(kept)


def windows(captures: DataFrame, size: int, overlap: int, least: int = 1) -> DataFrame:
    """(capture_id, window, first, last) of runs of ``n`` images; the last window may be partial."""
    step = size - min(max(least, overlap), size - 2)
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n").cast("int") - 1 - (size - step), F.lit(step)))
    out = captures.where("n > 0").select("capture_id", "n", F.posexplode(starts).alias("window", "first"))
    return out.select("capture_id", "window", "first", (F.least(F.col("first") + size, F.col("n")) - 1).cast("int").alias("last"))


def _best(q: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, k: int, least: float, rows: int = 256) -> list[tuple[np.ndarray, ...]]:
    """(q, n, s) of the best k of ids n (ascending), with unit vectors b, for each id of q, some rows at a time."""
    out = []
    for first in range(0, len(q), rows):
        near = a[first : first + rows] @ b.T
        i, j = np.nonzero(near >= least - 1e-9)
        s = np.round(near[i, j], 12)
        fine = (s >= least) & (q[first + i] != n[j])
        i, j, s = i[fine], j[fine], s[fine]
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, s = i[place < k], j[place < k], s[place < k]
        out.append((q[first + i], n[j], s))
    return out


def retrieval_graph(vectors: DataFrame, k: int = 8, least: float = 0.55, block: int = 2048) -> DataFrame:
    """(a, b): unordered union of each vector's k most similar by cosine, at least ``least`` (ties: smaller id).

    Exact: every pair of blocks of vectors meets once, for both, in numpy, and only a block's best k of each row are
    written. vectors: (group_id, id, v).
    """
    sizes = vectors.groupBy("group_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = vectors.where("v is not null").join(sizes, "group_id").withColumn("at", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    met = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    met = met.select("group_id", F.least("at", "_with").alias("low"), F.greatest("at", "_with").alias("high"), "at", "id", "v")

    def fn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for at in dict.fromkeys(key[1:]):
            side = rows[rows["at"] == at].sort_values("id", kind="stable")
            m = np.array(side["v"].tolist(), np.float64).reshape(len(side), -1)
            sides.append((side["id"].to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))
        turns = [(sides[0], sides[0])] if len(sides) == 1 else [sides, sides[::-1]]
        found = [f for a, b in turns if len(a[0]) and len(b[0]) for f in _best(*a, *b, k, least)]
        q, n, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        return pd.DataFrame({"group_id": key[0], "q": np.asarray(q, "int64"), "n": np.asarray(n, "int64"), "s": np.asarray(s, float)})

    found = met.groupBy("group_id", "low", "high").applyInPandas(fn, "group_id long, q long, n long, s double")
    place = F.row_number().over(W.partitionBy("group_id", "q").orderBy(F.desc("s"), "n"))
    top = found.withColumn("_r", place).where(F.col("_r") <= k)
    return top.select("group_id", F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct()


def camera_groups(images: DataFrame, mode: str) -> DataFrame:
    """Adds ``camera_group``: one for all, by make, model, focal length and size, or one for each image."""
    made = F.format_string("%s-%s-%.6f-%dx%d", "make", "model", "focal", "width", "height")
    known = F.col("make").isNotNull() & F.col("model").isNotNull() & F.col("focal").isNotNull()
    group: Column = {"shared": F.lit("shared"), "automatic": F.when(known, made).otherwise(F.col("image").cast("string")), "per_image": F.col("image").cast("string")}[mode]
    return images.withColumn("camera_group", group)


def camera_group_check(grouped: DataFrame, cameras: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, groups, cameras, ok): whether groups of images and camera ids correspond one to one.

    grouped: (key, image, camera_group); cameras: (key, image, camera_id), as assigned. Images without a camera
    are not ok.
    """
    both = grouped.join(cameras.select(key, "image", "camera_id"), [key, "image"], "left")
    pairs = both.groupBy(key, "camera_group", "camera_id").agg(F.lit(1).alias("_one"))
    out = pairs.groupBy(key).agg(F.count_distinct("camera_group").alias("groups"), F.count_distinct("camera_id").alias("cameras"), F.count("*").alias("_n"), F.count_if(F.col("camera_id").isNull()).alias("_bare"))
    return out.select(key, "groups", "cameras", ((F.col("groups") == F.col("_n")) & (F.col("cameras") == F.col("_n")) & (F.col("_bare") == 0)).alias("ok"))


def camera_axes(cameras: DataFrame) -> DataFrame:
    """Adds the centre (cx, cy, cz) and view direction (fx, fy, fz) of poses (qw, qx, qy, qz, tx, ty, tz)."""
    rows = geometry.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    centre = geometry.centre(rows, tuple(F.col(c) for c in ("tx", "ty", "tz")))
    return cameras.withColumns(dict(zip(("cx", "cy", "cz", "fx", "fy", "fz"), (*centre, *rows[2]), strict=True)))


def refinement_plan(images: DataFrame, local: DataFrame, loops: DataFrame, most: int) -> DataFrame:
    """(capture_id, local, loops, connected, within): local pairs and loop pairs not among them, whether all
    images are reachable over them, and whether there are at most ``most``. images: (capture_id, image_id)."""
    from scenemill.operators import graph

    clean = lambda df, p: df.where("i <> j").select("capture_id", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(p).alias("p"))
    both = clean(local, 0).unionByName(clean(loops, 1))
    if not both.where("a > b").isEmpty():  # where all are in order, tables dealt by i are not shuffled
        both = both.select("capture_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "p")
    edges = both.groupBy("capture_id", "a", "b").agg(F.min("p").alias("p"))
    roots = graph.components(images.select("capture_id", F.col("image_id").alias("node")), both, "capture_id")
    whole = roots.groupBy("capture_id").agg((F.count_distinct("root") == 1).alias("connected"))
    sizes = edges.groupBy("capture_id").agg(F.count_if(F.col("p") == 0).alias("local"), F.count_if(F.col("p") == 1).alias("loops"))
    out = whole.join(sizes, "capture_id", "left").fillna(0, ["local", "loops"])
    return out.select("capture_id", "local", "loops", "connected", (F.col("local") + F.col("loops") <= most).alias("within"))
