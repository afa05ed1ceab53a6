"""Sparse models and dataset descriptions: text models, match lists, pose files in JSON."""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions import geometry


def _lines(spark: SparkSession, paths: str) -> DataFrame:
    own = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    return own.where("line <> '' and line not like '#%'").withColumn("w", F.split("line", r"\s+"))


def read_cameras(spark: SparkSession, paths: str) -> DataFrame:
    """(path, camera_id, model, width, height, params) of cameras.txt files."""
    w = lambda i: F.get("w", F.lit(i))
    params = F.transform(F.slice("w", 5, F.size("w")), lambda x: x.cast("double"))
    return _lines(spark, paths).select("path", w(0).cast("int").alias("camera_id"), w(1).alias("model"), w(2).cast("int").alias("width"), w(3).cast("int").alias("height"), params.alias("params"))


def read_points(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(points, tracks) of points3D.txt files; tracks are (path, point_id, pos, image_id, point2d_idx)."""
    w = lambda i: F.get("w", F.lit(i))
    rows = _lines(spark, paths)
    names = ("x", "y", "z", "r", "g", "b", "error")
    kinds = ("double",) * 3 + ("int",) * 3 + ("double",)
    points = rows.select("path", w(0).cast("long").alias("point_id"), *[w(i + 1).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
    spots = F.sequence(F.lit(8), F.size("w") - 2, F.lit(2))
    pairs = F.transform(spots, lambda i: F.struct(F.get("w", i).cast("int").alias("image_id"), F.get("w", i + 1).cast("int").alias("point2d_idx")))
    tracks = rows.where("size(w) >= 10").select("path", w(0).cast("long").alias("point_id"), F.posexplode(pairs).alias("pos", "t"))
    return points, tracks.select("path", "point_id", "pos", "t.image_id", "t.point2d_idx")


def read_images(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(images, observations) of images.txt files: a pose line, then perhaps a line of x, y, point triples.

    The order of lines matters, so a file is one task's; a name is all that follows the ninth field.
    """

    def numbers(line: str) -> list[float] | None:
        try:
            out = [float(x) for x in line.split()]
        except ValueError:
            return None
        return out if len(out) % 3 == 0 else None

    def fn(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                rows, held = [], None
                for line in raw.decode("utf-8").splitlines():
                    text = line.strip()
                    if not text or text.startswith("#"):
                        continue
                    seen = numbers(text) if held is not None else None
                    if seen is not None:
                        held[-1] = [{"idx": i // 3, "x": seen[i], "y": seen[i + 1], "point_id": int(seen[i + 2])} for i in range(0, len(seen), 3)]
                        held = None
                        continue
                    w = text.split(None, 9)
                    held = [path, int(w[0]), *map(float, w[1:8]), int(w[8]), w[9], []]
                    rows.append(held)
                yield pd.DataFrame(rows, columns=["path", "image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name", "seen"])

    numbers_ = ", ".join(f"{c} double" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))
    schema = f"path string, image_id int, {numbers_}, camera_id int, name string, seen array<struct<idx:int,x:double,y:double,point_id:long>>"
    all_ = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(fn, schema)
    return all_.drop("seen"), all_.select("path", "image_id", F.inline("seen")).withColumnRenamed("idx", "point2d_idx")


def _text(rows: DataFrame, key: str, order: str, lines: Column) -> DataFrame:
    """(key, text): the lines of each key in order, so that equal tables give equal bytes. A model's text is one
    file, and so one row."""
    all_ = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, lines.alias("line")))).alias("r"))
    return all_.select(key, F.concat(F.array_join(F.transform("r", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def _words(*columns: str) -> list[Column]:
    return [F.col(c).cast("string") for c in columns]


def points_text(points: DataFrame, tracks: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, text) of points3D.txt: a line for each point, by id."""
    seen = tracks.groupBy(key, "point_id").agg(F.array_sort(F.collect_list(F.struct("pos", "image_id", "point2d_idx"))).alias("t"))
    end = F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<pos:int,image_id:int,point2d_idx:int>>")), lambda t: F.concat_ws(" ", t["image_id"], t["point2d_idx"])), " ")
    line = F.concat_ws(" ", *_words("point_id", "x", "y", "z", "r", "g", "b", "error"), F.nullif(end, F.lit("")))
    return _text(points.join(seen, [key, "point_id"], "left"), key, "point_id", line)


def cameras_text(cameras: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, text) of cameras.txt: a line for each camera (camera_id, model, width, height, params), by id."""
    return _text(cameras, key, "camera_id", F.concat_ws(" ", *_words("camera_id", "model", "width", "height"), F.array_join(F.transform("params", lambda p: p.cast("string")), " ")))


def images_text(images: DataFrame, observations: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, text) of images.txt: for each image, by id, a line of its pose, camera and name and one of what it sees."""
    seen = observations.groupBy(key, "image_id").agg(F.array_sort(F.collect_list(F.struct("point2d_idx", "x", "y", "point_id"))).alias("_s"))
    spot = lambda s: F.concat_ws(" ", s["x"].cast("string"), s["y"].cast("string"), s["point_id"].cast("string"))
    own = images.join(seen, [key, "image_id"], "left")
    pose = F.concat_ws(" ", *_words("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"))
    return _text(own, key, "image_id", F.concat(pose, F.lit("\n"), F.coalesce(F.array_join(F.transform("_s", spot), " "), F.lit(""))))


def model_violations(cameras: DataFrame, images: DataFrame, points: DataFrame, tracks: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, kind, id, reason) of what can't be written: duplicate ids and names, unknown cameras, images and
    points, colours outside 0 to 255, and numbers that are not finite."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    any_ = lambda names: functools.reduce(lambda x, y: x | y, [odd(c) for c in names])
    shown = lambda df, kind, id_, reason: df.select(key, F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.lit(reason).alias("reason"))
    twice = lambda df, column: df.groupBy(key, column).agg(F.count("*").alias("_n")).where("_n > 1")
    missing = lambda df, other, own, id_: df.join(other.select(key, F.col(id_).alias(own)), [key, own], "left_anti")
    found = [
        shown(twice(cameras, "camera_id"), "camera", "camera_id", "duplicate_id"), shown(twice(images, "image_id"), "image", "image_id", "duplicate_id"),
        shown(twice(images, "name"), "image", "name", "duplicate_name"), shown(twice(points, "point_id"), "point", "point_id", "duplicate_id"),
        shown(missing(images, cameras, "camera_id", "camera_id"), "image", "image_id", "unknown_camera"),
        shown(missing(tracks, images, "image_id", "image_id"), "track", "point_id", "unknown_image"),
        shown(missing(tracks, points, "point_id", "point_id"), "track", "point_id", "unknown_point"),
        shown(points.where(~(F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255))), "point", "point_id", "bad_colour"),
        shown(points.where(any_(("x", "y", "z", "error"))), "point", "point_id", "not_finite"),
        shown(images.where(any_(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))), "image", "image_id", "not_finite"),
        shown(cameras.where(F.exists("params", lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))), "camera", "camera_id", "not_finite"),
    ]
    return functools.reduce(DataFrame.unionByName, found).distinct()


def match_list(edges: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, pairs, text, digest): "a b" lines in order, a line end after each, and the text's SHA-256."""
    rows = F.array_sort(F.collect_list(F.struct("i", "j")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["i"].cast("string"), F.lit(" "), r["j"].cast("string"), F.lit("\n"))), "")
    return edges.groupBy(key).agg(F.count("*").alias("pairs"), text.alias("text")).withColumn("digest", F.sha2("text", 256))


#: Second images whose lines stand in one piece of a match list.
PIECE = 1024


def match_digest(edges: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, pairs, digest) as of ``match_list``, without its text: a capture's lines are put together in pieces, which
    pass in order through one task for each capture; no row or task holds a list."""
    piece = F.floor(F.col("j") / PIECE).alias("_at")
    line = lambda j: F.concat(F.col("i").cast("string"), F.lit(" "), j.cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("j")), line), "")
    own = edges.groupBy(key, "i", piece).agg(F.count("*").alias("pairs"), lines.alias("text"))
    own = own.select(key, "i", "_at", "pairs", "text").repartition(key).sortWithinPartitions(key, "i", "_at").select(key, "pairs", "text")

    def fn(batches):
        capture, pairs, text = None, 0, None
        for b in batches:
            kind = b.schema.field(0).type
            keys, counts, texts = (b.column(k).to_pylist() for k in range(3))
            first = 0
            while first < len(keys):
                last = first + 1
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                if text is None or keys[first] != capture:
                    if text is not None:
                        yield row(kind, capture, pairs, text)
                    capture, pairs, text = keys[first], 0, hashlib.sha256()
                pairs += sum(counts[first:last])
                text.update("".join(texts[first:last]).encode())
                first = last
        if text is not None:
            yield row(kind, capture, pairs, text)

    def row(kind, capture, pairs, text):
        return pa.RecordBatch.from_arrays([pa.array([capture], kind), pa.array([pairs], pa.int64()), pa.array([text.hexdigest()])], [key, "pairs", "digest"])

    return own.mapInArrow(fn, f"{key} {edges.schema[key].dataType.simpleString()}, pairs long, digest string")


def read_match_list(spark: SparkSession, paths: str) -> DataFrame:
    return _lines(spark, paths).select("path", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))


#: Below this a distortion coefficient counts as none.
STRAIGHT = 1e-9


def _transforms(spark: SparkSession, paths: str) -> DataFrame:
    """A row for each frame of transforms.json files, its own intrinsics before the file's, with ``reason``: the
    first ground on which it can't be used, or null."""
    names = ["fl_x", "fl_y", "cx", "cy", "w", "h", "k1", "k2", "k3", "k4", "p1", "p2"]
    frames = f"array<struct<file_path:string,transform_matrix:array<array<double>>,{','.join(n + ':double' for n in names)}>>"
    raw = spark.read.schema(f"camera_model string, {', '.join(n + ' double' for n in names)}, frames {frames}").json(paths, multiLine=True)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    rows = raw.select("path", F.col("camera_model").alias("_declared"), *[F.col(n).alias("_" + n) for n in names], F.explode("frames").alias("f"))
    pick = {n: F.coalesce(F.col(f"f.{n}"), F.col("_" + n)) for n in names}
    bend = {n: F.coalesce(pick[n], F.lit(0.0)) for n in ("k1", "k2", "k3", "k4", "p1", "p2")}
    none = lambda *n: functools.reduce(lambda x, y: x & y, [F.abs(bend[c]) <= STRAIGHT for c in n])
    declared = {"PINHOLE": "PINHOLE", "SIMPLE_PINHOLE": "PINHOLE", "OPENCV": "OPENCV", "OPENCV_FISHEYE": "OPENCV_FISHEYE"}
    known = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    free = F.when(none(*bend), "PINHOLE").otherwise("OPENCV")
    model = F.when(F.col("_declared").isNull(), free).otherwise(F.try_element_at(known, F.col("_declared")))
    fits = F.when(model == "PINHOLE", none(*bend)).when(model == "OPENCV", none("k3", "k4")).otherwise(none("p1", "p2"))
    straight = [pick[n] for n in ("fl_x", "fl_y", "cx", "cy")]
    params = F.when(model == "PINHOLE", F.array(*straight)).when(model == "OPENCV", F.array(*straight, *[bend[n] for n in ("k1", "k2", "p1", "p2")]))
    params = params.otherwise(F.array(*straight, *[bend[n] for n in ("k1", "k2", "k3", "k4")]))
    whole = lambda n: F.coalesce((pick[n] > 0) & (F.rint(pick[n]) == pick[n]), F.lit(False))
    image = F.regexp_replace(F.col("f.file_path"), r"^(\./)+", "")
    again = F.count("*").over(W.partitionBy("path", "image")) > 1
    own = rows.select("path", image.alias("image"), model.alias("model"), pick["w"].cast("int").alias("w"), pick["h"].cast("int").alias("h"), params.alias("params"), F.flatten("f.transform_matrix").alias("matrix"), *[
        c.alias(f"_{i}") for i, c in enumerate((functools.reduce(lambda x, y: x | y, [c.isNull() for c in straight]), ~(whole("w") & whole("h")), model.isNull(), ~F.coalesce(fits, F.lit(True))))
    ])
    pose = geometry.world_to_camera(F.col("matrix"))["valid"]
    reason = (
        F.when(F.coalesce(F.trim("image"), F.lit("")) == "", "invalid_path").when(again, "duplicate_path").when(F.col("_0"), "missing_intrinsics").when(F.col("_1"), "invalid_dimensions")
        .when(F.col("_2"), "unsupported_model").when(F.col("_3"), "inconsistent_distortion").when(~F.coalesce(pose, F.lit(False)), "invalid_pose")
    )
    return own.withColumn("reason", reason).drop("_0", "_1", "_2", "_3")


def import_transforms(spark: SparkSession, paths: str) -> DataFrame:
    """(path, image, camera_id, model, w, h, params, matrix) of transforms.json files.

    A frame's own intrinsics stand before the file's; the model is the declared one, or PINHOLE without and OPENCV
    with distortion. Distinct intrinsics are cameras, numbered by first image. Frames of ``transform_violations``
    are left out.
    """
    own = _transforms(spark, paths).where("reason is null").drop("reason")
    first = own.groupBy("path", "model", "w", "h", "params").agg(F.min("image").alias("_first"))
    numbered = first.withColumn("camera_id", F.row_number().over(W.partitionBy("path").orderBy("_first"))).drop("_first")
    return own.join(numbered, ["path", "model", "w", "h", "params"]).select("path", "image", "camera_id", "model", "w", "h", "params", "matrix")


def transform_violations(spark: SparkSession, paths: str) -> DataFrame:
    """(path, image, reason) of frames that can't be used: invalid_path, duplicate_path, missing_intrinsics,
    invalid_dimensions, unsupported_model, inconsistent_distortion (with the model), invalid_pose."""
    return _transforms(spark, paths).where("reason is not null").select("path", "image", "reason")


def import_keyframes(spark: SparkSession, paths: str, blurry: float = 25.0) -> DataFrame:
    """(folder, image, camera_id, model, w, h, params, matrix, blurry) of keyframe JSON files, one for each image.

    Blurry keyframes (a score of ``blurry`` or less) are marked and kept. Distinct intrinsics are a folder's
    cameras, numbered by first image. ``matrix`` has three rows of four.
    """
    spots = [f"t_{i}{j}" for i in range(3) for j in range(4)]
    schema = ", ".join(f"{c} double" for c in ("fx", "fy", "cx", "cy", "width", "height", "blur_score", *spots))
    raw = spark.read.schema(schema).json(paths, multiLine=True).select("*", F.col("_metadata.file_path").alias("_path"))
    own = raw.select(
        F.regexp_extract("_path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("_path", r"([^/]+)\.json$", 1).alias("image"), F.lit("PINHOLE").alias("model"),
        F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), F.array("fx", "fy", "cx", "cy").alias("params"), F.array(*spots).alias("matrix"),
        F.coalesce(F.col("blur_score") <= blurry, F.lit(False)).alias("blurry"),
    )
    first = own.groupBy("folder", "w", "h", "params").agg(F.min("image").alias("_first"))
    numbered = first.withColumn("camera_id", F.row_number().over(W.partitionBy("folder").orderBy("_first"))).drop("_first")
    return own.join(numbered, ["folder", "w", "h", "params"]).select("folder", "image", "camera_id", "model", "w", "h", "params", "matrix", "blurry")
