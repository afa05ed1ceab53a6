"""Binary sparse models (little-endian). A file is parsed by one task and leaves it in batches of rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Camera models by number, with their count of parameters.
MODELS = [
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
]
_BATCH = 20_000
_SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("id", "<i8")])


class _Bytes:
    """A place in a file; it must be left at the end."""

    def __init__(self, raw: bytes, path: str):
        self.raw, self.at, self.path = raw, 0, path

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        end = self.raw.index(b"\0", self.at)
        out, self.at = self.raw[self.at : end].decode("utf-8"), end + 1
        return out

    def rows(self, kind: np.dtype, count: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, count, self.at)
        self.at += count * kind.itemsize
        return out

    def done(self) -> None:
        if self.at != len(self.raw):
            raise ValueError(f"{self.path} goes on after its last row")


def _cameras(f: _Bytes) -> Iterator[tuple]:
    for _ in range(f.take("Q")[0]):
        camera, model, width, height = f.take("iiQQ")
        name, count = MODELS[model]
        yield camera, name, width, height, list(f.take(f"{count}d"))


def _images(f: _Bytes) -> Iterator[tuple]:
    for _ in range(f.take("Q")[0]):
        head = f.take("i7di")
        name = f.text()
        f.rows(_SEEN, f.take("Q")[0])
        yield *head, name


def _observations(f: _Bytes) -> Iterator[tuple]:
    for _ in range(f.take("Q")[0]):
        image = f.take("i7di")[0]
        f.text()
        for k, (x, y, point) in enumerate(f.rows(_SEEN, f.take("Q")[0]).tolist()):
            yield image, k, x, y, point  # a missing point's largest unsigned number is -1


def _points(f: _Bytes) -> Iterator[tuple]:
    for _ in range(f.take("Q")[0]):
        head = f.take("Q3d3Bd")
        track = f.rows(np.dtype(("<i4", 2)), f.take("Q")[0])
        yield *head, track.tolist()


def _read(spark: SparkSession, paths: str, parse: Callable[[_Bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["path", *(part.split()[0] for part in schema.split(", "))]

    def fn(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                own, rows = _Bytes(bytes(raw), path), []
                for row in parse(own):
                    rows.append((path, *row))
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                own.done()
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(fn, f"path string, {schema}")


def read_cameras(spark: SparkSession, paths: str) -> DataFrame:
    """(path, camera_id, model, width, height, params) of cameras.bin files."""
    return _read(spark, paths, _cameras, "camera_id long, model string, width long, height long, params array<double>")


def read_images(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """Poses (path, image_id, q*, t*, camera_id, name) and observations (path, image_id, point2d_idx, x, y,
    point_id, -1 for none) of images.bin files."""
    pose = ", ".join(f"{c} double" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))
    return (
        _read(spark, paths, _images, f"image_id long, {pose}, camera_id long, name string"),
        _read(spark, paths, _observations, "image_id long, point2d_idx long, x double, y double, point_id long"),
    )


def read_points(spark: SparkSession, paths: str) -> DataFrame:
    """(path, point_id, x, y, z, r, g, b, error, track) of points3D.bin files; track: pairs of image and index."""
    return _read(spark, paths, _points, "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<array<int>>")
