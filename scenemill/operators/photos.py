"""Evidence on photos: descriptors and quality, checks of the evidence, and the choice of photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemill.functions import ranks
from scenemill.operators.frames import rank_diverse

#: Weights of red, green and blue in luma, cb and cr, in 256ths.
LUMA, CB, CR = (77, 150, 29), (-43, -85, 128), (128, -107, -21)
DESCRIPTOR = 64
_HASH = "^[0-9a-f]{64}$"


def _cells(values: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Whole means (cut towards 0) of a picture's values in a grid of cells, row by row."""
    height, width = values.shape
    y, x = (np.minimum(n - 1, np.arange(size) * n // size) for n, size in ((rows, height), (columns, width)))
    cell = (y[:, None] * columns + x[None, :]).reshape(-1)
    sums = np.bincount(cell, values.reshape(-1), rows * columns).astype(np.int64)
    counts = np.maximum(1, np.bincount(cell, minlength=rows * columns))
    return np.sign(sums) * (np.abs(sums) // counts)


def _toward_zero(a: int, b: int) -> int:
    return int(a / b) if abs(a) < 2**50 else (abs(a) // b) * (1 if a >= 0 else -1)


def descriptor(rgb: np.ndarray) -> np.ndarray:
    """The 64 bytes of a picture (height, width, 3): normalised luma of 8 x 4 cells, both chromas of 4 x 2, the
    directions of gradients in both halves, luma of 2 x 2, aspect, contrast, saturation and gradient."""
    p = rgb.astype(np.int64)
    height, width = p.shape[:2]
    mixed = lambda w: (p @ np.array(w) + 128) >> 8
    luma = mixed(LUMA)
    grid = _cells(luma, 4, 8)
    mean = int(grid.sum()) // 32
    spread = int(np.abs(grid - mean).sum()) // 32
    scale = max(8, spread)
    level = lambda g: [128 + _toward_zero((int(v) - mean) * 64, scale) for v in g]
    chroma = np.stack([_cells(128 + mixed(CB), 2, 4), _cells(128 + mixed(CR), 2, 4)], 1).reshape(-1)
    turns, slope = np.zeros((2, 4), np.int64), 0
    if width > 2 and height > 2:
        clipped = np.clip(luma, 0, 255)
        dx, dy = clipped[1:-1, 2:] - clipped[1:-1, :-2], clipped[2:, 1:-1] - clipped[:-2, 1:-1]
        ax, ay = np.abs(dx), np.abs(dy)
        way = np.where(ax > 2 * ay, 0, np.where(ay > 2 * ax, 1, np.where((dx >= 0) == (dy >= 0), 2, 3)))
        half = np.broadcast_to((np.arange(1, width - 1) >= width // 2).astype(np.int64), way.shape)
        turns = np.bincount((half * 4 + way).reshape(-1), (ax + ay).reshape(-1), 8).astype(np.int64).reshape(2, 4)
        slope = int((ax + ay).sum()) // way.size
    turns = turns * 255 // np.maximum(1, turns.sum(axis=1, keepdims=True))
    shine = int((p.max(axis=2) - p.min(axis=2)).sum()) // max(1, height * width)
    aspect = 128 + _toward_zero((width - height) * 127, max(1, width, height))
    all_ = [*level(grid), *chroma, *turns.reshape(-1), *level(_cells(luma, 2, 2)), aspect, spread * 4, shine, slope]
    return np.clip(np.array(all_, np.int64), 0, 255)


def quality_bucket(laplacian: Column, blur: Column, brightness: Column, clipped: Column) -> Column:
    """0 to 255 of a picture's scores: sharpness and contrast, less for exposure, clipping and darkness."""
    whole = lambda x: F.floor(x)  # noqa: E731  # of numbers that are never negative
    sharp = F.least(F.lit(180), whole(F.log2(F.greatest(laplacian, F.lit(0.0)) + 1) * 18))
    contrast = F.least(F.lit(50), whole(F.greatest(blur, F.lit(0.0)) * 2))
    off = whole(F.abs(brightness - 0.45) * 120) + whole(F.greatest(clipped, F.lit(0.0)) * 150) + F.when(brightness < 0.05, 40).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(255), 40 + sharp + contrast - off)).cast("int")


def photo_descriptors(photos: DataFrame) -> DataFrame:
    """Adds ``descriptor`` (array of 64) of the picture in ``rgb`` (binary, row by row) of ``width`` by ``height``.

    A picture without enough bytes, or of no size, has a null descriptor. Pictures of a batch are worked on one
    by one, so only their own bytes are in memory.
    """

    @F.pandas_udf("array<int>")
    def describe(raw: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for b, w, h in zip(raw, width, height, strict=True):
            fine = b is not None and w > 0 and h > 0 and len(b) >= 3 * int(w) * int(h)
            out.append(descriptor(np.frombuffer(b, np.uint8, 3 * int(w) * int(h)).reshape(int(h), int(w), 3)).tolist() if fine else None)
        return pd.Series(out)

    return photos.withColumn("descriptor", describe("rgb", F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))))


def validate_evidence(photos: DataFrame) -> DataFrame:
    """(capture_id, sha256, reason): what makes a capture's evidence unusable; no row for sound ones.

    photos: (capture_id, sha256, descriptor, proxy_w, proxy_h, proxy_sha256, recipe_version, recipe_sha256). A
    recipe is compared with that of the row with the smallest hash.
    """
    hash_ = lambda c: F.coalesce(F.col(c).rlike(_HASH), F.lit(False))
    order = ["invalid_sha256", "duplicate_sha256", "descriptor_length", "proxy_size", "invalid_proxy_sha256", "recipe_version", "invalid_recipe_sha256", "mixed_recipe_version", "mixed_recipe_sha256"]
    first = photos.groupBy("capture_id").agg(F.min(F.struct("sha256", "recipe_version", "recipe_sha256")).alias("_f"))
    several = photos.groupBy("capture_id", "sha256").agg((F.count("*") > 1).alias("_twice"))
    own = photos.join(several, ["capture_id", "sha256"], "left").join(first, "capture_id", "left")
    checks = [
        ~hash_("sha256"), F.coalesce("_twice", F.lit(False)), F.coalesce(F.size("descriptor") != DESCRIPTOR, F.lit(True)),
        ~F.coalesce((F.col("proxy_w") > 0) & (F.col("proxy_h") > 0), F.lit(False)), ~hash_("proxy_sha256"),
        ~F.coalesce(F.col("recipe_version") > 0, F.lit(False)), ~hash_("recipe_sha256"),
        ~F.col("recipe_version").eqNullSafe(F.col("_f.recipe_version")), ~F.col("recipe_sha256").eqNullSafe(F.col("_f.recipe_sha256")),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in zip(checks, order, strict=True)]))
    return own.select("capture_id", "sha256", F.explode(reasons).alias("reason")).distinct()


def select_photos(photos: DataFrame, mode: str, budget: int) -> DataFrame:
    """(capture_id, strategy, admission, sha256, place, rank): the chosen photos of each capture.

    ``use_all``: all, in the order of their hash, none of a capture with more than ``budget``; ``continuous``:
    even positions in the order of admission; ``diverse``: the first of ``rank_diverse``. ``place`` counts the
    chosen ones in their capture's order, ``rank`` as the strategy chose them. Photos: (capture_id, admission,
    sha256, descriptor, quality), one row for each hash.
    """
    # a rank within what was chosen: at most `budget` rows of a capture, but for use_all
    if mode == "continuous":
        rows = ranks.number_rows(photos.select("capture_id", "admission", "sha256"), "capture_id", ["admission", "sha256"])
        if budget == 1:
            chosen = rows.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")
        else:
            chosen = rows.where(ranks.even_positions(F.col("_n"), F.col("_i"), budget)).drop("_i", "_n")
        placed = ranks.number_rows(chosen, "capture_id", ["admission", "sha256"]).withColumn("rank", F.col("_i"))
    elif mode == "use_all":
        rows = ranks.number_rows(photos.select("capture_id", "admission", "sha256"), "capture_id", ["sha256", "admission"])
        placed = rows.where(F.col("_n") <= budget).withColumn("rank", F.col("_i"))
    else:
        best = rank_diverse(photos, budget).select("capture_id", "sha256", "rank")
        chosen = photos.select("capture_id", "admission", "sha256").join(best, ["capture_id", "sha256"])
        placed = ranks.number_rows(chosen, "capture_id", ["sha256"])
    return placed.select("capture_id", F.lit(mode).alias("strategy"), "admission", "sha256", F.col("_i").cast("int").alias("place"), F.col("rank").cast("int").alias("rank"))
