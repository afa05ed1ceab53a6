"""Image retrieval: descriptors of small pictures, and batches of images over a retrieval graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, BINS = 16, 8
#: Pictures described at a time; what is between a picture and its descriptor is many times their size.
AT_ONCE = 256
#: Red, green and blue in luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def describe(rgb: np.ndarray) -> np.ndarray:
    """Rows of unit length for pictures (n, 16, 16, 3) of bytes: scaled luminance, its slopes, and histograms."""
    p = rgb.astype(np.float64) / 255
    light = p @ np.array(LUMINANCE)
    flat = light.reshape(len(p), -1)
    own = flat - flat.mean(axis=1, keepdims=True)
    own = own / np.maximum(own.std(axis=1, keepdims=True), 0.05)
    across = np.concatenate([np.diff(light, axis=2), np.zeros((len(p), SIDE, 1))], axis=2).reshape(len(p), -1)
    down = np.concatenate([np.diff(light, axis=1), np.zeros((len(p), 1, SIDE))], axis=1).reshape(len(p), -1)
    place = np.minimum(BINS - 1, (p * BINS).astype(np.int64)).reshape(len(p), -1, 3)
    shares = [np.stack([(place[:, :, c] == b).mean(axis=1) for b in range(BINS)], 1) for c in range(3)]
    out = np.concatenate([own * 0.5, across * 0.25, down * 0.25, *shares], axis=1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def retrieval_descriptors(images: DataFrame) -> DataFrame:
    """Adds ``v`` (array of 792) of the 16 by 16 picture in ``rgb`` (binary, row by row); null without enough bytes."""

    @F.pandas_udf("array<double>")
    def fn(raw: pd.Series) -> pd.Series:
        fine = [b is not None and len(b) >= 3 * SIDE * SIDE for b in raw]
        out: list = [None] * len(raw)
        rows = np.flatnonzero(fine)
        for first in range(0, len(rows), AT_ONCE):
            some = rows[first : first + AT_ONCE]
            pictures = np.stack([np.frombuffer(raw.iloc[i], np.uint8, 3 * SIDE * SIDE).reshape(SIDE, SIDE, 3) for i in some])
            for i, v in zip(some, describe(pictures), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return images.withColumn("v", fn("rgb"))


def _grow(links: np.ndarray, chosen: np.ndarray, n: int) -> list[int]:
    """n more nodes, each the one with most neighbours among those chosen before (the smallest on ties), or
    fewer where no node is left."""
    taken, counts, out = chosen.copy(), links[:, chosen].sum(axis=1), []
    while len(out) < n and not taken.all():
        score = np.where(taken, -1, counts)
        i = int(np.argmax(score))
        if score[i] <= 0:
            raise LookupError("disconnected")
        out.append(i)
        taken[i] = True
        counts = counts + links[:, i]
    return out


def plan_batches(links: np.ndarray, size: int, overlap: int) -> list[list[int]]:
    """Batches of at most ``size`` nodes that cover a connected graph, each with anchors among earlier ones.

    Anchors are those with most neighbours in the batch, then those of the batch before, then the latest.
    """
    n = len(links)
    if n <= size:
        return [list(range(n))] if n else []
    if size < 4:
        raise LookupError("window_too_small")
    keep = min(max(2 if size == 4 else 3, overlap), size - 2)
    start = np.zeros(n, bool)
    start[0] = True
    batches = [[0, *_grow(links, start, size - 1)]]
    order = list(batches[0])
    while len(order) < n:
        seen = np.zeros(n, bool)
        seen[order] = True
        fresh = _grow(links, seen, size - keep)
        near = links[:, fresh].sum(axis=1)
        when = {node: i for i, node in enumerate(order)}
        last = set(batches[-1])
        anchors = sorted(order, key=lambda i: (-near[i], i not in last, -when[i]))[:keep]
        batches.append(sorted(anchors) + fresh)
        order += fresh
    return batches


def graph_batches(images: DataFrame, edges: DataFrame, size: int, overlap: int) -> DataFrame:
    """(group_id, batch, place, id, status): batches of images over the retrieval graph of their group.

    images: (group_id, id), edges: (group_id, a, b). Growth is greedy, so a group (hundreds of images) is one
    task. A disconnected group, or one that needs several batches of fewer than four, has one row that says so.
    """

    def fn(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        columns = ["group_id", "batch", "place", "id", "status"]
        if not len(own):
            return pd.DataFrame([], columns=columns)
        ids = np.sort(own["id"].unique())
        links = np.zeros((len(ids), len(ids)), bool)
        known = pairs[pairs["a"].isin(ids) & pairs["b"].isin(ids) & (pairs["a"] != pairs["b"])]
        a, b = (np.searchsorted(ids, known[c].to_numpy()) for c in "ab")
        links[a, b] = links[b, a] = True
        group = own["group_id"].iloc[0]
        try:
            if len(ids) > size:
                start = np.zeros(len(ids), bool)
                start[0] = True
                _grow(links, start, len(ids))
            batches = plan_batches(links, size, overlap)
        except LookupError as problem:
            return pd.DataFrame([(group, None, None, None, str(problem))], columns=columns)
        return pd.DataFrame([(group, i, j, ids[x], "ok") for i, batch in enumerate(batches) for j, x in enumerate(batch)], columns=columns)

    return images.groupBy("group_id").cogroup(edges.groupBy("group_id")).applyInPandas(fn, "group_id long, batch int, place int, id long, status string")
