"""Which way is up: the canonical vertical of a model, its accuracy, and its application."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemill.functions import geometry

#: What counts as support, and the gates of the estimate.
LEAST_CAMERAS, LEAST_OBSERVATIONS, HUBER = 8, 20, np.radians(8.0)
SPREAD, GAP, MEDIAN, TAIL, WIDE_TAIL, VARIATION, CONFLICT = 0.03, 25.0, 3.0, 8.0, 15.0, 5.0, 15.0
ROUNDS, DRAWS, AXIS_SEED, UP_SEED = 3, 32, 0x7A5B68E934C1D20F, 0x0D312F8A71C649B5
_OUT = (
    "status string, method string, qw double, qx double, qy double, qz double, support int, e0 double, e1 double, e2 double, "
    "median_residual double, p90_residual double, up_agreement double, sign_agreement double, variation double, plane_angle double, line double"
)


def rank_of(values: np.ndarray, p: float) -> float:
    """sorted[ceil(p n) - 1]"""
    return float(np.sort(values)[max(1, int(np.ceil(p * len(values)))) - 1])


def draws(seed: int, n: int) -> np.ndarray:
    """n numbers of the SplitMix64 generator."""
    u = np.uint64
    x = u(seed & (2**64 - 1)) + u(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def one_sign(v: np.ndarray) -> np.ndarray:
    """The vector or its opposite, whichever has its largest part (the first of equal ones) positive."""
    return -v if v[int(np.argmax(np.abs(v)))] < 0 else v


def flattest(vectors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(axis, eigenvalues upwards, which add up to 1) of the weighted mean of the vectors' outer products; the axis
    is the one that they are most nearly perpendicular to."""
    if weights.sum() <= 0:
        return None
    values, axes = np.linalg.eigh(np.einsum("i,ij,ik->jk", weights, vectors, vectors) / weights.sum())
    values = np.maximum(0, values)
    return (one_sign(axes[:, 0]), values / values.sum()) if values.sum() > 1e-15 else None


def robust_axis(vectors: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    found = flattest(vectors, base)
    for _ in range(ROUNDS):
        if found is None:
            return None
        off = np.arcsin(np.minimum(1, np.abs(vectors @ found[0])))
        found = flattest(vectors, base * np.where(off <= HUBER, 1, HUBER / np.maximum(off, 1e-15)))
    return found


def _samples(seed: int, n: int) -> np.ndarray:
    """DRAWS rows of indices, four fifths of n in each."""
    m = max(1, int(np.ceil(0.8 * n)))
    return (draws(seed, DRAWS * m) % np.uint64(n)).astype(np.int64).reshape(DRAWS, m)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(a @ b, -1, 1)))


def turning(v: np.ndarray, to: np.ndarray) -> list[float]:
    """Quaternion (w x y z, its first part that is not 0 positive) of the smallest turn from one unit vector to another:
    half the angle about what is perpendicular to both; for opposite ones about what is perpendicular to v and to
    the axis that v leans to least."""
    cosine = float(np.clip(v @ to, -1, 1))
    if cosine <= -1 + 1e-14:
        q = np.array([0.0, *np.cross(v, np.eye(3)[int(np.argmin(np.abs(v)))])])
    else:
        q = np.array([1 + cosine, *np.cross(v, to)]) if cosine < 1 - 1e-14 else np.array([1.0, 0, 0, 0])
    q = q / np.linalg.norm(q)
    first = q[np.flatnonzero(q)[0]]
    return (q * np.sign(first) + 0.0).tolist()


def upright(v: np.ndarray) -> list[float]:
    """The smallest turn of the unit vector v to +y."""
    return turning(v, np.array([0.0, 1.0, 0.0]))


def _trajectory(centres: np.ndarray) -> tuple[np.ndarray | None, float | None]:
    """(normal of the plane that the centres lie in, share of their spread along one line), where they tell."""
    off = centres - centres.mean(axis=0)
    extent = np.linalg.norm(off, axis=1).max(initial=0)
    if len(off) < LEAST_CAMERAS or not np.isfinite(extent) or extent <= 0:
        return None, None
    off, apart = off / extent, []
    for c in off:
        if len(apart) < LEAST_CAMERAS and all(np.linalg.norm(c - a) > 1e-9 for a in apart):
            apart.append(c)
    if len(apart) < LEAST_CAMERAS:
        return None, None
    found = flattest(off, np.ones(len(off)))
    if found is None:
        return None, None
    axis, values = found
    return (axis if values[1] >= SPREAD and values[1] / max(values[0], 1e-9) >= GAP else None), float(values[2])


def estimate(right: np.ndarray, up: np.ndarray, centres: np.ndarray, fallback: bool, seed: int) -> tuple:
    """The values of _OUT for one model's usable cameras, in the order of their names."""
    none = (None,) * 4
    if not len(right) or (found := robust_axis(right, np.ones(len(right)))) is None:
        return ("unresolved", None, *none, len(right), *(None,) * 10)
    axis, values = found
    varied = []
    for picks in _samples(seed + AXIS_SEED, len(right)):
        one = robust_axis(right, np.bincount(picks, minlength=len(right)).astype(float))
        varied.append(90.0 if one is None else float(np.degrees(np.arccos(min(1, abs(one[0] @ axis))))))
    variation = rank_of(np.array(varied), 0.95)
    off = np.degrees(np.arcsin(np.minimum(1, np.abs(right @ axis))))
    median, tail = rank_of(off, 0.5), rank_of(off, 0.9)
    normal, line = _trajectory(centres)
    plane = None if normal is None else float(np.degrees(np.arccos(min(1, abs(normal @ axis)))))
    votes = up @ axis
    plus, minus = int((votes > 0).sum()), int((votes < 0).sum())
    agree, sign = rank_of(np.abs(votes), 0.5), max(plus, minus) / len(votes)
    seen = lambda v: (len(right), *map(float, values), median, tail, agree, sign, v, plane, line)
    enough, open_ = len(right) >= LEAST_CAMERAS, plane is None or plane <= CONFLICT
    clear = values[1] >= SPREAD and values[1] / max(values[0], 1e-9) >= GAP
    known = agree >= 0.20 and sign >= 0.75
    if enough and clear and open_ and median <= MEDIAN and variation <= VARIATION and tail <= WIDE_TAIL:
        vertical = -axis if known and minus > plus else axis
        status = "verified" if known and tail <= TAIL else "axis_aligned_sign_unverified"
        return (status, "camera_right_nullspace", *upright(vertical), *seen(variation))
    if fallback and enough and not clear and open_ and line is not None and line >= 0.90:
        mean = up.mean(axis=0)
        size = np.linalg.norm(mean)
        if size > 0:
            spread = _angle(up, mean / size)
            sums = up[_samples(seed + UP_SEED, len(up))].sum(axis=1)
            sizes = np.linalg.norm(sums, axis=1)
            turned = np.where(sizes > 0, _angle(sums / np.maximum(sizes, 1e-300)[:, None], mean / size), 180.0)
            variation_up = rank_of(turned, 0.95)
            if size >= 0.90 and rank_of(spread, 0.5) <= 10 and rank_of(spread, 0.9) <= 20 and variation_up <= VARIATION:
                return ("verified", "camera_up_consensus", *upright(mean / size), *seen(variation_up))
    return ("unresolved", "camera_right_nullspace", *none, *seen(variation))


def canonical_orientation(cameras: DataFrame, observations: DataFrame, fallback: bool = True, seed: int = 0) -> DataFrame:
    """Per model: status, the rotation from the model's to upright coordinates (+y up), and the evidence for it.

    The vertical is what all cameras' right axes are perpendicular to; its sign is that of most image ups. Only
    cameras with 20 observations or more count. status: verified, axis_aligned_sign_unverified (weak sign, or a
    tail of residuals up to 15 degrees) or unresolved (no rotation). ``fallback`` allows the mean image up for
    cameras along a line. cameras: (model_id, image_id, name, q*, t*); observations: (model_id, image_id). One
    group for each model, of a few numbers for each camera; bootstraps are the same in every run.
    """
    rows = geometry.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    centre = geometry.centre(rows, tuple(F.col(c) for c in ("tx", "ty", "tz")))
    seen = observations.groupBy("model_id", "image_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_OBSERVATIONS)
    named = {f"r{i}": rows[0][i] for i in range(3)} | {f"u{i}": -rows[1][i] for i in range(3)} | {f"c{i}": centre[i] for i in range(3)}
    own = cameras.join(seen, ["model_id", "image_id"], "left").select("model_id", "name", "_n", *[v.alias(k) for k, v in named.items()])

    def fn(model: pd.DataFrame) -> pd.DataFrame:
        at = lambda k: used[[f"{k}{i}" for i in range(3)]].to_numpy(float)
        used = model[model["_n"].notna()].sort_values(["name", "_n"], kind="stable")
        long = lambda v: (v > 0) & np.isfinite(v)
        used = used[long(np.linalg.norm(at("r"), axis=1)) & long(np.linalg.norm(at("u"), axis=1))]
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        values = estimate(unit(at("r")), unit(at("u")), at("c"), fallback, seed)
        return pd.DataFrame([(model["model_id"].iloc[0], *values)], columns=["model_id", *[f.split()[0] for f in _OUT.split(", ")]])

    return own.groupBy("model_id").applyInPandas(fn, f"model_id long, {_OUT}")


def _product(a: tuple, b: tuple) -> tuple:
    w, x, y, z = a
    p, q, r, s = b
    return (w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def _turns(orientation: DataFrame) -> DataFrame:
    fine = F.col("qw").isNotNull()
    return orientation.select("model_id", *[F.when(fine, F.col(c)).alias(f"_{c}") for c in ("qw", "qx", "qy", "qz")])


def _own_turn() -> tuple:
    return tuple(F.coalesce(f"_{c}", F.lit(float(c == "qw"))) for c in ("qw", "qx", "qy", "qz"))


def orient_poses(poses: DataFrame, orientation: DataFrame) -> DataFrame:
    """Poses (model_id, q*, t*) in upright coordinates; unchanged where the orientation is unresolved."""
    names = ("qw", "qx", "qy", "qz")
    own = poses.join(_turns(orientation), "model_id", "left")
    w, x, y, z = _own_turn()
    turned = _product(tuple(F.col(c) for c in names), (w, -x, -y, -z))
    return own.select(*[turned[names.index(c)].alias(c) if c in names else F.col(c) for c in poses.columns])


def orient_points(points: DataFrame, orientation: DataFrame) -> DataFrame:
    """Points (model_id, x, y, z) in upright coordinates; unchanged where the orientation is unresolved."""
    own = points.join(_turns(orientation), "model_id", "left")
    rows = geometry.rotation(*_own_turn())
    moved = {c: geometry.dot(rows[i], (F.col("x"), F.col("y"), F.col("z"))) for i, c in enumerate("xyz")}
    return own.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in points.columns])


#: When the alignment of a model with its ground truth can be trusted.
TRUTH_HUBER, TRUTH_MEDIAN, TRUTH_TAIL, DOMINANT, LEAD = 3.0, 1.0, 3.0, 0.75, 0.5
_ACCURACY = "support int, alignment array<double>, median_residual double, p90_residual double, up_error double, sign_correct boolean, outcome string"


def orientation_error(candidate: DataFrame, truth: DataFrame, orientation: DataFrame, up: DataFrame) -> DataFrame:
    """Per model: how far the canonical up is from the physical one, in degrees, and whether its sign is right.

    candidate, truth: rotations (model_id, name, qw, qx, qy, qz) from the world to the camera, bound by name;
    orientation as of ``canonical_orientation``; up: (model_id, ux, uy, uz), the physical up in the truth's world.
    outcome: ok, unresolved (no error), unavailable (fewer than 8 names in common) or untrusted.
    """
    names = ("qw", "qx", "qy", "qz")
    both = candidate.select("model_id", "name", *names).join(truth.select("model_id", "name", *[F.col(c).alias("g" + c) for c in names]), ["model_id", "name"])
    ours, theirs = tuple(F.col(c) for c in names), tuple(F.col("g" + c) for c in names)
    apart = _product((theirs[0], -theirs[1], -theirs[2], -theirs[3]), ours)
    rows = both.select("model_id", *[a.alias(c) for a, c in zip(apart, names, strict=True)])
    known = orientation.select("model_id", "status", *[F.col(c).alias("o" + c) for c in names]).join(up, "model_id")

    def main(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, float]:
        values, axes = np.linalg.eigh(np.einsum("i,ij,ik->jk", w, q, q))
        return axes[:, 3], values[3] / w.sum(), (values[3] - values[2]) / w.sum()

    def fn(apart: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m in model.to_dict("records"):
            q = apart[list(names)].sort_values(list(names)).to_numpy(float)
            if len(q) < LEAST_CAMERAS:
                out.append((m["model_id"], len(q), None, None, None, None, None, "unavailable"))
                continue
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            far = lambda e: 2 * np.degrees(np.arccos(np.minimum(1, np.abs(q @ e))))
            w = np.ones(len(q))
            for _ in range(ROUNDS):
                off = far(main(q, w)[0])
                w = np.where(off <= TRUTH_HUBER, 1, TRUTH_HUBER / np.maximum(off, 1e-12))
            e, share, lead = main(q, w)
            off = far(e)
            median, tail = float(np.median(off)), rank_of(off, 0.9)
            e = one_sign(e) if e[0] == 0 else e * np.sign(e[0])
            head = (m["model_id"], len(q), e.tolist(), median, tail)
            if share < DOMINANT or lead < LEAD or median > TRUTH_MEDIAN or tail > TRUTH_TAIL:
                out.append((*head, None, None, "untrusted"))
            elif m["status"] == "unresolved":
                out.append((*head, None, None, "unresolved"))
            else:
                turn = lambda r, v: v + 2 * np.cross(r[1:], np.cross(r[1:], v) + r[0] * v)
                own = turn(e * [1, -1, -1, -1], np.array([m["ux"], m["uy"], m["uz"]], float))
                now = turn(np.array([m["o" + c] for c in names], float), own)
                y = float(np.clip(now[1] / np.linalg.norm(now), -1, 1))
                sure = m["status"] == "verified"
                out.append((*head, float(np.degrees(np.arccos(y if sure else abs(y)))), bool(y > 1e-12) if sure else None, "ok"))
        return pd.DataFrame(out, columns=["model_id", *[f.split()[0] for f in _ACCURACY.split(", ")]])

    return rows.groupBy("model_id").cogroup(known.groupBy("model_id")).applyInPandas(fn, f"model_id long, {_ACCURACY}")
