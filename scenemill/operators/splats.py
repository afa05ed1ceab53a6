"""Splat tables and the isolation of a subject."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions import ranks
from scenemill.functions.storage import cut, kept

#: Fixed value: the least weight of a pixel contribution, in single precision.
LEAST_WEIGHT = float(np.float32(0.04))
#: Fixed value: the constant term of spherical harmonics.
SH0 = 0.2820948


#: The constants of spherical harmonics of degree 1, 2 and 3.
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def sh_basis(x, y, z) -> list:
    """The 15 terms of degree 1 to 3 for a unit direction, as columns or as any numbers."""
    flat, out = x * x + y * y, [-SH1 * y, SH1 * z, -SH1 * x]
    out += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2 * z * z - flat), SH2[3] * x * z, SH2[4] * (x * x - y * y)]
    rim = 4 * z * z - flat
    out += [SH3[0] * y * (3 * x * x - y * y), SH3[1] * x * y * z, SH3[2] * y * rim, SH3[3] * z * (2 * z * z - 3 * flat)]
    return out + [SH3[4] * x * rim, SH3[5] * z * (x * x - y * y), SH3[6] * x * (x * x - 3 * y * y)]


def sh_color(splats: DataFrame, cameras: DataFrame) -> DataFrame:
    """(scene, view_id, row_index, red, green, blue): colour of each splat from each of its scene's cameras.

    f_dc_0 to 2 hold the constant term, sh_rest 15 terms of red, then green, then blue. A splat at the camera
    is seen along (0, 0, 1). cameras: a few for each scene (scene, view_id, cx, cy, cz).
    """
    gap = {f"_{c}": F.col(c) - F.col("c" + c) for c in "xyz"}
    seen = splats.join(cameras, "scene").withColumns(gap)
    size = F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in "xyz"), F.lit(0.0)))
    seen = seen.withColumn("_size", size)
    unit = {f"_{c}": F.when(F.col("_size") > 0, F.col(f"_{c}") / F.col("_size")).otherwise(F.lit(float(c == "z"))) for c in "xyz"}
    seen = seen.withColumns(unit).withColumn("_b", F.array(*sh_basis(F.col("_x"), F.col("_y"), F.col("_z"))))
    terms = lambda k: F.zip_with(F.slice("sh_rest", 15 * k + 1, 15), "_b", lambda a, b: a * b)
    shade = lambda k: F.greatest(F.lit(0.0), SH0 * F.col(f"f_dc_{k}") + F.aggregate(terms(k), F.lit(0.0), lambda s, t: s + t) + 0.5)
    return seen.select("scene", "view_id", "row_index", *[shade(k).alias(c) for k, c in enumerate(("red", "green", "blue"))])


def _odd(c) -> Column:
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def validate_splats(splats: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``reason``, the first ground on which a row is bad, or null.

    Grounds: a column of ``columns`` that is no finite number; a rotation shorter than 1e-8 (where there are
    rot_0 to rot_3); another number of higher terms than 45, or one that is no number, in sh_rest (null: none);
    a colour outside 0 to 255 (where there are color_0 to color_2).
    """
    checks = [F.when(_odd(c), F.lit(f"non_finite_{c}")) for c in columns]
    if "rot_0" in splats.columns:
        size = F.sqrt(sum((F.col(f"rot_{i}").cast("double") ** 2 for i in range(4)), F.lit(0.0)))
        checks.append(F.when(size < 1e-8, F.lit("degenerate_rotation")))
    if "sh_rest" in splats.columns:
        checks.append(F.when(F.size("sh_rest") != 45, F.lit("sh_count")))
        checks.append(F.when(F.exists("sh_rest", lambda x: _odd(x.cast("double"))), F.lit("non_finite_sh")))
    if "color_0" in splats.columns:
        for i in range(3):
            checks.append(F.when(~F.col(f"color_{i}").cast("double").between(0, 255), F.lit("color_range")))
    return splats.withColumn("reason", F.coalesce(*checks))


def _half(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x.astype(np.float16)


def _definite(c: list[np.ndarray]) -> np.ndarray:
    """Whether symmetric matrices (xx, xy, xz, yy, yz, zz) in half precision have no negative minor."""
    xx, xy, xz, yy, yz, zz = (x.astype(np.float64) for x in c)
    whole = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    minors = [xx, yy, zz, xx * yy - xy * xy, xx * zz - xz * xz, yy * zz - yz * yz, whole]
    return np.logical_and.reduce([m >= 0 for m in minors])


def encode_splats(splats: DataFrame) -> DataFrame:
    """Adds red, green, blue, alpha, covariance (xx, xy, xz, yy, yz, zz in half precision) and reason.

    The covariance is that of the turned and scaled splat; where rounding makes it indefinite, its diagonal
    goes up by a unit of the last place, twice at most. Colours are those of the constant harmonic (f_dc_0 to 2)
    or color_0 to 2 of 0 to 255; alpha is the sigmoid of the opacity. A row with a reason has no encoding.
    """
    numbers = ["x", "y", "z", "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]
    harmonic = "f_dc_0" in splats.columns
    shade = [f"f_dc_{i}" if harmonic else f"color_{i}" for i in range(3)]

    def fn(batches):
        for b in batches:
            f = {c: b[c].to_numpy(np.float32, na_value=np.nan) for c in [*numbers, *shade]}
            with np.errstate(all="ignore"):
                scale = np.exp(np.stack([f[f"scale_{i}"] for i in range(3)], 1))
                q = np.stack([f[f"rot_{i}"] for i in range(4)], 1)
                size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                w, x, y, z = (q * (1 / size).astype(np.float32)[:, None]).T
                rows = np.stack([
                    1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
                    2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
                ], 1).reshape(-1, 3, 3)
                turned = rows * scale[:, None, :]
                full = np.einsum("nij,nkj->nik", turned, turned)
                part = [full[:, i, j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
                half = [_half(v) for v in part]
                for _ in range(2):
                    off = ~_definite(half)
                    for k in (0, 3, 5):
                        half[k] = np.where(off, np.nextafter(half[k], np.float16(np.inf)), half[k])
                c = np.stack([f[k] for k in shade], 1)
                color = np.maximum(0, np.float32(0.5) + np.float32(SH0) * c) if harmonic else c / np.float32(255)
                o = f["opacity"].astype(np.float64)
                alpha = np.where(o >= 0, 1 / (1 + np.exp(-np.abs(o))), np.exp(-np.abs(o)) / (1 + np.exp(-np.abs(o)))).astype(np.float32)
                all_ = lambda *v: np.logical_and.reduce([np.isfinite(x) for x in v])
                grounds = [
                    ("non_finite_position", ~all_(f["x"], f["y"], f["z"])), ("non_finite_opacity", ~np.isfinite(o)),
                    ("non_finite_log_scale", ~all_(*[f[f"scale_{i}"] for i in range(3)])), ("non_finite_scale", ~all_(*scale.T)),
                    ("non_finite_rotation", ~all_(*q.T)), ("degenerate_rotation", ~(size >= 1e-8)),
                    ("non_finite_covariance", ~all_(*part)), ("unrepresentable_covariance", ~all_(*[_half(v) for v in part])),
                    ("indefinite_covariance", ~(all_(*half) & _definite(half))),
                    ("invalid_color", ~all_(*_half(c).T) if harmonic else ~((c >= 0) & (c <= 255)).all(axis=1)),
                ]
            reason = np.full(len(b), None, object)
            for name, bad in reversed(grounds):
                reason[bad] = name
            fine = reason == None  # noqa: E711
            out = b.copy()
            for k, name in enumerate(("red", "green", "blue")):
                out[name] = np.where(fine, color[:, k], np.nan)
            out["alpha"] = np.where(fine, alpha, np.nan)
            out["covariance"] = [m.tolist() if ok else None for m, ok in zip(np.stack(half, 1).astype(np.float32), fine, strict=True)]
            yield out.assign(reason=reason)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in splats.schema)
    made = splats.mapInPandas(fn, f"{own}, red float, green float, blue float, alpha float, covariance array<float>, reason string")
    return made.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("red", "green", "blue", "alpha")})


def scene_bounds(splats: DataFrame) -> DataFrame:
    """(scene, rows, visible, cx, cy, cz, radius): per-axis medians of the visible rows; the radius is the
    nearest-rank 99.5% distance from there plus three largest scales. All rows count where few are visible."""
    seen = 1 / (1 + F.exp(-F.col("opacity"))) >= 0.01
    rows = splats.withColumn("_seen", seen)
    count = rows.groupBy("scene").agg(F.count("*").alias("rows"), F.count_if("_seen").alias("visible"))
    enough = F.col("visible") >= F.greatest(F.lit(8), F.ceil(F.col("rows") / 1000))
    used = rows.join(count, "scene").where(F.col("_seen") | ~enough)
    used = cut(used)
    middle = count.join(ranks.percentiles_of(used, "scene", {c: {"c" + c: ("middle", 0.5)} for c in "xyz"}), "scene")
    off = F.sqrt(sum(((F.col(c) - F.col("c" + c)) ** 2 for c in "xyz"), F.lit(0.0))) + 3 * F.exp("scale")
    far = used.drop("rows", "visible").join(middle.select("scene", "cx", "cy", "cz"), "scene").withColumn("_d", off)
    return middle.join(ranks.percentiles(far, "scene", "_d", {"radius": ("rank", 0.995)}), "scene")


def systematic_sample(df: DataFrame, limit: int, key: str, order: str) -> DataFrame:
    """At most ``limit`` rows of each key at even positions, rounded half away from zero."""
    placed = ranks.number_rows(df, key, [order])
    return placed.where(ranks.even_positions(F.col("_n"), F.col("_i"), limit)).drop("_i", "_n")


def depth_rank(splats: DataFrame, cameras: DataFrame, radial: bool = True) -> DataFrame:
    """(scene, view_id, row_index, place): front to back by single-precision depth, ties by row.

    cameras: a few for each scene (scene, view_id, cx, cy, cz, fx, fy, fz).
    """
    gap = [F.col(c) - F.col("c" + c) for c in "xyz"]
    depth = sum((g * g for g in gap), F.lit(0.0)) if radial else sum((g * F.col("f" + c) for g, c in zip(gap, "xyz", strict=True)), F.lit(0.0))
    seen = splats.join(cameras, "scene").select("scene", "view_id", "row_index", depth.cast("float").alias("_d"))
    placed = ranks.number_rows(seen, ["scene", "view_id"], ["_d", "row_index"])
    return placed.select("scene", "view_id", "row_index", (F.col("_i") + 1).cast("int").alias("place"))


def lift(contributions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the weights alpha * transmittance of at least LEAST_WEIGHT, and with centrality, per view,
    gaussian and label. Partial sums are combined before the shuffle."""
    w = F.col("alpha") * F.col("transmittance")
    rows = contributions.withColumn("_w", w).where(F.col("_w") >= LEAST_WEIGHT)
    return rows.groupBy(*keys, "view_id", "held_out", "gaussian", "label").agg(F.sum("_w").alias("weight"), F.sum(F.col("_w") * F.col("centrality")).alias("central"))


def reduce_view(lifted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per view and gaussian: visible and foreground weight, the best label (lowest on ties), whether it is
    assigned (0.55 of what is visible), and the mean centrality."""
    best = F.max(F.struct("weight", (-F.col("label")).alias("neg"))).alias("_b")
    out = lifted.groupBy(*keys, "view_id", "held_out", "gaussian").agg(
        F.sum("weight").alias("visible"), F.sum(F.when(F.col("label") != 0, F.col("weight")).otherwise(0.0)).alias("foreground"), best, F.sum("central").alias("_c")
    )
    return out.select(
        *keys, "view_id", "held_out", "gaussian", "visible", "foreground", (-F.col("_b.neg")).alias("label"),
        ((F.col("_b.weight") >= 0.55 * F.col("visible")) & (F.col("visible") >= LEAST_WEIGHT)).alias("assigned"),
        F.least(F.greatest(F.col("_c") / F.col("visible"), F.lit(0.0)), F.lit(1.0)).alias("centrality"),
    )


def classify(gaussians: DataFrame, reduced: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds views, fg (foreground share), background_views and kind to every gaussian; unobserved is background."""
    kept = reduced.where(~F.col("held_out") & (F.col("visible") >= LEAST_WEIGHT))
    seen = kept.groupBy(*keys, "gaussian").agg(F.count("*").alias("views"), (F.sum("foreground") / F.sum("visible")).alias("fg"), F.avg((F.col("label") == 0).cast("double")).alias("background_views"))
    out = gaussians.join(seen, [*keys, "gaussian"], "left").fillna({"views": 0, "fg": 0.0, "background_views": 0.0})
    return out.withColumn("kind", F.when(F.col("fg") >= 0.65, "foreground").when(F.col("fg") <= 0.35, "background").otherwise("uncertain"))


def soft_iou(pixels: DataFrame) -> DataFrame:
    """(view_id, label, iou): sum of alpha inside a label over the union with what is rendered, best label last.

    pixels: (view_id, label, alpha); label 0 is outside.
    """
    whole = pixels.groupBy("view_id").agg(F.sum("alpha").alias("_all"))
    inside = pixels.where("label <> 0").groupBy("view_id", "label").agg(F.sum("alpha").alias("_in"), F.count("*").alias("_px"))
    return inside.join(whole, "view_id").select("view_id", "label", (F.col("_in") / (F.col("_px") + F.col("_all") - F.col("_in"))).alias("iou"))


def held_out_verdict(ious: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(views, median, quartile, passed) of each view's best label: a median of 0.70 or more, and 0.50 or more at
    the first quartile (sorted[floor((n - 1) / 4)]). ious: (view_id, label, iou); a few hundred views a scene."""
    best = ious.groupBy(*keys, "view_id").agg(F.max("iou").alias("iou"))
    values = F.array_sort(F.collect_list("iou"))
    out = best.groupBy(*keys).agg(F.count("*").alias("views"), F.median("iou").alias("median"), F.get(values, F.floor((F.count("*") - 1) / 4).cast("int")).alias("quartile"))
    return out.withColumn("passed", F.coalesce((F.col("median") >= 0.70) & (F.col("quartile") >= 0.50), F.lit(False)))


def _spread_bits(x: Column) -> Column:
    """16 bits with two free ones after each."""
    for shift, mask in ((32, 0xFFFF00000000FFFF), (16, 0x00FF0000FF0000FF), (8, 0xF00F00F00F00F00F), (4, 0x30C30C30C30C30C3), (2, 0x9249249249249249)):
        mask = mask if mask < 2**63 else mask - 2**64
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def tiles(points: DataFrame, rows: int) -> DataFrame:
    """``points`` (scene, row_index, x, y, z and more) with ``tile``: rows near each other in tiles of ``rows``,
    whatever their density.

    Tiles are runs of the order along a curve through space (interleaved bits of the position in the scene)."""
    ends = points.groupBy("scene").agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    step = lambda c: F.least(F.lit(65535), F.floor((F.col(c) - F.col(f"_l{c}")) / F.greatest(F.col(f"_h{c}") - F.col(f"_l{c}"), F.lit(1e-300)) * 65536)).cast("long")
    code = F.shiftleft(_spread_bits(step("x")), 2).bitwiseOR(F.shiftleft(_spread_bits(step("y")), 1)).bitwiseOR(_spread_bits(step("z")))
    placed = ranks.number_rows(points.join(ends, "scene").select(*points.columns, code.alias("_code")), "scene", ["_code", "row_index"])
    return placed.select(*points.columns, F.expr(f"_i div {rows}").alias("tile"))


def crowds(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, first): where more than k rows are equal in ``keys``, the smallest k + 1 of their row_index.

    Rows are cut to the first k + 1 of a crowd in their tasks, before the shuffle, so one crowd may hold most of a table."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("row_index"))
    first = points.select(*keys, "row_index").withColumn("_i", place).where(F.col("_i") <= k + 1)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("row_index")).alias("first")).where(F.size("first") > k)


def near_tiles(boxes: DataFrame, slack: float, fan: int = 16) -> DataFrame:
    """(scene, tile, otile, box of otile): other tiles whose box is no farther than a tile's reach.

    boxes: (scene, tile, reach, lx to hz of the rows that ask, olx to ohz of those that can be found; null where
    there are none). Runs of ``fan`` tiles make a node, runs of nodes the next level, up to at most ``fan`` nodes of
    a scene. Pairs of near nodes go down level by level, so tiles meet through their nodes only.
    """
    spans = [f"{o}{n}{c}" for o in ("", "o") for n in "lh" for c in "xyz"]
    found = [s for s in spans if s.startswith("o")]
    levels, top = [boxes.withColumnRenamed("tile", "node")], boxes.agg(F.max("tile")).first()[0] or 0
    while top >= fan:
        up = levels[-1].groupBy("scene", F.expr(f"node div {fan}").alias("node"))
        levels.append(cut(up.agg(F.max("reach").alias("reach"), *[(F.min if s[-2] == "l" else F.max)(s).alias(s) for s in spans])))
        top //= fan
    gap = lambda c: F.greatest(F.lit(0.0), F.col("ol" + c) - F.col("h" + c), F.col("l" + c) - F.col("oh" + c))
    near = F.sqrt(sum((gap(c) ** 2 for c in "xyz"), F.lit(0.0))) <= F.col("reach") * slack
    pairs = None
    for level in reversed(levels):
        asks = level.where("reach is not null").select("scene", "node", "reach", *[s for s in spans if s not in found])
        finds = level.where("olx is not null").select("scene", F.col("node").alias("onode"), *found)
        if pairs is None:
            met = asks.join(finds, "scene")
        else:
            below = pairs.withColumnsRenamed({"node": "_up", "onode": "_oup"})
            met = below.join(asks.withColumn("_up", F.expr(f"node div {fan}")), ["scene", "_up"]).join(finds.withColumn("_oup", F.expr(f"onode div {fan}")), ["scene", "_oup"])
        pairs = met.where(near).select("scene", "node", "onode", *(found if level is levels[0] else []))
        if level is not levels[0]:
            pairs = cut(pairs)
    return pairs.where("node <> onode").withColumnsRenamed({"node": "tile", "onode": "otile"})


def _nearest(q: pd.DataFrame, r: pd.DataFrame, k: int, turned: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of each query's k nearest of r, by distance and then id; -1 and infinity where there are
    fewer. Queries are worked on in blocks."""
    r = r.sort_values("row_index", kind="stable")
    ids, p, own, at = r["row_index"].to_numpy(), r[["x", "y", "z"]].to_numpy(float), q["row_index"].to_numpy(), q[["x", "y", "z"]].to_numpy(float)
    near, far = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
    for i in range(0, len(q), 128):
        a, block = at[i : i + 128], q.iloc[i : i + 128]
        d = np.sqrt((p[:, 0] - a[:, :1]) ** 2 + (p[:, 1] - a[:, 1:2]) ** 2 + (p[:, 2] - a[:, 2:]) ** 2)
        if turned:
            cosine = sum(block[c].to_numpy()[:, None] * r[c].to_numpy()[None, :] for c in ("fx", "fy", "fz"))
            d = d / block["spacing"].to_numpy()[:, None] * (1.5 - 0.5 * cosine)
        d[ids[None, :] == own[i : i + 128, None]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(d, top, 1)
        near[i : i + 128, : top.shape[1]] = np.where(np.isfinite(best), ids[top], -1)
        far[i : i + 128, : top.shape[1]] = best
    return near, far


def knn(splats: DataFrame, k: int = 16, tile_rows: int = 2000, turned: bool = False, block: int = 16384) -> DataFrame:
    """(scene, row_index, place, neighbour, distance): exact k nearest by distance, then row.

    Rows meet those of their own tile first; that bounds how far each one's neighbours can be. Then a row goes
    to the other tiles whose box is within that bound (``near_tiles``), ``block`` rows at a time, and the best k of
    all are kept. Of a position that more than k rows share, those rows need only its smallest row numbers, and so do
    all others: a crowd of any size costs no search. Rows with a position that is no finite number take no part;
    row_index must tell the rows of a scene apart.

    ``turned``: rows also have a unit direction (fx, fy, fz) and a ``spacing`` of their scene above 0, and what counts
    is the distance in spacings times 1.5 - 0.5 * cosine of the directions. That is no metric, but never less than the
    distance in spacings, so the same boxes bound it.
    """
    more = ["fx", "fy", "fz"] if turned else []
    columns = ["scene", "row_index", "x", "y", "z", *more, *(["spacing"] if turned else [])]
    odd = _odd("x") | _odd("y") | _odd("z")
    for c in more:
        odd = odd | _odd(c)
    fine = splats.where(~odd).withColumn("scene", F.col("scene").cast("long")).withColumn("row_index", F.col("row_index").cast("long")).select(*columns)
    spot = ["scene", "x", "y", "z"]
    fine = kept(fine)  # read by several steps
    many = kept(crowds(fine, spot, k))
    alike = kept(crowds(fine, [*spot, *more], k)) if turned else many
    told = fine.join(many.withColumnRenamed("first", "_crowd"), spot, "left").join(alike.withColumnRenamed("first", "_alike"), [*spot, *more], "left")
    told = told.withColumn("asks", F.col("_crowd").isNull()).withColumn("found", F.col("_alike").isNull() | F.array_contains("_alike", F.col("row_index")))
    own = cut(tiles(told.where("asks or found").select(*columns, "asks", "found"), tile_rows))
    shape = ", ".join(f"{c} {t}" for c, t in own.dtypes)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        q = rows[rows["asks"]]
        near, far = _nearest(q, rows, k, turned)
        bound = far[:, -1] * (q["spacing"].to_numpy() if turned else 1.0)
        return q.assign(near=pd.Series(list(near), q.index, object), far=pd.Series(list(far), q.index, object), reach=bound)

    first = cut(own.groupBy("scene", "tile").applyInPandas(inside, f"{shape}, near array<long>, far array<double>, reach double"))
    ends = lambda o: [f(c).alias(f"{o}{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    asking = first.groupBy("scene", "tile").agg(F.max("reach").alias("reach"), *ends(""))
    boxes = cut(asking.join(own.where("found").groupBy("scene", "tile").agg(*ends("o")), ["scene", "tile"], "full"))
    slack = 1 + (1e-5 if turned else 1e-9)  # distances and directions are rounded; ties count
    off = F.sqrt(sum((F.greatest(F.lit(0.0), F.col("ol" + c) - F.col(c), F.col(c) - F.col("oh" + c)) ** 2 for c in "xyz"), F.lit(0.0)))
    asked = first.select(*columns, "tile", "reach").join(near_tiles(boxes, slack), ["scene", "tile"]).where(off <= F.col("reach") * slack)
    asked = cut(asked.drop("tile").withColumnRenamed("otile", "tile").select(*columns, "tile"))
    load = asked.groupBy("scene", "tile").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    asked = asked.join(load, ["scene", "tile"]).select(*columns, "tile", F.expr("cast(pmod(xxhash64(row_index), _blocks) as int) as block"))
    against = own.where("found").join(load.withColumnRenamed("_blocks", "_of"), ["scene", "tile"]).select(*columns, "tile", F.expr("explode(sequence(0, _of - 1)) as block"))

    def outside(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        near, far = _nearest(q, r, k, turned)
        return pd.DataFrame({"scene": q["scene"].to_numpy(), "row_index": q["row_index"].to_numpy(), "near": pd.Series(list(near), dtype=object), "far": pd.Series(list(far), dtype=object)})

    met = asked.groupBy("scene", "tile", "block").cogroup(against.groupBy("scene", "tile", "block")).applyInPandas(outside, "scene long, row_index long, near array<long>, far array<double>")
    both = first.select("scene", "row_index", "near", "far").unionByName(met)
    rows = both.select("scene", "row_index", F.explode(F.arrays_zip("near", "far")).alias("f")).where("f.near >= 0").select("scene", "row_index", F.col("f.near").alias("neighbour"), F.col("f.far").alias("distance"))
    place = F.row_number().over(W.partitionBy("scene", "row_index").orderBy("distance", "neighbour"))
    searched = rows.withColumn("place", place).where(F.col("place") <= k).select("scene", "row_index", "place", "neighbour", "distance")
    others = F.slice(F.filter("first", lambda i: i != F.col("row_index")), 1, k)
    crowded = fine.join(many, spot).select("scene", "row_index", F.posexplode(others).alias("_p", "neighbour"))
    return searched.unionByName(crowded.select("scene", "row_index", (F.col("_p") + 1).alias("place"), "neighbour", F.lit(0.0).alias("distance")))


def finalise_subject(classified: DataFrame, selected: DataFrame, neighbours: DataFrame, most_background: float = 0.8, least: int = 13, passes: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, gaussian): members without those mostly seen as background, plus uncertain ones with enough selected
    neighbours, added in synchronous passes. neighbours: (keys, gaussian, neighbour)."""
    on = [*keys, "gaussian"]
    members = selected.join(classified, on).where(F.col("background_views") <= most_background).select(*on)
    unsure = classified.where("kind = 'uncertain'").select(*on)
    for _ in range(passes):
        hits = neighbours.join(members.withColumnRenamed("gaussian", "neighbour"), [*keys, "neighbour"], "left_semi").distinct()
        more = hits.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") >= least).join(unsure, on, "left_semi")
        members = members.unionByName(more.select(*on)).distinct()
    return members


def retained_check(classified: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("scene",), least: float = 0.001, most: float = 0.9) -> DataFrame:
    """(keys, retained, outcome): selected if the finished subject has between ``least`` and ``most`` of its scene."""
    whole = classified.groupBy(*keys).agg(F.count("*").alias("_n"))
    own = members.groupBy(*keys).agg(F.count("*").alias("_k"))
    out = whole.join(own, list(keys), "left").withColumn("retained", F.coalesce("_k", F.lit(0)) / F.col("_n"))
    return out.select(*keys, "retained", F.when(F.col("retained").between(least, most), "selected").otherwise("ambiguous").alias("outcome"))
