"""Video frames and photos: scores, schedules, selection, budgets, duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenemill.functions import ranks
from scenemill.functions.storage import kept


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _finite(x: Column, otherwise: float) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, x).otherwise(F.lit(otherwise))


def exposure_ev(brightness: Column, most: Column) -> Column:
    """Lift in stops for dark frames that can take one; 0 for others and for lifts under 0.15."""
    lift = F.least(F.lit(1.0), F.log2(F.lit(0.24) / brightness), F.log2(F.lit(0.98) / most))
    dark = (brightness >= 0.02) & (brightness < 0.18) & (most > 0) & (most < 0.98)
    return F.when(dark & (lift >= 0.15), lift).otherwise(F.lit(0.0))


def quality(sharpness: Column, brightness: Column, clipped: Column, motion: Column) -> Column:
    """Sharpness, less for clipping and poor light, a little more for motion. Odd values count as the neutral or worst one."""
    s, b = F.greatest(_finite(sharpness, 0.0), F.lit(0.0)), _clamp(_finite(brightness, 0.5), 0, 1)
    c, m = _clamp(_finite(clipped, 1.0), 0, 1), _clamp(_finite(motion, 0.0), 0, 1)
    # Where light counts as poor, and what it costs.
    light = F.when(b < 0.18, F.least(F.lit(0.45), (F.lit(0.18) - b) * 1.8)).when(b > 0.88, F.least(F.lit(0.55), (b - 0.88) * 2.5)).otherwise(F.lit(0.0))
    return s * (F.greatest(F.lit(0.05), 1 - F.least(F.lit(0.85), c * 1.5) - light) * (1 + m * 0.03))


def near_duplicate(a: Column, b: Column, most: int = 8) -> Column:
    """At most ``most`` bits differ between two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)) <= most


def score_luma(frames: DataFrame, width: int = 64, height: int = 64) -> DataFrame:
    """Adds blur, laplacian, brightness, clipped, max_component and dhash of the grid in ``luma`` (binary).

    A missing or short grid scores 0, and 1 clipped. The grid itself is dropped: nothing later needs it.
    """

    def fn(batches):
        for b in batches:
            rows = []
            for raw in b["luma"]:
                if raw is None or len(raw) < width * height:
                    rows.append((0.0, 0.0, 0.0, 1.0, 0.0, 0))
                    continue
                g = np.frombuffer(raw, np.uint8, width * height).reshape(height, width).astype(np.int64)
                edges = np.abs(np.diff(g, axis=1)).sum() + np.abs(np.diff(g, axis=0)).sum()
                lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
                small = g[np.arange(8)[:, None] * height // 8, np.arange(9)[None, :] * width // 9]
                bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
                mark = int(np.packbits(bits, bitorder="little").view("<u8")[0])
                rows.append((
                    edges / g.size, float(lap.var()) if lap.size else 0.0, g.mean() / 255, float(((g <= 5) | (g >= 250)).mean()),
                    g.max() / 255, mark - (1 << 64) if mark >> 63 else mark,
                ))
            scores = pd.DataFrame(rows, columns=["blur", "laplacian", "brightness", "clipped", "max_component", "dhash"])
            yield pd.concat([b.drop(columns="luma").reset_index(drop=True), scores], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != "luma")
    return frames.mapInPandas(fn, f"{kept}, blur double, laplacian double, brightness double, clipped double, max_component double, dhash long")


def luma_motion(now: bytes | None, then: bytes | None) -> float:
    """Mean difference of two centred grids, over 32, at most 1; 0 where one is missing or of another size."""
    if now is None or then is None or len(now) != len(then) or not len(now):
        return 0.0
    x, y = np.frombuffer(now, np.uint8).astype(float), np.frombuffer(then, np.uint8).astype(float)
    return min(1.0, float(np.abs((x - x.mean()) - (y - y.mean())).mean()) / 32)


def motion(frames: DataFrame) -> DataFrame:
    """Adds ``motion``: mean difference of centred luma grids to the clip's previous frame, over 32, at most 1.

    Where there is a column ``analysed``, only such frames count as previous ones; other frames have no motion.
    """
    order = W.partitionBy("clip_id").orderBy("frame_index")
    if "analysed" in frames.columns:
        seen = F.last(F.when(F.col("analysed"), F.col("luma")), ignorenulls=True)
        before = F.when(F.col("analysed"), seen.over(order.rowsBetween(W.unboundedPreceding, -1)))
    else:
        before = F.lag("luma").over(order)

    @F.pandas_udf("double")
    def differ(now: pd.Series, then: pd.Series) -> pd.Series:
        return pd.Series([luma_motion(a, b) for a, b in zip(now, then, strict=True)])

    return frames.withColumn("motion", differ("luma", before))


def safe_rate(rate: float) -> float:
    """Frames a second to analyse: at least one; one, where it is no positive number."""
    return max(rate, 1.0) if np.isfinite(rate) and rate > 0 else 1.0


def analysis_rate(duration: Column, target_fps: float, target_count: int) -> Column:
    """The asked rate, or three frames for each one that is wanted, whichever is more."""
    base = float(max(1, target_fps))
    fine = duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < float("inf"))
    return F.when(fine, F.greatest(F.lit(base), F.lit(3.0 * max(1, target_count)) / duration)).otherwise(F.lit(base))


class TimeRepair:
    """Times of one clip, frame by frame: each is after the one before."""

    def __init__(self, fps: float, last: float | None = None):
        self.fps, self.last = fps if np.isfinite(fps) and fps > 0 else 30.0, last

    def __call__(self, frame: int, t: float | None) -> tuple[float, bool]:
        """(time, whether it was repaired)."""
        usable = t is not None and np.isfinite(t) and t >= 0
        good = usable and (self.last is None or t > self.last)
        if not good:
            t = t if usable else frame / self.fps
            if self.last is not None and t <= self.last:
                t = self.last + 1 / self.fps
        self.last = float(t)
        return self.last, not good


class Due:
    """Whether frames of one clip are analysed: the first, then the first at or after each due time."""

    def __init__(self, rate: float, fps: float, due: float | None = None):
        rate = safe_rate(rate)
        self.step, self.due = 1.0 / rate, due
        self.tolerance = 0.5 / max(fps if np.isfinite(fps) and fps > 0 else 1.0, rate)

    def _after(self, t: float) -> float:
        return t + self.step if t + self.step > t else float(np.nextafter(t, np.inf))

    def __call__(self, t: float | None) -> bool:
        if t is None or not np.isfinite(t) or t < 0:
            return False
        reach = t + self.tolerance
        if self.due is None:
            self.due = self._after(t)
            return True
        if reach < self.due:
            return False
        ahead = self.due + (np.floor((reach - self.due) / self.step) + 1) * self.step
        self.due = float(ahead) if ahead > reach else self._after(reach)
        return True


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def repair_timestamps(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Per clip, a time that is no number or negative becomes frame / fps; one that is still not after the
    time before becomes that time plus a frame. ``repaired`` tells. A recurrence, so each clip is one group."""

    def fn(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values("frame_index", kind="stable")
        repair = TimeRepair(fps)
        done = [repair(i, t) for i, t in zip(clip["frame_index"], clip["t"], strict=True)]
        return clip.assign(t=[t for t, _ in done], repaired=[r for _, r in done])

    return frames.groupBy("clip_id").applyInPandas(fn, f"{_fields(frames)}, repaired boolean")


def schedule(frames: DataFrame, rate: float, fps: float) -> DataFrame:
    """Adds ``analysed``: the first frame, then the first at or after each due time, and always the last.

    The rate is one a second at least. Frames whose time is no number or negative are only taken as the last.
    """

    def fn(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values(["t", "frame_index"], kind="stable")
        due = Due(rate, fps)
        take = [due(t) for t in clip["t"]]
        if take:
            take[-1] = True
        return clip.assign(analysed=take)

    return frames.groupBy("clip_id").applyInPandas(fn, f"{_fields(frames)}, analysed boolean")


def select_timeline(candidates: DataFrame, count: int, spacing: float = 0.0) -> DataFrame:
    """(clip_id, slot, frame_index, t): per clip, ``count`` frames at even spacing, each the fittest near its slot.

    Fitness is quality less penalties for being off the slot, too close to the frame before, or a near
    duplicate of the last two. Ties go to the nearer, then the earlier frame. candidates: (clip_id,
    frame_index, t, q, dhash). Sequential in a clip; clips run in parallel.
    """

    def choose(t, q, h, frame, at, lo, hi, target, room, previous, recent):
        part = slice(lo, hi)
        off = np.abs(t[part] - target)
        fit = q[part] - (off / room if room > 0 else 0.0) * np.maximum(5, q[part] * 0.15)
        if previous is not None and spacing > 0:
            short = np.maximum(0, spacing - np.maximum(0, t[part] - previous)) / spacing
            fit = fit - short * q[part] * 0.2
        if recent:
            like = np.zeros(hi - lo, bool)
            for r in recent:
                like |= np.array([x is not None and ((x ^ r) & (2**64 - 1)).bit_count() <= 8 for x in h[part]])
            fit = fit - np.where(like, np.maximum(60, q[part]), 0)
        return lo + int(np.lexsort((frame[part], t[part], off, -fit))[0])

    def fn(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip[np.isfinite(clip["t"]) & (clip["t"] >= 0)].sort_values(["t", "frame_index", "q"], ascending=[True, True, False], kind="stable")
        clip = clip.drop_duplicates("frame_index")
        t, q, frame = clip["t"].to_numpy(float), clip["q"].to_numpy(float), clip["frame_index"].to_numpy()
        h = [None if pd.isna(x) else int(x) for x in clip["dhash"]]
        n = min(count, len(t))
        picks: list[int] = []
        if n == 1:
            picks = [choose(t, q, h, frame, None, 0, len(t), t[0], 0, None, [])] if len(t) > 1 else [0]
        elif n > 1:
            span = t[-1] - t[0]
            edge = min(span / 4, max(0.25, min(1, span / (n - 1) * 4)))
            hi = max(1, min(len(t) - n + 1, int(np.searchsorted(t, np.nextafter(t[0] + edge, np.inf)))))
            first = choose(t, q, h, frame, None, 0, hi, t[0], edge, None, [])
            tail = max(first + n - 1, int(np.searchsorted(t, t[-1] - edge)))
            last = choose(t, q, h, frame, None, tail, len(t), t[-1], edge, None, [])
            gap = (t[last] - t[first]) / (n - 1)
            picks, recent = [first], [h[first]] if h[first] is not None else []
            for slot in range(1, n - 1):
                target, low, high = t[first] + slot * gap, picks[-1] + 1, last - (n - slot - 1)
                a = max(low, int(np.searchsorted(t, target - gap / 2)))
                b = min(high + 1, int(np.searchsorted(t, target + gap / 2)))
                if a >= b:
                    spot = int(np.searchsorted(t, target))
                    a = max(low, min(high, spot - 1))
                    b = max(a, min(high, spot)) + 1
                picks.append(choose(t, q, h, frame, None, a, b, target, gap, t[picks[-1]], recent))
                recent = ([*recent, h[picks[-1]]] if h[picks[-1]] is not None else recent)[-2:]
            picks.append(choose(t, q, h, frame, None, max(picks[-1] + 1, tail), len(t), t[-1], edge, t[picks[-1]], recent))
        return pd.DataFrame({"clip_id": clip["clip_id"].iloc[:1].repeat(len(picks)).to_numpy(), "slot": np.arange(len(picks)), "frame_index": frame[picks], "t": t[picks]})

    return candidates.groupBy("clip_id").applyInPandas(fn, "clip_id long, slot int, frame_index int, t double")


def frame_target(clips: DataFrame, ceiling: int, rate: float, fast: bool) -> DataFrame:
    """(capture_id, target): the ceiling, or in fast mode what the videos' length asks for; null for bad lengths."""
    bad = F.bool_or(F.col("duration").isNull() | F.isnan("duration") | (F.col("duration") < 0))
    want = F.least(F.lit(ceiling), F.greatest(F.lit(30), 2 * F.count("*"), F.ceil(F.sum("duration") * rate)))
    return clips.groupBy("capture_id").agg(F.when(~bad, want if fast else F.lit(ceiling)).cast("long").alias("target"))


def _proportional(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``extra``: the ``total`` of each key shared out by ``weight`` within ``room``, largest remainder.

    Rows that are full at their share are filled first and the others share the rest; that ends at one level,
    so rows in the order of room by weight are full up to some point. A key's rows meet in windows, which
    Spark spills; ties go to the smaller ``order``.
    """
    usable = (F.col("room") > 0) & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    own = rows.withColumn("_w", F.when(F.coalesce(usable, F.lit(False)), F.col("weight"))).withColumn("_r", F.when(F.col("_w").isNotNull(), F.col("room")))
    by_level = W.partitionBy(key).orderBy(F.col("_r") / F.col("_w"), order).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(key)
    left = F.col("total") - F.coalesce(F.sum("_r").over(by_level), F.lit(0))
    weigh = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(by_level), F.lit(0.0))
    own = own.withColumn("_full", F.coalesce(F.col("_r") / F.col("_w") <= left / weigh, F.lit(False)))
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_r"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    own = own.withColumn("_rest", F.col("total") - spent).withColumn("_ideal", F.when(~F.col("_full"), F.col("_rest") * F.col("_w") / open_))
    own = own.withColumn("_whole", F.floor("_ideal"))
    own = own.withColumn("_more", F.col("_rest") - F.coalesce(F.sum("_whole").over(every), F.lit(0)))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(F.col("_ideal") - F.col("_whole")), order))
    one = F.when(place <= F.col("_more"), 1).otherwise(0)
    extra = F.when(F.col("_full"), F.col("_r")).when(F.col("_ideal").isNotNull(), F.col("_whole") + one).otherwise(F.lit(0))
    return own.withColumn("extra", extra.cast("long")).drop("_w", "_r", "_full", "_rest", "_ideal", "_whole", "_more")


def allocate(clips: DataFrame, budget: int) -> DataFrame:
    """(capture_id, clip_id, frames): two for each clip (or what it has), the rest by length, largest remainder.

    Clips that are full hand their share on; ties go to the smaller clip id. Where the budget can't cover all
    clips, or one with frames has no positive length, frames is null in the whole capture.
    """
    every = W.partitionBy("capture_id")
    fine = (F.col("duration") > 0) & (F.col("duration") < float("inf"))
    bad = (F.col("available") < 0) | ((F.col("available") > 0) & ~F.coalesce(fine, F.lit(False)))
    least = F.least(F.lit(2), F.col("available"))
    rows = clips.select("capture_id", "clip_id", F.col("available").cast("long").alias("available"), F.col("duration").cast("double").alias("weight"), bad.alias("_bad"), least.cast("long").alias("_least"))
    most = F.least(F.lit(budget).cast("long"), F.sum("available").over(every))
    rows = rows.withColumn("total", most - F.sum("_least").over(every)).withColumn("_bad", F.max("_bad").over(every)).withColumn("room", F.col("available") - F.col("_least"))
    if budget <= 0:
        return rows.select("capture_id", "clip_id", F.when(~F.col("_bad"), F.lit(0)).cast("long").alias("frames"))
    done = _proportional(rows.withColumn("_left", F.col("total")).withColumn("total", F.greatest("total", F.lit(0))), "capture_id", "clip_id")
    frames = F.when(~F.col("_bad") & (F.col("_left") >= 0), F.col("_least") + F.col("extra"))
    return done.select("capture_id", "clip_id", frames.alias("frames"))


def allocate_mixed(groups: DataFrame, budget: int, use_all_photos: bool = False) -> DataFrame:
    """(capture_id, group_id, frames) of groups (capture_id, group_id, is_video, available).

    Without ``use_all_photos`` a capture within the budget keeps all; else each video gets two frames (or what
    it has) and the rest goes by what is left in all groups. With it all photos stay and videos share what they
    leave; frames is null in the capture where photos leave less than what is reserved for videos: what there
    is, at most the larger of two a video and a quarter of the budget. Null as well where two a video is too much.
    """
    every = W.partitionBy("capture_id")
    budget = max(0, budget)
    rows = groups.select("capture_id", "group_id", "is_video", F.col("available").cast("long").alias("available"))
    photo = lambda x: F.sum(F.when(~F.col("is_video"), x).otherwise(0)).over(every)
    video = lambda x: F.sum(F.when(F.col("is_video"), x).otherwise(0)).over(every)
    if use_all_photos:
        quarter = F.greatest(2 * video(F.lit(1)), F.lit(budget // 4))
        reserve = F.least(video(F.col("available")), F.when(video(F.lit(1)) > 0, F.least(F.lit(budget), quarter)).otherwise(0))
        rows = rows.withColumn("_ok", photo(F.col("available")) <= F.greatest(F.lit(0), F.lit(budget) - reserve)).withColumn("_goal", F.greatest(F.lit(0), F.lit(budget) - photo(F.col("available"))))
        rows = rows.withColumn("_mine", F.col("is_video"))
    else:
        rows = rows.withColumn("_ok", F.lit(True)).withColumn("_goal", F.lit(budget)).withColumn("_mine", F.lit(True))
    there = F.sum(F.when(F.col("_mine"), F.col("available")).otherwise(0)).over(every)
    rows = rows.withColumn("_all", there <= F.col("_goal"))
    rows = rows.withColumn("_least", F.when(F.col("_mine") & F.col("is_video") & ~F.col("_all") & (F.col("_goal") > 0), F.least(F.lit(2), F.col("available"))).otherwise(0))
    rows = rows.withColumn("_left", F.col("_goal") - F.sum("_least").over(every)).withColumn("total", F.greatest("_left", F.lit(0)))
    rows = rows.withColumn("room", F.when(F.col("_mine"), F.col("available") - F.col("_least")).otherwise(0)).withColumn("weight", F.col("room").cast("double"))
    done = _proportional(rows, "capture_id", "group_id")
    frames = F.when(~F.col("_mine") | F.col("_all"), F.col("available")).otherwise(F.col("_least") + F.col("extra"))
    return done.select("capture_id", "group_id", F.when(F.col("_ok") & ((F.col("_left") >= 0) | F.col("_all")), frames).cast("long").alias("frames"))


def project_budget(rows: DataFrame, k: int, key: str, order: str, mode: str = "even") -> DataFrame:
    """Rows of each group, k at most. ``even``: at even positions, rounded half away from zero, the middle one
    for k = 1; ``prefix``: the first ones; ``preserve``: all, or none of a group that has more."""
    placed = ranks.number_rows(rows, key, [order])
    if mode == "prefix":
        return placed.where(F.col("_i") < k).drop("_i", "_n")
    if mode == "preserve":
        return placed.where(F.col("_n") <= k).drop("_i", "_n")
    if k == 1:
        return placed.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.round(s * (F.col("_n") - 1) / F.lit(float(k - 1))).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(spots, F.col("_i").cast("int"))).drop("_i", "_n")


def dedupe_exact(photos: DataFrame) -> DataFrame:
    """The first admitted row of each content in a capture, and how many copies it stands for."""
    return photos.groupBy("capture_id", "sha256").agg(F.min("admission").alias("admission"), (F.count("*") - 1).alias("copies"))


def dedupe_companions(photos: DataFrame) -> DataFrame:
    """Photos without the rendered one of a pair: one stem, exactly one raw and one rendered file, and as many of
    the columns width, height, exif as there are equal in both (two nulls are equal)."""
    same = [c for c in ("width", "height", "exif") if c in photos.columns]
    pair = photos.groupBy("capture_id", "stem").agg(
        F.count("*").alias("n"), F.count_if("is_raw").alias("raw"),
        *[((F.count_distinct(c) <= 1) & F.count(c).isin(0, 2)).alias(f"_{c}") for c in same],
    )
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(f"_{c}")
    drop = pair.where("n = 2 and raw = 1").where(alike).select("capture_id", "stem", F.lit(False).alias("is_raw"))
    return photos.join(drop, ["capture_id", "stem", "is_raw"], "left_anti")


#: Photos that one task scores, and candidates that a round picks from.
CHUNK, CANDIDATES = 50_000, 512


def _order(near: np.ndarray, quality: np.ndarray, sha: np.ndarray) -> np.ndarray:
    """Places from the best on: distance in steps of 64, quality, exact distance, the smaller hash."""
    return np.lexsort((sha, -near, -quality, -(near // 64)))


def _scored(candidates: int):
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        """A chunk's photos that aren't picked, with their distance to the nearest pick; the best ones are marked."""
        picks, rows = group[group["picked"]], group[~group["picked"]]
        rows = rows[~rows["sha256"].isin(picks["sha256"])]
        if len(rows) and len(picks):
            d = np.stack(rows["descriptor"].to_list()).astype(np.int32)
            near = rows["near"].to_numpy(np.int64)
            for p in picks["descriptor"]:
                far = np.abs(d - np.asarray(p, np.int32)).sum(axis=1)
                near = np.where(near < 0, far, np.minimum(near, far))
            rows = rows.assign(near=near)
        best = np.zeros(len(rows), bool)
        best[_order(rows["near"].to_numpy(np.int64), rows["quality"].to_numpy(np.int64), rows["sha256"].to_numpy())[: candidates + 1]] = True
        return rows.assign(top=best).drop(columns="picked")

    return fn


def _picked(k: int, candidates: int):
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        """The next picks among a capture's best photos: distances only shrink, so as long as the best of them is still
        ahead of the first one that isn't looked at, no other photo can overtake it."""
        rows = rows.sort_values("place").reset_index(drop=True)
        done, near, quality, sha = int(rows["done"].iloc[0]), rows["near"].to_numpy(np.int64).copy(), rows["quality"].to_numpy(np.int64), rows["sha256"].to_numpy()
        d, out = np.stack(rows["descriptor"].to_list()).astype(np.int32), []
        value = lambda i: (int(near[i]) // 64, int(quality[i]), int(near[i]))
        last = len(rows) - 1 if len(rows) > candidates else None
        bound, free = None if last is None else (value(last), sha[last]), np.ones(len(rows), bool)
        if last is not None:
            free[last] = False
        while free.any() and done + len(out) < k:
            left = np.flatnonzero(free)
            i = left[_order(near[left], quality[left], sha[left])[0]]
            if bound is not None and (value(i) < bound[0] or (value(i) == bound[0] and sha[i] > bound[1])):
                break
            out.append((rows["capture_id"].iloc[0], done + len(out), sha[i], d[i].tolist()))
            free[i] = False
            if near[i] < 0:  # the first pick of all gives every photo a distance: the others wait for it
                break
            near = np.minimum(near, np.abs(d - d[i]).sum(axis=1))
        return pd.DataFrame(out, columns=["capture_id", "rank", "sha256", "descriptor"])

    return fn


def rank_diverse(photos: DataFrame, k: int, chunk: int = CHUNK, candidates: int = CANDIDATES) -> DataFrame:
    """(capture_id, rank, sha256): greedy farthest points by L1 distance of ``descriptor``, best quality first.

    Distances count in steps of 64, then quality, exact distance and the smaller hash. Every prefix of the
    ranking is the ranking of a smaller k. In rounds: photos are scored in chunks of about ``chunk`` against the round's new picks, the
    best ``candidates`` of a capture are told by ranges, and of these as many are picked as no other photo can
    overtake; so a capture of any size is no group, and k picks take far fewer than k rounds.
    """
    kinds = "capture_id string, sha256 string, descriptor array<int>, quality int, near long, chunk long"
    own = photos.select(F.col("capture_id").cast("string").alias("capture_id"), "sha256", F.col("descriptor").cast("array<int>").alias("descriptor"), F.col("quality").cast("int").alias("quality"))
    own = own.dropDuplicates(["capture_id", "sha256"])
    sizes = own.groupBy("capture_id").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    rows = own.join(sizes, "capture_id").withColumn("near", F.lit(-1).cast("long")).withColumn("chunk", F.pmod(F.xxhash64("sha256"), F.col("chunks"))).drop("chunks")
    rows, sizes = kept(rows), kept(sizes)
    columns = [c.split()[0] for c in kinds.split(", ")]
    new = rows.limit(0).select("capture_id", F.lit(0).alias("rank"), "sha256", "descriptor")
    found = None
    for _ in range(k):
        to = new.join(sizes, "capture_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        to = to.select("capture_id", "sha256", "descriptor", F.lit(0).alias("quality"), F.lit(-1).cast("long").alias("near"), "chunk", F.lit(True).alias("picked"))
        both = rows.select(*columns, F.lit(False).alias("picked")).unionByName(to)
        scored = kept(both.groupBy("capture_id", "chunk").applyInPandas(_scored(candidates), kinds + ", top boolean"))
        order = [F.desc(F.floor(F.col("near") / 64)), F.desc("quality"), F.desc("near"), "sha256"]
        best = ranks.number_rows(scored.where("top"), "capture_id", order).where(F.col("_i") <= candidates).withColumnRenamed("_i", "place")
        done = found.groupBy("capture_id").agg(F.count("*").alias("done")) if found is not None else sizes.select("capture_id", F.lit(0).cast("long").alias("done"))
        best = best.join(done, "capture_id").where(F.col("done") < k)
        new = kept(best.groupBy("capture_id").applyInPandas(_picked(k, candidates), "capture_id string, rank int, sha256 string, descriptor array<int>"))
        if new.isEmpty():
            break
        found, rows = new if found is None else found.unionByName(new), scored.select(*columns)
    return (new if found is None else found).select("capture_id", "rank", "sha256")
