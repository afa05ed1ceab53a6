"""Operators against plain-Python versions of their rules, on small made tables."""

import itertools
import json
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenemill.functions import ranks
from scenemill.operators import alignment, conditioning, evaluation, frames, graph, models, orientation, pairs, photos, retrieval, splats
from scenemill.sources import model_files, splat_files
from scenemill.streaming.frames import stream_frames

# --- ranks -----------------------------------------------------------------------------------------------


def test_row_numbers_and_percentiles(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(i), float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True))] + [(9, 1000, 5.0), (8, 1001, None)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {r.i: (r["_i"], r["_n"]) for r in ranks.number_rows(df, "k", ["v", "i"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2], r[1]))
        assert [got[r[1]] for r in own] == [(j, len(own)) for j in range(len(own))]
    wanted = {"a": ("rank", 0.9), "b": ("middle", 0.5), "c": ("linear", 0.01), "d": ("rank", 0.0)}
    for r in ranks.percentiles(df, "k", "v", wanted).collect():
        own = np.sort([x[2] for x in rows if x[0] == r.k and x[2] is not None])
        assert r.a == own[math.ceil(0.9 * len(own)) - 1] and r.b == np.median(own) and abs(r.c - np.quantile(own, 0.01)) < 1e-9 and r.d == own[0]
    assert ranks.percentiles(df.limit(0), "k", "v", wanted).count() == 0


# --- frames ----------------------------------------------------------------------------------------------


def test_times_go_on_from_the_one_before(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 0.05, 0.04, 0.2])] + [(2, i, t) for i, t in enumerate([float("nan"), -3.0, 0.01, None, 5.0])]
    got = frames.repair_timestamps(spark.createDataFrame(rows, "clip_id long, frame_index int, t double"), 10.0).orderBy("clip_id", "frame_index").collect()
    assert np.allclose([r.t for r in got], [0, 0.05, 0.15, 0.2, 0.0, 0.1, 0.2, 0.3, 5.0])
    assert [r.repaired for r in got] == [False, False, True, False, True, True, True, True, False]


def test_schedule_clamps_its_rate_and_leaves_out_odd_times(spark):
    rows = [(1, i, t) for i, t in enumerate([float("nan"), 0.0, 0.25, 0.5, 0.9, 1.0, 3.7, 3.8, 4.2])]
    df = spark.createDataFrame(rows, "clip_id long, frame_index int, t double")
    for rate in (0.02, 1.0, float("nan"), -1.0):
        got = [r.frame_index for r in frames.schedule(df, rate, 10.0).where("analysed").orderBy("frame_index").collect()]
        assert got in ([1, 5, 6, 8], [0, 1, 5, 6, 8])  # an odd time is taken where it sorts last
    rates = spark.range(1).select(frames.analysis_rate(F.lit(10.0), 2, 100).alias("a"), frames.analysis_rate(F.lit(float("inf")), 2, 100).alias("b"))
    assert tuple(rates.first()) == (30.0, 2.0)


def test_motion_of_analysed_frames(spark):
    grids = [bytes([10, 20] * 50), bytes([20, 10] * 50), bytes([10, 20] * 50)]
    df = spark.createDataFrame([(1, i, g, i != 1) for i, g in enumerate(grids)], "clip_id long, frame_index int, luma binary, analysed boolean")
    assert [r.motion for r in frames.motion(df).orderBy("frame_index").collect()] == [0.0, 0.0, 0.0]


def shares(weights, room, total):
    """Fill what saturates, share the rest again; then floors and the largest remainders."""
    given, active, left = [0] * len(room), [i for i, w in enumerate(weights) if room[i] > 0 and w > 0], min(total, sum(room))
    while left > 0 and active:
        ideal = {i: left * weights[i] / sum(weights[j] for j in active) for i in active}
        full = [i for i in active if room[i] <= ideal[i]]
        for i in full:
            given[i], left = room[i], left - room[i]
        active = [i for i in active if i not in full]
        if full:
            continue
        for i in active:
            given[i] = int(ideal[i])
        for i in sorted(active, key=lambda i: (-(ideal[i] - int(ideal[i])), i))[: left - sum(given[i] for i in active)]:
            given[i] += 1
        break
    return given


def test_budgets_against_rounds_of_saturation(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for capture in range(60):
        n = int(rng.integers(1, 7))
        length, room = rng.integers(1, 40, n) / 4, rng.integers(0, 60, n)
        room[0] += 1
        budget = 31
        rows += [(capture, i, float(length[i]), int(room[i])) for i in range(n)]
        least = [min(2, int(r)) for r in room]
        total = min(budget, int(room.sum()))
        extra = shares(length.tolist(), [int(r) - x for r, x in zip(room, least, strict=True)], total - sum(least))
        want |= {(capture, i): least[i] + extra[i] for i in range(n)}
    got = {(r.capture_id, r.clip_id): r.frames for r in frames.allocate(spark.createDataFrame(rows, "capture_id long, clip_id long, duration double, available long"), 31).collect()}
    assert got == want
    one = spark.createDataFrame([(1, 0, 10.0, 4), (1, 1, 10.0, 100), (1, 2, 20.0, 100), (2, 0, 0.0, 5), (2, 1, 1.0, 5)], "capture_id long, clip_id long, duration double, available long")
    got = {(r.capture_id, r.clip_id): r.frames for r in frames.allocate(one, 31).collect()}
    assert [got[1, i] for i in range(3)] == [4, 10, 17] and got[2, 0] is None and got[2, 1] is None
    assert {r.frames for r in frames.allocate(one.where("capture_id = 1"), 0).collect()} == {0}


def mixed(groups, budget, use_all):
    videos, pictures = [g for g in groups if g[1]], [g for g in groups if not g[1]]
    if use_all:
        n = sum(g[2] for g in pictures)
        reserve = min(sum(g[2] for g in videos), min(budget, max(2 * len(videos), budget // 4)) if videos and budget > 0 else 0)
        if n > max(0, budget - reserve):
            return {g[0]: None for g in groups}
        rest = mixed(videos, max(0, budget - n), False)
        return {g[0]: rest[g[0]] if g[1] else g[2] for g in groups} if None not in rest.values() else {g[0]: None for g in groups}
    if budget <= 0:
        return {g[0]: 0 for g in groups}
    if sum(g[2] for g in groups) <= budget:
        return {g[0]: g[2] for g in groups}
    least = [min(2, g[2]) if g[1] else 0 for g in groups]
    if sum(least) > budget:
        return {g[0]: None for g in groups}
    room = [g[2] - x for g, x in zip(groups, least, strict=True)]
    return {g[0]: x + e for g, x, e in zip(groups, least, shares(room, room, budget - sum(least)), strict=True)}


@pytest.mark.parametrize("use_all", [False, True])
def test_mixed_budgets(spark, use_all):
    rng, budget = np.random.default_rng(5), 24 if use_all else 7
    rows, want = [], {}
    for capture in range(80):
        groups = [(i, bool(rng.integers(0, 3)), int(rng.integers(0, 30))) for i in range(int(rng.integers(1, 6)))]
        rows += [(capture, *g) for g in groups]
        want |= {(capture, i): n for i, n in mixed(groups, budget, use_all).items()}
    got = {(r.capture_id, r.group_id): r.frames for r in frames.allocate_mixed(spark.createDataFrame(rows, "capture_id long, group_id long, is_video boolean, available long"), budget, use_all).collect()}
    assert got == want and None in got.values()


def test_projection_modes(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 3)) for i in range(n)], "k long, i long")
    pick = lambda mode: sorted(map(tuple, frames.project_budget(df, 4, "k", "i", mode).collect()))
    assert pick("even") == [(1, 0), (1, 3), (1, 5), (1, 8), (2, 0), (2, 1), (2, 2)]
    assert pick("prefix") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)] and pick("preserve") == [(2, 0), (2, 1), (2, 2)]


def test_companions_need_one_size_and_one_origin(spark):
    rows = [(1, "a", True, 10, 8, "x"), (1, "a", False, 10, 8, "x"), (1, "b", True, 10, 8, "x"), (1, "b", False, 10, 9, "x"), (1, "c", True, 5, 5, None), (1, "c", False, 5, 5, "y"), (1, "d", True, 5, 5, None), (1, "d", False, 5, 5, None)]
    got = frames.dedupe_companions(spark.createDataFrame(rows, "capture_id long, stem string, is_raw boolean, width int, height int, exif string"))
    assert sorted((r.stem, r.is_raw) for r in got.collect() if not r.is_raw) == [("b", False), ("c", False)]


def test_stream_in_two_batches_carries_its_state(spark, tmp_path):
    rows = [(c, i, i * 0.1 + 0.01 * c if i % 11 != 4 else -1.0) for c in (1, 2) for i in range(40)]
    schema = "clip_id long, frame_index int, t double"
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = stream_frames(stream, 2.0, 10.0).writeStream.format("memory").queryName("two_batches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for part in (range(17), range(17, 40)):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    q.stop()
    got = {(r.clip_id, r.frame_index): (round(r.t, 9), r.repaired, r.analysed) for r in spark.table("two_batches").collect()}
    fixed = frames.repair_timestamps(spark.createDataFrame(rows, schema), 10.0)
    want = {(r.clip_id, r.frame_index): (round(r.t, 9), r.repaired, r.analysed) for r in frames.schedule(fixed, 2.0, 10.0).collect()}
    assert {k: v for k, v in got.items() if k[1] != 39} == {k: v for k, v in want.items() if k[1] != 39} and len(got) == 80


# --- photos ----------------------------------------------------------------------------------------------


def plain_descriptor(p):
    """The descriptor pixel by pixel."""
    height, width = p.shape[:2]
    cut = lambda a, b: int(math.copysign(abs(a) // b, a)) if a else 0
    clamp = lambda v: max(0, min(255, v))
    luma = lambda r, g, b: (77 * r + 150 * g + 29 * b + 128) >> 8
    cb = lambda r, g, b: 128 + ((-43 * r - 85 * g + 128 * b + 128) >> 8)
    cr = lambda r, g, b: 128 + ((128 * r - 107 * g - 21 * b + 128) >> 8)

    def means(rows, columns, of):
        sums, counts = [0] * (rows * columns), [0] * (rows * columns)
        for y in range(height):
            for x in range(width):
                c = min(rows - 1, y * rows // height) * columns + min(columns - 1, x * columns // width)
                sums[c] += of(*(int(v) for v in p[y, x]))
                counts[c] += 1
        return [cut(s, max(1, n)) for s, n in zip(sums, counts, strict=True)]

    grid = means(4, 8, luma)
    mean = sum(grid) // 32
    mad = sum(abs(v - mean) for v in grid) // 32
    level = lambda v: clamp(128 + cut((v - mean) * 64, max(8, mad)))
    out = [level(v) for v in grid]
    for a, b in zip(means(2, 4, cb), means(2, 4, cr), strict=True):
        out += [clamp(a), clamp(b)]
    bins, total, count = [0] * 8, 0, 0
    for y in range(1, height - 1):
        for x in range(1, width - 1):
            at = lambda yy, xx: luma(*(int(v) for v in p[yy, xx]))
            dx, dy = at(y, x + 1) - at(y, x - 1), at(y + 1, x) - at(y - 1, x)
            way = 0 if abs(dx) > 2 * abs(dy) else 1 if abs(dy) > 2 * abs(dx) else 2 if (dx >= 0) == (dy >= 0) else 3
            bins[(0 if x < width // 2 else 1) * 4 + way] += abs(dx) + abs(dy)
            total, count = total + abs(dx) + abs(dy), count + 1
    for h in (0, 4):
        out += [clamp(b * 255 // max(1, sum(bins[h : h + 4]))) for b in bins[h : h + 4]]
    out += [level(v) for v in means(2, 2, luma)]
    out.append(clamp(128 + cut((width - height) * 127, max(1, width, height))))
    out.append(clamp(mad * 4))
    out.append(clamp(int((p.max(axis=2).astype(int) - p.min(axis=2)).sum()) // (width * height)))
    out.append(clamp(total // max(1, count)))
    return out


def test_photo_descriptor(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, (h, w) in enumerate([(4, 8), (9, 13), (2, 2), (17, 5), (32, 32)]):
        rows.append((i, rng.integers(0, 256, (h, w, 3)).astype(np.uint8).tobytes(), w, h))
    rows += [(90, b"abc", 4, 4), (91, None, 4, 4), (92, b"abc", 0, 0)]
    got = {r.id: r.descriptor for r in photos.photo_descriptors(spark.createDataFrame(rows, "id long, rgb binary, width int, height int")).collect()}
    for i, raw, w, h in rows[:5]:
        assert got[i] == plain_descriptor(np.frombuffer(raw, np.uint8).reshape(h, w, 3)) and len(got[i]) == 64
    assert got[90] is None and got[91] is None and got[92] is None
    scores = spark.createDataFrame([(100.0, 10.0, 0.45, 0.0), (0.0, 0.0, 0.01, 1.0), (1e9, 1e9, 0.45, 0.0)], "l double, b double, m double, c double")
    assert [r[0] for r in scores.select(photos.quality_bucket(*[F.col(c) for c in "lbmc"])).collect()] == [40 + int(math.log2(101) * 18) + 20, 0, 255]


def test_selection_modes(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, f"{i * 7919 % 97:064x}", rng.integers(0, 256, 64).tolist(), int(rng.integers(0, 9))) for i in range(12)] + [("b", 0, "0" * 64, [0] * 64, 1)]
    df = spark.createDataFrame(rows, "capture_id string, admission long, sha256 string, descriptor array<int>, quality int")
    get = lambda mode, n: [(r.capture_id, r.admission, r.place, r.rank) for r in photos.select_photos(df, mode, n).orderBy("capture_id", "place").collect()]
    assert get("continuous", 4) == [("a", 0, 0, 0), ("a", 4, 1, 1), ("a", 7, 2, 2), ("a", 11, 3, 3), ("b", 0, 0, 0)]
    assert get("continuous", 1) == [("a", 6, 0, 0), ("b", 0, 0, 0)]
    assert get("use_all", 5) == [("b", 0, 0, 0)]
    diverse = get("diverse", 5)
    assert len(diverse) == 6 and sorted(x[3] for x in diverse if x[0] == "a") == [0, 1, 2, 3, 4]
    by_hash = sorted(rows, key=lambda r: r[2])
    assert [x[1] for x in diverse if x[0] == "a"] == [r[1] for r in by_hash if r[0] == "a" and r[1] in {x[1] for x in diverse if x[0] == "a"}]


def test_diverse_ranking_against_a_greedy_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(f"{i:064x}", rng.integers(0, 256, 64).tolist(), int(rng.integers(0, 5))) for i in range(40)]
    left, picks = list(rows), []
    while len(picks) < 12:
        far = lambda r: min(sum(abs(a - b) for a, b in zip(r[1], p[1], strict=True)) for p in picks) if picks else 0
        best = min(left, key=lambda r: (-(far(r) // 64), -r[2], -far(r), r[0]))
        picks.append(best)
        left.remove(best)
    got = frames.rank_diverse(spark.createDataFrame([("c", *r) for r in rows], "capture_id string, sha256 string, descriptor array<int>, quality int"), 12).orderBy("rank").collect()
    assert [r.sha256 for r in got] == [p[0] for p in picks]


# --- retrieval and pairs ---------------------------------------------------------------------------------


def test_retrieval_descriptor(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    got = np.array(retrieval.retrieval_descriptors(spark.createDataFrame([(1, p.tobytes()), (2, b"x")], "id long, rgb binary")).orderBy("id").first().v)
    rgb = p / 255
    light = rgb @ [0.2126, 0.7152, 0.0722]
    own = (light - light.mean()) / max((light - light.mean()).std(), 0.05)
    parts = [own.ravel() * 0.5, np.diff(light, axis=1, append=light[:, -1:]).ravel() * 0.25, np.diff(light, axis=0, append=light[-1:, :]).ravel() * 0.25]
    parts += [np.histogram(rgb[:, :, c], bins=8, range=(0, 1))[0] / 256 for c in range(3)]
    want = np.concatenate(parts)
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-12)


def test_batches_cover_and_overlap(spark):
    rng = np.random.default_rng(4)
    n = 40
    edges = [(1, i, i + 1) for i in range(n - 1)] + [(1, int(a), int(b)) for a, b in rng.integers(0, n, (60, 2))]
    images = spark.createDataFrame([(1, i) for i in range(n)] + [(2, i) for i in range(6)] + [(3, 0), (3, 1)], "group_id long, id long")
    got = retrieval.graph_batches(images, spark.createDataFrame(edges + [(2, 0, 1), (2, 3, 4)], "group_id long, a long, b long"), 5, 3).collect()
    assert {(r.group_id, r.status) for r in got} == {(1, "ok"), (2, "disconnected"), (3, "ok")}
    batches = {}
    for r in sorted((r for r in got if r.group_id == 1), key=lambda r: (r.batch, r.place)):
        batches.setdefault(r.batch, []).append(r.id)
    near = {i: {b for _, a, b in edges if a == i} | {a for _, a, b in edges if b == i} for i in range(n)}
    seen = set(batches[0])
    for k in range(1, len(batches)):
        fresh = [i for i in batches[k] if i not in seen]
        assert len(batches[k]) <= 5 and len(set(batches[k]) & seen) == 3
        grown = set(seen)
        for i in fresh:  # each has most links among those before, the smallest on ties
            rest = [(-len(near[j] & grown - {j}), j) for j in set(range(n)) - grown]
            assert min(rest) == (-len(near[i] & grown - {i}), i)
            grown.add(i)
        seen |= set(fresh)
    assert seen == set(range(n))


def test_camera_groups_and_pose_pairs(spark):
    rows = [(1, "m", "x", 4.25, 10, 8), (2, "m", "x", 4.25, 10, 8), (3, None, "x", 4.25, 10, 8)]
    df = spark.createDataFrame(rows, "image long, make string, model string, focal double, width int, height int")
    assert [r.camera_group for r in pairs.camera_groups(df, "automatic").orderBy("image").collect()] == ["m-x-4.250000-10x8", "m-x-4.250000-10x8", "3"]
    rng = np.random.default_rng(6)
    cams = [(1, i, *map(float, rng.normal(size=3)), *(lambda v: map(float, v / np.linalg.norm(v)))(rng.normal(size=3))) for i in range(80)]
    got = {(r.a, r.b) for r in pairs.pose_pairs(spark.createDataFrame(cams, "model_id long, image_id long, cx double, cy double, cz double, fx double, fy double, fz double")).collect()}
    c, f = np.array([r[2:5] for r in cams]), np.array([r[5:] for r in cams])
    d = np.linalg.norm(c[:, None] - c[None], axis=2)
    spacing = np.sort((d + np.diag([np.inf] * 80)).min(axis=1))[40]
    score = d / spacing * (1.5 - 0.5 * f @ f.T)
    want = {tuple(sorted((i, int(j)))) for i in range(80) for j in np.argsort(score[i] + np.where(np.arange(80) == i, np.inf, 0))[:8]}
    assert got == want


def test_clips_of_a_manifest(spark):
    rows = [(1, 5, 0, True, 0, "a", 0.0), (1, 5, 1, True, 3, "b", 0.5), (1, 2, 0, False, 2, "c", None), (1, 9, 0, True, 4, "a", 1.0), (1, 9, 1, False, 5, "d", 2.0)]
    df = spark.createDataFrame(rows, "capture_id long, clip_id long, pos int, is_video boolean, position int, image string, t double")
    assert [(r.clip_id, r.place, r.images) for r in pairs.clips_of(df).orderBy("place").collect()] == [(5, 0, 2), (2, 1, 1), (9, 2, 2)]
    assert {(r.clip_id, r.reason) for r in pairs.clip_violations(df).collect()} == {(5, "duplicate_image"), (9, "mixed_kind"), (9, "photo_with_time")}
    groups = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (2, 1, "x"), (2, 2, "y")], "capture_id long, image long, camera_group string")
    cams = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 8), (2, 1, 7), (2, 2, 7)], "capture_id long, image long, camera_id long")
    assert {r.capture_id: r.ok for r in pairs.camera_group_check(groups, cams).collect()} == {1: True, 2: False}


def test_transforms_and_their_violations(spark, tmp_path):
    eye = [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    frame = lambda path, **own: {"file_path": path, "transform_matrix": eye, **own}
    base = {"fl_x": 100, "fl_y": 101, "cx": 32, "cy": 24, "w": 64, "h": 48}
    files = {
        "a": {**base, "frames": [frame("./b.jpg"), frame("a.jpg", fl_x=90), frame("c.jpg", k1=0.1), frame("d.jpg", k1=1e-10), frame("e.jpg", k3=0.5), frame("g.jpg", w=1.5), frame("h.jpg"), frame("./h.jpg"), frame("i.jpg", transform_matrix=[[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])]},
        "b": {**base, "camera_model": "OPENCV_FISHEYE", "frames": [frame("a.jpg", k1=0.1, k4=0.2), frame("b.jpg", p1=0.1)]},
        "c": {**base, "camera_model": "PINHOLE", "frames": [frame("a.jpg", k1=0.1), frame("b.jpg")]},
        "d": {"fl_x": 1, "camera_model": "ODD", "frames": [frame("a.jpg"), frame("b.jpg", **base)]},
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    got = {(r.path[-6], r.image): r for r in model_files.import_transforms(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("a", "a.jpg"), ("a", "b.jpg"), ("a", "c.jpg"), ("a", "d.jpg"), ("b", "a.jpg"), ("c", "b.jpg")]
    assert got["a", "a.jpg"].camera_id == 1 and got["a", "b.jpg"].camera_id == 2 and got["a", "d.jpg"].camera_id == 2 and got["a", "c.jpg"].camera_id == 3
    assert got["a", "c.jpg"].model == "OPENCV" and got["a", "c.jpg"].params == [100, 101, 32, 24, 0.1, 0, 0, 0]
    assert got["b", "a.jpg"].model == "OPENCV_FISHEYE" and got["b", "a.jpg"].params == [100, 101, 32, 24, 0.1, 0, 0, 0.2]
    bad = {(r.path[-6], r.image): r.reason for r in model_files.transform_violations(spark, str(tmp_path)).collect()}
    assert bad == {
        ("a", "e.jpg"): "inconsistent_distortion", ("a", "g.jpg"): "invalid_dimensions", ("a", "h.jpg"): "duplicate_path", ("a", "i.jpg"): "invalid_pose", ("b", "b.jpg"): "inconsistent_distortion",
        ("c", "a.jpg"): "inconsistent_distortion", ("d", "a.jpg"): "missing_intrinsics", ("d", "b.jpg"): "unsupported_model",
    }


def test_written_models_read_back(spark, tmp_path):
    cameras = spark.createDataFrame([(1, 2, "PINHOLE", 64, 48, [1.5, 2.0, 3.0, 4.0]), (1, 1, "SIMPLE_PINHOLE", 6, 4, [1.0, 2.0, 3.0])], "model_id long, camera_id int, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(1, 3, 1.0, 0.0, 0.0, 0.0, 0.5, 0.25, 1e-7, 2, "a b.jpg"), (1, 2, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 1, "c.jpg")], "model_id long, image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string")
    seen = spark.createDataFrame([(1, 3, 1, 5.5, 6.5, -1), (1, 3, 0, 1.5, 2.5, 9)], "model_id long, image_id int, point2d_idx int, x double, y double, point_id long")
    text = model_files.images_text(images, seen).first().text
    assert text.split("\n")[:4] == ["2 0.5 0.5 0.5 0.5 0.0 0.0 0.0 1 c.jpg", "", "3 1.0 0.0 0.0 0.0 0.5 0.25 1.0E-7 2 a b.jpg", "1.5 2.5 9 5.5 6.5 -1"]
    (tmp_path / "images.txt").write_text(text)
    back, spots = model_files.read_images(spark, str(tmp_path / "images.txt"))
    assert {(r.image_id, r.name, r.tz, r.camera_id) for r in back.collect()} == {(3, "a b.jpg", 1e-7, 2), (2, "c.jpg", 0.0, 1)}
    assert sorted((r.point2d_idx, r.x, r.point_id) for r in spots.collect()) == [(0, 1.5, 9), (1, 5.5, -1)]
    assert model_files.cameras_text(cameras).first().text == "1 SIMPLE_PINHOLE 6 4 1.0 2.0 3.0\n2 PINHOLE 64 48 1.5 2.0 3.0 4.0\n"
    points = spark.createDataFrame([(1, 9, 0.0, float("nan"), 0.0, 1, 2, 300, 0.1), (1, 9, 0.0, 0.0, 0.0, 1, 2, 3, 0.1)], "model_id long, point_id long, x double, y double, z double, r int, g int, b int, error double")
    tracks = spark.createDataFrame([(1, 9, 0, 3, 0), (1, 8, 0, 77, 0)], "model_id long, point_id long, pos int, image_id int, point2d_idx int")
    more = images.union(images.where("image_id = 2").selectExpr("model_id", "7", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "5", "name"))
    got = {(r.kind, r.id, r.reason) for r in model_files.model_violations(cameras, more, points, tracks).collect()}
    assert got == {("image", "c.jpg", "duplicate_name"), ("image", "7", "unknown_camera"), ("point", "9", "duplicate_id"), ("point", "9", "bad_colour"), ("point", "9", "not_finite"), ("track", "8", "unknown_image"), ("track", "8", "unknown_point")}


# --- graphs ----------------------------------------------------------------------------------------------


def test_blocks_against_removal(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for capture in range(25):
        n = 9
        edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, n, (int(rng.integers(3, 14)), 2)) if e[0] != e[1]}
        if not edges:
            continue
        rows += [(capture, a, b) for a, b in edges]
        nodes = {x for e in edges for x in e}

        def parts(nodes, edges):
            root = {x: x for x in nodes}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(b)
            return len({find(x) for x in nodes})

        cuts = {x for x in nodes if parts(nodes - {x}, [e for e in edges if x not in e]) > parts(nodes, edges)}
        group = {e: e for e in edges}

        def leader(e, group=group):
            while group[e] != e:
                e = group[e]
            return e

        for e, f in itertools.combinations(sorted(edges), 2):  # edges of one block lie on one cycle
            shared = set(e) & set(f)
            if len(shared) == 1:
                (x,) = shared
                rest = [g for g in edges if x not in g]
                ends = [next(iter(set(g) - {x})) for g in (e, f)]
                root = {y: y for y in nodes - {x}}

                def find(y, root=root):
                    while root[y] != y:
                        y = root[y]
                    return y

                for a, b in rest:
                    root[find(a)] = find(b)
                if find(ends[0]) == find(ends[1]):
                    group[leader(e)] = leader(f)
        blocks = {}
        for e in edges:
            blocks.setdefault(leader(e), set()).update(e)
        sizes = sorted((len(v) for v in blocks.values()), reverse=True)
        want[capture] = (len(cuts), len(sizes), sizes[0], (sizes + [0])[1])
    got = {r.capture_id: (r.articulations, r.blocks, r.largest, r.second) for r in graph.biconnectivity(spark.createDataFrame(rows, "capture_id long, a long, b long")).collect()}
    assert got == want


def test_unfinished_components_raise(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(120)], "k long, node long")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(119)], "k long, a long, b long")
    assert {r.root for r in graph.components(nodes, edges, "k").collect()} == {0}
    with pytest.raises(RuntimeError, match="still changing"):
        graph.components(nodes, edges, "k", most_rounds=2)


def test_digests_ignore_order_and_see_changes(spark):
    rows = [(1, i, i * 3) for i in range(300)]
    digest = lambda r: graph.table_digest(spark.createDataFrame(r, "k long, i long, v long"), "k", ["i"]).first()
    a, b, c = digest(rows), digest(rows[::-1]), digest([*rows[:-1], (1, 299, 0)])
    assert a == b and a.rows == 300 and a.digest != c.digest


# --- models, alignment and orientation -------------------------------------------------------------------


def quaternion(axis, degrees):
    a = np.radians(degrees) / 2
    axis = np.array(axis, float) / np.linalg.norm(axis)
    return np.array([np.cos(a), *(np.sin(a) * axis)])


def times(a, b):
    w, x, y, z = a
    p, q, r, s = b
    return np.array([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])


def matrix(q):
    return alignment._matrices(np.array([q], float))[0]


POSES = "model_id long, image_id long, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def test_sim3_far_from_the_origin_and_its_limits(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(30, 3))
    turn = matrix(quaternion([0, 0, 1], 37))
    sets = {1: (s + 1e6, 2.5 * s @ turn.T + [4, -2, 3]), 2: (s, 30 * s), 3: (s, s * [1, 1, -1]), 4: (s, s + 0.3 * rng.normal(size=s.shape))}
    rows = [(k, *map(float, a), *map(float, b)) for k, (x, y) in sets.items() for a, b in zip(x, y, strict=True)]
    got = {r.model_id: r for r in models.estimate_sim3(spark.createDataFrame(rows, "model_id long, sx double, sy double, sz double, dx double, dy double, dz double")).collect()}
    assert got[1].status == "ok" and abs(got[1].scale - 2.5) < 1e-8 and np.allclose(np.array(got[1].rotation).reshape(3, 3), turn, atol=1e-8)
    assert [got[k].status for k in (2, 3, 4)] == ["implausible_scale", "reflection", "poor_fit"]


def ring(n=24, tilt=(30, (1, 0, 0)), noise=0.0, seed=0):
    """Upright cameras on a ring in a tilted world: world to camera = own turn times the tilt."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = times(quaternion([1, 0, 0], 5 * np.sin(i)), quaternion([0, 1, 0], 360 * i / n))
        own = times(quaternion([1, 0, 0], 180), own)  # y down, z forward
        if noise:
            own = times(quaternion(rng.normal(size=3), noise * rng.normal()), own)
        q = times(own, quaternion(tilt[1], tilt[0]))
        centre = matrix(quaternion(tilt[1], tilt[0])).T @ np.array([np.sin(2 * np.pi * i / n), 0.0, np.cos(2 * np.pi * i / n)])
        out.append((q, -matrix(q) @ centre))
    return out


def test_canonical_orientation_finds_the_vertical(spark):
    rows, seen = [], []
    for model, (cams, n) in enumerate([(ring(), 25), (ring(tilt=(70, (0, 0, 1)), noise=1.0), 25), (ring(), 5), (ring(6), 25)]):
        for i, (q, t) in enumerate(cams):
            rows.append((model, i, f"i{i:02d}", *map(float, q), *map(float, t)))
            seen += [(model, i)] * n
    poses = spark.createDataFrame(rows, POSES)
    got = {r.model_id: r for r in orientation.canonical_orientation(poses, spark.createDataFrame(seen, "model_id long, image_id long")).collect()}
    assert [got[m].status for m in range(4)] == ["verified", "verified", "unresolved", "unresolved"]
    for m, (tilt, limit) in enumerate([((30, (1, 0, 0)), 1e-6), ((70, (0, 0, 1)), 1.0)]):
        up = matrix(quaternion(tilt[1], tilt[0])).T @ [0, 1, 0]
        turned = matrix([got[m].qw, got[m].qx, got[m].qy, got[m].qz]) @ up
        assert np.degrees(np.arccos(min(1, turned[1]))) <= limit
    found = orientation.canonical_orientation(poses, spark.createDataFrame(seen, "model_id long, image_id long"))
    assert {r.model_id: r for r in found.collect()} == got  # bootstraps repeat
    again = orientation.orient_poses(poses, found)
    level = {r.model_id: r for r in orientation.canonical_orientation(again, spark.createDataFrame(seen, "model_id long, image_id long")).collect()}
    assert abs(level[0].qw - 1) < 1e-9 and again.columns == poses.columns
    assert sorted(map(tuple, again.where("model_id > 1").collect())) == sorted(map(tuple, poses.where("model_id > 1").collect()))
    point = spark.createDataFrame([(0, *map(float, matrix(quaternion((1, 0, 0), 30)).T @ [0, 2, 0])), (3, 1.0, 2.0, 3.0)], "model_id long, x double, y double, z double")
    moved = {r.model_id: (r.x, r.y, r.z) for r in orientation.orient_points(point, found).collect()}
    assert np.allclose(moved[0], (0, 2, 0), atol=1e-6) and moved[3] == (1.0, 2.0, 3.0)


def test_tails_and_lines_of_cameras(spark):
    """A tail of shaky frames leaves the sign open; cameras along a line fall back on their own up."""
    shaky = ring(40)
    for i in range(0, 40, 8):
        q, t = shaky[i]
        q = times(quaternion([0, 0, 1], 12), q)
        shaky[i] = (q, t)
    line = []
    for i in range(12):
        q = times(quaternion([1, 0, 0], 180), quaternion([0, 1, 0], 0.2 * i))
        line.append((q, -matrix(q) @ np.array([i * 1.0, 0, 0])))
    rows = [(m, i, f"i{i:02d}", *map(float, q), *map(float, t)) for m, cams in ((1, shaky), (2, line)) for i, (q, t) in enumerate(cams)]
    seen = spark.createDataFrame([(r[0], r[1]) for r in rows for _ in range(20)], "model_id long, image_id long")
    get = lambda fallback: {r.model_id: (r.status, r.method) for r in orientation.canonical_orientation(spark.createDataFrame(rows, POSES), seen, fallback).collect()}
    assert get(True) == {1: ("axis_aligned_sign_unverified", "camera_right_nullspace"), 2: ("verified", "camera_up_consensus")}
    assert get(False)[2] == ("unresolved", "camera_right_nullspace")


def test_draws_are_those_of_the_generator():
    state, out = 12345, []
    for _ in range(5):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        x = state
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(x ^ (x >> 31))
    assert orientation.draws(12345, 5).tolist() == out


def test_orientation_error(spark):
    cams = ring()
    world = quaternion([0, 1, 1], 50)  # from our world to the true one
    rows = [(1, f"i{i}", *map(float, q)) for i, (q, _) in enumerate(cams)]
    truth = [(1, f"i{i}", *map(float, times(q, world * [1, -1, -1, -1]))) for i, (q, _) in enumerate(cams)]
    schema = "model_id long, name string, qw double, qx double, qy double, qz double"
    ours, theirs = spark.createDataFrame(rows, schema), spark.createDataFrame(truth, schema)
    seen = spark.createDataFrame([(1, i) for i in range(24) for _ in range(20)], "model_id long, image_id long")
    poses = spark.createDataFrame([(1, i, f"i{i}", *map(float, q), *map(float, t)) for i, (q, t) in enumerate(cams)], POSES)
    found = orientation.canonical_orientation(poses, seen)
    true_up = matrix(world) @ matrix(quaternion((1, 0, 0), 30)).T @ [0, 1, 0]
    up = spark.createDataFrame([(1, *map(float, true_up))], "model_id long, ux double, uy double, uz double")
    got = orientation.orientation_error(ours, theirs, found, up).first()
    assert got.outcome == "ok" and got.up_error < 1e-4 and got.sign_correct and got.support == 24 and np.allclose(np.abs(np.array(got.alignment) @ world), 1)
    down = up.select("model_id", *[(-F.col(c)).alias(c) for c in ("ux", "uy", "uz")])
    assert orientation.orientation_error(ours, theirs, found, down).first().up_error > 179
    few = orientation.orientation_error(ours.limit(5), theirs, found, up).first()
    assert few.outcome == "unavailable"
    bent = theirs.withColumn("qx", F.when(F.hash("name") % 2 == 0, F.col("qx") + 1).otherwise(F.col("qx")))
    assert orientation.orientation_error(ours, bent, found, up).first().outcome == "untrusted"


def test_oriented_alignment_and_deviation(spark):
    rng = np.random.default_rng(2)
    turn, rows = quaternion([1, 2, 3], 70), []
    for window, n in ((1, 2), (2, 6), (3, 1)):
        for i in range(n):
            q = times(quaternion(rng.normal(size=3), 40), quaternion([0, 1, 0], 30 * i))
            rows.append((window, i, f"i{i}", *map(float, q), *map(float, rng.normal(size=3))))
    own = spark.createDataFrame(rows, POSES)
    sim = spark.createDataFrame([(w, "ok", 1.7, matrix(turn).reshape(-1).tolist(), [1.0, 2.0, -3.0]) for w in (1, 2, 3)], "model_id long, status string, scale double, rotation array<double>, translation array<double>")
    moved = alignment.align_poses(own, sim)
    both = own.select("model_id", "image_id", *[F.col(c).alias("s" + c) for c in alignment.POSE]).join(moved.select("model_id", "image_id", *[F.col(c).alias("d" + c) for c in alignment.POSE]), ["model_id", "image_id"])
    got = {r.model_id: r for r in alignment.estimate_oriented_sim3(both, "model_id").collect()}
    assert [got[k].status for k in (1, 2, 3)] == ["ok", "ok", "unavailable"]
    for k in (1, 2):
        assert abs(got[k].scale - 1.7) < 1e-9 and np.allclose(np.array(got[k].rotation).reshape(3, 3), matrix(turn), atol=1e-9) and np.allclose(got[k].translation, [1, 2, -3])
    checked = alignment.check_rotations(moved.withColumnRenamed("model_id", "window_id"), moved.withColumnRenamed("model_id", "window_id")).orderBy("window_id").collect()
    assert [r.ok for r in checked] == [True, True, False] and max(r.worst for r in checked) < 1e-5
    dev = {r.model_id: r for r in alignment.pose_deviation(own, moved).collect()}
    assert dev[2].status == "ok" and dev[2].centre_p95 < 1e-9 and dev[2].rotation_p95 < 1e-5
    assert dev[1].status == "unavailable" and dev[1].centre_p95 is None


def test_oriented_alignment_of_noisy_mirrored_opposite_and_flat_windows(spark):
    """Against the same definition in numpy, where views disagree: each status, and a turn by half a circle."""
    rng = np.random.default_rng(11)
    windows = {1: 5, 2: 7, 3: 2, 4: 2, 5: 3, 6: 2, 7: 4}
    rows = []
    for w, n in windows.items():
        for i in range(n):
            qs = times(quaternion(rng.normal(size=3), 25), quaternion([0, 1, 0], 40 * i))
            cs = rng.normal(size=3)
            qd, cd = qs, 1.7 * cs + [1, 2, 3]
            if w in (1, 2):
                qd, cd = times(quaternion(rng.normal(size=3), 6), qs), cd + 0.03 * rng.normal(size=3)
            if w == 2:
                cd = cd * [1, 1, -1]
            if w == 3:  # seen from behind: the baseline points the other way
                cs = np.array([0.0, 0, 1.0 * i])
                qs, qd, cd = np.array([1.0, 0, 0, 0]), np.array([1.0, 0, 0, 0]), -cs
            if w == 4:
                cd = np.ones(3)
            if w == 5:
                cd = 40 * cs
            if w == 7:
                cd = cd + rng.normal(size=3)
            rows.append((w, i, *map(float, qs), *map(float, -matrix(qs) @ cs), *map(float, qd), *map(float, -matrix(qd) @ cd)))
    schema = "window_id long, image_id long, " + ", ".join(f"{p}{c} double" for p in "sd" for c in alignment.POSE)
    got = {r.window_id: r for r in alignment.estimate_oriented_sim3(spark.createDataFrame(rows, schema)).collect()}
    assert {w: r.status for w, r in got.items()} == {1: "ok", 2: "poor_fit", 3: "ok", 4: "no_baseline", 5: "implausible_scale", 6: "ok", 7: "poor_fit"}
    assert got[4].scale is None and got[5].rotation is None and got[1].n == 5
    for w in (1, 2, 3, 6, 7):
        own = np.array([r[2:] for r in rows if r[0] == w])
        rs, rd = ([matrix(q) for q in own[:, a : a + 4]] for a in (0, 7))
        cs, cd = (np.array([-r.T @ t for r, t in zip(m, own[:, a : a + 3], strict=True)]) for m, a in ((rs, 4), (rd, 11)))
        u, _, vt = np.linalg.svd(sum(b.T @ a for a, b in zip(rs, rd, strict=True)))
        rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        both = list(itertools.combinations(range(len(cs)), 2))
        scale = np.median([np.linalg.norm(cd[j] - cd[i]) / np.linalg.norm(cs[j] - cs[i]) for i, j in both])
        i, j = max(both, key=lambda p: np.linalg.norm(cs[p[1]] - cs[p[0]]))
        a, b = rot @ (cs[j] - cs[i]), cd[j] - cd[i]
        found = np.array(got[w].rotation).reshape(3, 3)
        assert np.allclose(found @ found.T, np.eye(3)) and np.linalg.det(found) > 0 and abs(got[w].scale - scale) < 1e-9
        assert np.allclose(found @ (cs[j] - cs[i]) / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-9)
        turn = found @ rot.T
        angle = np.arccos(np.clip((np.trace(turn) - 1) / 2, -1, 1))
        assert abs(angle - np.arccos(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1))) < 1e-6  # the smallest such turn
        shift = np.median(cd - scale * cs @ found.T, axis=0)
        assert np.allclose(got[w].translation, shift)
        off = np.sqrt((((scale * cs @ found.T + shift) - cd) ** 2).sum(axis=1).mean()) / np.sqrt(((cd - cd.mean(axis=0)) ** 2).sum(axis=1).mean())
        assert abs(got[w].rmse - off) < 1e-9


def test_anchors_span_the_largest_triangle(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, *map(float, rng.normal(size=3))) for i in range(9)] + [(2, i, float(i), 0.0, 0.0) for i in range(5)] + [(3, 0, 0.0, 0.0, 0.0)]
    got = {r.window_id: r for r in alignment.select_anchors(spark.createDataFrame(rows, "window_id long, image_id long, x double, y double, z double")).collect()}
    p = {r[1]: np.array(r[2:]) for r in rows if r[0] == 1}
    area = lambda t: 0.5 * np.linalg.norm(np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]]))
    best = max(itertools.combinations(range(9), 3), key=area)
    assert (got[1].a, got[1].b, got[1].c) == best and abs(got[1].area - area(best)) < 1e-12
    assert got[2].a is None and got[3].a is None


def test_voxels_count_from_the_least_point(spark):
    rng = np.random.default_rng(4)
    p, w, c = rng.normal(size=(400, 3)), rng.integers(0, 4, 400), rng.integers(0, 256, (400, 3))
    df = spark.createDataFrame([(1, *map(float, a), float(b), *map(int, d)) for a, b, d in zip(p, w, c, strict=True)] + [(1, float("nan"), 0.0, 0.0, 1.0, 0, 0, 0)], "capture_id long, x double, y double, z double, w double, r int, g int, b int")
    keep = w > 0
    p, w, c = p[keep], w[keep], c[keep]
    lower, upper = np.quantile(p, [0.01, 0.99], axis=0)
    extent = np.maximum(upper - lower, 0)
    size = max((np.prod(np.maximum(extent, extent.max() * 0.01)) / 60) ** (1 / 3), extent.max() / 4096)
    keys, inverse = np.unique(np.floor((p - p.min(axis=0)) / size).astype(int), axis=0, return_inverse=True)
    weight = np.bincount(inverse, w)
    mean = np.stack([np.bincount(inverse, p[:, k] * w) / weight for k in range(3)], 1)
    shade = np.clip(np.rint(np.stack([np.bincount(inverse, c[:, k] * w) / weight for k in range(3)], 1)), 0, 255)
    chosen = np.argsort(-weight, kind="stable")[:60]
    want = {tuple(keys[i]): (mean[i], shade[i]) for i in chosen}
    got = {(r.kx, r.ky, r.kz): (np.array([r.x, r.y, r.z]), np.array([r.r, r.g, r.b])) for r in models.fuse_voxels(df, None, 60).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k][0], want[k][0]) and (got[k][1] == want[k][1]).all() for k in want)


def test_opening_cameras(spark):
    cams = spark.createDataFrame([(1, 5, "b"), (1, 7, "a"), (1, 9, "c")], "model_id long, image_id long, name string")
    seen = spark.createDataFrame([(1, 7)] * 4 + [(1, 5)] * 4 + [(1, 9)], "model_id long, image_id long")
    assert models.opening_camera(cams, seen).first().image_id == 5 and models.opening_camera(cams, seen, ordered=False).first().image_id == 7


def test_render_cameras_with_distortion_are_refused(spark):
    row = lambda scene, i, model: (scene, i, 1.0, 0.0, 0.0, 0.0, float(i), 0.0, 0.0, model, [100.0, 110.0, 30.0, 20.0], 64, 48, 128, 48)
    df = spark.createDataFrame([row("a", 0, "PINHOLE"), row("a", 2, "PINHOLE"), row("b", 0, "PINHOLE"), row("b", 1, "OPENCV")], "scene string, image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, model string, params array<double>, camera_width int, camera_height int, width int, height int")
    got = {(r.scene, r.image_id): r for r in models.render_cameras(df, 0.5, 4.0).collect()}
    near, far = 0.5, 4.0
    zs = far / (near - far)
    want = [2 * 200 / 128, 0, 0, 0, 0, 2 * 110 / 48, 0, 0, 1 - 2 * 60 / 128, 2 * 20 / 48 - 1, zs, -1, 0, 0, zs * near, 0]
    assert np.allclose(got["a", 2].projection, want) and np.allclose(got["a", 2].view, [1, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1, 0, 2, 0, 0, 1])
    assert got["b", 0].refused and got["b", 0].view is None


# --- splats ----------------------------------------------------------------------------------------------


def test_nearest_neighbours_of_uneven_clouds(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(size=(700, 3)), rng.normal(size=(500, 3)) * 0.001 + 4, [[50.0, 0, 0], [0, 900.0, 0]], np.zeros((40, 3))])
    rows = [(1, i, *map(float, x)) for i, x in enumerate(p)] + [(2, i, float(i), 0.0, 0.0) for i in range(3)] + [(2, 9, float("nan"), 0.0, 0.0)]
    got = {}
    for r in splats.knn(spark.createDataFrame(rows, "scene long, row_index long, x double, y double, z double"), 7, tile_rows=64).orderBy("scene", "row_index", "place").collect():
        got.setdefault((r.scene, r.row_index), []).append(r.neighbour)
    d = np.sqrt((p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2)
    np.fill_diagonal(d, np.inf)
    assert all(got[1, i] == np.argsort(d[i], kind="stable")[:7].tolist() for i in range(len(p)))
    assert got[2, 0] == [1, 2] and got[2, 1] == [0, 2] and (2, 9) not in got


def test_encoding_against_doubles(spark):
    rng = np.random.default_rng(10)
    names = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2"]
    rows = rng.normal(size=(300, 14)).astype(np.float32).astype(float)
    odd = np.tile(rows[:1], (6, 1))
    odd[0, 0], odd[1, 3], odd[2, 4], odd[3, 7:11], odd[4, 4], odd[5, 11] = np.nan, np.inf, 1e4, 0, 20, 1e9
    df = spark.createDataFrame(pd.DataFrame(np.concatenate([rows, odd]), columns=names).assign(i=range(306)))
    got = {r.i: r for r in splats.encode_splats(df).collect()}
    assert [got[300 + k].reason for k in range(6)] == ["non_finite_position", "non_finite_opacity", "non_finite_scale", "degenerate_rotation", "unrepresentable_covariance", "invalid_color"]
    assert got[300].covariance is None and got[300].red is None
    for i in range(300):
        q, scale = rows[i, 7:11], np.exp(rows[i, 4:7])
        turned = matrix(q) * scale[None, :]
        full = turned @ turned.T
        want = [full[a, b] for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
        if got[i].reason is None:
            assert np.allclose(got[i].covariance, want, rtol=4e-3, atol=4e-3 * np.abs(full).max())
            assert abs(got[i].alpha - 1 / (1 + np.exp(-rows[i, 3]))) < 1e-6 and abs(got[i].red - max(0, 0.5 + 0.2820948 * rows[i, 11])) < 1e-6
            c = got[i].covariance
            assert np.linalg.eigvalsh([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]])[0] > -1e-6 * np.abs(full).max()
        else:
            assert got[i].reason == "indefinite_covariance"
    assert sum(got[i].reason is None for i in range(300)) > 250


def test_validation_grounds(spark):
    rows = [(1.0, 0.0, [0.0] * 45, 5), (float("nan"), 0.0, None, 5), (1.0, 1e-9, None, 5), (1.0, 1.0, [0.0] * 44, 5), (1.0, 1.0, [float("inf")] * 45, 5), (1.0, 1.0, None, 300)]
    df = spark.createDataFrame([(i, r[0], r[1] if i else 1.0, 0.0, 0.0, 0.0, r[2], r[3], 0, 0) for i, r in enumerate(rows)], "i long, x double, rot_0 double, rot_1 double, rot_2 double, rot_3 double, sh_rest array<double>, color_0 int, color_1 int, color_2 int")
    assert [r.reason for r in splats.validate_splats(df, ["x"]).orderBy("i").collect()] == [None, "non_finite_x", "degenerate_rotation", "sh_count", "non_finite_sh", "color_range"]


def test_compressed_files(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 300
    header = "ply\nformat binary_little_endian 1.0\nelement chunk 2\n"
    ranges = [f"{e}{k}_{c}" for k, axes in (("", "xyz"), ("_scale", "xyz"), ("", "rgb")) for e in ("min", "max") for c in axes]
    header += "".join(f"property float {c}\n" for c in ranges) + f"element vertex {n}\n"
    header += "".join(f"property uint packed_{c}\n" for c in ("position", "rotation", "scale", "color")) + "end_header\n"
    chunks = [[*low, *high, *(low - 3), *(high - 3), 0, 0, 0, 1, 1, 0.5] for low, high in ((rng.normal(size=3), 3 + rng.normal(size=3)) for _ in range(2))]
    packed = rng.integers(0, 2**32, (n, 4), dtype=np.uint64)
    body = b"".join(struct.pack("<18f", *c) for c in chunks) + b"".join(struct.pack("<4I", *map(int, v)) for v in packed)
    (tmp_path / "a.ply").write_bytes(header.encode() + body)
    got = splat_files.read_compressed_ply(spark, str(tmp_path / "a.ply")).orderBy("row_index").collect()
    assert len(got) == n
    for i in (0, 17, 255, 256, 299):
        c = np.array(chunks[i // 256])
        pos, rot, scale, color = (int(v) for v in packed[i])
        parts = lambda v: np.array([(v >> 21 & 2047) / 2047, (v >> 11 & 1023) / 1023, (v & 2047) / 2047])
        assert np.allclose([got[i].x, got[i].y, got[i].z], c[0:3] + parts(pos) * (c[3:6] - c[0:3]), atol=1e-5)
        assert np.allclose([got[i].scale_0, got[i].scale_1, got[i].scale_2], c[6:9] + parts(scale) * (c[9:12] - c[6:9]), atol=1e-5)
        three = [((rot >> s & 1023) / 1023 - 0.5) * math.sqrt(2) for s in (20, 10, 0)]
        want = list(three)
        want.insert(rot >> 30, math.sqrt(max(0, 1 - sum(v * v for v in three))))
        assert np.allclose([got[i].rot_0, got[i].rot_1, got[i].rot_2, got[i].rot_3], want, atol=1e-5)
        assert np.allclose([got[i].color_0, got[i].color_1, got[i].color_2], np.array([color >> 24 & 255, color >> 16 & 255, (color >> 8 & 255) / 2]), atol=1e-3)
        alpha = min(max((color & 255) / 255, 1e-6), 1 - 1e-6)
        assert abs(got[i].opacity - math.log(alpha / (1 - alpha))) < 1e-4
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nend_header\n")
    with pytest.raises(Exception, match="not a compressed file"):
        splat_files.read_compressed_ply(spark, str(tmp_path / "b.ply")).collect()


def test_finishing_a_subject(spark):
    kinds = {i: "foreground" for i in range(20)} | {20: "uncertain", 21: "uncertain", 22: "background"}
    own = spark.createDataFrame([(1, i, k, 0.9 if i == 3 else 0.1) for i, k in kinds.items()], "scene long, gaussian long, kind string, background_views double")
    selected = spark.createDataFrame([(1, i) for i in range(20)], "scene long, gaussian long")
    near = [(1, 20, i) for i in range(13)] + [(1, 21, i) for i in range(4, 16)] + [(1, 21, 20)] + [(1, 22, i) for i in range(16)]
    got = splats.finalise_subject(own, selected, spark.createDataFrame(near, "scene long, gaussian long, neighbour long"), keys=("scene",))
    assert {r.gaussian for r in got.collect()} == set(range(20)) - {3}  # 20 has 12 left
    more = spark.createDataFrame([*near, (1, 20, 15)], "scene long, gaussian long, neighbour long")
    got = splats.finalise_subject(own, selected, more, keys=("scene",))
    assert {r.gaussian for r in got.collect()} == set(range(22)) - {3}  # 21 follows in the second pass
    assert splats.retained_check(own, got).first().outcome == "ambiguous"  # 21 of 23 is over 90%


def test_invalid_scenes(spark):
    rows = [(None, "exit", False, "bad", False), (0, "exit", False, "bad", False), (1, "exit", True, "bad", False), (1, "exit", False, " ", False), (1, "exit", False, "bad", None), (1, "odd", False, "bad", False), (1, "exit", False, "worse", True), (1, "signal", False, "bad", False)]
    df = spark.createDataFrame([(i, *r, "bad") for i, r in enumerate(rows)], "i long, exit_code int, termination_reason string, cancelled boolean, failure_type string, corrupt_ply boolean, expected_failure string")
    assert [r.status for r in evaluation.invalid_scene(df).orderBy("i").collect()] == ["blocked", "failed", "failed", "blocked", "blocked", "blocked", "failed", "passed"]


def test_long_tracks_over_many_tasks(spark):
    """Points with many rays, dealt into pairs of blocks, against one row each."""
    rng = np.random.default_rng(21)
    seen = [(1, i, p, float(abs(rng.normal()) / 300)) for p, n in ((1, 90), (2, 31), (3, 1), (4, 2)) for i in range(n)]
    centres = [(1, i, *map(float, rng.normal(size=3) * 0.2)) for i in range(90)]
    points = [(1, p, 0.0, 0.0, float(3 * p)) for p in range(1, 5)]
    tables = (
        spark.createDataFrame(seen, "model_id long, image_id long, point_id long, angle double"), spark.createDataFrame(centres, "model_id long, image_id long, cx double, cy double, cz double"),
        spark.createDataFrame(points, "model_id long, point_id long, px double, py double, pz double"),
    )
    show = lambda df: sorted((*r[:8], round(r[8], 9)) for r in df.collect())
    whole = show(conditioning.parallax(*tables))
    assert whole == show(conditioning.parallax(*tables, long=1, long_block=16)) == show(conditioning.parallax(*tables, long=40, long_block=50))
    assert [r[2] for r in whole] == [90, 31, 1, 2] and 0 < whole[0][3] <= 90


def test_diverse_ranking_in_rounds_is_the_greedy_one(spark):
    """Whatever the chunks and the candidates of a round; ties, copies and captures of a few photos included."""
    rng = np.random.default_rng(31)
    rows = [(c, f"{int(rng.integers(0, 10**6)):064x}", rng.integers(0, 40, 8).tolist() if rng.random() < 0.7 else [5] * 8, int(rng.integers(0, 3))) for c, n in (("a", 90), ("b", 17), ("c", 1)) for _ in range(n)]

    def greedy(own, k):
        own = sorted(own, key=lambda r: r[1])
        near, picks, free = [0] * len(own), [], set(range(len(own)))
        while free and len(picks) < k:
            i = min(free, key=lambda j: (-(near[j] // 64), -own[j][3], -near[j], own[j][1]))
            free.remove(i)
            far = [sum(abs(x - y) for x, y in zip(own[i][2], o[2], strict=True)) for o in own]
            near = far if not picks else [min(a, b) for a, b in zip(near, far, strict=True)]
            picks.append(own[i][1])
        return picks

    df = spark.createDataFrame(rows + rows[:3], "capture_id string, sha256 string, descriptor array<int>, quality int")
    want = sorted((c, i, s) for c in "abc" for i, s in enumerate(greedy([r for r in rows if r[0] == c], 25)))
    for chunk, candidates in ((50_000, 512), (20, 7)):
        assert sorted(map(tuple, frames.rank_diverse(df, 25, chunk, candidates).collect())) == want
    assert frames.rank_diverse(df.limit(0), 5).count() == 0


def _brute(p, k, f=None, spacing=None):
    d = np.sqrt((p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2)
    if f is not None:
        d = d / spacing * (1.5 - 0.5 * sum(f[:, None, c] * f[None, :, c] for c in range(3)))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_nearest_neighbours_with_crowds_and_levels(spark):
    rng = np.random.default_rng(12)
    line = np.stack([np.arange(900.0), np.zeros(900), np.zeros(900)], 1)  # ties on both sides
    p = np.concatenate([line, np.tile([[450.5, 0.0, 0.0]], (500, 1)), rng.normal(size=(400, 3))])[rng.permutation(1800)]
    df = spark.createDataFrame(pd.DataFrame({"scene": 1, "row_index": range(1800), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = splats.knn(df, 5, tile_rows=8, block=50).toPandas().sort_values(["row_index", "place"])
    assert (got["neighbour"].to_numpy().reshape(1800, 5) == _brute(p, 5)).all()
    assert splats.knn(df.limit(0), 5).count() == 0
    twice = splats.knn(df.where("row_index < 3"), 5).toPandas()
    assert len(twice) == 6  # fewer than k


def test_tiles_meet_through_their_nodes(spark):
    """Pairs of tiles are those of all tiles with all, and grow with the tiles, not with their square."""
    side = {}
    for n in (20, 40):
        i = np.arange(n * n)
        x, y = i % n, i // n
        code = sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(6))
        low = pd.DataFrame({"scene": 1, "tile": np.argsort(np.argsort(code)), "reach": 0.5, "lx": x * 1.0, "hx": x + 0.9, "ly": y * 1.0, "hy": y + 0.9, "lz": 0.0, "hz": 0.0})
        low.loc[7, "reach"] = 3.2  # one with a far reach
        boxes = spark.createDataFrame(low.assign(**{"o" + c: low[c] for c in ("lx", "hx", "ly", "hy", "lz", "hz")}))
        got = {(r.tile, r.otile) for r in splats.near_tiles(boxes, 1 + 1e-9, fan=4).collect()}
        t = dict(zip(low["tile"], zip(x, y, low["reach"], strict=True), strict=True))
        gap = lambda a, b: max(0.0, abs(a - b) - 0.9)
        assert got == {(a, b) for a in t for b in t if a != b and np.hypot(gap(t[a][0], t[b][0]), gap(t[a][1], t[b][1])) <= t[a][2] + 1e-9}
        side[n] = len(got)
    assert side[40] < 4.5 * side[20]


def test_pose_pairs_over_tiles(spark):
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.normal(size=(300, 3)), np.tile([[0.25, 0.5, 0.0]], (60, 1)), rng.integers(0, 4, size=(100, 3)).astype(float), [[90.0, 0, 0]]])
    f = rng.normal(size=(len(p), 3))
    f[rng.random(len(p)) < 0.5] = [0.0, 0.0, 1.0]
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    cams = pd.DataFrame({"model_id": 1, "image_id": range(len(p)), "cx": p[:, 0], "cy": p[:, 1], "cz": p[:, 2], "fx": f[:, 0], "fy": f[:, 1], "fz": f[:, 2]})
    small = cams.head(4).assign(model_id=2)
    got = pairs.pose_pairs(spark.createDataFrame(pd.concat([cams, small])), tile_rows=16).toPandas()
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(near, np.inf)
    best = _brute(p, 8, f, max(np.sort(near.min(axis=1))[len(p) // 2], 1e-12))
    assert {(r.a, r.b) for r in got[got.model_id == 1].itertuples()} == {tuple(sorted((i, int(j)))) for i in range(len(p)) for j in best[i]}
    assert len(got[got.model_id == 2]) == 6 and not got.duplicated().any()
