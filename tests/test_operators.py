"""Small hand-made inputs, invariances and brute force for what SQL doesn't express."""

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scenemill.functions import geometry
from scenemill.operators import conditioning, evaluation, frames, graph, models, subject
from scenemill.sources import binary_models, model_files, splat_files
from scenemill.streaming.frames import stream_frames


def test_luma_scores(spark):
    flat = bytes([100] * 4096)
    stripes = bytes([0, 255] * 2048)
    got = frames.score_luma(spark.createDataFrame([(1, flat), (2, stripes), (3, None)], "id long, luma binary")).orderBy("id").collect()
    assert (got[0].blur, got[0].laplacian, got[0].clipped, got[0].dhash) == (0.0, 0.0, 0.0, 0)
    assert abs(got[0].brightness - 100 / 255) < 1e-12
    assert got[1].clipped == 1.0 and got[1].max_component == 1.0 and abs(got[1].blur - 255 * 63 / 64) < 1e-9
    assert got[2].clipped == 1.0 and got[2].blur == 0.0


def test_motion_ignores_brightness(spark):
    a, b = bytes([10, 20] * 50), bytes([30, 40] * 50)
    got = frames.motion(spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, bytes([20, 10] * 50))], "clip_id long, frame_index int, luma binary"))
    assert [round(r.motion, 9) for r in got.orderBy("frame_index").collect()] == [0.0, 0.0, 10 / 32]


def test_repair_timestamps(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 0.5, 0.4, float("nan"), -1.0, 9.0])]
    got = frames.repair_timestamps(spark.createDataFrame(rows, "clip_id long, frame_index int, t double"), 10.0).orderBy("frame_index").collect()
    assert [r.repaired for r in got] == [False, False, True, True, True, False]
    times = [r.t for r in got]
    assert all(b > a for a, b in zip(times, times[1:], strict=False))


def test_timeline_prefers_quality_and_avoids_copies(spark):
    rows = [(1, i, float(i), 100.0 if i % 5 == 2 else 50.0, i * 0x0F0F0F0F) for i in range(50)]
    got = frames.select_timeline(spark.createDataFrame(rows, "clip_id long, frame_index int, t double, q double, dhash long"), 5).orderBy("slot").collect()
    picks = [r.frame_index for r in got]
    assert len(picks) == 5 and picks == sorted(set(picks))
    assert sum(p % 5 == 2 for p in picks) >= 3


def test_diverse_ranking_has_prefixes_and_no_order(spark):
    rng = np.random.default_rng(3)
    rows = [("c", f"{i:064x}", rng.integers(0, 256, 64).tolist(), int(rng.integers(0, 4))) for i in range(30)]
    schema = "capture_id string, sha256 string, descriptor array<int>, quality int"
    ten = [r.sha256 for r in frames.rank_diverse(spark.createDataFrame(rows, schema), 10).orderBy("rank").collect()]
    five = [r.sha256 for r in frames.rank_diverse(spark.createDataFrame(rows[::-1], schema), 5).orderBy("rank").collect()]
    assert ten[:5] == five


def test_allocation(spark):
    rows = [(1, 1, 10.0, 100), (1, 2, 30.0, 100), (1, 3, 5.0, 1)]
    got = frames.allocate(spark.createDataFrame(rows, "capture_id long, clip_id long, duration double, available long"), 25).orderBy("clip_id").collect()
    assert [r.frames for r in got] == [7, 17, 1]
    none = frames.allocate(spark.createDataFrame(rows, "capture_id long, clip_id long, duration double, available long"), 3).collect()
    assert all(r.frames is None for r in none)


def test_blocks(spark):
    # two triangles that share a node, and a bridge
    rows = [(1, a, b) for a, b in [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5), (5, 6)]]
    got = graph.biconnectivity(spark.createDataFrame(rows, "capture_id long, a long, b long")).first()
    assert (got.articulations, got.blocks, got.largest, got.second) == (2, 3, 3, 3)


def test_blocks_of_a_large_graph(spark):
    """Chains of rings, hubs and bridges whose blocks are known, over nodes that no order favours."""
    rng = np.random.default_rng(8)
    for key, n_rings, most in [(1, 60, 12)]:
        name, edges, sizes, last = list(range(20_000)), [], [], None
        rng.shuffle(name)
        used = iter(name)
        for _ in range(n_rings):
            ring = [next(used) if last is None or rng.random() < 0.5 else last, *[next(used) for _ in range(int(rng.integers(2, most)))]]
            edges += list(zip(ring, [*ring[1:], ring[0]], strict=True))
            sizes.append(len(ring))
            if last is not None and ring[0] != last:
                edges.append((last, ring[0]))
                sizes.append(2)
            last = ring[int(rng.integers(0, len(ring)))]
        hub = last
        for _ in range(50):
            edges.append((hub, next(used)))
            sizes.append(2)
        rows = [(key, int(a), int(b)) if rng.random() < 0.5 else (key, int(b), int(a)) for a, b in edges for _ in range(1 + int(rng.random() < 0.1))]
        rows += [(key, int(hub), int(hub))]
        found = graph.blocks(spark.createDataFrame(rows, "k long, a long, b long"), "k").collect()
        members = {}
        for r in found:
            members.setdefault(r.block, set()).update((r.node, r.parent))
        assert sorted(len(m) for m in members.values()) == sorted(sizes)
        count = {}
        for m in members.values():
            for x in m:
                count[x] = count.get(x, 0) + 1
        got = graph.biconnectivity(spark.createDataFrame(rows, "k long, a long, b long"), "k").first()
        top = sorted(sizes, reverse=True)
        assert tuple(got) == (key, sum(c > 1 for c in count.values()), len(sizes), top[0], top[1])
    assert graph.biconnectivity(spark.createDataFrame([(1, 2, 2)], "k long, a long, b long"), "k").count() == 0


def test_components_of_a_long_path(spark):
    nodes = spark.range(64).select(F.lit(1).alias("k"), F.col("id").alias("node"))
    path = spark.range(63).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 40")
    got = {r.node: r.root for r in graph.components(nodes, path, "k").collect()}
    assert got == {i: 0 if i <= 40 else 41 for i in range(64)}


def test_sim3(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(20, 3))
    c, n = np.cos(0.6457718), np.sin(0.6457718)
    d = 2.5 * s @ np.array([[c, -n, 0], [n, c, 0], [0, 0, 1]]).T + [4, -2, 3]
    rows = [(1, *map(float, a), *map(float, b)) for a, b in zip(s, d, strict=True)] + [(2, *map(float, a), *map(float, a * [1, 1, -1])) for a in s] + [(3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    rows += [(4, float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(5)]
    got = {r.model_id: r for r in models.estimate_sim3(spark.createDataFrame(rows, "model_id long, sx double, sy double, sz double, dx double, dy double, dz double")).collect()}
    assert abs(got[1].scale - 2.5) < 1e-9 and np.allclose(got[1].translation, [4, -2, 3]) and got[1].rmse < 1e-6
    assert got[2].rmse > 0.1 and abs(np.linalg.det(np.array(got[2].rotation).reshape(3, 3)) - 1) < 1e-9
    assert got[3].status == "unavailable" and got[4].status == "degenerate"


def test_topology_digest_ignores_ids_and_order(spark):
    rows = [(1, 1, "a", 0), (1, 1, "b", 3), (1, 2, "a", 1), (1, 2, "c", 2)]
    again = [(1, 9, "c", 2), (1, 9, "a", 1), (1, 4, "b", 3), (1, 4, "a", 0)]
    schema = "model_id long, point_id long, name string, idx int"
    a, b = (models.topology_digest(spark.createDataFrame(r, schema)).first() for r in (rows, again))
    assert a == b and a.points == 2


def test_text_model(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# two images\n1 1 0 0 0 0 0 0 1 my image.jpg\n320 240 1 331 240 2\n2 1 0 0 0 1 0 0 1 b.jpg\n")
    (tmp_path / "cameras.txt").write_text("1 SIMPLE_PINHOLE 640 480 100 320 240\n")
    (tmp_path / "points3D.txt").write_text("1 0 0 10 1 2 3 0.5 1 0\n2 1 0 10 1 2 3 0.5 1 1 2 0\n")
    images, seen = model_files.read_images(spark, str(tmp_path / "images.txt"))
    assert [r.name for r in images.orderBy("image_id").collect()] == ["my image.jpg", "b.jpg"]
    cams = model_files.read_cameras(spark, str(tmp_path / "cameras.txt"))
    points, tracks = model_files.read_points(spark, str(tmp_path / "points3D.txt"))
    assert tracks.count() == 3
    key = lambda df: df.withColumn("model_id", F.lit(1)).drop("path")
    flat = key(images).join(key(cams).select("camera_id", "model", "params"), "camera_id").withColumn("focal", F.col("params")[0])
    pts = key(points).select("model_id", "point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    got = models.residual_summary(models.residuals(key(seen), flat, pts)).first()
    assert (got.observations, got.mean, got.median, got.p90) == (2, 0.5, 0.5, 1.0)
    text = model_files.points_text(key(points), key(tracks)).first().text
    assert text.splitlines()[1].endswith("1 1 2 0")


def test_splat_files(spark, tmp_path):
    names = splat_files.COLUMNS
    rows = np.arange(5 * len(names), dtype="<f4").reshape(5, -1)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    path = tmp_path / "a.ply"
    path.write_bytes(head.encode() + rows.tobytes())
    got = splat_files.read_splat_ply(spark, str(path)).orderBy("row_index").toPandas()
    assert np.array_equal(got[names].to_numpy(np.float32), rows)
    name = got["path"][0]
    kept = splat_files.filter_ply(spark, str(path), spark.createDataFrame([(name, 3), (name, 1)], "path string, row_index long")).first()
    assert bytes(kept.content).endswith(rows[[1, 3]].tobytes()) and b"element vertex 2\n" in bytes(kept.content) and kept.low == rows[1, :3].tolist()
    (tmp_path / "b.splat").write_bytes(struct.pack("<6f8B", 1, 2, 3, 1, 1, 1, 9, 8, 7, 128, 255, 128, 128, 128))
    one = splat_files.read_splat_binary(spark, str(tmp_path / "b.splat")).first()
    assert (one.x, one.scale_0, one.color_0, one.rot_1) == (1.0, 0.0, 9, 0.0)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = pd.DataFrame({"clip_id": [1] * 40, "frame_index": range(40), "t": [i * 0.1 for i in range(40)]}).astype({"frame_index": "int32"})
    source = tmp_path / "in"
    spark.createDataFrame(rows).selectExpr("clip_id", "cast(frame_index as int) as frame_index", "t").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("clip_id long, frame_index int, t double").parquet(str(source))
    q = stream_frames(stream, 2.0, 10.0).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.frame_index for r in spark.table("frames_out").where("analysed").orderBy("frame_index").collect()]
    want = [r.frame_index for r in frames.schedule(spark.createDataFrame(rows).selectExpr("clip_id", "cast(frame_index as int) as frame_index", "t"), 2.0, 10.0).where("analysed").orderBy("frame_index").collect()]
    assert got == [i for i in want if i != 39] or got == want


def test_binary_model(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 7, 1, 640, 480, 100.0, 110.0, 320.0, 240.0))
    seen = struct.pack("<Q", 2) + struct.pack("<ddQ", 320.0, 240.0, 5) + struct.pack("<ddQ", 1.5, 2.5, 2**64 - 1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<i7di", 3, 1, 0, 0, 0, 0.5, 0, 0, 7) + "a ü.jpg".encode() + b"\0" + seen)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ4i", 5, 0, 0, 10, 1, 2, 255, 0.25, 2, 3, 0, 4, 9))
    cam = binary_models.read_cameras(spark, str(tmp_path / "cameras.bin")).first()
    assert (cam.camera_id, cam.model, cam.width, cam.params) == (7, "PINHOLE", 640, [100.0, 110.0, 320.0, 240.0])
    images, observations = binary_models.read_images(spark, str(tmp_path / "images.bin"))
    assert (images.first().name, images.first().tx, images.first().camera_id) == ("a ü.jpg", 0.5, 7)
    assert [r.point_id for r in observations.orderBy("point2d_idx").collect()] == [5, -1]
    point = binary_models.read_points(spark, str(tmp_path / "points3D.bin")).first()
    assert (point.point_id, point.z, point.b, point.error, point.track) == (5, 10.0, 255, 0.25, [[3, 0], [4, 9]])


def test_spread_and_verdict(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(300, 3)) * [3, 2, 1]
    p[0] = [500, 0, 0]
    rows = [(1, *map(float, r)) for r in p] + [(2, float(i), 0.0, 0.0) for i in range(9)] + [(3, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model_id long, x double, y double, z double")
    off = p - p.mean(axis=0)
    size = np.linalg.norm(off, axis=1)
    limit = np.sort(size)[int(np.ceil(0.99 * 300)) - 1]
    want = np.linalg.eigvalsh(np.cov((off * np.minimum(1, limit / size)[:, None]).T, bias=True))
    got = {r.model_id: r for r in conditioning.spread(df, True).collect()}
    assert np.allclose([got[1].low, got[1].middle, got[1].high], want / want.sum())
    assert np.allclose([got[2].low, got[2].middle, got[2].high], [0, 0, 1]) and got[3].high == 0.0
    good = (100, 95, 50, 0.1, 10, 6, 0.1)
    cases = [good, (100, 89, *good[2:]), (*good[:2], 2, *good[3:]), (*good[:3], 1e-5, *good[4:]), (*good[:5], 4, 0.1), (*good[:6], 1e-9)]
    schema = "k long, registered long, strong long, centres long, baseline double, points long, conditioned_points long, middle_eigenvalue double"
    out = conditioning.verdict(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], schema)).orderBy("k").collect()
    assert [r.reason for r in out] == [None, "insufficient_view_support", "collapsed_trajectory", "collapsed_trajectory", "insufficient_parallax", "degenerate_points"]


def test_image_metrics(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((12, 13, 3)), rng.random((12, 13, 3))
    g = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    g = np.outer(g, g) / g.sum() ** 2

    def blur(a):
        p = np.pad(a, ((5, 5), (5, 5), (0, 0)))
        return np.array([[[(p[i : i + 11, j : j + 11, c] * g).sum() for c in range(3)] for j in range(13)] for i in range(12)])

    mx, my = blur(x), blur(y)
    s = (2 * mx * my + 1e-4) * (2 * (blur(x * y) - mx * my) + 9e-4) / ((mx**2 + my**2 + 1e-4) * (blur(x * x) - mx**2 + blur(y * y) - my**2 + 9e-4))
    rows = [(1, x.reshape(-1).tolist(), y.reshape(-1).tolist()), (2, x.reshape(-1).tolist(), x.reshape(-1).tolist())]
    got = evaluation.image_metrics(spark.createDataFrame(rows, "k long, render array<double>, truth array<double>"), 13, 12).orderBy("k").collect()
    assert abs(got[0].psnr + 10 * np.log10(((x - y) ** 2).mean())) < 1e-9 and abs(got[0].ssim - s.mean()) < 1e-9
    assert got[1].psnr == float("inf") and abs(got[1].ssim - 1) < 1e-12


def test_subject_choice(spark):
    ranked = [(1, 5, 0.1, 0.9, 0.8, 1), (1, 9, 0.1, 0.5, 0.3, 2), (2, 5, 0.1, 0.9, 0.8, 1), (2, 9, 0.1, 0.5, 0.7, 2), (3, 1, 0.1, 0.2, 0.9, 1), (4, 1, 0.95, 0.9, 0.9, 1)]
    df = spark.createDataFrame(ranked, "scene long, component long, retained double, coverage double, score double, place int")
    scenes = spark.range(1, 6).withColumnRenamed("id", "scene")
    got = {r.scene: (r.component, r.outcome) for r in subject.choose_subject(scenes, df).collect()}
    assert got == {1: (5, "selected"), 2: (None, "ambiguous"), 3: (None, "noSubject"), 4: (None, "ambiguous"), 5: (None, "noSubject")}
    anchor = spark.createDataFrame([(2, 9, 1.5), (2, 5, 0.5), (3, 1, 2.0)], "scene long, component long, weight double")
    got = {r.scene: (r.component, r.outcome) for r in subject.choose_subject(scenes, df, anchor).collect()}
    assert got[2] == (9, "selected") and got[3] == (None, "noSubject") and got[1] == (5, "selected")


def test_world_to_camera(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    turns = [np.diag(d).astype(float) for d in ([1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1])]
    for k in range(24):
        r = turns[k] if k < 4 else np.linalg.qr(rng.normal(size=(3, 3)))[0]
        r = r * np.sign(np.linalg.det(r))
        c = rng.normal(size=3)
        rows.append((k, np.column_stack([r, c]).reshape(-1).tolist()))
        own = (r * [1, -1, -1]).T
        want.append((own, -own @ c))
    rows += [(98, (-np.eye(3, 4)).reshape(-1).tolist()), (99, (2 * np.eye(3, 4)).reshape(-1).tolist()), (97, None)]
    df = spark.createDataFrame(rows, "k long, m array<double>").withColumns(geometry.world_to_camera(F.col("m")))
    turned = geometry.rotation(*[F.col(f"q{c}") for c in "wxyz"])
    got = {r.k: r for r in df.withColumn("r", F.array(*[x for row in turned for x in row])).collect()}
    for k, (r, t) in enumerate(want):
        assert got[k].valid and np.allclose(np.reshape(got[k].r, (3, 3)), r) and np.allclose([got[k].tx, got[k].ty, got[k].tz], t)
        assert next(q for q in (got[k].qw, got[k].qx, got[k].qy, got[k].qz) if q) > 0
    assert not any(got[k].valid for k in (97, 98, 99))


def test_keyframes(spark, tmp_path):
    base = {"fx": 10.0, "fy": 11.0, "cx": 5.0, "cy": 4.0, "width": 640, "height": 480} | {f"t_{i}{j}": float(4 * i + j) for i in range(3) for j in range(4)}
    for name, more in {"b": {"blur_score": 25.0}, "a": {"blur_score": 90.5}, "c": {"fx": 12.0}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(base | more, indent=1))
    got = model_files.import_keyframes(spark, str(tmp_path)).orderBy("image").collect()
    assert [(r.image, r.camera_id, r.blurry) for r in got] == [("a", 1, False), ("b", 1, True), ("c", 2, False)]
    assert got[0].params == [10.0, 11.0, 5.0, 4.0] and got[0].matrix == [float(i) for i in range(12)]
