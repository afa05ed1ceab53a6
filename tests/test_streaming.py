"""Streams of frames against the batch jobs over finished clips."""

import os
import time

import numpy as np
import pytest

from scenemill.operators import frames
from scenemill.streaming.frames import STORE, stream_candidates

SCHEMA = "clip_id long, frame_index int, t double, luma binary, ends boolean"


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE[0])
    yield
    spark.conf.set(STORE[0], before)


def clips(rng):
    """Frames with broken times; the last of a clip ends it."""
    rows = []
    for clip, n in ((1, 37), (2, 1), (3, 60)):
        t = 0.0
        for i in range(n):
            t += float(rng.uniform(0.02, 0.2))
            said = (t, -1.0, t - 0.5, float("nan"))[0 if rng.random() < 0.8 else int(rng.integers(1, 4))]
            rows.append((clip, i, said, rng.integers(0, 256, 64, dtype=np.uint8).tobytes(), i == n - 1))
    return rows


def run(spark, tmp_path, parts, name, **options):
    """The stream's output when its input comes in these parts, stopped and started again after each second one."""
    source, sink, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "cp"))
    os.makedirs(source)
    for k, part in enumerate(parts):
        made = str(tmp_path / f"{name}-part{k}")
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(made)
        (file,) = (f for f in os.listdir(made) if f.endswith(".parquet"))
        os.rename(f"{made}/{file}", f"{source}/{k:03}.parquet")
        os.utime(f"{source}/{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        if k % 2 or k == len(parts) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            query = stream_candidates(stream, 2.0, 10.0, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(200)
            assert query.exception() is None
            query.stop()
    return sorted((r.clip_id, r.frame_index, round(r.t, 9), r.repaired, r.analysed, round(r.motion, 9)) for r in spark.read.parquet(sink).collect())


def batch(spark, rows):
    fixed = frames.repair_timestamps(spark.createDataFrame(rows, SCHEMA), 10.0)
    found = frames.motion(frames.schedule(fixed, 2.0, 10.0))
    return sorted((r.clip_id, r.frame_index, round(r.t, 9), r.repaired, r.analysed, round(r.motion, 9)) for r in found.collect())


def test_any_split_and_restarts_agree_with_batch(spark, tmp_path, store):
    rng = np.random.default_rng(5)
    rows = clips(rng)
    want = batch(spark, rows)
    assert any(r[3] for r in want) and any(not r[4] for r in want) and max(r[5] for r in want) > 0
    cuts = sorted(rng.choice(np.arange(1, 60), 3, replace=False).tolist())
    parts = [[r for r in rows if a <= r[1] < b] for a, b in zip([0, *cuts], [*cuts, 99], strict=True)]
    assert run(spark, tmp_path, parts, "split") == want


def test_a_clip_without_an_end_holds_its_last_frame(spark, tmp_path, store):
    rows = [(1, i, i * 0.1, b"\x00" * 63 + bytes([i]), None) for i in range(8)]
    got = run(spark, tmp_path, [rows], "open")
    assert [r[1] for r in got] == list(range(7))


def test_a_timer_ends_an_idle_clip(spark, tmp_path, store):
    rows = [(1, i, i * 0.1, b"\x00" * 63 + bytes([i]), None) for i in range(8)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = stream_candidates(spark.readStream.schema(SCHEMA).parquet(source), 2.0, 10.0, idle=200)
    query = stream.writeStream.format("memory").queryName("idle_clip").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("idle_clip").where("frame_index = 7").isEmpty():
            time.sleep(0.5)
        assert query.exception() is None
    finally:
        query.stop()
    out = spark.table("idle_clip").orderBy("frame_index").collect()
    assert [r.frame_index for r in out] == list(range(8)) and out[-1].analysed and out[-1].motion > 0
