"""The frame pass over a stream: time repair and analysis schedule, with state for each clip."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scenemill.operators.frames import Due, TimeRepair, luma_motion

OUTPUT = "clip_id long, frame_index int, t double, repaired boolean, analysed boolean"
STATE = "last double, due double, seen int"


def stream_frames(frames: DataFrame, rate: float, fps: float, idle: int | None = None) -> DataFrame:
    """Frames (clip_id, frame_index, t) with repaired times and whether they are analysed.

    The state of a clip is its last time, the next due time and how many frames it had. With ``idle`` it goes when
    no frame came for so many milliseconds of processing time, and a later frame begins the clip anew; Spark then
    runs batches all the time, so that is for streams that don't end. Frames of one batch are taken in order of their index. That the last frame is always kept can't be known from a stream;
    a batch job over the finished clip adds it, and motion, which needs the picture of the analysed frame before.
    """

    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["clip_id", "frame_index", "t", "repaired", "analysed"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        last, due, seen = state.get if state.exists else (-1.0, -1.0, 0)
        repair, hit = TimeRepair(fps, last if seen else None), Due(rate, fps, due if seen else None)
        rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
        out = []
        for i, t in zip(rows["frame_index"], rows["t"], strict=True):
            time, fixed = repair(i, t)
            out.append((key[0], int(i), time, fixed, bool(hit(time))))
        state.update((repair.last, hit.due, seen + len(out)))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("clip_id").applyInPandasWithState(fn, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


#: Name and value of the setting that names the state store which processors with timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CANDIDATES = f"{OUTPUT}, motion double"
_CLIP = "last double, due double, seen int, analysed binary"
_HELD = "frame_index int, t double, repaired boolean, luma binary"


class ClipProcessor(StatefulProcessor):
    """A clip's frames in turn. Its state: the last time, the next due time, frames seen and the luma grid of the last
    analysed frame; apart from it the newest frame, if it isn't analysed, as it will be if it turns out to be the last."""

    def __init__(self, rate: float, fps: float, idle: int | None, keep: int | None):
        self.rate, self.fps, self.idle, self.keep = rate, fps, idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", _CLIP, ttlDurationMs=self.keep)
        self.held = handle.getValueState("held", _HELD, ttlDurationMs=self.keep)

    def _finish(self, key: tuple, held: tuple | None, analysed: bytes | None) -> list[tuple]:
        """The last frame is always analysed."""
        self.clip.clear()
        self.held.clear()
        return [] if held is None else [(key[0], *held[:3], True, luma_motion(held[3], analysed))]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, due, seen, analysed = self.clip.get() if self.clip.exists() else (None, None, 0, None)
        held, out = self.held.get() if self.held.exists() else None, []
        repair, hit = TimeRepair(self.fps, last if seen else None), Due(self.rate, self.fps, due if seen else None)
        batch, ended = pd.concat(list(rows)).sort_values("frame_index", kind="stable"), False
        for i, t, luma, ends in zip(batch["frame_index"], batch["t"], batch["luma"], batch["ends"], strict=True):
            if ended:  # a frame after the end begins the clip anew
                repair, hit, seen, analysed, ended = TimeRepair(self.fps), Due(self.rate, self.fps), 0, None, False
            if held is not None:
                out.append((key[0], *held[:3], False, 0.0))
                held = None
            time, fixed = repair(i, t)
            seen += 1
            if hit(time):
                out.append((key[0], int(i), time, fixed, True, luma_motion(luma, analysed)))
                analysed = luma
            else:
                held = (int(i), time, fixed, luma)
            if ends:
                out += self._finish(key, held, analysed)
                held, ended = None, True
        if not ended:
            self.clip.update((repair.last, hit.due, seen, analysed))
            if held is None:
                self.held.clear()
            else:
                self.held.update(held)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        analysed = self.clip.get()[3] if self.clip.exists() else None
        out = self._finish(key, self.held.get() if self.held.exists() else None, analysed)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    def close(self) -> None:
        pass


def stream_candidates(frames: DataFrame, rate: float, fps: float, idle: int | None = None, keep: int | None = None) -> DataFrame:
    """(clip_id, frame_index, t, repaired, analysed, motion) of each frame of a stream, once.

    frames: (clip_id, frame_index, t, luma, ends). A frame is analysed if it is due, or the last of its clip; motion is
    against the analysed frame before, 0 for the first and for frames that aren't analysed. A frame that isn't due
    comes out when the next one is there, or its clip ends: with a frame whose ``ends`` is true, or, given ``idle``,
    when none came for so many milliseconds of processing time. A frame after the end begins the clip anew. State
    that lay untouched for ``keep`` milliseconds is dropped by the store, with a frame that was held.

    Frames of one batch are taken in order of their index, and those of a later batch after them, so any split of clips
    in order gives what a batch job over the finished clips gives. Null ``ends`` are false. The session's state
    store is set to RocksDB, which keeps timers and several states; a clip's state is a few KB.
    """
    frames.sparkSession.conf.set(*STORE)
    own = frames.selectExpr("clip_id", "frame_index", "t", "luma", "coalesce(ends, false) as ends")
    processor = ClipProcessor(rate, fps, idle, keep)
    timed = idle is not None or keep is not None
    return own.groupBy("clip_id").transformWithStateInPandas(processor, CANDIDATES, "Append", "ProcessingTime" if timed else "None")
