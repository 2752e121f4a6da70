"""Steady frames of live cameras: a state machine, in batch and as a stream, and the sharpest of a burst.

A frame is ``(camera, ts, frame_id, width, corners array<struct<x, y>>, confidence)``;
frames without an outline have null corners. They are taken by ``(ts, frame_id)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Share of the frame's width that a corner may move, steady frames before a capture, and least confidence.
TOLERANCE, STEADY_FRAMES, LEAST_CONFIDENCE = 0.035, 5, 0.62


class Seen(NamedTuple):
    count: int = 0
    corners: tuple[tuple[float, float], ...] | None = None
    confidence: float = 0.0


class Step(NamedTuple):
    count: int
    steady: bool
    armed: bool
    captured: bool
    held: tuple[tuple[float, float], ...] | None


def advance(seen: Seen, corners: tuple[tuple[float, float], ...] | None, confidence: float | None, width: float, automatic: bool = True) -> tuple[Seen, Step]:
    """One frame of a camera.

    Without an outline the count is 0 and the last outline is forgotten. The
    first outline counts 1. A later one counts on if each corner moved by less
    than the tolerance, else the count is 0. A steady frame of count 5 or more is
    armed if the *previous* frame was confident, as a frame's own outline and
    confidence are kept only after the judgement; so a capture holds the previous
    outline. A capture forgets count and outline.
    """
    if corners is None:
        return Seen(0, None, 0.0), Step(0, False, False, False, None)
    sure = confidence or 0.0
    if seen.corners is None:
        return Seen(1, corners, sure), Step(1, False, False, False, None)
    limit = (width * TOLERANCE) ** 2
    steady = len(corners) == len(seen.corners) and all((a - c) ** 2 + (b - d) ** 2 < limit for (a, b), (c, d) in zip(corners, seen.corners))
    count = seen.count + 1 if steady else 0
    armed = steady and count >= STEADY_FRAMES and seen.confidence > LEAST_CONFIDENCE
    if armed and automatic:
        return Seen(0, None, sure), Step(count, True, True, True, seen.corners)
    return Seen(count, corners, sure), Step(count, steady, armed, False, seen.corners if armed else None)


OUT = "camera string, ts timestamp, frame_id long, count int, steady boolean, armed boolean, captured boolean, corners array<struct<x:double,y:double>>"
_STATE = "count int, corners array<struct<x:double,y:double>>, confidence double, ts timestamp, frame_id long"


def _points(corners) -> tuple[tuple[float, float], ...] | None:
    return None if corners is None else tuple((float(p["x"]), float(p["y"])) for p in corners)


def _folded(camera: str, seen: Seen, frames: pd.DataFrame, automatic: bool) -> tuple[Seen, pd.DataFrame]:
    rows = []
    for f in frames.sort_values(["ts", "frame_id"]).itertuples(index=False):
        seen, s = advance(seen, _points(f.corners), f.confidence, f.width, automatic)
        rows.append((camera, f.ts, f.frame_id, s.count, s.steady, s.armed, s.captured, None if s.held is None else [{"x": x, "y": y} for x, y in s.held]))
    return seen, pd.DataFrame(rows, columns=["camera", "ts", "frame_id", "count", "steady", "armed", "captured", "corners"])


def stability(frames: DataFrame, automatic: bool = True) -> DataFrame:
    """Each frame's step, of a table at rest. A camera's frames are folded one after the other, in one task."""
    return frames.groupBy("camera").applyInPandas(lambda key, x: _folded(key[0], Seen(), x, automatic)[1], OUT)


def stability_stream(frames: DataFrame, automatic: bool = True, late: str = "10 seconds") -> DataFrame:
    """The same of a stream. An extension: frames later than the watermark, or before one already judged, are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, corners, sure, ts, frame = state.get if state.exists else (0, None, 0.0, None, -1)
        x = pd.concat(list(batches))
        if ts is not None:
            x = x[(x["ts"] > ts) | ((x["ts"] == ts) & (x["frame_id"] > frame))]
        if not len(x):
            return
        seen, out = _folded(key[0], Seen(count, None if corners is None else tuple((p[0], p[1]) for p in corners), sure), x, automatic)
        last = out.iloc[-1]
        kept = None if seen.corners is None else [(a, b) for a, b in seen.corners]
        state.update((seen.count, kept, seen.confidence, last["ts"], int(last["frame_id"])))
        yield out

    return frames.withWatermark("ts", late).groupBy("camera").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def sampled(frames: DataFrame, every: str = "190 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The first frame of each camera in each span of 190 ms: a busy detector's frames are dropped, not queued."""
    own = frames.withWatermark("ts", late) if frames.isStreaming else frames
    names = [c for c in frames.columns if c not in ("camera", "ts")]
    first = F.min_by(F.struct("ts", *names), F.struct("ts", "frame_id")).alias("f")
    return own.groupBy("camera", F.window("ts", every).alias("w")).agg(first).select("camera", "f.*")


def runs(frames: DataFrame, key: str, order: list[str], value: Column, tolerance: Column) -> DataFrame:
    """``frames`` with ``count``: the state machine for one number in place of four corners, as windows.

    Null values forget what came before. The first run after a start or a null
    counts from 1, a run after an unsteady frame from 0.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    first = value.isNotNull() & before.isNull()
    unsteady = value.isNotNull() & before.isNotNull() & (F.abs(value - before) >= tolerance)
    marked = frames.withColumns({"_first": first, "_cut": first | unsteady | value.isNull(), "_null": value.isNull()})
    grouped = marked.withColumn("_run", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "_run").orderBy(*order)
    begun = F.first("_first").over(own)
    count = F.when(F.col("_null"), 0).otherwise(F.row_number().over(own) - 1 + begun.cast("int"))
    return grouped.withColumn("count", count.cast("int")).drop("_first", "_cut", "_null", "_run")


def sharpest(frames: DataFrame, burst: str, order: str, sharpness: str, most: int = 4) -> DataFrame:
    """Of the first ``most`` frames of each burst the sharpest, the first of equals."""
    numbered = frames.withColumn("_n", F.row_number().over(Window.partitionBy(burst).orderBy(order))).where(F.col("_n") <= most)
    return numbered.groupBy(burst).agg(F.max_by(F.col(order), F.struct(sharpness, -F.col("_n"))).alias(order), F.max(sharpness).alias(sharpness))


def debounced(keystrokes: DataFrame, gap: str = "220 milliseconds", late: str = "2 seconds") -> DataFrame:
    """``(session, ts, query)`` -> the last query of each pause of 220 ms, in batch or as a stream."""
    own = keystrokes.withWatermark("ts", late) if keystrokes.isStreaming else keystrokes
    return own.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.max_by("query", "ts").alias("query"), F.max("ts").alias("ts")).select("session", "ts", "query")
