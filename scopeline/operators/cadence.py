"""Which frames are looked at: calibration samples and the monitor's cadence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def effective_hz(fps: Column, target: float = fixed.MONITOR_HZ) -> Column:
    """The cadence that a source can give."""
    return F.least(F.lit(target), fps)


def calibration_sample(recordings: DataFrame, k: int = fixed.CALIBRATION_FRAMES) -> DataFrame:
    """recording_id and frame_index of at most ``k`` evenly spaced frames, first and last among them."""
    step = F.greatest(F.col("n_frames") - 1, F.lit(0)) / float(k - 1)
    index = F.bround(F.col("i") * step, 0).cast("long")
    return recordings.select("recording_id", "n_frames", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).select("recording_id", index.alias("frame_index")).distinct()


def wanted_frames(frames: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled frames; narrow ``frames`` to what is needed before, so that pixels of others are never read."""
    return frames.join(sample.select("recording_id", "frame_index"), ["recording_id", "frame_index"], "left_semi")


def dropped_frames(sample: DataFrame, kept: DataFrame) -> DataFrame:
    """Sampled frames that were not kept."""
    return sample.join(kept.select("recording_id", "frame_index"), ["recording_id", "frame_index"], "left_anti")


def due_regular(recordings: DataFrame, target: float = fixed.MONITOR_HZ) -> DataFrame:
    """recording_id, frame_index and t of the due frames of constant-rate recordings, without any order between rows.

    Frame i is due when its time reaches a later interval than frame i - 1's.
    """
    frames = recordings.where("n_frames > 0 and fps > 0").select("recording_id", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame_index"))
    hz = effective_hz(F.col("fps"), target)

    def slot(index: Column) -> Column:
        return F.floor((index / F.col("fps") + fixed.CADENCE_EPSILON) * hz)

    i = F.col("frame_index")
    return frames.where((i == 0) | (slot(i) > slot(i - 1))).select("recording_id", "frame_index", (i / F.col("fps")).alias("t"))


def due_by_clock(clock: DataFrame, hz: float) -> DataFrame:
    """``clock`` (recording_id, t) with slot and due, by one window: exact for clocks without gaps."""
    order = Window.partitionBy("recording_id").orderBy("t", "frame_id")
    slot = F.floor((F.col("t") - F.min("t").over(Window.partitionBy("recording_id")) + fixed.CADENCE_EPSILON) * hz)
    rows = clock.withColumn("slot", slot)
    return rows.withColumn("due", F.coalesce(F.col("slot") > F.lag("slot").over(order), F.lit(True)))


class Cadence:
    """The cadence of one clock, gaps included: after a due instant the next is the first multiple of the interval past it."""

    def __init__(self, hz: float):
        if not hz > 0:
            raise ValueError("the rate must be positive")
        self.interval, self.next, self.due_count, self.skipped = 1.0 / hz, None, 0, 0

    def due(self, t: float) -> bool:
        if self.next is None:
            self.next = t
        if t + fixed.CADENCE_EPSILON < self.next:
            self.skipped += 1
            return False
        self.next += (int((t - self.next) / self.interval) + 1) * self.interval
        self.due_count += 1
        return True


def due_exact(clock: DataFrame, hz: float) -> DataFrame:
    """recording_id, frame_id, t and due of clocks with gaps: one ordered fold a recording."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t", "ascending"), ("frame_id", "ascending")])
        clock_state = Cadence(hz)
        due = [clock_state.due(t) for t in rows.column("t").to_pylist()]
        return rows.append_column("due", pa.array(due, pa.bool_()))

    return clock.select("recording_id", "frame_id", "t").groupBy("recording_id").applyInArrow(run, "recording_id long, frame_id string, t double, due boolean")


def missing_frames(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Due frames that a recording does not have: any row here means that its monitor pass must fail."""
    return expected.join(present.select("recording_id", "frame_index"), ["recording_id", "frame_index"], "left_anti")


def sample_indices(n: int, k: int = fixed.CALIBRATION_FRAMES) -> list[int]:
    """``calibration_sample`` of one recording, for callers without a session."""
    return sorted({int(x) for x in np.rint(np.arange(k) * (max(n - 1, 0) / (k - 1)))})
