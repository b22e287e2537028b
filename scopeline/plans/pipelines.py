"""The two passes over recordings, composed of operators: calibration and monitor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, fixed
from ..operators import cadence, masks, session
from ..sources import tables


def analyze_frames(pixels: DataFrame, width: int, height: int, min_area: int = fixed.MIN_COMPONENT, min_rim: int = fixed.MIN_RIM) -> DataFrame:
    """One row a frame: class counts, candidate box and routing (on the raw mask)."""
    found = masks.popup_boxes(masks.packed(pixels, width, height), min_area, min_rim).select("recording_id", "frame_index", "box")
    routed = masks.routing(pixels, found, width, height)
    return masks.histogram(pixels).join(found, ["recording_id", "frame_index"]).join(routed, ["recording_id", "frame_index"])


def analyze_images(frames: DataFrame, min_area: int = fixed.MIN_COMPONENT, min_rim: int = fixed.MIN_RIM) -> DataFrame:
    """As ``analyze_frames``, from binary frames of any sizes (width, height, pixels, labels)."""
    pixels = masks.unpacked(frames)
    size = frames.selectExpr("cast(recording_id as long) recording_id", "cast(frame_index as long) frame_index", "width", "height")
    found = masks.popup_boxes(frames, min_area, min_rim).select("recording_id", "frame_index", "box").join(size, list(masks.FRAME))
    routed = masks.routing(pixels, found, F.col("width"), F.col("height"))
    return masks.histogram(pixels).join(found, list(masks.FRAME)).join(routed, list(masks.FRAME))


def observed(frames: DataFrame, fps: float | Column, *keep: str) -> DataFrame:
    """Observations of analysed frames: the box of a routed frame, else none; time is the frame's number over the rate."""
    return frames.select(
        "recording_id",
        *keep,
        F.format_string("f%06d", F.col("frame_index")).alias("frame_id"),
        (F.col("frame_index") / fps).alias("t"),
        F.when(F.col("routed") & F.col("box").isNotNull(), F.col("box")).alias("box"),
    )


def monitor_records(observations: DataFrame, interval: float, width: int, height: int, method: str = "median") -> DataFrame:
    """The monitor's primary output, times rounded to a microsecond."""
    out = session.fold(observations, interval, width, height, method)
    return out.withColumn("t", F.round("t", 6))


def analyze_sessions(calibration: DataFrame, observations: DataFrame, interval: float, width: int, height: int, method: str = "median", enabled: bool = True) -> DataFrame:
    """One row a recording: calibration boxes with the monitor's final state and counters.

    ``calibration`` is ``masks.crop_choices``'s result. A disabled monitor leaves
    the calibration part as it is.
    """
    final = session.summary(observations, interval, width, height, method, enabled=enabled)
    return calibration.withColumnRenamed("reason", "view_reason").join(final.withColumnRenamed("box", "active_box").withColumnRenamed("reason", "active_reason"), "recording_id", "full")


@dataclass(frozen=True)
class Analysis:
    """``result``: one row a recording; ``records``: the monitor's ticks of those that could be analysed."""

    result: DataFrame
    records: DataFrame


def analyze_recordings(
    recordings: DataFrame,
    pixels: DataFrame,
    width: int,
    height: int,
    target_hz: float = fixed.MONITOR_HZ,
    method: str = "median",
    enabled: bool = True,
    share: float = fixed.AGREEMENT,
    min_area: int = fixed.MIN_COMPONENT,
    min_rim: int = fixed.MIN_RIM,
    min_share: float = fixed.MIN_POPUP_SHARE,
) -> Analysis:
    """Both passes over any number of recordings (recording_id, n_frames, fps), from their segmented pixels.

    Calibration takes evenly spaced frames, drops those that are not admissible,
    and lets the rest vote on the boxes. The monitor takes the frames that the
    cadence asks for, in time order. A recording fails closed: one with no frames
    or no rate, or with any of its frames missing, has that as its status, the
    first missing frame, no boxes and no records. A disabled monitor leaves the
    calibration as it is and reads no frame for itself.
    """
    probed = tables.probed(recordings.select("recording_id", "n_frames", "fps"))
    readable = probed.where(F.col("reason") == "ok")
    present = pixels.select(*masks.FRAME).distinct()
    every = readable.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("frame_index"))
    gaps = cadence.missing_frames(every, present).groupBy("recording_id").agg(F.min("frame_index").alias("first_missing"))
    judged = probed.join(gaps, "recording_id", "left").withColumn("status", F.when(F.col("first_missing").isNotNull(), "decode_failed").otherwise(F.col("reason")))
    whole = judged.where(F.col("status") == "ok").select("recording_id", "n_frames", "fps")

    sample = cadence.calibration_sample(whole)
    calibration = cadence.wanted_frames(pixels, sample)
    features = masks.frame_features(masks.packed(calibration, width, height))
    admitted = masks.admission(features)
    kept = features.where(masks.inadmissible().isNull()).join(admitted.where("admitted").select("recording_id"), "recording_id", "left_semi")
    voters = cadence.wanted_frames(calibration, kept)
    choices = masks.crop_choices(masks.agreement(voters, share), masks.popup_presence(voters, width * height, min_share=min_share), width, height)
    shape = choices.select("recording_id", F.col("reason").alias("choice_reason"), *(F.when(F.col("reason") == fixed.OK, F.col(n)).alias(n) for n in ("inner_box", "full_box")))

    due = cadence.due_regular(whole, target_hz)
    hz = cadence.effective_hz(F.col("fps"), target_hz)
    looked = analyze_frames(cadence.wanted_frames(pixels, due if enabled else due.limit(0)), width, height, min_area, min_rim)
    timed = looked.join(whole.select("recording_id", "fps"), "recording_id").withColumn("interval", 1.0 / hz)
    ticks = observed(timed, F.col("fps"), "interval")
    records = session.fold(ticks, "interval", width, height, method).withColumn("t", F.round("t", 6))
    records = records.withColumn("frame_index", F.substring("frame_id", 2, 20).cast("long"))
    final = session.summary(ticks, "interval", width, height, method).withColumnsRenamed({"box": "active_box", "reason": "active_reason", "epoch": "final_epoch"})

    out = judged.join(admitted.select("recording_id", F.col("n_frames").alias("n_sampled"), "n_kept", "retained", F.col("reason").alias("sample_reason")), "recording_id", "left")
    out = out.join(shape, "recording_id", "left").join(final, "recording_id", "left")
    good = F.col("status") == "ok"
    return Analysis(
        out.select(
            "recording_id",
            "status",
            "first_missing",
            F.when(good, F.coalesce("sample_reason", "choice_reason")).alias("view_reason"),
            "inner_box",
            "full_box",
            "active_box",
            F.when(good, F.coalesce("active_reason", F.lit(fixed.DISABLED))).alias("active_reason"),
            *(F.coalesce(n, F.lit(0)).alias(n) for n in ("final_epoch", "n_locks", "n_unlocks")),
            F.lit(target_hz).alias("monitor_hz"),
            F.when(F.coalesce("fps", F.lit(0.0)) > 0, hz).alias("effective_monitor_hz"),
            F.col("n_frames").cast("long").alias("n_frames_in_source"),
            F.coalesce("n_monitored", F.lit(0)).alias("n_frames_monitored"),
            F.coalesce("n_sampled", F.lit(0)).alias("n_calibration_frames"),
            F.coalesce("n_kept", F.lit(0)).alias("n_admissible"),
            "retained",
            "gate_reason",
            F.lit(enabled).alias("pip_enabled"),
        ),
        records.select("recording_id", "frame_index", "t", "box", "state", "epoch", "event", "reason"),
    )


def flat(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with each named box as four columns."""
    for n in names:
        parts = [F.col(n)[s].alias(s if n == "box" else f"{n}_{s}") for s in boxes.SIDES]
        df = df.select(*[c for c in df.columns if c != n], *parts)
    return df
