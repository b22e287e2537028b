"""The engine's registered queries over the driver's tables (see ``sources.tables`` for the adapters)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes, fixed
from .operators import cadence, evidence, masks, session, stability
from .plans.pipelines import analyze_frames, analyze_recordings, analyze_sessions, flat, monitor_records, observed
from .session import table
from .sources import sinks, tables

W, H = tables.WIDTH, tables.HEIGHT
#: The monitor's interval in the adapters' unit of time.
INTERVAL = 0.2
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.bins(tables.observations(spark, sf))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return masks.agreement(tables.pixels(spark, sf))


# evidence and session boxes


@query
def evidence_bins(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_bins(spark, sf).select("recording_id", "bin", "frame_id", "t", "span", "n_routed", "box"), "box")


@query
def session_box_median(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.estimate(_bins(spark, sf)).select("recording_id", "n_bins", "box"), "box")


@query
def session_box_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.estimate(_bins(spark, sf), "quantile").select("recording_id", "n_bins", "box"), "box")


@query
def session_box_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.estimate(_bins(spark, sf), "occupancy").where("box is not null").select("recording_id", "n_bins", "box"), "box")


@query
def cluster_box(spark: SparkSession, sf: str) -> DataFrame:
    bins = evidence.bins(tables.observations(spark, sf, fixed_boxes=True))
    return flat(evidence.kernel_boxes(bins, "cluster", W, H).select("recording_id", "box", "diagnostic"), "box")


@query
def session_box_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.kernel_boxes(_bins(spark, sf), "cluster", W, H).select("recording_id", "box", "diagnostic"), "box")


@query
def session_geometry_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.geometry(tables.observations(spark, sf)), "box")


@query
def centre_distances(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.centre_distances(_bins(spark, sf), W, H).select("recording_id", "bin_a", "bin_b", F.round("distance", 9).alias("distance"))


@query
def asof_live_box(spark: SparkSession, sf: str) -> DataFrame:
    return flat(evidence.as_of(tables.observations(spark, sf), INTERVAL), "box")


@query
def evidence_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.trailing(tables.observations(spark, sf), 7, tables.MICROS_A_DAY).select("recording_id", "frame_id", "us", "n_kept")


# boxes


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's box with one of another size and place."""
    e = table(spark, sf, "events")
    x, y = 100 + F.floor(F.abs("value")) % 40, 60 + F.col("event_id") % 20
    a = boxes.box(x, y, x + 200, y + 150)
    x2, y2 = x + F.col("event_id") % 260 - 30, y + F.col("event_id") % 170 - 10
    b = boxes.box(x2, y2, x2 + 150 + F.col("event_id") % 100, y2 + 100 + F.floor(F.abs("value")) % 90)
    return e.select("event_id", a.alias("a"), b.alias("b"))


@query
def box_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("event_id", boxes.iou(F.col("a"), F.col("b")).alias("iou"), boxes.drifted(F.col("b"), F.col("a")).alias("drifted"))


@query
def folded_area_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("event_id", boxes.area_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query
def validate_box_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 9).alias("k"), (F.floor(F.abs("value")) % 40).cast("double").alias("v"))
    v = F.col("v")
    cases = [F.array(v, v, v + 60, v + 50), F.array(v, v, v + 60), F.array(v, v, F.lit(float("nan")), v), F.array(v, v + 0.5, v + 60, v + 50), F.array(v, v, v, v + 9), F.array(v - 41, v, v + 9, v + 9), F.array(v, v, v + 7, v + 90), F.array(v + 1, v, v + W, v + 90)]
    coords = F.lit(None).cast("array<double>")
    for k, c in enumerate(cases):
        coords = F.when(F.col("k") == k, c).otherwise(coords)
    return e.select("event_id", boxes.reason(coords, F.lit(W), F.lit(H)).alias("reason"))


@query
def validate_box_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes made for one frame size, met with frames of another size for every third event."""
    wide = F.when(F.col("event_id") % 3 == 0, F.lit(W // 2)).otherwise(F.lit(W))
    made = F.when(F.col("event_id") % 7 > 0, F.lit(W))
    coords = F.array(*(F.col("a")[s].cast("double") for s in boxes.SIDES))
    return _pairs(spark, sf).select("event_id", boxes.reason(coords, wide, F.lit(H), expected=(made, F.lit(H))).alias("reason"))


@query
def clamp_box(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_pairs(spark, sf).select("event_id", boxes.clamped(F.col("b"), F.lit(300), F.lit(200)).alias("box")), "box")


@query
def letterbox_params(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (320 + F.col("p_size") * 13).alias("w"), (240 + F.col("p_partkey") % 701).alias("h"))
    return p.select("p_partkey", boxes.letterbox(F.col("w"), F.col("h"), 512, 384).alias("s")).select("p_partkey", "s.*")


# sampling and cadence


@query
def recording_probe(spark: SparkSession, sf: str) -> DataFrame:
    r = tables.recordings(spark, sf).withColumn("n_frames", F.col("n_frames") * (F.col("recording_id") % 5 > 0).cast("int")).withColumn("fps", F.when(F.col("recording_id") % 7 > 0, F.col("fps")))
    return tables.probed(r).select("recording_id", "n_frames", "reason")


@query
def calibration_sample(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.calibration_sample(tables.recordings(spark, sf))


@query
def effective_rate(spark: SparkSession, sf: str) -> DataFrame:
    return tables.recordings(spark, sf).select("recording_id", cadence.effective_hz(F.col("fps")).alias("hz"))


@query
def cadence_due_regular(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.due_regular(tables.recordings(spark, sf))


@query
def scheduled_count(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.due_regular(tables.recordings(spark, sf)).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_due"))


@query
def cadence_due_clock(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.due_by_clock(tables.observations(spark, sf), 2.0).select("recording_id", "frame_id", "slot", "due")


@query
def cadence_due_exact(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.due_exact(tables.observations(spark, sf), 2.0)


# stability


@query
def split_half_stability(spark: SparkSession, sf: str) -> DataFrame:
    return stability.split_half(_bins(spark, sf))


@query
def temporal_segments(spark: SparkSession, sf: str) -> DataFrame:
    return flat(stability.segments(_bins(spark, sf)), "box")


@query
def split_half_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return stability.split_half(_bins(spark, sf), method="quantile")


@query
def split_half_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return stability.split_half(_bins(spark, sf), method="occupancy")


@query
def split_half_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return stability.split_half(_bins(spark, sf), method="cluster")


@query
def temporal_segments_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return flat(stability.segments(_bins(spark, sf), "quantile"), "box")


@query
def temporal_segments_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return flat(stability.segments(_bins(spark, sf), "occupancy"), "box")


@query
def bootstrap_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return flat(stability.bootstrap(_bins(spark, sf)), "box")


# masks and frames


@query
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return masks.histogram(tables.pixels(spark, sf))


@query
def agreement_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _votes(spark, sf)


@query
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.pixels(spark, sf)
    runs = p.select("recording_id", "frame_index", "y", F.col("x").alias("x_start"), (F.col("x") + 1).alias("x_end"), "cls")
    return masks.run_agreement(runs, p.select("recording_id", "frame_index").distinct(), (fixed.TISSUE, fixed.CORNER))


@query
def popup_presence(spark: SparkSession, sf: str) -> DataFrame:
    return masks.popup_presence(tables.pixels(spark, sf), 64, min_share=0.3)


@query
def full_fov_box(spark: SparkSession, sf: str) -> DataFrame:
    return flat(masks.view_box(_votes(spark, sf)), "box")


@query
def box_preservation(spark: SparkSession, sf: str) -> DataFrame:
    votes = _votes(spark, sf)
    inner = votes.select("recording_id").distinct().select("recording_id", boxes.box(*(F.lit(v) for v in (2, 1, 7, 6))).alias("box"))
    return masks.preservation(votes, inner, "view")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("recording_id", "frame_index").orderBy("y", "x")
    p = tables.pixels(spark, sf).withColumn("step", F.abs(F.col("gray") - F.lag("gray").over(order)))
    return masks.features(p, F.col("step") / 60.0)


@query
def frame_features_basic(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("recording_id", "frame_index", *(F.round(c, 6).alias(c) for c in ("dynamic_range", "crushed", "saturated", "gradient")))


@query
def frame_features_sobel(spark: SparkSession, sf: str) -> DataFrame:
    out = masks.frame_features(masks.packed(tables.pixels(spark, sf), 8, 8))
    return out.select("recording_id", "frame_index", *(F.round(c, 6).alias(c) for c in ("dynamic_range", "crushed", "saturated", "gradient")))


@query
def admissibility_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("recording_id", "frame_index", masks.inadmissible().alias("reason"))


@query
def session_admission(spark: SparkSession, sf: str) -> DataFrame:
    return masks.admission(_features(spark, sf))


@query
def routing_support(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.pixels(spark, sf)
    f = F.col("frame_index")
    box = F.when(f % 7 > 0, boxes.box(f % 3, f % 2, F.lit(7) + f % 3, F.lit(8))).when(f % 14 == 0, boxes.box(F.lit(9), F.lit(0), F.lit(12), F.lit(4)))
    out = masks.routing(p, p.select("recording_id", "frame_index").distinct().withColumn("box", box), 8, 8)
    return out.select("recording_id", "frame_index", "routed", "reason", *(F.round(c, 9).alias(c) for c in ("support", "tissue", "warm")))


@query
def clean_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masks.clean_masks(_votes(spark, sf), 8, 8, "view")


@query
def inner_fov_box(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.pixels(spark, sf)
    votes = masks.agreement(p, 0.25)
    return flat(masks.crop_choices(votes, masks.popup_presence(p, 64, min_share=0.3), 8, 8, min_inner=0.5), "inner_box", "full_box")


@query
def popup_repair(spark: SparkSession, sf: str) -> DataFrame:
    return masks.popup_boxes(masks.packed(tables.pixels(spark, sf), 8, 8), 3, 1).select("recording_id", "frame_index", "n_repairs", "added_pixels", "main_area", F.sha2("labels", 256).alias("labels_sha256"))


@query
def popup_crop_box(spark: SparkSession, sf: str) -> DataFrame:
    return flat(masks.popup_boxes(masks.packed(tables.pixels(spark, sf), 8, 8), 3, 1).select("recording_id", "frame_index", "box"), "box")


@query
def frame_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return flat(analyze_frames(tables.pixels(spark, sf), 8, 8, 3, 1), "box")


# sessions


@query
def monitor_record(spark: SparkSession, sf: str) -> DataFrame:
    return flat(monitor_records(tables.observations(spark, sf, fixed_boxes=True), INTERVAL, W, H), "box")


@query
def monitor_record_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.as_json(monitor_records(tables.observations(spark, sf, fixed_boxes=True), INTERVAL, W, H))


@query
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return flat(session.summary(tables.observations(spark, sf, fixed_boxes=True), INTERVAL, W, H), "box")


@query
def monitor_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can know of the monitor without its state: ticks seen and positive ones."""
    return session.summary(tables.observations(spark, sf, fixed_boxes=True), INTERVAL, W, H).select("recording_id", "n_monitored", "n_routed", "n_rejected")


@query
def session_result(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.pixels(spark, sf)
    choices = masks.crop_choices(masks.agreement(p, 0.25), masks.popup_presence(p, 64, min_share=0.3), 8, 8)
    frames = observed(analyze_frames(p, 8, 8, 3, 1), 2.0)
    return flat(analyze_sessions(choices, frames, INTERVAL, 8, 8), "inner_box", "full_box", "active_box")


@query
def session_disabled(spark: SparkSession, sf: str) -> DataFrame:
    return session.summary(tables.observations(spark, sf), INTERVAL, W, H, enabled=False).select("recording_id", "n_monitored", "reason")


# whole recordings


def _analysis(spark: SparkSession, sf: str):
    return analyze_recordings(*tables.clips(spark, sf), 8, 8, method="median", share=0.25, min_area=3, min_rim=1, min_share=0.3)


@query
def recording_result(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_analysis(spark, sf).result, "inner_box", "full_box", "active_box")


@query
def recording_records(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_analysis(spark, sf).records, "box")


@query
def recording_status(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can know of a recording's analysis without the boxes: whether it failed closed, and how much was looked at."""
    return _analysis(spark, sf).result.select("recording_id", "status", "first_missing", "monitor_hz", "effective_monitor_hz", "n_frames_in_source", "n_frames_monitored", "n_calibration_frames")


@query
def recording_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Due frames that a recording lacks."""
    recordings, frames = tables.clips(spark, sf)
    due = cadence.due_regular(recordings.where("fps is not null").withColumn("n_frames", F.col("n_frames") + F.col("recording_id") % 3))
    return cadence.missing_frames(due.select("recording_id", "frame_index"), frames.select("recording_id", "frame_index").distinct())


@query
def calibration_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled frames that there are, and their pixels' count."""
    recordings, frames = tables.clips(spark, sf)
    found = cadence.wanted_frames(frames, cadence.calibration_sample(recordings))
    return found.groupBy("recording_id", "frame_index").agg(F.count(F.lit(1)).alias("n_pixels"))


@query
def dropped_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled frames that are not admissible."""
    features = _features(spark, sf).select("recording_id", "frame_index", masks.inadmissible().alias("reason"))
    return cadence.dropped_frames(features.select("recording_id", "frame_index"), features.where("reason is null"))
