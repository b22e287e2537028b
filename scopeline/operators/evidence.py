"""Temporal evidence: bins with one representative, box estimates over them, and reasons to abstain."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, fixed
from . import kernels


def bins(observations: DataFrame, bin_sec: float = fixed.BIN_SEC) -> DataFrame:
    """One representative a (recording, bin): nearest to the bin's centre, ties to the least frame id.

    Bins count from the recording's first positive observation. One shuffle by
    recording serves both windows; only the first row of a bin leaves it.
    """
    own = Window.partitionBy("recording_id")
    positive = observations.where(F.col("box").isNotNull()).select("recording_id", "frame_id", "t", "box")
    placed = positive.withColumn("t0", F.min("t").over(own)).withColumn("span", F.max("t").over(own) - F.col("t0")).withColumn("n_routed", F.count(F.lit(1)).over(own))
    placed = placed.withColumn("bin", F.floor((F.col("t") - F.col("t0")) / bin_sec).cast("int"))
    centre = F.col("t0") + (F.col("bin") + 0.5) * bin_sec
    nearest = Window.partitionBy("recording_id", "bin").orderBy(F.abs(F.col("t") - centre), "frame_id")
    return placed.withColumn("_at", F.row_number().over(nearest)).where("_at = 1").drop("_at", "t0")


def positions(evidence: DataFrame) -> DataFrame:
    """``evidence`` with each bin's position, that of observations without a time last, and the recording's bin count."""
    order = Window.partitionBy("recording_id").orderBy(F.col("bin").asc_nulls_last())
    return evidence.withColumn("pos", F.row_number().over(order) - 1).withColumn("n_bins", F.count(F.lit(1)).over(Window.partitionBy("recording_id")))


def median_box() -> Column:
    return boxes.rounded(*(F.median(F.col("box")[s]) for s in boxes.SIDES))


def quantile_box(low: float = fixed.QUANTILES[0], high: float = fixed.QUANTILES[1]) -> Column:
    """An envelope: the low quantile for near edges, the high one for far edges."""
    if not 0.0 <= low < high <= 1.0:
        raise ValueError("quantiles must satisfy 0 <= low < high <= 1")
    return boxes.rounded(*(quantile(F.col("box")[s], q) for s, q in zip(boxes.SIDES, (low, low, high, high), strict=True)))


def quantile(values: Column, q: float) -> Column:
    """The interpolated quantile of integers as DuckDB's quantile_cont has it: below * (1 - part) + (above * part), the first product not rounded.

    ``percentile`` rounds both products, which at a half moves a rounded side by a pixel. It lies between
    the values at the two ranks, so these are its neighbours among the distinct values; a group holds no more than those.
    """
    found, distinct = F.percentile(values, F.lit(q)), F.collect_set(values)
    below, above = F.array_max(F.filter(distinct, lambda v: v <= found)).cast("double"), F.array_min(F.filter(distinct, lambda v: v >= found)).cast("double")
    rank = (F.count(values) - 1) * F.lit(q)
    part = rank - F.floor(rank)
    return _fused(below, 1 - part, above * part)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the errors of the product (Dekker) and of the sum (Knuth) are exact doubles, and are added last."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * 134217729.0
        high = wide - (wide - x)
        return high, x - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    product = a * b
    lost = a2 * b2 - (((product - a1 * b1) - a2 * b1) - a1 * b2)
    total = product + c
    came = total - product
    return total + (((product - (total - came)) + (c - came)) + lost)


def kernel_boxes(evidence: DataFrame, method: str, width: int, height: int) -> DataFrame:
    """recording_id, n_bins, span, n_routed, box and diagnostic by the occupancy or cluster estimator, a recording's bins in one array.

    A recording has at most ``EVIDENCE_BINS`` bins in use at a time in a monitor;
    over a whole recording the array has one small entry a bin.
    """
    if method not in ("occupancy", "cluster"):
        raise ValueError(f"no such kernel: {method}")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bin")
        held = [tuple(b[s] for s in boxes.SIDES) for b in rows.column("box").to_pylist()]
        found, note = (kernels.occupancy_box(held), "") if method == "occupancy" else kernels.cluster_box(held, width, height)
        return pa.table(
            {
                "recording_id": pa.array([key[0].as_py()], pa.int64()),
                "n_bins": pa.array([len(held)], pa.int64()),
                "span": rows.column("span").slice(0, 1).cast(pa.float64()),
                "n_routed": rows.column("n_routed").slice(0, 1).cast(pa.int64()),
                "box": pa.array([None if found is None else dict(zip(boxes.SIDES, found, strict=True))], pa.struct([(s, pa.int32()) for s in boxes.SIDES])),
                "diagnostic": pa.array([note], pa.string()),
            }
        )

    schema = f"recording_id long, n_bins long, span double, n_routed long, box {boxes.BOX}, diagnostic string"
    return evidence.select("recording_id", "bin", "span", "n_routed", "box").groupBy("recording_id").applyInArrow(run, schema)


def estimate(evidence: DataFrame, method: str = "median", width: int = 1280, height: int = 720) -> DataFrame:
    """recording_id, n_bins, span, n_routed and the method's box."""
    if method not in fixed.METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method in ("occupancy", "cluster"):
        return kernel_boxes(evidence, method, width, height).select("recording_id", "n_bins", "span", "n_routed", "box")
    facts = [F.count(F.lit(1)).alias("n_bins"), F.max("span").alias("span"), F.max("n_routed").alias("n_routed")]
    return evidence.groupBy("recording_id").agg(*facts, (median_box() if method == "median" else quantile_box()).alias("box"))


def geometry(
    observations: DataFrame, method: str = "median", width: int = 1280, height: int = 720, bin_sec: float = fixed.BIN_SEC, popup_detection: bool = True
) -> DataFrame:
    """One row a recording: the box, or null with the reason.

    Every recording in ``observations`` has a row, those without a positive too.
    """
    everyone = observations.select("recording_id").distinct()
    if not popup_detection:
        return everyone.select("recording_id", F.lit(0).cast("long").alias("n_routed"), F.lit(0).cast("long").alias("n_bins"), F.lit(None).cast(boxes.BOX).alias("box"), F.lit(fixed.POPUP_BLIND).alias("reason"))
    found = everyone.join(estimate(bins(observations, bin_sec), method, width, height), "recording_id", "left")
    few = F.coalesce(F.col("n_routed") < fixed.MIN_ROUTED, F.lit(True)) | (F.col("n_bins") < fixed.MIN_BINS) | (F.col("span") < fixed.MIN_SPAN)
    reason = F.when(few, fixed.INSUFFICIENT).when(F.col("box").isNull(), fixed.AMBIGUOUS if method == "cluster" else fixed.INSUFFICIENT).otherwise(fixed.OK)
    out = found.withColumn("reason", reason)
    return out.select("recording_id", F.coalesce("n_routed", F.lit(0)).alias("n_routed"), F.coalesce("n_bins", F.lit(0)).alias("n_bins"), F.when(F.col("reason") == fixed.OK, F.col("box")).alias("box"), "reason")


def trailing(observations: DataFrame, keep_bins: int = fixed.EVIDENCE_BINS, bin_micros: int = 1_000_000) -> DataFrame:
    """Positive observations with the count of evidence that a trailing window keeps: strictly younger than the newest minus its length.

    ``us`` is the observation's time in microseconds: range frames need integers.
    """
    window = Window.partitionBy("recording_id").orderBy("us").rangeBetween(-(keep_bins * bin_micros - 1), 0)
    positive = observations.where(F.col("box").isNotNull())
    return positive.withColumn("n_kept", F.least(F.count(F.lit(1)).over(window), F.lit(fixed.EVIDENCE_ROWS)))


def as_of(observations: DataFrame, interval: float) -> DataFrame:
    """Every tick with the last positive observation up to it, and whether that one is still live."""
    past = Window.partitionBy("recording_id").orderBy("t", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("box").isNotNull(), F.struct("t", "box")), ignorenulls=True).over(past)
    rows = observations.withColumn("_seen", seen)
    valid = boxes.live(F.col("_seen")["t"], F.col("t"), interval)
    return rows.select("recording_id", "frame_id", "t", F.col("_seen")["t"].alias("last_t"), valid.alias("live"), F.when(valid, F.col("_seen")["box"]).alias("box"))


def centre_distances(evidence: DataFrame, width: int, height: int) -> DataFrame:
    """Distances of centres between the bins a < b of a recording, in shares of the frame."""
    own = evidence.select("recording_id", "bin", ((F.col("box")["x1"] + F.col("box")["x2"]) / 2.0 / width).alias("cx"), ((F.col("box")["y1"] + F.col("box")["y2"]) / 2.0 / height).alias("cy"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.recording_id") == F.col("b.recording_id")) & (F.col("a.bin") < F.col("b.bin")))
    return pairs.select("a.recording_id", F.col("a.bin").alias("bin_a"), F.col("b.bin").alias("bin_b"), F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")).alias("distance"))
