"""Command line: ``python -m scopeline monitor|geometry|summary OBSERVATIONS OUT [options]``,
``python -m scopeline recording PIXELS OUT --recordings RECORDINGS``, ``frames PIXELS OUT`` and
``images FILES OUT --weights MODEL_FILE``.

OBSERVATIONS is Parquet with recording_id, frame_id, t and box; PIXELS with
recording_id, frame_index, y, x, cls, gray, b, g and r; RECORDINGS with
recording_id, n_frames and fps. FILES are pictures, each analysed alone: OUT has
frames (JSON), masks and overlays. OUT must not exist.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import evidence, session
from .plans.pipelines import analyze_frames, analyze_images, analyze_recordings, monitor_records
from .session import local_session
from .sources import network, sinks, tables

CAVEAT = "A null box means that no box could be vouched for; see reason."
ONE_FRAME = "A single frame has no field of view of its recording and no active box; box is this frame's candidate only."


def pictures(spark: SparkSession, given: argparse.Namespace) -> None:
    """Masks, overlays and one line of analysis for each picture; a file that is no picture has a line that says so."""
    read = tables.images(spark, given.observations)
    found = network.segmented(read.where("reason = 'ok'"), spark, given.weights, given.sha256)
    # written first, so that the network sees each picture once
    found.write.mode("errorifexists").parquet(f"{given.out}/masks")
    frames = spark.read.parquet(f"{given.out}/masks")
    sinks.write_masks(sinks.overlays(frames), f"{given.out}/overlays")
    looked = analyze_images(frames, given.min_area, given.min_rim).drop("width", "height", "frame_index").withColumnRenamed("reason", "routing_reason")
    lines = read.select("path", "recording_id", F.col("width"), F.col("height"), F.col("reason").alias("status")).join(looked, "recording_id", "left")
    sinks.write_summary(lines, f"{given.out}/frames", ONE_FRAME)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scopeline", description=__doc__)
    parser.add_argument("action", choices=("monitor", "geometry", "summary", "recording", "frames", "images"))
    parser.add_argument("observations", help="observations, pixels for recording and frames, or picture files for images")
    parser.add_argument("out")
    parser.add_argument("--monitor-hz", type=float, default=fixed.MONITOR_HZ)
    parser.add_argument("--method", choices=fixed.METHODS, default="median")
    parser.add_argument("--width", type=int, default=1280)
    parser.add_argument("--height", type=int, default=720)
    parser.add_argument("--no-pip", action="store_true", help="leave the monitor out of the summary")
    parser.add_argument("--recordings", help="with recording: the recordings' frame counts and rates")
    parser.add_argument("--min-area", type=int, default=fixed.MIN_COMPONENT, help="least pixels of a popup")
    parser.add_argument("--min-rim", type=int, default=fixed.MIN_RIM, help="least rim of a popup's repair")
    parser.add_argument("--weights", help="with images: the model file")
    parser.add_argument("--sha256", default=fixed.MODEL_SHA256, help="the model file's digest")
    given = parser.parse_args(args)
    if given.action == "images" and not given.weights:
        parser.error("images needs --weights")
    if given.action == "recording" and not given.recordings:
        parser.error("recording needs --recordings")
    if given.monitor_hz <= 0:
        parser.error("--monitor-hz must be positive")
    spark = local_session()
    if given.action == "images":
        pictures(spark, given)
        return 0
    rows = spark.read.parquet(given.observations)
    common = (given.width, given.height, given.method)
    if given.action == "monitor":
        sinks.write_jsonl(monitor_records(rows, 1.0 / given.monitor_hz, *common), given.out)
    elif given.action == "geometry":
        sinks.write_summary(evidence.geometry(rows, given.method, given.width, given.height), given.out, CAVEAT, F.when(F.col("reason") == fixed.OK, "ok").otherwise("unavailable"))
    elif given.action == "summary":
        sinks.write_summary(session.summary(rows, 1.0 / given.monitor_hz, *common, enabled=not given.no_pip), given.out, CAVEAT, F.when(F.col("box").isNotNull(), "ok").otherwise("unavailable"))
    elif given.action == "frames":
        sinks.write_frames(analyze_frames(rows, given.width, given.height, given.min_area, given.min_rim), given.out)
    else:
        found = analyze_recordings(spark.read.parquet(given.recordings), rows, given.width, given.height, given.monitor_hz, given.method, not given.no_pip, min_area=given.min_area, min_rim=given.min_rim)
        sinks.write_summary(found.result, f"{given.out}/sessions", CAVEAT)
        if not given.no_pip:
            sinks.write_jsonl(found.records, f"{given.out}/records")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
