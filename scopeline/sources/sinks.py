"""Sinks: Spark's commit protocol leaves no partial output that reads as success."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, null boxes kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records as JSON lines; a failed write leaves no files."""
    as_json(df).write.mode("errorifexists").text(path)


def write_summary(df: DataFrame, path: str, caveat: str, status: str | Column = "ok") -> None:
    """Summaries as JSON with a caveat, and a status where ``df`` has none of its own."""
    said = [] if "status" in df.columns else [(F.lit(status) if isinstance(status, str) else status).alias("status")]
    df.select("*", *said, F.lit(caveat).alias("caveat")).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_frames(df: DataFrame, path: str) -> None:
    """One JSON file's worth of lines a recording: each frame's analysis, without its pixels."""
    kept = [n for n, kind in df.dtypes if kind != "binary"]
    df.select(*kept).write.mode("errorifexists").partitionBy("recording_id").option("ignoreNullFields", "false").json(path)


#: Colours of the mask's classes from 1 on as B, G, R bytes, and the weight that the picture keeps under them.
CLASS_COLOURS, PICTURE_WEIGHT = ((0, 160, 0), (200, 120, 0), (0, 0, 220)), 0.55


def overlays(frames: DataFrame) -> DataFrame:
    """Frames (recording_id, frame_index, width, height, pixels, labels) with overlay: the picture with its mask laid over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        colour = np.array([(0, 0, 0), *CLASS_COLOURS], dtype=np.float64)
        for batch in batches:
            out = []
            for p, m in zip(batch.column("pixels").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                picture, label = np.frombuffer(p, np.uint8).reshape(-1, 3).astype(np.float64), np.frombuffer(m, np.uint8)
                laid = PICTURE_WEIGHT * picture + (1 - PICTURE_WEIGHT) * colour[label]
                out.append(np.rint(np.where(label[:, None] > 0, laid, picture)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], [*batch.schema.names[:4], "overlay"])

    rows = frames.selectExpr("cast(recording_id as long) recording_id", "cast(frame_index as long) frame_index", "cast(width as int) width", "cast(height as int) height", "pixels", "labels")
    return rows.mapInArrow(run, "recording_id long, frame_index long, width int, height int, overlay binary")


def write_masks(frames: DataFrame, path: str) -> None:
    """Masks as Parquet, one row a frame, grouped by recording."""
    frames.write.mode("errorifexists").partitionBy("recording_id").parquet(path)


def stream_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of records to Parquet with exactly-once file commits."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
