"""Sources: engine tables from files, and adapters that derive them from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..session import table

WIDTH, HEIGHT = 1280, 720
MICROS_A_DAY = 86_400_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and sha256 of files, for frames and model files alike."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as frames: path, recording_id, frame_index, width, height, pixels as B, G, R bytes, and reason.

    Each file is a recording of one frame, numbered by the hash of its path. Gray
    pictures get three equal channels, transparency is left out. A file that is
    no readable picture has the reason ``unreadable`` and no pixels.
    """
    read = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column("nChannels").to_pylist(), batch.column("data").to_pylist(), strict=True):
                grid = np.frombuffer(data or b"", np.uint8).reshape(-1, n if n and n > 0 else 1)
                out.append(np.ascontiguousarray(grid[:, :3] if n in (3, 4) else grid.repeat(3, axis=1)).tobytes() if len(grid) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["path", "width", "height", "pixels"])

    found = read.select(F.col("origin").alias("path"), "width", "height", "nChannels", "data").mapInArrow(run, "path string, width int, height int, pixels binary")
    reason = F.when(F.col("pixels").isNull(), "unreadable").otherwise("ok")
    return found.select("path", F.xxhash64("path").alias("recording_id"), F.lit(0).cast("long").alias("frame_index"), "width", "height", "pixels", reason.alias("reason"))


class ModelFileError(RuntimeError):
    """A model file that is missing or not the expected one."""


def checked_model(spark: SparkSession, path: str, sha256: str) -> bytes:
    """A model file's bytes once its digest is the expected one; the file is one row of bounded size."""
    found = files(spark, path).where(F.col("sha256") == sha256.lower()).select("content").head(1)
    if not found:
        raise ModelFileError(f"no file with digest {sha256} at {path}")
    return bytes(found[0]["content"])


def checked_network(found: dict, classes: int, base_channels: int, tensors: int, is_tensor: Callable[[object], bool]) -> dict:
    """The settings inside a loaded model file (``model_state`` and ``config``), once all of it is as expected.

    ``network.read`` makes a mapping of a file.
    """
    lacking = [k for k in ("model_state", "config") if k not in found]
    if lacking:
        raise ModelFileError(f"the model file lacks {lacking}; it has {sorted(found)}")
    settings = (found["config"] or {}).get("model") or {}
    try:
        shape = int(settings["num_classes"]), int(settings["base_channels"])
    except (KeyError, TypeError, ValueError) as e:
        raise ModelFileError(f"the model file's settings do not say its shape: {settings}") from e
    if shape != (classes, base_channels):
        raise ModelFileError(f"the model file is for {shape[0]} classes and {shape[1]} channels, not {classes} and {base_channels}")
    state = found["model_state"]
    held = sum(map(is_tensor, state.values()))
    if not held == len(state) == tensors:
        raise ModelFileError(f"the model file has {len(state)} entries, {held} of them tensors, not {tensors}")
    return dict(settings)


def with_masks(frames: DataFrame, provider: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Frames to masks by any batch-wise provider: inference is a stage that callers plug in.

    Filter the frames before this: Spark moves no filter through it.
    """
    return frames.mapInArrow(provider, schema)


def probed(recordings: DataFrame) -> DataFrame:
    """``recordings`` with reason: ok, or why a recording cannot be analysed (no frames, or no frame rate)."""
    return recordings.withColumn("reason", F.when(~(F.coalesce("n_frames", F.lit(0)) > 0), "no_frames").when(~(F.coalesce("fps", F.lit(0.0)) > 0), "no_frame_rate").otherwise("ok"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording a user: its frame count and rate, from the user's events."""
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("recording_id")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.element_at(F.array(*(F.lit(v) for v in (59.0, 29.97, 25.0, 1.0))), (F.col("recording_id") % 4 + 1).cast("int"))
    return events.select("recording_id", (F.col("n") * 7 + F.col("recording_id") % 11).alias("n_frames"), rate.alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def observations(spark: SparkSession, sf_dir: str, fixed_boxes: bool = False) -> DataFrame:
    """One observation an event: recording_id, event_id, frame_id, t (days from the user's first event) and box.

    Events of type ``error`` are negative (null box). ``fixed_boxes`` gives every
    ten days of a recording one box, so that boxes lock and move.
    """
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("recording_id")
    rows = events.select(F.col("user_id").alias("recording_id"), "event_id", "event_type", "value", micros.alias("us"))
    rows = rows.withColumn("us", F.col("us") - F.min("us").over(own)).withColumn("t", F.col("us") / float(MICROS_A_DAY))
    if fixed_boxes:
        block = F.floor(F.col("t") / 10).cast("int")
        x1, y1 = 100 + block * 300 + F.col("recording_id") % 50, 60 + block * 100
    else:
        x1, y1 = 100 + F.floor(F.abs("value")) % 40, 60 + F.col("event_id") % 20
    made = boxes.box(x1, y1, x1 + 200, y1 + 150)
    return rows.select("recording_id", "event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("frame_id"), "us", "t", F.when(F.col("event_type") != "error", made).alias("box"))


def clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recordings (recording_id, n_frames, fps) and their 8 x 8 frames, numbered from 0 in each.

    Of four recordings one promises a frame that it does not have; of nine one has no rate.
    """
    rows = pixels(spark, sf_dir)
    rows = rows.withColumn("frame_index", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("frame_index")).cast("long") - 1)
    counted = rows.groupBy("recording_id").agg((F.max("frame_index") + 1).alias("n"))
    r = F.col("recording_id")
    rate = F.when(r % 9 != 8, F.when(r % 2 == 0, 10.0).otherwise(4.0))
    return counted.select("recording_id", (F.col("n") + (r % 4 == 3).cast("long")).alias("n_frames"), rate.alias("fps")), rows


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames from vectors: recording_id, frame_index, y, x, cls, gray, b, g, r."""
    v = F.abs(F.col("v").cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), F.col("vec_id").alias("frame_index"), F.posexplode("embedding").alias("p", "v"))

    def channel(scale: int, modulus: int):
        return (F.floor(v * scale) % modulus).cast("int")

    return rows.select(
        "recording_id", "frame_index", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"),
        channel(1000, 4).alias("cls"), channel(1000, 256).alias("gray"), channel(3000, 256).alias("b"), channel(5000, 256).alias("g"), channel(7000, 256).alias("r"),
    )
