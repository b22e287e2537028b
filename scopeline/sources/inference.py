"""Frames to masks around any network: letterboxing in, probabilities out, both in numpy.

The network is any callable from a batch (n, 3, height, width) to class scores
(n, classes, height, width), such as ``network.UNet``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


@dataclass(frozen=True)
class Fit:
    """How a frame was fitted into the input: scaled size, margins and its own size."""

    width: int
    height: int
    left: int
    top: int
    source_width: int
    source_height: int


def resized(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of the first two axes, pixel centres aligned, edges repeated."""

    def axis(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    grid = grid.astype(np.float64)
    y0, y1, fy = axis(grid.shape[0], height)
    x0, x1, fx = axis(grid.shape[1], width)
    fy = fy.reshape(-1, *[1] * (grid.ndim - 1))
    rows = grid[y0] * (1 - fy) + grid[y1] * fy
    fx = fx.reshape(1, -1, *[1] * (grid.ndim - 2))
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def fitted(frame: np.ndarray, width: int, height: int) -> tuple[np.ndarray, Fit]:
    """A B, G, R frame as an R, G, B input of shares of one, centred on zeros."""
    h, w = frame.shape[:2]
    scale = min(width / w, height / h)
    new_w, new_h = max(1, round(w * scale)), max(1, round(h * scale))
    left, top = (width - new_w) // 2, (height - new_h) // 2
    out = np.zeros((height, width, 3))
    out[top : top + new_h, left : left + new_w] = np.rint(resized(frame, new_h, new_w))
    return (out[..., ::-1].transpose(2, 0, 1) / 255.0).astype(np.float32), Fit(new_w, new_h, left, top, w, h)


def labels(scores: np.ndarray, fit: Fit) -> np.ndarray:
    """The class of each pixel of the source: softmax, margins off, resized, largest (in this order)."""
    p = np.exp(scores - scores.max(axis=0, keepdims=True))
    p /= p.sum(axis=0, keepdims=True)
    p = p[:, fit.top : fit.top + fit.height, fit.left : fit.left + fit.width].transpose(1, 2, 0)
    return resized(p, fit.source_height, fit.source_width).argmax(axis=2).astype(np.uint8)


def segment(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int = 512, height: int = 384) -> DataFrame:
    """Masks of frames (recording_id, frame_index, width, height, pixels); ``load`` makes the network once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = load()
        for batch in batches:
            out = []
            for w, h, p in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "pixels")), strict=True):
                given, fit = fitted(np.frombuffer(p, np.uint8).reshape(h, w, 3), width, height)
                out.append(labels(network(given[None])[0], fit).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "labels"])

    rows = frames.selectExpr("cast(recording_id as long) recording_id", "cast(frame_index as long) frame_index", "cast(width as int) width", "cast(height as int) height", "pixels")
    return tables.with_masks(rows, run, "recording_id long, frame_index long, width int, height int, pixels binary, labels binary")


def paired(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with their masks, one to one, and reason: ok, or which of the two is missing."""
    both = frames.join(masks.select("recording_id", "frame_index", "labels"), ["recording_id", "frame_index"], "full")
    return both.withColumn("reason", F.when(F.col("labels").isNull(), "no_mask").when(F.col("pixels").isNull(), "no_frame").otherwise("ok"))
