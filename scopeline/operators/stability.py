"""Split-half stability, temporal segments and block bootstrap over binned evidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, fixed
from . import evidence as ev
from . import kernels


def split_rows(max_bins: int = fixed.EVIDENCE_BINS) -> list[tuple[int, str, str, int]]:
    """(n_bins, split, half, pos) of every split for every count of bins."""
    return [(n, name, half, pos) for n in range(1, max_bins + 1) for name, one, two in kernels.splits(n) for half, part in (("a", one), ("b", two)) for pos in part]


def _known(method: str) -> str:
    if method not in fixed.METHODS:
        raise ValueError(f"unknown method {method!r}")
    return method


def split_half(evidence: DataFrame, min_half: int = fixed.MIN_BINS, method: str = "median", width: int = 1280, height: int = 720) -> DataFrame:
    """The verdict on each recording's box by ``method``: worst overlap and area ratio over the splits of all its bins."""
    _known(method)
    kind = evidence.schema["recording_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bin")
        held = list(zip(*(rows.column(s).to_pylist() for s in boxes.SIDES), strict=True))
        scores, few = kernels.split_scores(held, method, width, height, min_half)
        stable, reason = kernels.verdict(scores)
        worst = [min(x) for x in zip(*scores, strict=True)] or [None, None]
        return pa.table(
            {
                "recording_id": rows.column("recording_id").slice(0, 1),
                "n_bins": pa.array([len(held)], pa.int32()),
                "worst_iou": pa.array(worst[:1], pa.float64()),
                "worst_area_ratio": pa.array(worst[1:], pa.float64()),
                "n_evaluated": pa.array([len(scores)], pa.int64()),
                "n_insufficient": pa.array([few], pa.int64()),
                "stable": pa.array([stable], pa.bool_()),
                "reason": pa.array([reason], pa.string()),
            }
        )

    flat = evidence.select("recording_id", "bin", *(F.col("box")[s].alias(s) for s in boxes.SIDES))
    schema = f"recording_id {kind}, n_bins int, worst_iou double, worst_area_ratio double, n_evaluated long, n_insufficient long, stable boolean, reason string"
    return flat.groupBy("recording_id").applyInArrow(run, schema)


def segments(evidence: DataFrame, method: str = "median", width: int = 1280, height: int = 720) -> DataFrame:
    """Boxes of the contiguous parts: early and late from two bins on, thirds from three on (the last takes the rest).

    A part without a box by the method has a null one.
    """
    placed = ev.positions(evidence)
    n, p = F.col("n_bins"), F.col("pos")
    half = F.when(n >= 2, F.when(p < F.floor(n / 2), "early").otherwise("late"))
    third = F.floor(n / 3)
    part = F.when(n >= 3, F.when(p < third, "first_third").when(p < 2 * third, "middle_third").otherwise("last_third"))
    named = placed.withColumn("segment", F.explode(F.array(half, part))).where("segment is not null")
    if _known(method) in ("median", "quantile"):
        return named.groupBy("recording_id", "segment").agg(F.count(F.lit(1)).alias("n"), (ev.median_box() if method == "median" else ev.quantile_box()).alias("box"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held = [tuple(b[s] for s in boxes.SIDES) for b in rows.sort_by("bin").column("box").to_pylist()]
        found = kernels.estimate(held, method, width, height)
        box = None if found is None else dict(zip(boxes.SIDES, found, strict=True))
        return pa.table({"recording_id": pa.array([key[0].as_py()], pa.int64()), "segment": pa.array([key[1].as_py()], pa.string()), "n": pa.array([len(held)], pa.int64()), "box": pa.array([box], pa.struct([(s, pa.int32()) for s in boxes.SIDES]))})

    return named.select("recording_id", "segment", "bin", "box").groupBy("recording_id", "segment").applyInArrow(run, f"recording_id long, segment string, n long, box {boxes.BOX}")


def bootstrap(evidence: DataFrame, resamples: int = 1000, block: int = 3, method: str = "median", width: int = 1280, height: int = 720) -> DataFrame:
    """recording_id, resample and the box, by ``method``, of each block-bootstrap resample; none below ``block`` bins."""

    _known(method)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held = [tuple(b[s] for s in boxes.SIDES) for b in rows.sort_by("bin").column("box").to_pylist()]
        found = kernels.bootstrap_boxes(held, resamples, block, method, width, height)
        kind = pa.struct([(s, pa.int32()) for s in boxes.SIDES])
        return pa.table({"recording_id": pa.array([key[0].as_py()] * len(found), pa.int64()), "resample": pa.array(range(len(found)), pa.int32()), "box": pa.array([dict(zip(boxes.SIDES, f, strict=True)) for f in found], kind)})

    return evidence.select("recording_id", "bin", "box").groupBy("recording_id").applyInArrow(run, f"recording_id long, resample int, box {boxes.BOX}")
