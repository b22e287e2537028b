"""The causal monitor: one state object a recording, folded over its ticks in order.

Batch and streaming call the same ``Monitor``; its state is bounded by the
evidence window and by the rings, and turns into plain values and back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, fixed
from . import kernels

Box = tuple[int, int, int, int]


def representatives(held: list[tuple[str, float, Box]], bin_sec: float) -> tuple[list[tuple[str, float, Box]], float]:
    """One observation a bin, nearest to its centre, and the span of all."""
    first, last = min(o[1] for o in held), max(o[1] for o in held)
    best: dict[int, tuple] = {}
    for frame, t, box in held:
        k = math.floor((t - first) / bin_sec)
        rank = (abs(t - (first + (k + 0.5) * bin_sec)), frame)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (frame, t, box))
    return [best[k][1] for k in sorted(best)], last - first


def attempted(held: list[tuple[str, float, Box]], width: int, height: int, method: str, bin_sec: float = fixed.BIN_SEC, require_stability: bool = True) -> dict:
    """One attempt to vouch for a box: reason (the first gate that fails, else ok) and what the gates saw.

    The gates are: enough evidence, an estimate, a legal box, and halves that
    agree. box is null unless all passed.
    """
    out = {"reason": fixed.INSUFFICIENT, "box": None, "n_routed": len(held), "n_bins": 0, "worst_iou": None, "worst_area_ratio": None, "cluster": ""}
    if len(held) < fixed.MIN_ROUTED:
        return out
    chosen, span = representatives(held, bin_sec)
    out["n_bins"] = len(chosen)
    if len(chosen) < fixed.MIN_BINS or span < fixed.MIN_SPAN:
        return out
    boxes_held = [o[2] for o in chosen]
    if method == "cluster":
        box, out["cluster"] = kernels.cluster_box(boxes_held, width, height)
    else:
        box = kernels.estimate(boxes_held, method, width, height)
    if box is None:
        return out | {"reason": fixed.AMBIGUOUS if method == "cluster" else fixed.INSUFFICIENT}
    legal = kernels.box_reason(box, width, height)
    if legal != fixed.VALID:
        return out | {"reason": legal}
    if require_stability:
        scores, _ = kernels.split_scores(boxes_held, method, width, height)
        if scores:
            out["worst_iou"], out["worst_area_ratio"] = (min(x) for x in zip(*scores, strict=True))
        stable, why = kernels.verdict(scores)
        if not stable:
            return out | {"reason": why}
    return out | {"reason": fixed.OK, "box": box}


@dataclass
class Monitor:
    """State of one recording. ``step`` folds a tick in and says what it did."""

    interval: float
    width: int
    height: int
    method: str = "median"
    bin_sec: float = fixed.BIN_SEC
    require_stability: bool = True
    locked: Box | None = None
    epoch: int = 0
    last_positive: float | None = None
    drift_since: float | None = None
    drift_count: int = 0
    evidence: list = field(default_factory=list)
    ring: list = field(default_factory=list)
    drift_ring: list = field(default_factory=list)
    observed: int = 0
    routed: int = 0
    locks: int = 0
    unlocks: int = 0
    attempts: int = 0
    inferred: int = 0
    expired: int = 0
    rejected: int = 0
    #: The last attempt to lock: ``attempted``'s result, none before the first.
    gate: dict | None = None

    def __post_init__(self) -> None:
        if not self.interval > 0:
            raise ValueError("the interval must be positive")
        if self.method not in fixed.METHODS:
            raise ValueError(f"unknown method {self.method!r}")

    def step(self, frame: str, t: float, box: Box | None) -> dict:
        """A record of the tick: event, live box, state, epoch and reason.

        An illegal box counts as a tick without one. Drift is judged against the
        box locked before the tick. A confirmed unlock starts a new epoch, and the
        tick that confirmed it is no evidence for the next one.
        """
        self.observed += 1
        rejected = box is not None and kernels.box_reason(box, self.width, self.height) != fixed.VALID
        self.rejected += rejected
        event, tried = None, self.attempts
        if box is None or rejected:
            self.last_positive = None
            self._steady()
        else:
            self.routed += 1
            self.last_positive = t
            self.ring = [*self.ring, frame][-fixed.ID_RING :]
            if self.locked is not None and self._moved(frame, t, box):
                self.locked, self.evidence, self.drift_ring, self.gate = None, [], [], None
                self.unlocks += 1
                self.epoch += 1
                self._steady()
                event = "unlock"
            else:
                self._remember(frame, t, box)
                if self.locked is None and self._attempt():
                    event = "relock" if self.unlocks else "lock"
        live, reason = self._live(t)
        return {"frame_id": frame, "t": t, "box": live, "state": "locked" if self.locked is not None else "unlocked", "epoch": self.epoch, "event": event, "reason": reason, "rejected": rejected, "gate": self.gate if self.attempts > tried else None}

    def _steady(self) -> None:
        self.drift_count, self.drift_since = 0, None

    def _moved(self, frame: str, t: float, box: Box) -> bool:
        """Whether the tick confirms that the box has moved: long enough and often enough in a row."""
        self.drift_ring = [*self.drift_ring, frame][-fixed.DRIFT_RING :]
        if kernels.iou(box, self.locked) >= fixed.DRIFT_IOU:
            self._steady()
            return False
        if self.drift_since is None:
            self.drift_since = t
        self.drift_count += 1
        return t - self.drift_since >= fixed.DRIFT_PATIENCE and self.drift_count >= fixed.DRIFT_COUNT

    def _remember(self, frame: str, t: float, box: Box) -> None:
        oldest = t - fixed.EVIDENCE_BINS * self.bin_sec
        kept = [o for o in self.evidence if o[1] > oldest] if self.evidence and self.evidence[0][1] <= oldest else self.evidence
        self.evidence = [*kept, (frame, t, box)][-fixed.EVIDENCE_ROWS :]

    def _attempt(self) -> bool:
        """Locks the evidence's box if it passes every gate; ``gate`` keeps what it found and the first gate that failed."""
        self.attempts += 1
        self.gate = attempted(self.evidence, self.width, self.height, self.method, self.bin_sec, self.require_stability)
        if self.gate["reason"] != fixed.OK:
            return False
        self.locked, self.drift_ring = self.gate["box"], []
        self.locks += 1
        self._steady()
        return True

    def _live(self, t: float) -> tuple[Box | None, str]:
        if self.locked is None:
            return None, fixed.UNLOCKED
        if self.last_positive is None or t - self.last_positive > fixed.TTL_FACTOR * self.interval:
            self.expired += 1
            return None, fixed.EXPIRED
        reason = kernels.box_reason(self.locked, self.width, self.height)
        if reason != fixed.VALID:
            return None, reason
        self.inferred += 1
        return self.locked, fixed.OK

    def size(self) -> dict[str, int]:
        """Rows held, all of them bounded, and the bins that the evidence falls into."""
        bins = len(representatives(self.evidence, self.bin_sec)[0]) if self.evidence else 0
        return {"evidence": len(self.evidence), "bins": bins, "ring": len(self.ring), "drift_ring": len(self.drift_ring)}

    def manifest(self) -> dict:
        """What the monitor is set to and has come to, without the evidence itself."""
        held = {n: getattr(self, n) for n in ("method", "bin_sec", "require_stability", "epoch", "attempts", "locks", "unlocks", "gate")}
        return held | {f"n_{n}": k for n, k in self.size().items()}

    def dump(self) -> dict:
        return asdict(self)

    @classmethod
    def load(cls, state: dict) -> Monitor:
        state = dict(state)
        state["evidence"] = [(f, t, tuple(b)) for f, t, b in state["evidence"]]
        state["locked"] = tuple(state["locked"]) if state["locked"] else None
        if state["gate"] and state["gate"]["box"]:
            state["gate"] = state["gate"] | {"box": tuple(state["gate"]["box"])}
        return cls(**state)


BOX_TYPE = pa.struct([(s, pa.int32()) for s in boxes.SIDES])
RECORD = f"recording_id long, frame_id string, t double, box {boxes.BOX}, state string, epoch int, event string, reason string"
SUMMARY = (
    f"recording_id long, n_monitored long, n_routed long, n_locks long, n_unlocks long, n_rejected long, n_inferred long, n_expired long, epoch int, box {boxes.BOX}, reason string, "
    "n_attempts long, gate_reason string, gate_bins int, gate_iou double, gate_area_ratio double, gate_cluster string"
)


def _struct(box: Box | None) -> dict | None:
    return None if box is None else dict(zip(boxes.SIDES, box, strict=True))


def _tuple(box: dict | None) -> Box | None:
    return None if box is None else tuple(box[s] for s in boxes.SIDES)


def _ticks(observations: DataFrame, interval: float | str) -> DataFrame:
    """The columns that a fold reads; ``interval`` is a number or the column that has it."""
    return observations.select("recording_id", "frame_id", "t", "box", (F.col(interval) if isinstance(interval, str) else F.lit(float(interval))).alias("_interval"))


def _ordered(rows: pa.Table) -> tuple[float, Iterator[tuple[str, float, Box | None]]]:
    """A recording's interval and its ticks in order."""
    rows = rows.sort_by([("t", "ascending"), ("frame_id", "ascending")])
    frame, t, box = (rows.column(n).to_pylist() for n in ("frame_id", "t", "box"))
    return rows.column("_interval")[0].as_py(), zip(frame, t, map(_tuple, box), strict=True)


def fold(observations: DataFrame, interval: float | str, width: int, height: int, method: str = "median", bin_sec: float = fixed.BIN_SEC) -> DataFrame:
    """The monitor's record of every tick: one shuffle by recording, then an ordered fold.

    Ticks of a recording are ordered by t, ties by frame id. The drift comparison
    depends on earlier locks, so no window can express it. ``interval`` is a
    number, or the name of a column that has each recording's.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        every, ticks = _ordered(rows)
        monitor = Monitor(every, width, height, method, bin_sec)
        out = [monitor.step(*tick) for tick in ticks]
        return pa.table(
            {
                "recording_id": pa.array([key[0].as_py()] * len(out), pa.int64()),
                "frame_id": pa.array([o["frame_id"] for o in out], pa.string()),
                "t": pa.array([o["t"] for o in out], pa.float64()),
                "box": pa.array([_struct(o["box"]) for o in out], BOX_TYPE),
                "state": pa.array([o["state"] for o in out], pa.string()),
                "epoch": pa.array([o["epoch"] for o in out], pa.int32()),
                "event": pa.array([o["event"] for o in out], pa.string()),
                "reason": pa.array([o["reason"] for o in out], pa.string()),
            }
        )

    return _ticks(observations, interval).groupBy("recording_id").applyInArrow(run, RECORD)


def summary(observations: DataFrame, interval: float | str, width: int, height: int, method: str = "median", bin_sec: float = fixed.BIN_SEC, enabled: bool = True) -> DataFrame:
    """One row a recording: counters, final state and the last attempt's gates; a disabled monitor has the reason alone."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        every, ticks = _ordered(rows)
        monitor, last = Monitor(every, width, height, method, bin_sec), {"box": None, "reason": fixed.DISABLED}
        for tick in ticks if enabled else ():
            last = monitor.step(*tick)
        gate = monitor.gate or dict.fromkeys(("reason", "n_bins", "worst_iou", "worst_area_ratio", "cluster"))
        counters = (monitor.observed, monitor.routed, monitor.locks, monitor.unlocks, monitor.rejected, monitor.inferred, monitor.expired, monitor.epoch)
        values = (key[0].as_py(), *counters, _struct(last["box"]), last["reason"], monitor.attempts, gate["reason"], gate["n_bins"], gate["worst_iou"], gate["worst_area_ratio"], gate["cluster"])
        names = [c.split()[0] for c in SUMMARY.replace(boxes.BOX, "box").split(", ")]
        kinds = [*[pa.int64()] * 8, pa.int32(), BOX_TYPE, pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return _ticks(observations, interval).groupBy("recording_id").applyInArrow(run, SUMMARY)
