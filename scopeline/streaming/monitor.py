"""The monitor over a stream: the batch fold's state object behind a stateful processor.

Late policy: a tick at or before the last one folded of its recording is
dropped and counted; a micro-batch's ticks of a recording are folded in order
of (t, frame_id). State is bounded by the monitor's own windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import boxes, fixed
from ..operators.session import Monitor

OUTPUT = f"recording_id long, frame_id string, t double, box {boxes.BOX}, state string, epoch int, event string, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MonitorProcessor(StatefulProcessor):
    """One ``Monitor`` a recording, kept as JSON between micro-batches."""

    def __init__(self, interval: float, width: int, height: int, method: str, bin_sec: float):
        self.args = (interval, width, height, method, bin_sec)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("monitor", StructType([StructField("json", StringType()), StructField("dropped", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        monitor, last, dropped = Monitor(*self.args), None, 0
        if self.state.exists():
            text, dropped = self.state.get()
            held = json.loads(text)
            last = tuple(held.pop("last")) if held["last"] else held.pop("last")
            monitor = Monitor.load(held)
        ticks = pd.concat(list(rows)).sort_values(["t", "frame_id"], kind="stable")
        out = []
        for tick in ticks.itertuples(index=False):
            if last is not None and (tick.t, tick.frame_id) <= last:
                dropped += 1
                continue
            last = (float(tick.t), tick.frame_id)
            sides = [getattr(tick, s) for s in boxes.SIDES]
            out.append(monitor.step(tick.frame_id, float(tick.t), None if pd.isna(sides[0]) else tuple(int(s) for s in sides)))
        self.state.update((json.dumps(monitor.dump() | {"last": last}), dropped))
        if out:
            yield pd.DataFrame(
                {
                    "recording_id": [key[0]] * len(out),
                    "box": [None if o["box"] is None else dict(zip(boxes.SIDES, o["box"], strict=True)) for o in out],
                    **{n: [o[n] for o in out] for n in ("frame_id", "t", "state", "epoch", "event", "reason")},
                }
            )[["recording_id", "frame_id", "t", "box", "state", "epoch", "event", "reason"]]

    def close(self) -> None:
        pass


def monitor(stream: DataFrame, interval: float, width: int, height: int, method: str = "median", bin_sec: float = fixed.BIN_SEC) -> DataFrame:
    """Records of a stream of ticks (recording_id, frame_id, t, box); needs the RocksDB state store (``ROCKSDB``)."""
    flat = stream.selectExpr("recording_id", "frame_id", "t", *(f"box.{s} as {s}" for s in boxes.SIDES))
    processor = MonitorProcessor(interval, width, height, method, bin_sec)
    return flat.groupBy("recording_id").transformWithStateInPandas(processor, outputStructType=_output(), outputMode="append", timeMode="none")


def _output() -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(OUTPUT)
