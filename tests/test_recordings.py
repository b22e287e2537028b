import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeline import __main__ as cli
from scopeline.functions import boxes, fixed
from scopeline.operators import cadence, kernels, masks, session, stability
from scopeline.operators.session import Monitor, attempted
from scopeline.plans.pipelines import analyze_recordings
from scopeline.session import shared_dir
from scopeline.sources import sinks, tables

SIDE = 24


def clip(recording, n, lost=()):
    """Frames with tissue in the middle and a popup box that stays, or none of it in recording 2."""
    rows = []
    for i in range(n):
        if i in lost:
            continue
        for y in range(SIDE):
            for x in range(SIDE):
                cls = fixed.TISSUE if 1 <= y < 23 and 1 <= x < 23 else 0
                if recording != 2 and 14 <= y < 23 and 14 <= x < 23:
                    cls = fixed.POPUP
                shade = 40 + (x * 37 + y * 61 + i) % 180
                rows.append((recording, i, y, x, cls, shade, 20, 60, 60 + shade % 150))
    return rows


SCHEMA = "recording_id long, frame_index long, y int, x int, cls int, gray int, b int, g int, r int"


@pytest.fixture(scope="module")
def analysed(spark):
    rows = clip(1, 40) + clip(2, 30) + clip(3, 20, lost=(7, 11))
    recordings = spark.createDataFrame([(1, 40, 4.0), (2, 30, 2.0), (3, 20, 4.0), (4, 0, 4.0), (5, 10, None)], "recording_id long, n_frames long, fps double")
    pixels = spark.createDataFrame(rows, SCHEMA).cache()
    yield recordings, pixels, analyze_recordings(recordings, pixels, SIDE, SIDE, min_area=10, min_rim=3)
    pixels.unpersist()


def test_recordings_end_to_end(analysed):
    out = {r.recording_id: r for r in analysed[2].result.collect()}
    assert {k: r.status for k, r in out.items()} == {1: "ok", 2: "ok", 3: "decode_failed", 4: "no_frames", 5: "no_frame_rate"}
    assert out[3].first_missing == 7 and out[3].inner_box is None and out[3].active_reason is None and out[3].n_frames_monitored == 0
    assert out[1].view_reason == fixed.OK == out[2].view_reason and out[1].inner_box is not None and out[1].n_calibration_frames == 24 == out[1].n_admissible
    assert (out[1].effective_monitor_hz, out[2].effective_monitor_hz, out[1].monitor_hz) == (4.0, 2.0, fixed.MONITOR_HZ) and out[1].n_frames_monitored == out[1].n_frames_in_source == 40
    # the popup stays where it is, so the monitor locks it and keeps it
    assert out[1].active_box is not None and out[1].n_locks == 1 and out[1].active_reason == fixed.OK == out[1].gate_reason
    assert out[2].active_box is None and out[2].active_reason == fixed.UNLOCKED and out[2].n_locks == 0


def test_records_are_the_monitor_s_own_and_failed_recordings_have_none(analysed):
    recordings, pixels, found = analysed
    got = {}
    for r in found.records.orderBy("recording_id", "frame_index").collect():
        got.setdefault(r.recording_id, []).append((r.frame_index, r.t, r.box and tuple(r.box), r.state, r.epoch, r.event, r.reason))
    assert set(got) == {1, 2} and [r[0] for r in got[2]] == list(range(30))
    box = next(b for _, _, b, *_ in got[1] if b)
    monitor, expected = Monitor(1 / 4.0, SIDE, SIDE), []
    for i in range(40):
        o = monitor.step(f"f{i:06d}", i / 4.0, box)
        expected.append((i, round(i / 4.0, 6), o["box"], o["state"], o["epoch"], o["event"], o["reason"]))
    assert got[1] == expected


def test_a_disabled_monitor_reads_nothing_for_itself(analysed):
    recordings, pixels, _ = analysed
    found = analyze_recordings(recordings, pixels, SIDE, SIDE, enabled=False, min_area=10, min_rim=3)
    out = {r.recording_id: r for r in found.result.collect()}
    assert out[1].active_reason == fixed.DISABLED and out[1].active_box is None and out[1].inner_box is not None and not out[1].pip_enabled
    assert out[1].n_frames_monitored == 0 and found.records.count() == 0


def test_command_line_of_recordings(spark, analysed, tmp_path):
    recordings, pixels, _ = analysed
    recordings.write.parquet(str(tmp_path / "r"))
    pixels.where("recording_id = 1").write.parquet(str(tmp_path / "p"))
    common = ["--width", str(SIDE), "--height", str(SIDE), "--min-area", "10", "--min-rim", "3"]
    assert cli.main(["recording", str(tmp_path / "p"), str(tmp_path / "out"), "--recordings", str(tmp_path / "r"), *common]) == 0
    said = {r.recording_id: r for r in spark.read.json(str(tmp_path / "out/sessions")).collect()}
    # frames of recordings 2 and 3 are not there at all
    assert said[1].status == "ok" and said[2].status == "decode_failed" == said[3].status and said[1].caveat
    assert spark.read.text(str(tmp_path / "out/records")).count() == 40
    assert cli.main(["frames", str(tmp_path / "p"), str(tmp_path / "frames"), *common]) == 0
    assert spark.read.json(str(tmp_path / "frames")).count() == 40
    with pytest.raises(SystemExit):
        cli.main(["recording", str(tmp_path / "p"), str(tmp_path / "x")])


def test_missing_frames_are_those_that_are_due(spark):
    due = spark.createDataFrame([(1, 0), (1, 5), (2, 3)], "recording_id long, frame_index long")
    there = spark.createDataFrame([(1, 0), (2, 4)], "recording_id long, frame_index long")
    assert sorted(tuple(r) for r in cadence.missing_frames(due, there).collect()) == [(1, 5), (2, 3)]


def ticks(boxes_at):
    return [(f"f{i:03d}", float(t), b) for i, (t, b) in enumerate(boxes_at)]


A, B = (100, 100, 300, 250), (700, 400, 900, 550)


@pytest.mark.parametrize(
    "held,method,reason,bins",
    [
        ([(0, A), (1, A)], "median", fixed.INSUFFICIENT, 0),
        ([(0, A), (0.1, A), (0.2, A)], "median", fixed.INSUFFICIENT, 1),
        ([(0, A), (2, A), (4, A)], "median", fixed.INSUFFICIENT_SPLIT, 3),
        ([(t, A) for t in range(6)], "median", fixed.OK, 6),
        ([(t, A if t % 2 else B) for t in range(8)], "median", fixed.UNSTABLE, 8),
        ([(t, A if t % 2 else B) for t in range(8)], "cluster", fixed.AMBIGUOUS, 8),
        ([(t, (100, 100, 104, 250)) for t in range(8)], "quantile", fixed.TOO_SMALL, 8),
        ([(t, (-9, 100, 104, 250)) for t in range(8)], "occupancy", fixed.OUT_OF_FRAME, 8),
    ],
)
def test_an_attempt_names_the_first_gate_that_fails(held, method, reason, bins):
    found = attempted(ticks(held), 1280, 720, method)
    assert (found["reason"], found["n_bins"], found["n_routed"]) == (reason, bins, len(held)) and (found["box"] is not None) == (reason == fixed.OK)
    if method == "cluster":
        assert found["cluster"] == fixed.COMPETING
    if reason == fixed.UNSTABLE:
        assert found["worst_iou"] < fixed.MIN_SPLIT_IOU
    if reason == fixed.UNSTABLE:
        assert attempted(ticks(held), 1280, 720, method, require_stability=False)["reason"] == fixed.OK


def test_the_monitor_keeps_its_last_gate(spark):
    monitor = Monitor(0.5, 1280, 720)
    seen = [monitor.step(*tick)["gate"] for tick in ticks([(t, A) for t in range(8)])]
    assert [g["reason"] for g in seen if g][-1] == fixed.OK and [g and g["reason"] for g in seen[:2]] == [fixed.INSUFFICIENT] * 2
    assert monitor.manifest()["gate"]["box"] == A and monitor.manifest()["n_bins"] == 8 and monitor.manifest()["attempts"] == monitor.attempts
    back = Monitor.load(json.loads(json.dumps(monitor.dump())))
    assert back.gate == monitor.gate and back == monitor
    rows = [(k, f, t, b and dict(zip(boxes.SIDES, b, strict=True)), 0.5) for k in (1, 2) for f, t, b in ticks([(t, A if k == 1 or t % 2 else B) for t in range(8)])]
    df = spark.createDataFrame(rows, f"recording_id long, frame_id string, t double, box {boxes.BOX}, every double")
    out = {r.recording_id: r for r in session.summary(df, "every", 1280, 720).collect()}
    assert out[1].gate_reason == fixed.OK and out[2].gate_reason == fixed.UNSTABLE and out[2].gate_iou < 0.95 and out[2].n_attempts > 2 and out[2].gate_bins == 8


@pytest.mark.parametrize("method", fixed.METHODS)
def test_batch_stability_and_segments_by_every_method(spark, method):
    draw = np.random.default_rng(1)
    held = {k: [(b, tuple(int(v) for v in np.array(A) + draw.integers(-3, 4) * k)) for b in range(n)] for k, n in ((1, 9), (2, 2), (3, 70), (4, 1))}
    df = spark.createDataFrame([(k, b, dict(zip(boxes.SIDES, box, strict=True))) for k, x in held.items() for b, box in x], f"recording_id long, bin int, box {boxes.BOX}")
    for r in stability.split_half(df, method=method).collect():
        scores, few = kernels.split_scores([b for _, b in held[r.recording_id]], method, 1280, 720)
        assert (r.n_evaluated, r.n_insufficient, r.stable, r.reason) == (len(scores), few, *kernels.verdict(scores)) and r.n_bins == len(held[r.recording_id])
    got = {(r.recording_id, r.segment): (r.n, r.box and tuple(r.box)) for r in stability.segments(df, method).collect()}
    expected = {}
    for k, x in held.items():
        one, n = [b for _, b in x], len(x)
        parts = ({"early": one[: n // 2], "late": one[n // 2 :]} if n >= 2 else {}) | ({"first_third": one[: n // 3], "middle_third": one[n // 3 : 2 * (n // 3)], "last_third": one[2 * (n // 3) :]} if n >= 3 else {})
        expected |= {(k, name): (len(p), kernels.estimate(p, method, 1280, 720)) for name, p in parts.items()}
    assert got == expected
    assert {r.recording_id: r.n for r in stability.bootstrap(df, 20, method=method).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 20, 3: 20}
    with pytest.raises(ValueError):
        stability.segments(df, "mean")


def test_crop_choices_refuses_what_makes_no_sense(spark):
    pixels = spark.createDataFrame(clip(1, 2), SCHEMA)
    votes, presence = masks.agreement(pixels), masks.popup_presence(pixels, SIDE * SIDE)
    for bad in (0.0, 1.1, -1, float("nan")):
        with pytest.raises(ValueError):
            masks.agreement(pixels, bad)
    for bad in ({"min_share": -0.1}, {"min_share": 1.5}, {"min_frames": 2}):
        with pytest.raises(ValueError):
            masks.popup_presence(pixels, SIDE * SIDE, **bad)
    with pytest.raises(ValueError):
        masks.crop_choices(votes, presence, SIDE, SIDE, detector=False, popup_mask_reliable=True)
    raw, trusted = (masks.crop_choices(votes, presence, SIDE, SIDE, popup_mask_reliable=x).first() for x in (False, True))
    assert not raw.popup_mask_reliable and raw.popup_mask_reason and trusted.popup_mask_reliable and raw.inner_box == trusted.inner_box
    none = masks.crop_choices(votes.where("false"), presence, SIDE, SIDE).first()
    assert none.reason == "no masks" and none.inner_box is None
    other = spark.createDataFrame([(1, 9, 40, 40, 0, 0, 0, 0, 0)], SCHEMA)
    assert [r.recording_id for r in masks.mixed_sizes(pixels.unionByName(other)).collect()] == [1] and masks.mixed_sizes(pixels).count() == 0


def test_model_files_must_be_as_expected():
    good = {"model_state": {"a": 1.0, "b": 2.0}, "config": {"model": {"num_classes": 4, "base_channels": 8}}}

    def check(found):
        return tables.checked_network(found, 4, 8, 2, lambda v: isinstance(v, float))

    assert check(good) == good["config"]["model"]
    for bad in (
        {"config": good["config"]},
        {"model_state": good["model_state"]},
        good | {"config": {"model": {"num_classes": 3, "base_channels": 8}}},
        good | {"config": {"model": {"num_classes": 4, "base_channels": 16}}},
        good | {"config": {}},
        good | {"model_state": {"a": 1.0}},
        good | {"model_state": {"a": 1.0, "b": "x"}},
    ):
        with pytest.raises(tables.ModelFileError):
            check(bad)


def test_overlays_colour_what_the_mask_marks(spark):
    picture = np.full((2, 2, 3), 100, np.uint8)
    df = spark.createDataFrame([(1, 0, 2, 2, picture.tobytes(), bytes([0, 1, 2, 3]))], "recording_id long, frame_index long, width int, height int, pixels binary, labels binary")
    out = np.frombuffer(sinks.overlays(df).first().overlay, np.uint8).reshape(4, 3)
    assert out[0].tolist() == [100] * 3
    for i, colour in enumerate(sinks.CLASS_COLOURS, 1):
        assert out[i].tolist() == [round(0.55 * 100 + 0.45 * c) for c in colour]


def test_boxes_of_another_resolution_are_refused():
    assert kernels.box_reason(A, 1280, 720, (1280, 720)) == fixed.VALID and kernels.box_reason(A, 1280, 720, (640, 360)) == fixed.MISMATCH


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
