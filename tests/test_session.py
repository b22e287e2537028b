import numpy as np
import pytest

from scopeline.functions import fixed
from scopeline.operators import kernels, session
from scopeline.operators.session import Monitor

A, B = (900, 460, 1100, 610), (200, 120, 400, 270)
W, H = 1280, 720


def drive(ticks, **kw):
    monitor = Monitor(0.2, W, H, **kw)
    return [monitor.step(f"f{i:06d}", t, box) for i, (t, box) in enumerate(ticks)], monitor


def ticks(start, box, n=60):
    return [(start + 0.2 * i, box) for i in range(n)]


def test_trace_of_a_relocation():
    records, monitor = drive(ticks(0, A) + ticks(20, B))
    events = [(round(r["t"], 6), r["event"], r["epoch"], r["box"]) for r in records if r["event"]]
    assert events == [(3.0, "lock", 0, A), (21.0, "unlock", 1, None), (24.2, "relock", 1, B)]
    by_time = {round(r["t"], 6): r for r in records}
    assert by_time[2.8]["reason"] == fixed.UNLOCKED and by_time[2.8]["box"] is None
    # until the move is confirmed the old box is reported
    assert by_time[20.8]["box"] == A and by_time[20.8]["reason"] == fixed.OK
    assert by_time[21.2]["box"] is None and by_time[24.0]["state"] == "unlocked"
    assert records[-1]["box"] == B and (monitor.locks, monitor.unlocks, monitor.epoch) == (2, 1, 1)


def test_no_lock_without_positives_or_span():
    assert all(r["box"] is None for r in drive([(0.2 * i, None) for i in range(40)])[0])
    assert all(r["box"] is None for r in drive(ticks(0, A, 15))[0])


def test_a_negative_tick_ends_output_but_not_the_lock():
    records, monitor = drive([*ticks(0, A, 30), (6.0, None), (6.2, A)])
    assert records[-2]["reason"] == fixed.EXPIRED and records[-2]["state"] == "locked" and records[-1]["box"] == A
    assert monitor.unlocks == 0


def test_ttl_ends_at_one_and_a_half_intervals():
    monitor = Monitor(0.2, W, H)
    for t, box in ticks(0, A, 30):
        monitor.step("f", t, box)
    assert monitor._live(5.8 + 0.3)[1] == fixed.OK and monitor._live(5.8 + 0.31)[1] == fixed.EXPIRED


def test_an_illegal_box_is_a_negative_tick():
    records, monitor = drive([(0.2 * i, (W - 10, H - 10, W + 500, H + 500)) for i in range(40)])
    assert all(r["box"] is None and r["rejected"] for r in records) and monitor.routed == 0


def test_records_do_not_depend_on_later_ticks():
    whole = drive(ticks(0, A) + ticks(20, B))[0]
    assert drive(ticks(0, A))[0] == whole[:60]


def test_state_is_bounded_and_survives_a_round_trip():
    import json

    monitor = Monitor(0.2, W, H)
    rest = None
    for i, (t, box) in enumerate([(0.01 * k, A) for k in range(9000)]):
        if i == 4500:
            rest = Monitor.load(json.loads(json.dumps(monitor.dump())))
        one = monitor.step(f"f{i}", t, box)
        assert rest is None or rest.step(f"f{i}", t, box) == one
    assert monitor.size()["evidence"] <= fixed.EVIDENCE_ROWS and monitor.size()["ring"] <= fixed.ID_RING and monitor.size()["drift_ring"] <= fixed.DRIFT_RING


def test_unknown_settings_raise():
    with pytest.raises(ValueError):
        Monitor(0.0, W, H)
    with pytest.raises(ValueError):
        Monitor(0.2, W, H, method="mean")


@pytest.mark.parametrize("method", fixed.METHODS)
def test_every_method_locks_a_steady_box(method):
    assert drive(ticks(0, A), method=method)[0][-1]["box"] == A


def observations(spark):
    rows = [(r, f"f{i:06d}", t, None if (i + r) % 17 == 0 else dict(zip(("x1", "y1", "x2", "y2"), box, strict=True))) for r in range(3) for i, (t, box) in enumerate(ticks(0, A) + ticks(20, B))]
    return spark.createDataFrame(rows, "recording_id long, frame_id string, t double, box struct<x1:int,y1:int,x2:int,y2:int>")


def test_batch_fold_equals_the_object(spark):
    got = {(r.recording_id, r.frame_id): (r.event, r.epoch, r.reason) for r in session.fold(observations(spark), 0.2, W, H).collect()}
    held = [(t, None if i % 17 == 0 else box) for i, (t, box) in enumerate(ticks(0, A) + ticks(20, B))]
    for i, r in enumerate(drive(held)[0]):
        assert got[(0, f"f{i:06d}")] == (r["event"], r["epoch"], r["reason"])


def test_stream_equals_batch(spark, tmp_path):
    from scopeline.streaming.monitor import monitor

    every = observations(spark)
    for k in range(2):  # two files, so two micro-batches in the order of time
        every.where(f"(t >= 10) = ({k} = 1)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = monitor(stream, 0.2, W, H).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(spark.table("records").collect(), key=lambda r: (r.recording_id, r.t))
    expected = sorted(session.fold(every, 0.2, W, H).collect(), key=lambda r: (r.recording_id, r.t))
    assert got == expected


def test_stability_needs_bins_and_agreement():
    assert kernels.stability([A] * 3, "median", W, H) == (False, fixed.INSUFFICIENT_SPLIT)
    assert kernels.stability([A] * 4, "median", W, H) == (True, fixed.OK)
    assert kernels.stability([A, A, B, B], "median", W, H) == (False, fixed.UNSTABLE)


def test_splits_are_fixed_halves():
    for n in (1, 2, 5, 60):
        assert len(kernels.splits(n)) == 8
        for _, a, b in kernels.splits(n):
            assert sorted(a + b) == list(range(n)) and kernels.splits(n) == kernels.splits(n)


def test_cluster_does_not_chain_and_needs_dominance():
    slide = [(100 + 60 * i, 100, 300 + 60 * i, 250) for i in range(12)]
    assert kernels.cluster_box(slide, W, H)[0] is None
    assert kernels.cluster_box([A] * 8 + [B] * 2, W, H)[0] == A
    assert kernels.cluster_box([A, B] * 4, W, H) == (None, fixed.COMPETING)


def test_complete_linkage_equals_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(20):
        points = draw.random((draw.integers(1, 14), 2)).round(1)
        groups = [[i] for i in range(len(points))]
        distance = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
        while len(groups) > 1:
            cost, a, b = min((distance[np.ix_(groups[a], groups[b])].max(), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            if cost > 0.35:
                break
            groups[a] += groups.pop(b)
        assert kernels.linked(points, 0.35) == groups


def test_occupancy_is_the_half_covered_area():
    assert kernels.occupancy_box([(0, 0, 10, 10), (2, 2, 12, 12), (50, 50, 60, 60)]) == (2, 2, 10, 10)
    assert kernels.occupancy_box([(0, 0, 10, 10), (20, 20, 30, 30), (40, 40, 50, 50)]) is None


def test_bootstrap_is_seeded():
    held = [(i, i, 50 + i, 60 + i) for i in range(10)]
    assert kernels.bootstrap_boxes(held[:2]) == [] and len(kernels.bootstrap_boxes(held, 50)) == 50
    assert kernels.bootstrap_boxes(held, 50) == kernels.bootstrap_boxes(held, 50)


@pytest.mark.parametrize("method", ["median", "quantile"])
def test_bootstrap_equals_one_resample_after_another(method):
    for n in (3, 4, 7, 31, 400):
        held = [((7 * i) % 13, i % 5, 13 + (11 * i) % 17, 6 + i % 3) for i in range(n)]
        draw, expected = np.random.default_rng(fixed.SPLIT_SEED), []
        for _ in range(700):
            picked = []
            for start in draw.integers(0, max(1, n - 2), size=int(np.ceil(n / 3))):
                picked.extend(held[int(start) : int(start) + 3])
            expected.append(kernels.estimate(picked[:n], method, W, H))
        assert kernels.bootstrap_boxes(held, 700, method=method) == expected


def test_bootstrap_query_has_every_resample(spark):
    from scopeline import queries

    sf = "/root/testdata/sf0.001"
    bins = {r.recording_id: r["count"] for r in queries._bins(spark, sf).groupBy("recording_id").count().collect()}
    found = {r.recording_id: r["count"] for r in queries.bootstrap_boxes(spark, sf).groupBy("recording_id").count().collect()}
    assert found == {k: 1000 for k, n in bins.items() if n >= 3} and found


def test_split_half_judges_every_bin(spark):
    from scopeline.operators import stability

    # the box moves before the last 60 bins; another stays; a third has too few bins
    rows = [(1, k, A if k < 40 else B) for k in range(100)] + [(2, k, A) for k in range(75)] + [(3, k, A) for k in range(3)]
    out = {r.recording_id: r for r in stability.split_half(spark.createDataFrame(rows, "recording_id long, bin int, box struct<x1:int,y1:int,x2:int,y2:int>")).collect()}
    assert (out[1].n_bins, out[1].stable, out[1].reason, out[1].worst_iou) == (100, False, fixed.UNSTABLE, 0.0)
    assert (out[2].n_bins, out[2].stable, out[2].reason, out[2].n_evaluated, out[2].n_insufficient) == (75, True, fixed.OK, 8, 0)
    assert (out[3].n_bins, out[3].stable, out[3].reason, out[3].worst_iou, out[3].n_insufficient) == (3, False, fixed.INSUFFICIENT_SPLIT, None, 8)
