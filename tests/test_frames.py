import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeline.functions import boxes
from scopeline.operators import cadence, kernels, masks
from scopeline.sources import sinks, tables


def ellipse(shape, cy, cx, ry, rx):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return (((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1).astype(np.uint8)


# ellipse (cy, cx, ry, rx) in 240 x 320, and the rectangle of aspect 1.25: fixed values
RECTANGLES = [
    ((90, 202, 70, 113), (133, 35, 271, 145)),
    ((111, 128, 58, 136), (64, 60, 192, 162)),
    ((142, 165, 90, 108), (88, 80, 242, 204)),
    ((156, 158, 97, 132), (69, 86, 247, 228)),
]


@pytest.mark.parametrize("shape,expected", RECTANGLES)
def test_inscribed_rectangle(shape, expected):
    assert kernels.inscribed(ellipse((240, 320), *shape)) == expected


def test_inscribed_rectangle_finds_room_beside_a_hole():
    ring = ellipse((200, 200), 100, 100, 90, 90)
    ring[80:120, 80:120] = 0
    x1, y1, x2, y2 = kernels.inscribed(ring)
    assert ring[y1:y2, x1:x2].all()
    assert kernels.inscribed(np.zeros((20, 20), np.uint8)) is None


def test_components_equal_a_flood_fill():
    draw = np.random.default_rng(1)
    for diagonal in (False, True):
        for _ in range(10):
            on = draw.random((12, 15)) < 0.5
            labels, areas = kernels.components(on, diagonal)
            seen, count = np.zeros(on.shape, int), 0
            for y, x in zip(*np.nonzero(on), strict=True):
                if seen[y, x]:
                    continue
                count += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 12 and 0 <= b < 15 and on[a, b] and not seen[a, b]:
                        seen[a, b] = count
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or i * j == 0]
            assert (labels == seen).all() and len(areas) == count + 1


def test_clean_keeps_the_largest_part_and_fills_small_holes():
    mask = np.zeros((60, 60), np.uint8)
    mask[5:50, 5:50] = 1
    mask[20, 20] = 0
    mask[30:40, 30:40] = 0
    mask[55:58, 55:58] = 1
    out = kernels.clean(mask)
    assert out[20, 20] == 1 and out[35, 35] == 0 and out[56, 56] == 0


def test_popup_repair_fills_a_detached_part():
    frame, mask = np.zeros((300, 400, 3), np.uint8), np.zeros((300, 400), np.uint8)
    frame[:, :200] = 100
    frame[50:150, 250:350] = 100
    mask[50:52, 250:350] = 3
    out, footprint, repairs, main = kernels.popup_repair(frame, mask)
    assert main == 60_000 and len(repairs) == 1 and repairs[0]["bbox"] == [250, 50, 100, 100] and repairs[0]["hull_area"] == 10_000
    assert (out[50:150, 250:350] == 3).all() and kernels.popup_box(footprint, out) == (250, 50, 350, 150)
    none = kernels.popup_repair(frame, np.zeros_like(mask))
    assert none[2] == [] and kernels.popup_box(none[1], none[0]) is None


def test_popup_box_wants_a_solid_component():
    mask = np.zeros((100, 100), np.uint8)
    mask[10:40, 10:40] = 3
    empty = np.zeros(mask.shape, bool)
    assert kernels.popup_box(empty, mask) == (10, 10, 40, 40) and kernels.popup_box(empty, mask, fallback=False) is None
    mask[13:37, 13:37] = 0
    assert kernels.popup_box(empty, mask) is None


def test_frame_features():
    dark = kernels.frame_features(np.zeros((20, 20, 3), np.uint8))
    assert dark == (0.0, 1.0, 0.0, 0.0)
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 20, axis=0).repeat(3, axis=2)
    assert kernels.frame_features(ramp)[3] == pytest.approx(80 * 18 / 20)


@pytest.mark.parametrize("fps,n,due", [(59.0, 59_000, 5000), (29.97, 29_970, 5000), (25.0, 25_000, 5000), (1.0, 1000, 1000), (59.0, 393_297, 33_331)])
def test_cadence_counts(spark, fps, n, due):
    clock = cadence.Cadence(min(5.0, fps))
    assert sum(clock.due(i / fps) for i in range(n)) == due
    recording = spark.createDataFrame([(1, n, fps)], "recording_id long, n_frames long, fps double")
    assert cadence.due_regular(recording).count() == due


def test_cadence_after_a_gap(spark):
    times = [0.0, 0.1, 0.2] + [10.0 + 0.05 * i for i in range(40)]
    clock = cadence.Cadence(5.0)
    due = [clock.due(t) for t in times]
    assert due[:4] == [True, False, True, True] and sum(due[4:]) <= 11
    rows = spark.createDataFrame([(1, f"f{i:04d}", t) for i, t in enumerate(times)], "recording_id long, frame_id string, t double")
    assert [r.due for r in sorted(cadence.due_exact(rows, 5.0).collect(), key=lambda r: r.t)] == due


def test_calibration_sample(spark):
    for n in (56_272, 24, 7, 1):
        recording = spark.createDataFrame([(1, n)], "recording_id long, n_frames long")
        got = sorted(r.frame_index for r in cadence.calibration_sample(recording).collect())
        assert got == cadence.sample_indices(n) and got[0] == 0 and got[-1] == n - 1 and len(got) == min(n, 24)


def test_admission_is_a_share(spark):
    def frames(good):
        rows = [(1, i, 200.0 if i < good else 0.0, 0.0, 0.0, 5.0) for i in range(24)]
        return spark.createDataFrame(rows, "recording_id long, frame_index long, dynamic_range double, crushed double, saturated double, gradient double")

    assert masks.admission(frames(12)).first().admitted
    refused = masks.admission(frames(11)).first()
    assert not refused.admitted and refused.reason == "dynamic range 0.0"


def test_missing_frames_are_found(spark):
    recording = spark.createDataFrame([(1, 300, 30.0)], "recording_id long, n_frames long, fps double")
    due = cadence.due_regular(recording)
    assert due.count() == 50
    present = spark.range(90).selectExpr("1L as recording_id", "id as frame_index")
    assert cadence.missing_frames(due, present).agg(F.min("frame_index")).first()[0] == 90


def test_run_votes_equal_pixel_votes(spark):
    draw = np.random.default_rng(2)
    pixel, run = [], []
    for f in range(7):
        grid = draw.integers(0, 4, (6, 20)).repeat(3, axis=1)
        for y in range(6):
            edge = [0, *(np.flatnonzero(np.diff(grid[y])) + 1).tolist(), 60]
            run += [(1, f, y, a, b, int(grid[y, a])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            pixel += [(1, f, y, x, int(grid[y, x])) for x in range(60)]
    pixels = spark.createDataFrame(pixel, "recording_id long, frame_index long, y int, x int, cls int")
    runs = spark.createDataFrame(run, "recording_id long, frame_index long, y int, x_start int, x_end int, cls int")
    stable = masks.run_agreement(runs, pixels.select("recording_id", "frame_index").distinct(), (1, 2))
    got = {(r.y, x) for r in stable.collect() for x in range(r.x_start, r.x_end)}
    assert got == {(r.y, r.x) for r in masks.agreement(pixels).where("view").collect()}


def test_box_expressions_equal_the_kernels(spark):
    draw = np.random.default_rng(3)
    held = [tuple(int(v) for v in draw.integers(0, 50, 4)) for _ in range(200)]
    pairs = [(i, *a, *b) for i, (a, b) in enumerate(zip(held[::2], held[1::2], strict=True)) if a[0] < a[2] and a[1] < a[3] and b[0] < b[2] and b[1] < b[3]]
    df = spark.createDataFrame(pairs, "i int, " + ", ".join(f"{s}{k} int" for k in "ab" for s in boxes.SIDES))
    a, b = (boxes.box(*(F.col(s + k) for s in boxes.SIDES)) for k in "ab")
    for r in df.select(a.alias("a"), b.alias("b")).select("a", "b", boxes.iou(F.col("a"), F.col("b")).alias("iou"), boxes.area_ratio(F.col("a"), F.col("b")).alias("ratio")).collect():
        assert r.iou == pytest.approx(kernels.iou(tuple(r.a), tuple(r.b))) and r.ratio == pytest.approx(kernels.area_ratio(tuple(r.a), tuple(r.b)))


def test_null_boxes_stay_null(spark):
    df = spark.createDataFrame([(None,)], f"box {boxes.BOX}")
    row = df.select(boxes.clamped(F.col("box"), F.lit(10), F.lit(10)).alias("c"), boxes.iou(F.col("box"), F.col("box")).alias("i"), boxes.drifted(F.col("box"), F.col("box")).alias("d")).first()
    assert row.c is None and row.i is None and row.d is False


def test_model_file_gate(spark, tmp_path):
    import hashlib

    (tmp_path / "m.bin").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest()
    assert tables.checked_model(spark, str(tmp_path / "m.bin"), digest) == b"weights"
    with pytest.raises(tables.ModelFileError):
        tables.checked_model(spark, str(tmp_path / "m.bin"), "0" * 64)


def test_mask_provider_and_sinks(spark, tmp_path):
    frames = spark.createDataFrame([(1, 0, 2, 2)], "recording_id long, frame_index long, width int, height int")

    def provider(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b"\x01" * 4] * batch.num_rows)], ["recording_id", "frame_index", "labels"])

    found = tables.with_masks(frames, provider, "recording_id long, frame_index long, labels binary")
    assert bytes(found.first().labels) == b"\x01" * 4
    sinks.write_masks(found, str(tmp_path / "masks"))
    assert spark.read.parquet(str(tmp_path / "masks")).count() == 1
    records = spark.createDataFrame([(1, None)], f"recording_id long, box {boxes.BOX}")
    sinks.write_jsonl(records, str(tmp_path / "records"))
    assert spark.read.text(str(tmp_path / "records")).first().value == '{"recording_id":1,"box":null}'
