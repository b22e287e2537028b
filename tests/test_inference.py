import numpy as np
import pytest

from scopeline import __main__ as cli
from scopeline.functions import boxes, fixed
from scopeline.sources import inference


def test_resize_keeps_flat_and_linear_pictures():
    assert (inference.resized(np.full((7, 5, 3), 9.0), 20, 30) == 9).all()
    ramp = np.arange(8.0)[None].repeat(4, axis=0)
    assert inference.resized(ramp, 4, 4)[0] == pytest.approx([0.5, 2.5, 4.5, 6.5])


def test_letterbox_centres_and_swaps_channels():
    frame = np.zeros((100, 50, 3), np.uint8)
    frame[..., 0] = 255  # blue
    given, fit = inference.fitted(frame, 512, 384)
    assert given.shape == (3, 384, 512) and (fit.width, fit.height, fit.left, fit.top) == (192, 384, 160, 0)
    assert given[2, :, 160:352].min() == 1.0 and given[:2].max() == 0.0 and given[2, :, :160].max() == 0.0


def test_segment_with_a_network_of_thresholds(spark):
    frame = np.zeros((30, 40, 3), np.uint8)
    frame[:, 20:] = 200
    rows = spark.createDataFrame([(1, 0, 40, 30, bytearray(frame.tobytes()))], "recording_id long, frame_index long, width int, height int, pixels binary")

    def load():
        def network(batch):
            bright = batch.mean(axis=1)
            return np.stack([0.5 - bright, bright - 0.5, bright * 0 - 9, bright * 0 - 9], axis=1) * 20

        return network

    out = inference.segment(rows, load)
    got = np.frombuffer(out.first().labels, np.uint8).reshape(30, 40)
    assert (got[:, :19] == 0).all() and (got[:, 21:] == fixed.TISSUE).all()
    assert [r.reason for r in inference.paired(rows, out).collect()] == ["ok"]
    assert [r.reason for r in inference.paired(rows, out.where("false")).collect()] == ["no_mask"]


def test_command_line(spark, tmp_path, monkeypatch):
    rows = [(1, f"f{i:06d}", 0.2 * i, dict(zip(boxes.SIDES, (100, 100, 300, 250), strict=True))) for i in range(40)]
    spark.createDataFrame(rows, f"recording_id long, frame_id string, t double, box {boxes.BOX}").write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    for action in ("monitor", "geometry", "summary"):
        assert cli.main([action, str(tmp_path / "in"), str(tmp_path / action)]) == 0
    assert spark.read.json(str(tmp_path / "monitor")).where("event = 'lock'").count() == 1
    assert spark.read.json(str(tmp_path / "geometry")).first().box.x1 == 100
    assert spark.read.json(str(tmp_path / "summary")).first().n_locks == 1
    assert cli.main(["summary", str(tmp_path / "in"), str(tmp_path / "off"), "--no-pip"]) == 0
    assert spark.read.json(str(tmp_path / "off")).first().reason == fixed.DISABLED
    with pytest.raises(SystemExit):
        cli.main(["monitor", "a", "b", "--monitor-hz", "0"])
