import collections
import hashlib
import io
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from scopeline import __main__ as cli
from scopeline.functions import fixed
from scopeline.operators import masks
from scopeline.sources import network, tables

SIZE = {"input_width": 32, "input_height": 16}


def state_of(classes, base, levels=4, seed=0):
    draw = np.random.default_rng(seed)
    out = {}
    for name, shape in network.shapes(classes, base, levels).items():
        if name.endswith("tracked"):
            out[name] = np.array(3, np.int64)
        else:
            low = 0.5 if name.endswith("running_var") else -0.5
            out[name] = draw.uniform(low, 1.0, shape).astype(np.float32)
    return out


def model_file(content, monkeypatch, extra=None):
    """``content`` as the archive of a network library: arrays become tensors, each with a storage of its own."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    kinds = {"<f4": "FloatStorage", "<i8": "LongStorage"}
    for name in kinds.values():
        setattr(torch, name, type(name, (), {"__module__": "torch", "__qualname__": name}))

    def _rebuild_tensor_v2(*_):
        raise AssertionError("only named")

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    storages = []

    class Storage:
        def __init__(self, array):
            self.array = array

    class Writer(pickle.Pickler):
        def persistent_id(self, obj):
            if isinstance(obj, Storage):
                storages.append(obj.array)
                return ("storage", getattr(torch, kinds[obj.array.dtype.str]), str(len(storages) - 1), "cpu", obj.array.size)
            return None

        def reducer_override(self, obj):
            if isinstance(obj, np.ndarray):
                stride = tuple(s // obj.itemsize for s in obj.strides)
                return _rebuild_tensor_v2, (Storage(obj), 0, obj.shape, stride, False, collections.OrderedDict())
            return NotImplemented

    raw = io.BytesIO()
    Writer(raw, 2).dump(content)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("m/data.pkl", raw.getvalue())
        for i, a in enumerate(storages):
            archive.writestr(f"m/data/{i}", a.tobytes())
        for name, value in (extra or {}).items():
            archive.writestr(name, value)
    return out.getvalue()


def whole(state, classes=4, base=8):
    return {"model_state": collections.OrderedDict(state), "config": {"model": {"num_classes": classes, "base_channels": base, **SIZE}}}


def naive(state, x, levels):
    """The same network by loops over pixels, batch norms apart, in double precision."""

    def conv(x, name):
        w, b = state[f"{name}.weight"], state[f"{name}.bias"]
        side = w.shape[2] // 2
        out = np.zeros((len(b), *x.shape[1:]))
        for o in range(len(b)):
            for y in range(x.shape[1]):
                for z in range(x.shape[2]):
                    total = float(b[o])
                    for i in range(x.shape[0]):
                        for dy in range(-side, side + 1):
                            for dx in range(-side, side + 1):
                                if 0 <= y + dy < x.shape[1] and 0 <= z + dx < x.shape[2]:
                                    total += float(w[o, i, dy + side, dx + side]) * x[i, y + dy, z + dx]
                    out[o, y, z] = total
        return out

    def norm(x, name):
        mean, var, g, b = (state[f"{name}.{k}"].astype(float)[:, None, None] for k in ("running_mean", "running_var", "weight", "bias"))
        return (x - mean) / np.sqrt(var + 1e-5) * g + b

    def pair(x, name):
        for at in (0, 3):
            x = np.maximum(norm(conv(x, f"{name}.block.{at}"), f"{name}.block.{at + 1}"), 0)
        return x

    def grown(x, name):
        w, b = state[f"{name}.weight"], state[f"{name}.bias"]
        out = np.zeros((w.shape[1], 2 * x.shape[1], 2 * x.shape[2])) + b[:, None, None]
        for i, y, z in np.ndindex(x.shape):
            out[:, 2 * y : 2 * y + 2, 2 * z : 2 * z + 2] += x[i, y, z] * w[i]
        return out

    def pooled(x):
        return np.array([[[c[y : y + 2, z : z + 2].max() for z in range(0, c.shape[1], 2)] for y in range(0, c.shape[0], 2)] for c in x])

    beside = []
    for k in range(1, levels + 1):
        x = pair(x, f"enc{k}")
        beside.append(x)
        x = pooled(x)
    x = pair(x, "bottleneck")
    for k in range(levels, 0, -1):
        x = pair(np.concatenate([grown(x, f"up{k}"), beside[k - 1]]), f"dec{k}")
    return conv(x, "classifier")


def test_network_equals_loops_over_pixels():
    state = state_of(3, 2, levels=2)
    draw = np.random.default_rng(1)
    batch = draw.random((2, 3, 8, 12)).astype(np.float32)
    got = network.UNet.of(state, levels=2)(batch)
    assert got.shape == (2, 3, 8, 12)
    for one, x in zip(got, batch, strict=True):
        assert one == pytest.approx(naive(state, x.astype(float), 2), rel=1e-3, abs=1e-3)
    with pytest.raises(ValueError):
        network.UNet.of(state, levels=2)(batch[:, :, :6])


def test_the_networks_tensors_are_as_many_as_the_file_has():
    assert len(network.shapes(4, 8)) == 136


def test_model_files_are_read_and_gated(monkeypatch):
    state = state_of(4, 8)
    content = model_file(whole(state), monkeypatch)
    found = network.read(content)
    assert all((found["model_state"][k] == v).all() and found["model_state"][k].dtype == v.dtype for k, v in state.items())
    model, settings = network.load(content)
    assert settings["input_width"] == 32 and model(np.zeros((1, 3, 16, 32), np.float32)).shape == (1, 4, 16, 32)
    first = next(iter(state))
    bad = [
        whole({k: v for k, v in state.items() if k != first}),
        whole({("other" if k == first else k): v for k, v in state.items()}),
        whole(state | {first: np.zeros((8, 3, 3, 4), np.float32)}),
        whole(state | {first: "no tensor"}),
        whole(state, classes=3),
        {"config": {}},
        [1, 2],
    ]
    files = [model_file(b, monkeypatch) for b in bad]
    files += [b"", b"no archive", content[:-200], model_file(whole(state), monkeypatch, {"m/byteorder": "big"})]
    for f in files:
        with pytest.raises(tables.ModelFileError):
            network.load(f)


def test_a_model_file_runs_no_code():
    class Call:
        def __reduce__(self):
            return (print, ("called",))

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("m/data.pkl", pickle.dumps({"model_state": Call()}, 2))
    with pytest.raises(tables.ModelFileError, match="asks for"):
        network.read(out.getvalue())


def test_a_tensor_stays_inside_its_storage():
    storage = np.arange(6, dtype=np.float32)
    assert network._tensor(storage, 1, (2, 2), (1, 2)).tolist() == [[1, 3], [2, 4]]
    assert network._tensor(storage, 6, (0, 3), (3, 1)).shape == (0, 3) and network._tensor(storage, 5, (), ()) == 5
    for offset, size, stride in ((0, (7,), (1,)), (3, (2, 2), (2, 1)), (6, (), ()), (-1, (1,), (1,)), (0, (2,), (-1,))):
        with pytest.raises(tables.ModelFileError):
            network._tensor(storage, offset, size, stride)


def picture(path, w, h, seed):
    """A binary 24-bit bitmap, which the JVM reads as any other picture; returns its B, G, R bytes, top row first."""
    colour = np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)
    pad = -3 * w % 4
    body = b"".join(row.tobytes() + b"\0" * pad for row in colour[::-1])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
    path.write_bytes(head + info + body)
    return colour


def test_pictures_are_read_and_unreadable_files_say_so(spark, tmp_path):
    wanted = {"a.bmp": picture(tmp_path / "a.bmp", 7, 5, 1), "b.bmp": picture(tmp_path / "b.bmp", 4, 6, 2)}
    (tmp_path / "c.bmp").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r for r in tables.images(spark, str(tmp_path)).collect()}
    assert got["c.bmp"].reason == "unreadable" and got["c.bmp"].pixels is None
    for name, colour in wanted.items():
        r = got[name]
        assert (r.reason, r.height, r.width) == ("ok", *colour.shape[:2]) and bytes(r.pixels) == colour.tobytes()


def test_unpacked_is_the_inverse_of_packed(spark):
    colour, label = bytes(range(36)), bytes([0, 1, 2, 3] * 3)
    frames = spark.createDataFrame([(1, 0, 4, 3, bytearray(colour), bytearray(label))], "recording_id long, frame_index long, width int, height int, pixels binary, labels binary")
    rows = masks.unpacked(frames)
    back = masks.packed(rows, 4, 3).first()
    assert (bytes(back.pixels), bytes(back.labels)) == (colour, label)
    assert rows.where("y = 1 and x = 2").first().gray == round(0.114 * 18 + 0.587 * 19 + 0.299 * 20)


def test_pictures_on_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    colours = {"a.bmp": picture(tmp_path / "in" / "a.bmp", 40, 30, 3), "b.bmp": picture(tmp_path / "in" / "b.bmp", 24, 24, 4)}
    (tmp_path / "in" / "c.bmp").write_bytes(b"no picture")
    content = model_file(whole(state_of(4, 8)), monkeypatch)
    monkeypatch.undo()
    (tmp_path / "model").write_bytes(content)
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    given = ["images", str(tmp_path / "in"), str(tmp_path / "out"), "--weights", str(tmp_path / "model")]
    with pytest.raises(tables.ModelFileError):
        cli.main(given)
    assert cli.main([*given, "--sha256", hashlib.sha256(content).hexdigest()]) == 0
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out" / "frames")).collect()}
    found = {r.recording_id: r for r in spark.read.parquet(str(tmp_path / "out" / "masks")).collect()}
    laid = {r.recording_id: r for r in spark.read.parquet(str(tmp_path / "out" / "overlays")).collect()}
    assert rows["c.bmp"].status == "unreadable" and rows["c.bmp"].n_0 is None and len(found) == len(laid) == 2
    model, _ = network.load(content)
    for name, colour in colours.items():
        from scopeline.sources import inference

        batch, fit = inference.fitted(colour, 32, 16)
        expected = inference.labels(model(batch[None])[0], fit)
        r = rows[name]
        assert bytes(found[r.recording_id].labels) == expected.tobytes()
        assert [r[f"n_{k}"] for k in range(4)] == np.bincount(expected.ravel(), minlength=4).tolist()
        assert r.status == "ok" and r.routing_reason == fixed.NO_FOOTPRINT and len(laid[r.recording_id].overlay) == colour.size
    with pytest.raises(SystemExit):
        cli.main(["images", "a", "b"])
