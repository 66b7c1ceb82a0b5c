import struct
import zlib

import numpy as np
import pytest

from rotorlens.sources import matfile


def _element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _array(kind, shape, name, *parts):
    head = _element(6, struct.pack("<II", kind, 0)) + _element(5, struct.pack(f"<{len(shape)}i", *shape)) + _element(1, name.encode())
    return _element(14, head + b"".join(parts))


def _text(x):
    return _array(4, (1, len(x)), "", _element(17, np.array([ord(c) for c in x], "<u2").tobytes()))


def _struct(shape, name, names, values):
    width = max(map(len, names)) + 1
    fields = b"".join(n.encode().ljust(width, b"\0") for n in names)
    small = struct.pack("<HHI", 5, 4, width)
    return _array(2, shape, name, small, _element(1, fields), *values)


def _file(channels, compressed):
    entries = [part for n, x in channels.items() for part in (_text(n), _array(6, (1, len(x)), "", _element(9, np.asarray(x, "<f8").tobytes())))]
    y = _struct((1, len(channels)), "", ["Name", "Data"], entries)
    body = _struct((1, 1), "N15_M01_F10_K001_1", ["Y"], [y])
    if compressed:
        packed = zlib.compress(body)
        body = struct.pack("<II", 15, len(packed)) + packed
    return b"test".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + body


@pytest.mark.parametrize("compressed", [False, True])
def test_channels_of_a_file(compressed):
    data = {"speed": [1.0, 2.5], "vibration_1": list(np.linspace(-1, 1, 33))}
    got = matfile.channels(_file(data, compressed))
    assert {k: v.tolist() for k, v in got.items()} == data
    assert matfile.variables(_file(data, compressed)).keys() == {"N15_M01_F10_K001_1"}
    with pytest.raises(ValueError):
        matfile.channels(b"no")
    with pytest.raises(ValueError):
        matfile.variables(_file(data, False)[:-40])


def test_recordings_set_failures_apart(spark, tmp_path):
    (tmp_path / "K001").mkdir()
    (tmp_path / "K001" / "good.mat").write_bytes(_file({"a": [1.0], "b": [2.0, 3.0]}, True))
    (tmp_path / "K001" / "bad.mat").write_bytes(b"x" * 200)
    rows = matfile.recordings(spark, f"file://{tmp_path}").collect()
    assert sorted((r["file"], r["channel"], list(r["x"])) for r in rows if r["error"] is None) == [("good.mat", "a", [1.0]), ("good.mat", "b", [2.0, 3.0])]
    assert [r["file"] for r in rows if r["error"]] == ["bad.mat"]
    one = matfile.recordings(spark, f"file://{tmp_path}", ["b", "c"]).where("file = 'good.mat'").first()
    assert one["error"] == "ValueError: no channels ['c']"
