"""Pixels of made-up textures against values worked out by hand."""

import struct
import zlib

import numpy as np
import pytest

from tessera.operators import textures as T


@pytest.mark.parametrize(
    ("form", "data", "want"),
    [
        (1, b"\x40", (255, 255, 255, 64)),
        (2, struct.pack("<H", 0x8F04), (255, 0, 68, 136)),
        (3, b"\x01\x02\x03", (1, 2, 3, 255)),
        (4, b"\x01\x02\x03\x04", (1, 2, 3, 4)),
        (5, b"\x04\x01\x02\x03", (1, 2, 3, 4)),
        (7, struct.pack("<H", 0xF800 | 63 << 5), (255, 255, 0, 255)),
        (13, struct.pack("<H", 0xF048), (255, 0, 68, 136)),
        (14, b"\x03\x02\x01\x04", (1, 2, 3, 4)),
        (16, struct.pack("<2e", 1.0, 0.5), (255, 127, 0, 255)),
        (20, struct.pack("<4f", 2.0, -1.0, 0.25, float("nan")), (255, 0, 63, 0)),
        (62, b"\x09\x08", (9, 8, 0, 255)),
        (74, struct.pack("<4H", 0xFF00, 0x8000, 1, 0x1234), (255, 128, 0, 0x12)),
    ],
)
def test_raw_formats(form, data, want):
    assert tuple(T.pixels_of(data, 1, 1, form)[0, 0].tolist()) == want


def block(first, second, places):
    return struct.pack("<HHI", first, second, sum(p << 2 * k for k, p in enumerate(places)))


def test_dxt():
    red, blue = 0xF800, 0x001F
    places = [0, 1, 2, 3] * 4
    got = T.pixels_of(block(red, blue, places), 4, 4, T.DXT1)
    assert got[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    assert T.pixels_of(block(blue, red, places), 4, 4, T.DXT1)[0].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255], [127, 0, 127, 255], [0, 0, 0, 0]]
    alpha = bytes(k | k << 4 for k in range(8))
    assert T.pixels_of(alpha + block(red, blue, places), 4, 4, T.DXT3)[::-1, :, 3].ravel().tolist() == [17 * (k // 2) for k in range(16)]
    which = sum((k % 8) << 3 * k for k in range(16))
    one = T.pixels_of(bytes([210, 0]) + which.to_bytes(6, "little") + block(red, blue, places), 4, 4, T.DXT5)[::-1, :, 3].ravel().tolist()
    assert one == [210, 0, 180, 150, 120, 90, 60, 30] * 2
    two = T.pixels_of(bytes([0, 250]) + which.to_bytes(6, "little") + block(red, blue, places), 4, 4, T.DXT5)[::-1, :, 3].ravel().tolist()
    assert two == [0, 250, 50, 100, 150, 200, 0, 255] * 2
    wide = T.pixels_of(block(red, red, [0] * 16) + block(blue, blue, [0] * 16), 6, 3, T.DXT1)
    assert wide.shape == (3, 6, 4) and wide[2].tolist() == [[255, 0, 0, 255]] * 4 + [[0, 0, 255, 255]] * 2


@pytest.mark.parametrize(("across", "down", "height"), [(4, 8, 1), (8, 32, 2), (16, 64, 8)])
def test_block_linear_is_a_permutation(across, down, height):
    assert sorted(T.block_linear(across, down, height).ravel().tolist()) == list(range(across * down))
    data = np.random.default_rng(1).bytes(across * down * 16)
    assert T.unswizzled(T.swizzled(data, across, down, height), across, down, height) == data != T.swizzled(data, across, down, height)


def read_png(data):
    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 4 * width)[:, 1:].reshape(height, width, 4)


def test_frames(spark):
    image = np.arange(4 * 3 * 4, dtype=np.uint8).reshape(3, 4, 4)  # as stored: the bottom row first
    rows = [("a", 4, 3, 4, bytearray(image.tobytes())), ("b", 0, 0, 4, bytearray()), ("c", 4, 4, 48, bytearray(16)), ("d", 9, 9, 4, bytearray(3)), ("e", 1, 1, 4, None)]
    found = T.pixels(spark.createDataFrame(rows, "name string, width int, height int, format int, data binary")).persist()
    got = {r["name"]: r for r in found.collect()}
    assert bytes(got["a"]["rgba"]) == image[::-1].tobytes() and bytes(got["b"]["rgba"]) == b""
    assert all(got[k]["rgba"] is None and got[k]["pixel_error"] for k in "cde") and "library" in got["c"]["pixel_error"]
    parts = [("s", "a", 1, 0, 2, 1, 0), ("x", "a", 1, 0, 2, 1, 1), ("y", "a", 0, 0, 1, 3, 2), ("half", "a", 1, 0, 2, 1, 3), ("turn", "a", 0, 0, 2, 1, 4), ("edge", "a", 3, 2, 9, 9, 0), ("none", "zz", 0, 0, 1, 1, 0)]
    cut = T.sprites(spark.createDataFrame(parts, "sprite string, name string, x int, y int, w int, h int, rotation int"), found, "name")
    out = {r["sprite"]: r["image"] and read_png(bytes(r["image"])) for r in cut.collect()}
    assert out["s"].tolist() == [image[0, 1:3].tolist()] and out["x"].tolist() == [image[0, 1:3][::-1].tolist()]
    assert out["y"][:, 0].tolist() == image[:, 0].tolist() and out["half"].tolist() == out["x"].tolist()
    assert out["turn"].shape == (2, 1, 4) and out["turn"][:, 0].tolist() == image[0, :2].tolist()
    assert out["edge"].tolist() == [[image[2, 3].tolist()]] and out["none"] is None
    assert T.swap_pairs(b"abcde") == b"badce"
