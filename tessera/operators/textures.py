"""Pixels of decoded textures: raw formats, block-compressed DXT, block-linear layouts, PNG, and sprites cut from them.

An image is one row and is decoded by numpy in its task; formats that need an outside library are rows with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raw formats by number: numpy type of a component, components as stored, where r, g, b, a come from (-1: full, -2: none).
RAW: dict[int, tuple[str, int, tuple[int, int, int, int]]] = {
    1: ("u1", 1, (-1, -1, -1, 0)),
    3: ("u1", 3, (0, 1, 2, -1)),
    4: ("u1", 4, (0, 1, 2, 3)),
    5: ("u1", 4, (1, 2, 3, 0)),
    8: ("u1", 3, (2, 1, 0, -1)),
    9: ("u2", 1, (0, -2, -2, -1)),
    14: ("u1", 4, (2, 1, 0, 3)),
    15: ("f2", 1, (0, -2, -2, -1)),
    16: ("f2", 2, (0, 1, -2, -1)),
    17: ("f2", 4, (0, 1, 2, 3)),
    18: ("f4", 1, (0, -2, -2, -1)),
    19: ("f4", 2, (0, 1, -2, -1)),
    20: ("f4", 4, (0, 1, 2, 3)),
    62: ("u1", 2, (0, 1, -2, -1)),
    63: ("u1", 1, (0, -2, -2, -1)),
    72: ("u2", 2, (0, 1, -2, -1)),
    73: ("u2", 3, (0, 1, 2, -1)),
    74: ("u2", 4, (0, 1, 2, 3)),
}
# Formats of 16 bits a pixel: (lowest bit, bits) of r, g, b, a; no bits: full.
PACKED16 = {2: ((8, 4), (4, 4), (0, 4), (12, 4)), 7: ((11, 5), (5, 6), (0, 5), (0, 0)), 13: ((12, 4), (8, 4), (4, 4), (0, 4))}
DXT1, DXT3, DXT5 = 10, 11, 12
TEXELS = 4


def _raw(data: bytes, width: int, height: int, form: int) -> np.ndarray:
    kind, parts, source = RAW[form]
    stored = np.frombuffer(data, np.dtype(kind).newbyteorder("<"), width * height * parts).reshape(height, width, parts)
    if kind[0] == "f":
        stored = (np.clip(np.nan_to_num(stored.astype(np.float32)), 0, 1) * 255).astype(np.uint8)
    elif kind == "u2":
        stored = (stored >> 8).astype(np.uint8)
    out = np.zeros((height, width, 4), np.uint8)
    for k, part in enumerate(source):
        out[..., k] = 255 if part == -1 else 0 if part == -2 else stored[..., part]
    return out


def _packed16(data: bytes, width: int, height: int, form: int) -> np.ndarray:
    stored = np.frombuffer(data, "<u2", width * height).reshape(height, width).astype(np.uint32)
    channels = [(stored >> low & (1 << bits) - 1) * 255 // ((1 << bits) - 1) if bits else np.full_like(stored, 255) for low, bits in PACKED16[form]]
    return np.stack(channels, axis=-1).astype(np.uint8)


def _rgb565(c: np.ndarray) -> np.ndarray:
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1).astype(np.int32)


def _dxt(data: bytes, width: int, height: int, form: int) -> np.ndarray:
    across, down = -(-width // TEXELS), -(-height // TEXELS)
    size = 8 if form == DXT1 else 16
    blocks = np.frombuffer(data, np.uint8, across * down * size).reshape(-1, size)
    ends = blocks[:, -8:-4].copy().view("<u2").astype(np.int32)
    colours = _rgb565(ends)
    first, second = colours[:, 0], colours[:, 1]
    three = (ends[:, 0] <= ends[:, 1])[:, None] & (form == DXT1)  # three colours and a clear one
    mixed = np.where(three, (first + second) // 2, (2 * first + second) // 3), np.where(three, 0, (first + 2 * second) // 3)
    table = np.stack([first, second, *mixed], axis=1)
    places = (blocks[:, -4:].copy().view("<u4") >> np.arange(0, 32, 2, dtype=np.uint32) & 3).astype(np.int64)
    pixels = np.full((len(blocks), 16, 4), 255, np.uint8)
    pixels[..., :3] = np.take_along_axis(table, places[..., None], axis=1)
    if form == DXT1:
        pixels[..., 3] = np.where(three & (places == 3), 0, 255)
    elif form == DXT3:
        pixels[..., 3] = (blocks[:, :8, None] >> np.array([0, 4], np.uint8) & 15).reshape(-1, 16) * 17
    else:
        a, b = blocks[:, 0].astype(np.int32), blocks[:, 1].astype(np.int32)
        step = np.arange(1, 7)
        six = (a[:, None] * (7 - step) + b[:, None] * step) // 7
        four = np.concatenate([(a[:, None] * (5 - step[:4]) + b[:, None] * step[:4]) // 5, np.tile([0, 255], (len(a), 1))], axis=1)
        alphas = np.concatenate([a[:, None], b[:, None], np.where((a > b)[:, None], six, four)], axis=1)
        bits = np.zeros((len(a), 8), np.uint8)
        bits[:, :6] = blocks[:, 2:8]
        which = (bits.view("<u8") >> np.arange(0, 48, 3, dtype=np.uint64) & 7).astype(np.int64)
        pixels[..., 3] = np.take_along_axis(alphas, which, axis=1)
    whole = pixels.reshape(down, across, TEXELS, TEXELS, 4).transpose(0, 2, 1, 3, 4).reshape(down * TEXELS, across * TEXELS, 4)
    return whole[:height, :width]


def pixels_of(data: bytes, width: int, height: int, form: int) -> np.ndarray:
    """``height x width x 4`` bytes, the top row first: stored images begin at the bottom."""
    if width * height == 0:
        return np.zeros((height, width, 4), np.uint8)
    decode = _raw if form in RAW else _packed16 if form in PACKED16 else _dxt if form in (DXT1, DXT3, DXT5) else None
    if decode is None:
        raise ValueError(f"texture format {form} needs a library that isn't here")
    return decode(data, width, height, form)[::-1]


def swap_pairs(data: bytes) -> bytes:
    """Every two bytes the other way round."""
    return np.frombuffer(data, np.uint16, len(data) // 2).byteswap().tobytes() + data[len(data) // 2 * 2 :]


def block_linear(across: int, down: int, block_height: int) -> np.ndarray:
    """Place of each 16-byte texel, row by row, of a grid of whole blocks.

    A group (GOB) is 4 texels wide and 8 high, with the bits y0, y1, x0, y2, x1 from the lowest; ``block_height`` groups stand on each other.
    """
    x, y = np.arange(across)[None, :], np.arange(down)[:, None]
    inner = (y & 1) + ((y >> 1 & 1) << 1) + ((x & 1) << 2) + ((y >> 2 & 1) << 3) + ((x >> 1 & 1) << 4)
    group_y = y // 8
    block = group_y // block_height * (across // 4) + x // 4
    return (block * block_height + group_y % block_height) * 32 + inner


def unswizzled(data: bytes, across: int, down: int, block_height: int) -> bytes:
    """The texels row by row; ``swizzled`` is the inverse."""
    return np.frombuffer(data, "V16", across * down)[block_linear(across, down, block_height).ravel()].tobytes()


def swizzled(data: bytes, across: int, down: int, block_height: int) -> bytes:
    out = np.zeros(across * down, "V16")
    out[block_linear(across, down, block_height).ravel()] = np.frombuffer(data, "V16", across * down)
    return out.tobytes()


def png(rgba: np.ndarray) -> bytes:
    """An image file of ``height x width x 4`` bytes."""
    height, width, _ = rgba.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rgba).reshape(height, width * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


# -- as DataFrames --------------------------------------------------------------------------------------


def pixels(textures: DataFrame) -> DataFrame:
    """``textures`` (``width, height, format, data`` among its columns) with ``rgba`` (the top row first) and ``pixel_error``.

    Data that is too short, a format that isn't known or a null is a row with an error; an empty image has no bytes.
    """
    place = [textures.columns.index(c) for c in ("data", "width", "height", "format")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rgba = wrong = None
                try:
                    rgba = pixels_of(*[batch.column(k)[row].as_py() for k in place]).tobytes()
                except Exception as error:  # noqa: BLE001  the row says what is wrong
                    wrong = f"{type(error).__name__}: {error}"
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([rgba], pa.binary()), pa.array([wrong], pa.string())], [*batch.schema.names, "rgba", "pixel_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in textures.schema)
    return textures.mapInArrow(run, schema + ", rgba binary, pixel_error string")


# How a packed sprite lies in its texture.
UPRIGHT, FLIP_X, FLIP_Y, TURN_180, TURN_90 = range(5)


def sprites(parts: DataFrame, decoded: DataFrame, texture: str) -> DataFrame:
    """``parts`` with ``image``, a PNG of each sprite's rectangle of its texture (I16); each texture is decoded once, whatever cuts from it.

    ``parts`` has the column ``texture`` names, which joins with that of ``decoded`` (``pixels``), and ``x, y, w, h`` (from the bottom
    left) and ``rotation``. A rectangle that leaves the texture is cut at its edge; a texture that isn't there gives null.
    """
    held = decoded.select(F.col(texture).alias("__t"), F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("rgba").alias("__rgba"))
    joined = parts.join(held, F.col(texture) == F.col("__t"), "left").drop("__t")
    place = [joined.columns.index(c) for c in ("__rgba", "__w", "__h", "x", "y", "w", "h", "rotation")]
    kept = [k for k, c in enumerate(joined.columns) if not c.startswith("__")]

    def cut(raw: bytes, width: int, height: int, x: int, y: int, w: int, h: int, rotation: int) -> bytes:
        whole = np.frombuffer(raw, np.uint8).reshape(height, width, 4)
        own = whole[max(0, height - y - h) : max(0, height - y), max(0, x) : max(0, x + w)]
        turned = {FLIP_X: own[:, ::-1], FLIP_Y: own[::-1], TURN_180: own[::-1, ::-1], TURN_90: np.rot90(own, -1)}
        return png(turned.get(rotation, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = [batch.column(k)[row].as_py() for k in place]
                image = None if None in asked else cut(*asked)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(row, 1) for k in kept], pa.array([image], pa.binary())], [*[batch.schema.names[k] for k in kept], "image"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k, f in enumerate(joined.schema) if k in kept)
    return joined.mapInArrow(run, schema + ", image binary")
