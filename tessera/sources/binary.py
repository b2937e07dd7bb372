"""Bytes in and out: an endian-aware cursor, a writer, and the codecs of containers."""

from __future__ import annotations

import gzip
import lzma
import struct
from collections.abc import Callable

import pyarrow as pa

LONGEST_NAME = 32_767
#: Widths and struct letters of the scalar readers.
SCALARS = {"i8": "b", "u8": "B", "i16": "h", "u16": "H", "i32": "i", "u32": "I", "i64": "q", "u64": "Q", "f16": "e", "f32": "f", "f64": "d", "bool": "?"}


class Cursor:
    """Reads scalars and strings from bytes at a moving place."""

    def __init__(self, data: bytes, order: str = ">", at: int = 0):
        self.data, self.order, self.at = memoryview(data), order, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"{n} bytes asked for at {self.at} of {len(self.data)}")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def read(self, *kinds: str):
        """One value, or a tuple of several, packed without gaps."""
        form = struct.Struct(self.order + "".join(SCALARS[k] for k in kinds))
        found = form.unpack(self.take(form.size))
        return found[0] if len(kinds) == 1 else found

    def many(self, kind: str, count: int) -> list:
        form = struct.Struct(f"{self.order}{count}{SCALARS[kind]}")
        return list(form.unpack(self.take(form.size)))

    def name(self) -> str:
        """A string that ends in a zero byte."""
        end = bytes(self.data[self.at : self.at + LONGEST_NAME]).find(b"\0")
        if end < 0:
            raise ValueError("a name does not end")
        out = self.take(end).decode("utf-8", "surrogateescape")
        self.at += 1
        return out

    def text(self) -> str:
        """A string with its length before it, padded to four bytes."""
        out = self.take(self.read("i32")).decode("utf-8", "surrogateescape")
        self.align(4)
        return out

    def align(self, to: int = 4) -> None:
        self.at += -self.at % to


class Writer:
    """The reverse of ``Cursor``."""

    def __init__(self, order: str = ">"):
        self.order, self.out = order, bytearray()

    def put(self, kinds: str, *values) -> Writer:
        self.out += struct.pack(self.order + "".join(SCALARS[k] for k in kinds.split()), *values)
        return self

    def raw(self, data: bytes) -> Writer:
        self.out += data
        return self

    def name(self, s: str) -> Writer:
        self.out += s.encode("utf-8", "surrogateescape") + b"\0"
        return self

    def text(self, s: str) -> Writer:
        data = s.encode("utf-8", "surrogateescape")
        return self.put("i32", len(data)).raw(data).align(4)

    def align(self, to: int = 4) -> Writer:
        self.out += bytes(-len(self.out) % to)
        return self


# -- codecs (A27, H18, H19, K01) --------------------------------------------------------------------


def _lzma_filter(properties: bytes) -> list[dict]:
    code, window = struct.unpack("<BI", properties)
    return [{"id": lzma.FILTER_LZMA1, "lc": code % 9, "lp": code // 9 % 5, "pb": code // 45, "dict_size": window}]


def lzma_unpack(data: bytes, size: int) -> bytes:
    stream = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_lzma_filter(data[:5]))
    return stream.decompress(data[5:], size)


def lzma_pack(data: bytes) -> bytes:
    properties = struct.pack("<BI", 3 + 9 * (0 + 5 * 2), 1 << 19)
    return properties + lzma.compress(data, lzma.FORMAT_RAW, filters=_lzma_filter(properties))


def _arrow(codec: str) -> tuple[Callable[[bytes, int], bytes], Callable[[bytes], bytes]]:
    return (
        lambda data, size: pa.Codec(codec).decompress(data, decompressed_size=size, asbytes=True),
        lambda data: pa.Codec(codec).compress(data, asbytes=True),
    )


#: Codec number -> (decompress(data, size), compress(data)); ``with_codec`` adds to it.
CODECS: dict[int, tuple[Callable[[bytes, int], bytes], Callable[[bytes], bytes]]] = {
    0: (lambda data, size: data, lambda data: data),
    1: (lzma_unpack, lzma_pack),
    2: _arrow("lz4_raw"),
    3: _arrow("lz4_raw"),
}
CODEC_NAMES = {0: "none", 1: "lzma", 2: "lz4", 3: "lz4hc", 4: "lzham"}
CODEC_MASK = 0x3F
CHUNK_BYTES = {2: 1 << 17, 3: 1 << 17}


Codecs = dict[int, tuple[Callable[[bytes, int], bytes], Callable[[bytes], bytes]]]


def with_codec(number: int, unpack: Callable[[bytes, int], bytes], pack: Callable[[bytes], bytes], codecs: Codecs | None = None) -> Codecs:
    """The codecs with one more: a value to give to ``assets.files``, which takes it to the tasks."""
    return {**(codecs or CODECS), number: (unpack, pack)}


def unpack(data: bytes, size: int, flags: int, codecs: Codecs | None = None) -> bytes:
    codec, known = flags & CODEC_MASK, codecs or CODECS
    if codec not in known:
        raise ValueError(f"codec {CODEC_NAMES.get(codec, codec)} is not available")
    return known[codec][0](data, size)


def pack_chunks(data: bytes, flags: int, codecs: Codecs | None = None) -> tuple[bytes, list[tuple[int, int, int]]]:
    """Compressed chunks one after another, and (size, compressed size, flags) of each.

    A chunk that compression makes no smaller is stored as it is.
    """
    codec = flags & CODEC_MASK
    most = CHUNK_BYTES.get(codec, (1 << 32) - 1)
    out, table = bytearray(), []
    for at in range(0, len(data), most):
        part = data[at : at + most]
        packed = (codecs or CODECS)[codec][1](part)
        stored = codec and len(packed) >= len(part)
        table.append((len(part), len(part if stored else packed), flags & ~CODEC_MASK if stored else flags))
        out += part if stored else packed
    return bytes(out), table


def gunzip(data: bytes) -> bytes:
    return gzip.decompress(data)


def brotli_unpack(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), "brotli").read()


def brotli_pack(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "brotli") as stream:
        stream.write(data)
    return sink.getvalue().to_pybytes()
