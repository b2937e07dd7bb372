"""Layouts of asset containers: bundles, web files and serialized files, read and written."""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass, field

from tessera.sources import typetree as tt
from tessera.sources.binary import CODEC_MASK, CODECS, Codecs, Cursor, Writer, brotli_pack, brotli_unpack, gunzip, pack_chunks, unpack

# Signatures at the head of files, and names that never hold serialized data.
BUNDLE_SIGNATURES = (b"UnityFS\0", b"UnityWeb\0", b"UnityRaw\0", b"UnityArchive\0")
WEB_SIGNATURES = (b"UnityWebData", b"TuanjieWebData")
RESOURCE_ENDINGS = (".resS", ".resource", ".config", ".xml", ".dat")
BROTLI_MARK = b"brotli"
BLOCKS_AT_END, PAD_BLOCKS, COMBINED = 0x80, 0x200, 0x40
SCRIPT_CLASS = 114
BUNDLE_CLASS = 142


def version_tuple(text: str) -> tuple[int, ...]:
    return tuple(map(int, re.findall(r"\d+", text)[:3]))


# -- sniffing (A08, A09) ----------------------------------------------------------------------------


def plausible_header(data: bytes) -> bool:
    c = Cursor(data)
    metadata, size, version, offset = c.read("u32", "u32", "u32", "u32")
    if version >= 22:
        c.at = 20
        metadata, size, offset = c.read("u32", "i64", "i64")
    return version <= 100 and 0 <= offset <= len(data) and metadata <= size <= len(data) and size >= offset


def sniff(data: bytes, name: str = "") -> str:
    """bundle, web, zip, serialized or resource, by tests in this order."""
    if len(data) < 20:
        return "resource"
    if data.startswith(BUNDLE_SIGNATURES):
        return "bundle"
    if data.startswith(WEB_SIGNATURES):
        return "web"
    if data.startswith(b"PK\x03\x04"):
        return "zip"
    if len(data) < 128:
        return "resource"
    if data[:2] == b"\x1f\x8b":
        return "web" if gunzip(data).startswith(WEB_SIGNATURES) else "resource"
    if data[0x20 : 0x20 + len(BROTLI_MARK)] == BROTLI_MARK:
        return "web"
    if name.endswith(RESOURCE_ENDINGS):
        return "resource"
    return "serialized" if plausible_header(data) else "resource"


# -- bundles (A10-A13, J07) ---------------------------------------------------------------------------


@dataclass
class Bundle:
    signature: str
    version: int
    player: str
    engine: str
    flags: int
    blocks: list[tuple[int, int, int]] = field(default_factory=list)
    entries: list[tuple[str, bytes, int]] = field(default_factory=list)  # path, content, flags


def pads_blocks(engine: str) -> bool:
    """Whether flag 0x200 means padding: it had another use in older engines."""
    v = version_tuple(engine)
    first = {2020: (2020, 3, 34), 2021: (2021, 3, 2), 2022: (2022, 1, 1)}
    return v >= (2020,) and v >= first.get(v[0], v)


def read_bundle(data: bytes, fallback: str | None = None, codecs: Codecs | None = None) -> Bundle:
    c = Cursor(data)
    signature, version, player, engine = c.name(), c.read("u32"), c.name(), c.name()
    if not engine or version_tuple(engine)[:1] in ((), (0,)):
        if fallback is None:
            raise ValueError("the engine's version is unknown and no fallback is set")
        engine = fallback
    if signature in ("UnityWeb", "UnityRaw") and version < 6:
        return _read_stream(c, Bundle(signature, version, player, engine, 0))
    c.read("i64")
    packed, size, flags = c.read("u32", "u32", "u32")
    if signature != "UnityFS":
        c.read("u8")
    if version >= 7:
        c.align(16)
    start = c.at
    if flags & BLOCKS_AT_END:
        c.at = len(data) - packed
    info = Cursor(unpack(c.take(packed), size, flags, codecs))
    if flags & BLOCKS_AT_END:
        c.at = start
    info.take(16)
    out = Bundle(signature, version, player, engine, flags)
    out.blocks = [info.read("u32", "u32", "u16") for _ in range(info.read("i32"))]
    listing = [(*info.read("i64", "i64", "u32"), info.name()) for _ in range(info.read("i32"))]
    if flags & PAD_BLOCKS and pads_blocks(engine):
        c.align(16)
    whole = b"".join([unpack(c.take(n), raw, f, codecs) for raw, n, f in out.blocks])
    out.entries = [(path, whole[at : at + n], f) for at, n, f, path in listing]
    return out


def _read_stream(c: Cursor, out: Bundle) -> Bundle:
    """The oldest layout: one stream of all entries."""
    if out.version >= 4:
        c.take(16)
        c.read("u32")
    c.read("u32")
    header, _, levels = c.read("u32", "u32", "i32")
    sizes = [c.read("u32", "u32") for _ in range(levels)]
    packed, raw = sizes[-1]
    c.at = header
    body = c.take(packed)
    if out.signature == "UnityWeb":
        # properties, then eight bytes of size, then the stream
        body = CODECS[1][0](body[:5] + body[13:], raw)
    info = Cursor(body)
    listing = [(info.name(), *info.read("u32", "u32")) for _ in range(info.read("i32"))]
    out.blocks = [(raw, packed, 1 if out.signature == "UnityWeb" else 0)]
    out.entries = [(path, body[at : at + n], 0) for path, at, n in listing]
    return out


# Fixed values: (flags of the file, flags of its blocks) for each packer.
PACKERS = {"none": (64, 64), "lz4": (194, 2), "lzma": (65, 1)}


def write_bundle(b: Bundle, packer: str | tuple[int, int] | int = "original", codecs: Codecs | None = None) -> bytes:
    """The bundle's bytes (J07): by a packer's name, by flags of the file and of its blocks, by a codec's number, or as it was.

    The listing stands before the blocks, or after them where flag 0x80 says so. Blocks aren't padded.
    """
    if packer == "original":
        packer = (b.flags & ~PAD_BLOCKS | COMBINED, b.flags & CODEC_MASK)
    elif isinstance(packer, str):
        packer = PACKERS[packer]
    flags, block_flags = packer if isinstance(packer, tuple) else (COMBINED | packer, packer)
    whole = b"".join(content for _, content, _ in b.entries)
    body, blocks = pack_chunks(whole, block_flags, codecs)
    info = Writer().raw(bytes(16)).put("i32", len(blocks))
    for block in blocks:
        info.put("u32 u32 u16", *block)
    info.put("i32", len(b.entries))
    at = 0
    for path, content, entry_flags in b.entries:
        info.put("i64 i64 u32", at, len(content), entry_flags).name(path)
        at += len(content)
    packed = (codecs or CODECS)[flags & CODEC_MASK][1](bytes(info.out))
    w = Writer().name(b.signature).put("u32", b.version).name(b.player).name(b.engine)
    place = len(w.out)
    w.put("i64 u32 u32 u32", 0, len(packed), len(info.out), flags)
    if b.signature != "UnityFS":
        w.put("u8", 0)
    if b.version >= 7:
        w.align(16)
    w.raw(body + packed if flags & BLOCKS_AT_END else packed + body)
    w.out[place : place + 8] = len(w.out).to_bytes(8, "big")
    return bytes(w.out)


# -- web files (A14, J09) -----------------------------------------------------------------------------


def read_web(data: bytes) -> tuple[str, str, list[tuple[str, bytes]]]:
    """(signature, packer, entries)."""
    packer = "none"
    if data[:2] == b"\x1f\x8b":
        packer, data = "gzip", gunzip(data)
    elif not data.startswith(WEB_SIGNATURES):
        packer, data = "brotli", brotli_unpack(data)
    c = Cursor(data, "<")
    signature = c.name()
    if not signature.startswith(tuple(s.decode() for s in WEB_SIGNATURES)):
        raise ValueError(f"no web file: {signature!r}")
    head, entries = c.read("i32"), []
    while c.at < head:
        at, n, length = c.read("i32", "i32", "i32")
        entries.append((c.take(length).decode(), data[at : at + n]))
    return signature, packer, entries


def write_web(signature: str, packer: str, entries: list[tuple[str, bytes]]) -> bytes:
    names = [path.encode() for path, _ in entries]
    head = len(signature) + 1 + 4 + sum(12 + len(n) for n in names)
    w, at = Writer("<").name(signature).put("i32", head), head
    for n, (_, content) in zip(names, entries, strict=True):
        w.put("i32 i32 i32", at, len(content), len(n)).raw(n)
        at += len(content)
    data = bytes(w.out) + b"".join(content for _, content in entries)
    return {"none": lambda x: x, "gzip": lambda x: gzip.compress(x, mtime=0), "brotli": brotli_pack}[packer](data)


# -- serialized files (A16-A18, A28, J06) ---------------------------------------------------------------


@dataclass
class Type:
    class_id: int
    stripped: bool = False
    script_index: int = -1
    script_id: bytes | None = None
    old_hash: bytes = bytes(16)
    tree: tt.Node | None = None
    dependencies: list[int] = field(default_factory=list)
    reference: tuple[str, str, str] | None = None


@dataclass
class Entry:
    path_id: int
    type_id: int
    class_id: int
    data: bytes
    start: int = 0
    destroyed: int | None = None
    stripped: int | None = None


@dataclass
class Serialized:
    version: int
    order: str
    engine: str
    platform: int = 0
    has_trees: bool = True
    types: list[Type] = field(default_factory=list)
    objects: list[Entry] = field(default_factory=list)
    scripts: list[tuple[int, int]] = field(default_factory=list)
    externals: list[tuple[str, bytes, int, str]] = field(default_factory=list)  # temporary name, guid, type, path
    reference_types: list[Type] = field(default_factory=list)
    user: str = ""
    big_ids: int = 0


def _has_script(t: Type, version: int, reference: bool) -> bool:
    return (reference and t.script_index >= 0) or (t.class_id < 0 if version < 16 else t.class_id == SCRIPT_CLASS)


def _read_type(c: Cursor, f: Serialized, reference: bool) -> Type:
    v = f.version
    t = Type(c.read("i32"))
    if v >= 16:
        t.stripped = c.read("bool")
    if v >= 17:
        t.script_index = c.read("i16")
    if v >= 13:
        if _has_script(t, v, reference):
            t.script_id = c.take(16)
        t.old_hash = c.take(16)
    if f.has_trees:
        t.tree = tt.read_blob(c, v) if v >= 12 or v == 10 else tt.read_nested(c, v)
        if v >= 21 and reference:
            t.reference = (c.name(), c.name(), c.name())
        elif v >= 21:
            t.dependencies = c.many("i32", c.read("i32"))
    return t


def _write_type(w: Writer, f: Serialized, t: Type, reference: bool) -> None:
    v = f.version
    w.put("i32", t.class_id)
    if v >= 16:
        w.put("bool", t.stripped)
    if v >= 17:
        w.put("i16", t.script_index)
    if v >= 13:
        if _has_script(t, v, reference):
            w.raw(t.script_id or bytes(16))
        w.raw(t.old_hash)
    if f.has_trees:
        (tt.write_blob if v >= 12 or v == 10 else tt.write_nested)(w, t.tree, v)
        if v >= 21 and reference:
            for name in t.reference:
                w.name(name)
        elif v >= 21:
            w.put("i32", len(t.dependencies))
            for d in t.dependencies:
                w.put("i32", d)


def read_serialized(data: bytes, parent_engine: str | None = None) -> Serialized:
    c = Cursor(data)
    metadata, size, version, offset = c.read("u32", "u32", "u32", "u32")
    if version >= 9:
        order = ">" if c.read("bool") else "<"
        c.take(3)
        if version >= 22:
            metadata, size, offset, _ = c.read("u32", "i64", "i64", "i64")
    else:
        c.at = size - metadata
        order = ">" if c.read("bool") else "<"
    c.order = order
    f = Serialized(version, order, c.name() if version >= 7 else "")
    f.engine = f.engine if f.engine not in ("", "0.0.0") else parent_engine or f.engine
    if version >= 8:
        f.platform = c.read("i32")
    if version >= 13:
        f.has_trees = c.read("bool")
    f.types = [_read_type(c, f, False) for _ in range(c.read("i32"))]
    if 7 <= version < 14:
        f.big_ids = c.read("i32")
    for _ in range(c.read("i32")):
        if version >= 14:
            c.align(4)
        path_id = c.read("i64" if version >= 14 or f.big_ids else "i32")
        start = c.read("i64" if version >= 22 else "u32") + offset
        length, type_id = c.read("u32", "i32")
        e = Entry(path_id, type_id, c.read("u16") if version < 16 else f.types[type_id].class_id, data[start : start + length], start)
        if version < 11:
            e.destroyed = c.read("u16")
        if 11 <= version < 17:
            c.read("i16")
        if version in (15, 16):
            e.stripped = c.read("i8")
        f.objects.append(e)
    if version >= 11:
        for _ in range(c.read("i32")):
            index = c.read("i32")
            if version >= 14:
                c.align(4)
            f.scripts.append((index, c.read("i64" if version >= 14 else "i32")))
    for _ in range(c.read("i32")):
        temporary = c.name() if version >= 6 else ""
        guid, kind = (c.take(16), c.read("i32")) if version >= 5 else (bytes(16), 0)
        f.externals.append((temporary, guid, kind, c.name()))
    if version >= 20:
        f.reference_types = [_read_type(c, f, True) for _ in range(c.read("i32"))]
    if version >= 5:
        f.user = c.name()
    return f


def write_serialized(f: Serialized) -> bytes:
    """The file's bytes, objects by path id and eight bytes apart."""
    v = f.version
    m = Writer(f.order)
    if v >= 7:
        m.name(f.engine)
    if v >= 8:
        m.put("i32", f.platform)
    if v >= 13:
        m.put("bool", f.has_trees)
    m.put("i32", len(f.types))
    for t in f.types:
        _write_type(m, f, t, False)
    if 7 <= v < 14:
        m.put("i32", f.big_ids)
    m.put("i32", len(f.objects))
    body = Writer(f.order)
    # places are counted from the file's start: the metadata follows the header from version 9 on
    head = 0 if v < 9 else 20 if v < 22 else 48
    for e in sorted(f.objects, key=lambda e: e.path_id):
        body.align(8)
        if v >= 14:
            m.out += bytes(-(head + len(m.out)) % 4)
        m.put("i64" if v >= 14 or f.big_ids else "i32", e.path_id)
        m.put("i64" if v >= 22 else "u32", len(body.out)).put("u32 i32", len(e.data), e.type_id)
        if v < 16:
            m.put("u16", e.class_id)
        if v < 11:
            m.put("u16", e.destroyed or 0)
        if 11 <= v < 17:
            m.put("i16", -1)
        if v in (15, 16):
            m.put("i8", e.stripped or 0)
        body.raw(e.data)
    if v >= 11:
        m.put("i32", len(f.scripts))
        for index, identifier in f.scripts:
            m.put("i32", index)
            if v >= 14:
                m.out += bytes(-(head + len(m.out)) % 4)
            m.put("i64" if v >= 14 else "i32", identifier)
    m.put("i32", len(f.externals))
    for temporary, guid, kind, path in f.externals:
        if v >= 6:
            m.name(temporary)
        if v >= 5:
            m.raw(guid).put("i32", kind)
        m.name(path)
    if v >= 20:
        m.put("i32", len(f.reference_types))
        for t in f.reference_types:
            _write_type(m, f, t, True)
    if v >= 5:
        m.name(f.user)
    flag = bytes([f.order == ">"])
    if v < 9:  # the metadata, with its flag, ends the file
        data = 16
        out = Writer().put("u32 u32 u32 u32", len(m.out) + 1, data + len(body.out) + len(m.out) + 1, v, data)
        return bytes(out.raw(bytes(body.out)).raw(flag).raw(bytes(m.out)).out)
    data = -(-(head + len(m.out)) // 16) * 16
    size = data + len(body.out)
    if v < 22:
        out = Writer().put("u32 u32 u32 u32", len(m.out), size, v, data).raw(flag + bytes(3))
    else:
        out = Writer().put("u32 u32 u32 u32", 0, 0, v, 0).raw(flag + bytes(3)).put("u32 i64 i64 i64", len(m.out), size, data, 0)
    return bytes(out.raw(bytes(m.out)).align(16).raw(bytes(body.out)).out)
