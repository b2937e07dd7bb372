"""Column helpers: versions, names, paths, bit fields, vectors, sizes. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Release letters of engine versions; any other letter is 255.
VERSION_TYPES: dict[str, int] = {"a": 0, "b": 1, "c": 2, "f": 3, "p": 4, "x": 5}
UNKNOWN_TYPE = 255

_HEAD = r"(?s)^(\d+)\.(\d+)\.(\d+)"
_TAIL = _HEAD + r"(\D+?)(\d+)?(\D.*)?$"


# -- versions (H01-H04) ---------------------------------------------------------------------------


def version_parts(v: Column) -> Column:
    """``struct<major, minor, build, type, type_number, postfix>``; without a letter the type is f, 0."""
    number = lambda group: F.regexp_extract(v, _HEAD, group).try_cast("int")
    letter = F.lower(F.regexp_extract(v, _TAIL, 4))
    known = F.create_map(*[F.lit(x) for pair in VERSION_TYPES.items() for x in pair])
    kind = F.when(letter == "", F.lit(VERSION_TYPES["f"])).otherwise(F.coalesce(F.try_element_at(known, letter), F.lit(UNKNOWN_TYPE)))
    digits = F.regexp_extract(v, _TAIL, 5)
    return F.struct(
        number(1).alias("major"),
        number(2).alias("minor"),
        number(3).alias("build"),
        kind.cast("int").alias("type"),
        F.coalesce(digits.try_cast("int"), F.lit(0)).alias("type_number"),
        F.regexp_extract(v, _TAIL, 6).alias("postfix"),
    )


def version_key(parts: Column) -> Column:
    """One bigint that orders like the parts: 16 bits each for major, minor, build, 8 for type and number."""
    out = F.lit(0).cast("long")
    for field, shift in (("major", 48), ("minor", 32), ("build", 16), ("type", 8), ("type_number", 0)):
        out = out.bitwiseOR(F.shiftleft(parts[field].cast("long"), shift))
    return out


def version_field(key: Column, field: str) -> Column:
    shift, mask = {"major": (48, 0xFFFF), "minor": (32, 0xFFFF), "build": (16, 0xFFFF), "type": (8, 0xFF), "type_number": (0, 0xFF)}[field]
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(mask)).cast("int")


def version_at_least(key: Column, *parts: int) -> Column:
    """Whether a version is not below a short tuple of parts."""
    padded = [*parts, 0, 0, 0, 0, 0][:5]
    least = 0
    for value, shift in zip(padded, (48, 32, 16, 8, 0), strict=True):
        least |= value << shift
    return key >= F.lit(least)


def version_text(parts: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for name, k in VERSION_TYPES.items() for x in (k, name)])
    tail = F.concat(F.coalesce(F.try_element_at(letters, parts["type"]), F.lit("u")), parts["type_number"].cast("string"), parts["postfix"])
    head = F.concat_ws(".", parts["major"], parts["minor"], parts["build"])
    return F.when(parts["major"] <= 5, head).otherwise(F.concat(head, tail))


# -- names, paths, enums (B11, B16, C13, D07, H05, H06, A08, H25) -------------------------------------


def clean_name(name: Column) -> Column:
    """A field name as an identifier."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^\(int&\)", ""), r"\?$", "")
    plain = F.regexp_replace(plain, r"[ .:\-\[\]]", "_")
    return F.when(plain.isin("pass", "from"), F.concat(plain, F.lit("_"))).when(plain.rlike(r"^\d"), F.concat(F.lit("x"), plain)).otherwise(plain)


def simple_name(path: Column) -> Column:
    """Key of a registered file: the last segment of either kind of path, lower-cased, extension kept."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))


def destination(path: Column, skip: int) -> Column:
    """A container path without its first ``skip`` directories and empty segments."""
    parts = F.filter(F.slice(F.split(path, "/"), skip + 1, 1_000_000), lambda x: x != "")
    return F.array_join(parts, "/")


def enum_name(names: dict[int, str], value: Column) -> Column:
    """Name of an enum value; an unknown one gets a name that holds the number."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.format_string("Unknown (%d)", value))


# -- bits and numbers (H07, H08, H09, H14, H15) -------------------------------------------------------


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four channels in 0 to 1 as 32 bits, red lowest; fractions are cut off."""
    out = F.lit(0).cast("long")
    for k, c in enumerate((r, g, b, a)):
        out = out.bitwiseOR(F.shiftleft((c * 255).cast("long"), 8 * k))
    return out


def unpack_rgba(rgba: Column) -> list[Column]:
    return [F.shiftright(rgba, 8 * k).bitwiseAND(F.lit(255)) / 255 for k in range(4)]


def bit_fields(value: Column, widths: list[int]) -> list[Column]:
    """Consecutive fields, lowest bits first."""
    out, at = [], 0
    for w in widths:
        out.append(F.shiftright(value, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return out


def unpack_ints(value: Column, bits: int, count: int) -> Column:
    """``count`` fields of ``bits`` bits of a bigint, lowest first."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(*[F.shiftright(value, k * bits).bitwiseAND(mask) for k in range(count)])


def dequantise(x: Column, start: Column, span: Column, bits: int) -> Column:
    return start if bits == 0 else x * span / ((1 << bits) - 1) + start


def align_up(n: Column, to: int) -> Column:
    return n + F.pmod(-n, F.lit(to))


def chunk_sizes(size: Column, most: int) -> Column:
    """Sizes of the chunks that so many bytes are cut into."""
    count = F.ceil(size / most).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.least(F.lit(most).cast("long"), size - k * most))).otherwise(F.array().cast("array<bigint>"))


# -- arrays (H10, H11, G05, I04, I06, I07) --------------------------------------------------------------


def reshape(a: Column, width: int) -> Column:
    rows = (F.size(a) / width).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(a, i * width + 1, F.lit(width)))).otherwise(F.array())


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalise(a: Column, tiny: float = 1e-5) -> Column:
    """The unit vector; vectors no longer than ``tiny`` become zeros."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > tiny, x / n).otherwise(F.lit(0.0)))


def normal_from_xy(x: Column, y: Column) -> Column:
    """Third component of a unit vector; if x and y are too long, both are scaled and it is zero."""
    rest = 1 - x * x - y * y
    length = F.sqrt(x * x + y * y)
    return F.when(rest >= 0, F.array(x, y, F.sqrt(F.greatest(rest, F.lit(0.0))))).otherwise(F.array(x / length, y / length, F.lit(0.0)))


def triangles(indices: Column) -> Column:
    """Index triples of a triangle list; an incomplete one at the end is left out."""
    return F.filter(reshape(indices, 3), lambda t: F.size(t) == 3)


def strip_triangles(indices: Column) -> Column:
    """Triples of a triangle strip: those with equal corners are left out, every second one is turned."""
    n = F.size(indices) - 2
    at = lambda k: F.element_at(indices, k.cast("int"))
    every = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k % 2 == 1, F.array(at(k), at(k + 1), at(k + 2))).otherwise(F.array(at(k + 1), at(k), at(k + 2))))
    return F.when(n > 0, F.filter(every, lambda t: (t[0] != t[1]) & (t[1] != t[2]) & (t[0] != t[2]))).otherwise(F.array())


def quad_triangles(indices: Column) -> Column:
    """Two triples for each four indices."""
    quads = F.filter(reshape(indices, 4), lambda q: F.size(q) == 4)
    return F.flatten(F.transform(quads, lambda q: F.array(F.array(q[0], q[1], q[2]), F.array(q[0], q[2], q[3]))))


def deinterleave(a: Column, stride: int, offset: int, width: int) -> Column:
    """``width`` values at ``offset`` of each ``stride``."""
    return F.transform(reshape(a, stride), lambda row: F.slice(row, offset + 1, width))


def text_slices(data: Column, parts: int) -> Column:
    """Equal slices of ``length // parts``; what is left over is cut off."""
    size = F.floor(F.length(data) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(data, k * size + 1, size))


def block_bytes(width: Column, height: Column, block: int, bytes_a_block: int) -> Column:
    """Bytes of an image that is stored in square blocks."""
    side = lambda n: F.ceil(n / block)
    return (side(width) * side(height) * bytes_a_block).cast("long")


def gob_offset(x: Column, y: Column, block_height: int, gobs_across: Column) -> Column:
    """Place of the 16-byte texel (x, y) in the block-linear layout: 4 x 8 texels a group of bytes (GOB).

    Within a GOB the bits of the place are y0, y1, x0, y2, x1 from the lowest.
    """
    bit = lambda v, k, to: F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), to)
    inner = bit(y, 0, 0) + bit(y, 1, 1) + bit(x, 0, 2) + bit(y, 2, 3) + bit(x, 1, 4)
    gob_x, gob_y = F.floor(x / 4), F.floor(y / 8)
    block = F.floor(gob_y / block_height) * gobs_across + gob_x
    return ((block * block_height + gob_y % block_height) * 32 + inner).cast("long")
