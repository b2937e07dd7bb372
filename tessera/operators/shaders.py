"""Shader programs: platforms and the kinds of program they can use (I19), programs of blobs and their text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.sources.binary import Cursor

# The format's platform numbers from 0, as they are printed.
PLATFORMS = [
    "openGL",
    "d3d9",
    "xbox360",
    "ps3",
    "d3d11",
    "gles",
    "glesdesktop",
    "flash",
    "d3d11_9x",
    "gles3",
    "psp2",
    "ps4",
    "xboxone",
    "psm",
    "metal",
    "glcore",
    "n3ds",
    "wiiu",
    "vulkan",
    "switch",
    "xboxone+_d3d12",
]
UNKNOWN = "unknown"

# Program kinds (numbers of the format, first to last) that a platform can use.
# Metal takes its vertex kind only, as the format's known reader has it.
USABLE: dict[str, tuple[int, int]] = {
    "openGL": (1, 1),
    "d3d9": (9, 12),
    "xbox360": (26, 30),
    "d3d11": (15, 22),
    "gles": (5, 5),
    "d3d11_9x": (13, 14),
    "gles3": (2, 4),
    "psp2": (26, 30),
    "ps4": (26, 30),
    "xboxone": (26, 30),
    "metal": (23, 23),
    "glcore": (6, 8),
    "n3ds": (26, 30),
    "wiiu": (26, 30),
    "vulkan": (25, 25),
    "switch": (26, 30),
    "xboxone+_d3d12": (26, 30),
}


def platform_name(platform: str | Column) -> Column:
    """The printed name of a platform number; ``unknown`` for null and numbers without one."""
    at = F.col(platform) if isinstance(platform, str) else platform
    names = F.array(*[F.lit(n) for n in PLATFORMS])
    return F.when((at >= 0) & (at < len(PLATFORMS)), F.get(names, at.cast("int"))).otherwise(F.lit(UNKNOWN))


def program_usable(platform: str | Column, program: str | Column) -> Column:
    """Whether a platform can use a kind of program; null where the platform has no rule or either is null."""
    kind = F.col(program) if isinstance(program, str) else program
    first = F.create_map(*[F.lit(x) for name, (a, _) in USABLE.items() for x in (name, a)])
    last = F.create_map(*[F.lit(x) for name, (_, b) in USABLE.items() for x in (name, b)])
    name = platform_name(platform)
    return kind.between(F.try_element_at(first, name), F.try_element_at(last, name))


def usable_programs(programs: DataFrame, platform: str, program: str) -> DataFrame:
    """The rows whose program their platform can use.

    Rows of platforms without a rule go, like rows with a null; repeated rows stay. The rules are
    literals of the plan, so this is a filter of the scan: no join and no shuffle.
    """
    return programs.where(program_usable(platform, program))


# -- programs of a blob (I20) ------------------------------------------------------------------------

# Layouts (dates of the format) from which a program has a further statistic, and
# between which it lists local keywords.
STATISTIC_FROM, LOCAL_FROM, LOCAL_UNTIL = 201608170, 201806140, 202012090
# Fixed value: what a Metal program begins with if a place of its text follows.
METAL_MARK = 0xF00DCAFE
METAL = (23, 24)

KEYS = ["path", "path_id", "platform"]
PROGRAMS = "path string, path_id bigint, platform int, place int, layout int, kind int, keywords array<string>, local_keywords array<string>, code binary, error string"


def _words(c: Cursor) -> list[str]:
    """Strings, with U+FFFD for bytes that aren't UTF-8."""
    return [c.text().encode("utf-8", "surrogateescape").decode("utf-8", "replace") for _ in range(c.read("i32"))]


def _program(c: Cursor) -> tuple:
    if c.at < 0:
        raise ValueError(f"a program at {c.at}")
    layout, kind = c.read("i32", "i32")
    c.take(16 if layout >= STATISTIC_FROM else 12)
    keywords = _words(c)
    local = _words(c) if LOCAL_FROM <= layout < LOCAL_UNTIL else None
    code = c.take(c.read("i32"))
    if kind in METAL and code:
        own = Cursor(code, "<")
        if own.read("u32") == METAL_MARK:
            own.at = max(0, own.read("i32"))
        own.name()
        code = own.take(len(code) - own.at)
    return layout, kind, keywords, local, code


def programs(blobs: DataFrame, endian: str = "<") -> DataFrame:
    """The programs of rows ``path, path_id, platform, engine, blob``, a row each (``PROGRAMS``).

    ``place`` is a program's number in its blob, ``local_keywords`` null where the layout has none,
    ``code`` its bytes (of Metal programs what follows the entry's name). A program, or a table of programs, that
    can't be read is a row with an error; null blobs give no rows, repeated rows give rows each.
    """
    wide = F.coalesce(C.version_at_least(C.version_key(C.version_parts(F.col("engine"))), 2019, 3), F.lit(True))
    rows = blobs.where("blob is not null").select(*[F.col(k).cast(t) for k, t in zip(KEYS, ("string", "long", "int"), strict=True)], F.when(wide, 12).otherwise(8).alias("step"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*zip(KEYS, (pa.string(), pa.int64(), pa.int32()), strict=True), *[(n, pa.int32()) for n in ("place", "layout", "kind")]])
        for n, t in (("keywords", pa.list_(pa.string())), ("local_keywords", pa.list_(pa.string())), ("code", pa.binary()), ("error", pa.string())):
            schema = schema.append(pa.field(n, t))
        for batch in batches:
            for row in batch.to_pylist():
                key, out = [row[k] for k in KEYS], []
                table = Cursor(row["blob"], endian)
                try:
                    count = table.read("i32")
                    if not 0 <= count <= len(row["blob"]) // row["step"]:
                        raise ValueError(f"{count} programs in {len(row['blob'])} bytes")
                    for place in range(count):
                        table.at = 4 + place * row["step"]
                        start = table.read("i32")
                        try:
                            found = (*_program(Cursor(row["blob"], endian, start)), None)
                        except ValueError as e:
                            found = (None,) * 5 + (str(e),)
                        out.append((*key, place, *found))
                except ValueError as e:
                    out.append((*key, *(None,) * 6, str(e)))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema)

    return rows.mapInArrow(run, PROGRAMS)


def _keyword_line(title: str, words: Column) -> Column:
    line = F.concat(F.lit(title + " { "), F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('" '))), ""), F.lit("}\n"))
    return F.when(F.size(words) > 0, line).otherwise(F.lit(""))


def program_text() -> Column:
    """The text of a row of ``programs``: its keywords, then its source in quotes; null for a row with an error.

    Compiled kinds have a remark for a source, kind 25 (SPIR-V) none. Bytes that aren't UTF-8 become U+FFFD.
    """
    kind, code = F.col("kind"), F.make_valid_utf8(F.col("code").cast("string"))
    source = F.when(kind.between(1, 8) | kind.between(26, 30) | kind.isin(*METAL), code).when(kind.between(9, 22), F.lit("// shader disassembly not supported on DXBC"))
    source = source.when(kind == 25, F.lit("")).otherwise(F.concat(F.lit("//shader disassembly not supported on "), kind.cast("string")))
    text = F.concat(_keyword_line("Keywords", F.col("keywords")), _keyword_line("Local Keywords", F.col("local_keywords")), F.lit('"'), F.when(F.length("code") > 0, source).otherwise(F.lit("")), F.lit('"'))
    return F.when(F.col("error").isNull(), text)


def fill_programs(shaders: DataFrame, found: DataFrame) -> DataFrame:
    """``shaders`` (``KEYS`` and ``text``) with each ``GpuProgramIndex n`` of the text replaced by program n's text.

    ``found`` are rows of ``programs``. What names no readable program stays as it is. Of rows that repeat a place the
    least text counts; a blob's programs make one map, which is as large as the shader that it came from.
    """
    texts = found.withColumn("__text", program_text()).where("__text is not null").groupBy(*KEYS, "place").agg(F.min("__text").alias("__text"))
    maps = texts.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("place", "__text"))).alias("__programs"))
    mark = "GpuProgramIndex [^\n]+"
    pieces, marks = F.split("text", mark, -1), F.regexp_extract_all("text", F.lit(f"({mark})"), F.lit(1))
    number = lambda m: F.trim(F.substring(m, 17, 1 << 20)).try_cast("int")
    fill = F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(F.try_element_at(F.col("__programs"), number(m)), m, F.lit(""))))
    return shaders.join(maps, KEYS, "left").withColumn("text", F.array_join(fill, "")).select(*shaders.columns)
