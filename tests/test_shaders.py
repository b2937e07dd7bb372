"""Platform names, usable program kinds, and programs of made-up blobs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import shaders as S
from tessera.sources.binary import Writer

PROGRAMS = "platform int, program int"


def test_names(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (20, 0), (21, 0), (-1, 0), (None, 0)], PROGRAMS)
    assert [r[0] for r in rows.select(S.platform_name("platform")).collect()] == ["openGL", "ps3", "xboxone+_d3d12", "unknown", "unknown", "unknown"]


def test_usable(spark):
    every = spark.range(21).select(F.col("id").cast("int").alias("platform")).crossJoin(spark.range(32).select(F.col("id").cast("int").alias("program")))
    got = {(r.platform, r.program) for r in S.usable_programs(every, "platform", "program").collect()}
    console = {(p, k) for p in (2, 10, 11, 12, 16, 17, 19, 20) for k in range(26, 31)}
    others = {(0, 1), (5, 5), (14, 23), (18, 25)} | {(1, k) for k in (9, 10, 11, 12)} | {(4, k) for k in range(15, 23)} | {(8, 13), (8, 14)} | {(9, 2), (9, 3), (9, 4)} | {(15, 6), (15, 7), (15, 8)}
    assert got == console | others


def test_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None, 1), (0, None), (3, 1), (0, 1), (0, 1)], PROGRAMS)
    assert [tuple(r) for r in S.usable_programs(rows, "platform", "program").collect()] == [(0, 1), (0, 1)]
    assert [r[0] for r in rows.select(S.program_usable("platform", "program")).collect()] == [None, None, None, True, True]
    assert S.usable_programs(rows.limit(0), "platform", "program").count() == 0


BLOBS = "path string, path_id bigint, platform int, engine string, blob binary"
METAL = Writer("<").put("u32 i32", S.METAL_MARK, 8).name("main").raw(b"void m() {}").out


def program(layout, kind, keywords, code, local=()):
    w = Writer("<").put("i32 i32 i32 i32 i32", layout, kind, 0, 0, 0)
    if layout >= 201608170:
        w.put("i32", 0)
    w.put("i32", len(keywords))
    for k in keywords:
        w.text(k)
    if 201806140 <= layout < 202012090:
        w.put("i32", len(local))
        for k in local:
            w.text(k)
    return bytes(w.put("i32", len(code)).raw(code).align(4).out)


def blob(step, parts):
    w, at = Writer("<").put("i32", len(parts)), 4 + step * len(parts)
    for p in parts:
        w.put("i32 i32", at, len(p)).raw(bytes(step - 8))
        at += len(p)
    return bytes(w.raw(b"".join(parts)).out)


@pytest.mark.parametrize(("engine", "step"), [("2018.4.1f1", 8), ("2019.3.0f1", 12), ("2021.3.1f1", 12)])
def test_programs(spark, engine, step):
    parts = [program(201510240, 1, ["A", "BC"], b"void main() {}"), program(201806140, 15, [], b"DXBC", ["L"]), program(202012090, 25, [], b"x"), program(202012090, 23, [], bytes(METAL)), program(202012090, 31, ["K"], b"y"), program(202012090, 1, [], b"")]
    found = S.programs(spark.createDataFrame([("f", 1, 15, engine, blob(step, parts))], BLOBS))
    rows = found.withColumn("text", S.program_text()).orderBy("place").collect()
    assert [r.error for r in rows] == [None] * 6
    assert [r.local_keywords for r in rows] == [None, ["L"], None, None, None, None]
    assert [r.text for r in rows] == [
        'Keywords { "A" "BC" }\n"void main() {}"',
        'Local Keywords { "L" }\n"// shader disassembly not supported on DXBC"',
        '""',
        '"void m() {}"',
        'Keywords { "K" }\n"//shader disassembly not supported on 31"',
        '""',
    ]


def test_broken_blobs(spark):
    good = program(201510240, 1, [], b"\xff")
    bad = good[:12]
    odd = program(201510240, 1, ["\udcff"], b"")
    astray = Writer("<").put("i32 i32 i32 i32", 1, -9, 0, 0).raw(good).out
    rows = [("a", 1, 0, None, blob(12, [good, bad])), ("b", 1, 0, "", b"\xff\xff\xff\x7f"), ("c", 1, 0, "2020.1.0f1", b""), ("d", 1, 0, "2020.1.0f1", None), ("e", None, None, "2020.1.0f1", blob(12, [])), ("f", 1, 0, None, blob(12, [odd])), ("g", 1, 0, None, bytes(astray))]
    got = S.programs(spark.createDataFrame(rows, BLOBS)).withColumn("text", S.program_text()).orderBy("path", "place").collect()
    assert [(r.path, r.place, r.text, r.error is None) for r in got] == [("a", 0, '"\ufffd"', True), ("a", 1, None, False), ("b", None, None, False), ("c", None, None, False), ("f", 0, 'Keywords { "\ufffd" }\n""', True), ("g", 0, None, False)]


def test_fill(spark):
    found = S.programs(spark.createDataFrame([("f", 1, 15, "2020.1.0f1", blob(12, [program(201510240, 1, [], b"zero $1"), program(201510240, 1, [], b"one")]))] * 2, BLOBS))
    rows = [("f", 1, 15, "a\nGpuProgramIndex 1\nb GpuProgramIndex 0\nGpuProgramIndex 7\nGpuProgramIndex x", 9), ("g", 1, 15, "GpuProgramIndex 0", 9), ("h", 1, 15, None, 9), ("i", None, 15, "", 9)]
    shaders = spark.createDataFrame(rows, "path string, path_id bigint, platform int, text string, place int")
    got = S.fill_programs(shaders, found).orderBy("path")
    assert got.columns == shaders.columns
    assert [r.text for r in got.collect()] == ['a\n"one"\nb "zero $1"\nGpuProgramIndex 7\nGpuProgramIndex x', "GpuProgramIndex 0", None, ""]
