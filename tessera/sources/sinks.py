"""Objects and files back into containers, and files into folders.

Rows meet by the container they go to and stream through the task that writes it, so a task holds one container.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from posixpath import dirname

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import containers as ct
from tessera.sources import typetree as tt
from tessera.sources.assets import trees_from_json
from tessera.sources.binary import Codecs

WRITTEN = "path string, content binary"


def _each_path(rows: DataFrame, order: list[str], write: Callable[[list[dict]], bytes]) -> DataFrame:
    """``path, content``: what ``write`` makes of all rows of a path, in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]["path"]]), pa.array([write(held)], pa.binary())], ["path", "content"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["path"] != row["path"]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return rows.repartition("path").sortWithinPartitions("path", *order).mapInArrow(run, WRITTEN)


def serialized_files(objects: DataFrame, engine: str, version: int = 22, order: str = "<", platform: int = 5) -> DataFrame:
    """``path, content`` of serialized files with the objects of rows ``path, path_id, class_id, tree, payload, externals``.

    ``externals`` is an array of the paths that pointers of the file count from 1; the first row's holds. Objects are written by path id.
    """

    def write(rows: list[dict]) -> bytes:
        places: dict[tuple[int, str], int] = {}
        for r in rows:
            places.setdefault((r["class_id"], r["tree"]), len(places))
        types = [ct.Type(class_id, tree=trees_from_json(tree)) for class_id, tree in places]
        entries = [ct.Entry(r["path_id"], places[r["class_id"], r["tree"]] if version >= 16 else r["class_id"], r["class_id"], r["payload"]) for r in rows]
        outside = [("", bytes(16), 0, target) for target in rows[0]["externals"] or []]
        return ct.write_serialized(ct.Serialized(version, order, engine, platform, True, types, entries, externals=outside))

    return _each_path(objects.select("path", "path_id", "class_id", "tree", "payload", "externals"), ["path_id"], write)


def bundles(entries: DataFrame, engine: str, packer: str | tuple[int, int] = "lz4", codecs: Codecs | None = None, version: int = 8) -> DataFrame:
    """``path, content`` of bundles with the files of rows ``path, name, content`` (J07); files are written by name."""

    def write(rows: list[dict]) -> bytes:
        held = [(r["name"], r["content"], 0 if r["name"].endswith(ct.RESOURCE_ENDINGS) else 4) for r in rows]
        return ct.write_bundle(ct.Bundle("UnityFS", version, "5.x.x", engine, 0, entries=held), packer, codecs)

    return _each_path(entries.select("path", "name", "content"), ["name"], write)


def web_files(entries: DataFrame, packer: str = "gzip", signature: str = "UnityWebData1.0") -> DataFrame:
    """``path, content`` of web files with the files of rows ``path, name, content``."""
    return _each_path(entries.select("path", "name", "content"), ["name"], lambda rows: ct.write_web(signature, packer, [(r["name"], r["content"]) for r in rows]))


def repacked(raw: DataFrame, changed: DataFrame, packer: str | tuple[int, int] = "original", fallback_version: str | None = None) -> DataFrame:
    """``path, content`` of the bundles among ``raw`` (``path, content``) of which ``changed`` (``path, content``, nested paths) has entries.

    Only top-level files that changed are written; entries that didn't keep their bytes.
    """
    edits = changed.select(F.regexp_replace("path", r"/[^/]*$", "").alias("__in"), F.struct(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content").alias("e"))
    edits = edits.groupBy("__in").agg(F.collect_list("e").alias("edits"))
    both = raw.join(edits, F.col("path") == F.col("__in")).select("path", "content", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = ct.read_bundle(row["content"], fallback_version)
                new = {e["name"]: e["content"] for e in row["edits"]}
                b.entries = [(n, new.get(n, data), flags) for n, data, flags in b.entries]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([ct.write_bundle(b, packer)], pa.binary())], ["path", "content"])

    return both.mapInArrow(run, WRITTEN)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of each row to ``dest`` below ``folder``, a URI or a path that all executors share (J01); ``dest, bytes`` of each.

    A file appears under its name when it is whole, so a task that runs again does no harm. Of rows with one ``dest`` the last written stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for dest, content in zip(batch.column("dest").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{dest}"
                system.create_dir(dirname(target), recursive=True)
                part = f"{dirname(target)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([batch.column("dest"), pa.array([len(x) for x in batch.column("content").to_pylist()], pa.int64())], ["dest", "bytes"])

    safe = F.array_join(F.filter(F.split("dest", r"[/\\]"), lambda x: ~x.isin("", ".", "..")), "/")
    return rows.where("content IS NOT NULL").select(safe.alias("dest"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "dest string, bytes bigint")


def json_of(tree: tt.Node) -> str:
    """A tree as the JSON that objects carry."""
    return json.dumps(tt.to_dicts(tree))
