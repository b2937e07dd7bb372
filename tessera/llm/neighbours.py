"""Approximate nearest neighbours by cosine: NN-descent builds a graph, greedy search answers.

Equal vectors fold into one node first, so a vector that a third of all rows share is one node, not a
group. The graph starts from groups of about ``GROUP`` nodes on one side of the same random hyperplanes, each
held against itself. Every round then joins neighbours of neighbours: each node gathers its neighbours and those that list it,
compares the pairs that have a new one, and proposes each member to the others where it beats their
worst neighbour. A node that many list is cut into blocks of about ``BLOCK`` of these, each compared
with itself and with the node's own neighbours, so no task gets all of them. Proposals meet in one
shuffle by node and the best ``k`` stay, until few edges are new.

A search keeps one row a query: a beam of the best nodes so far, each open until its neighbours were scored. Each round
sends the best open nodes to the graph, which holds the neighbours with their vectors and is partitioned by node once, and
what beats the beam's worst comes back. A node that fell out of the beam can't beat it again, so nothing else is
remembered. It ends when no beam has an open node. The best found are scored again in double precision on the original vectors.

In the joins a vector travels as bytes (8 bits a component) with one scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, small_side

GROUP = 1024
BLOCK = 48
SALTS = 64


# -- nodes ------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part: an id, all finite, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)")


def scaled(x: np.ndarray) -> np.ndarray:
    """The vector times a power of two that brings its largest component near 1: no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1])


def quantised(nodes: DataFrame, dim: int) -> DataFrame:
    """``node, q binary, s float``: ``s * q`` is the unit vector; shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, scales = [], []
            for v in batch.column(1):
                x = np.array(v.values)
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
                s = np.abs(x).max() / 127
                marks.append(np.rint(x / s).astype(np.int8).tobytes().ljust(dim, b"\0"))
                scales.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(scales, pa.float32())], ["node", "q", "s"])

    return nodes.select("node", "v").mapInArrow(run, "node long, q binary, s float")


def matrix(marks: pa.Array, scales: pa.Array) -> np.ndarray:
    raw = b"".join(marks.to_pylist())
    return np.frombuffer(raw, np.int8).reshape(len(marks), -1).astype(np.float32) * scales.to_numpy(zero_copy_only=False)[:, None]


# -- streaming groups ---------------------------------------------------------------------------


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(batch, 0) != last:
            yield pa.Table.from_batches(held)
            held = []
        last = key(batch, batch.num_rows - 1)
        start = batch.num_rows - 1
        while start and key(batch, start - 1) == last:
            start -= 1
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def spans(t: pa.Table, keys: int) -> list[tuple[int, int]]:
    columns = [t.column(c).to_numpy() for c in range(keys)]
    new = np.zeros(len(t), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), np.append(at[1:], len(t)).tolist(), strict=True))


# -- the graph ----------------------------------------------------------------------------------


def best(edges: DataFrame, k: int) -> DataFrame:
    """``node, nbr, sim, fresh``: the ``k`` nearest of each node; an edge that was known isn't fresh."""
    one = edges.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return one.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def first_graph(marks: DataFrame, count: int, dim: int, k: int, trees: int, seed: int = 23) -> DataFrame:
    """The nearest within groups of each node: in each of ``trees`` a group shares the sides of random hyperplanes.

    There are as many hyperplanes as leave about ``GROUP`` nodes a group; a larger one is dealt out by a hash of the node.
    """
    depth = max(0, int(np.log2(max(1, count / GROUP))))
    trees = trees if depth else 1
    planes = np.random.default_rng(seed).normal(size=(dim, trees * depth))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = matrix(batch.column("q"), batch.column("s")) @ planes > 0
            places = ones.reshape(len(ones), trees, depth) @ (1 << np.arange(depth))
            keys = (places + (np.arange(trees) << depth)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 1):
            x = matrix(t.column("q").combine_chunks(), t.column("s").combine_chunks())
            ids = t.column("node").to_numpy()
            for a, b in spans(t, 1):
                sim = x[a:b] @ x[a:b].T
                np.fill_diagonal(sim, -2)
                n = min(-(-2 * k // trees), k, b - a - 1)
                if n < 1:
                    continue
                j = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[a:b], n)), pa.array(ids[a:b][j].ravel()), pa.array(np.take_along_axis(sim, j, 1).ravel())], ["node", "nbr", "sim"]
                )

    placed = marks.mapInArrow(sides, "node long, q binary, s float, sides array<long>")
    large = placed.select(F.explode("sides").alias("side")).groupBy("side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * GROUP)
    rows = placed.select(F.explode("sides").alias("side"), "node", "q", "s").join(small_side(checkpoint(large)), "side", "left")
    part = F.pmod(F.xxhash64("node", "side"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)))
    found = rows.select(F.xxhash64("side", part).alias("g"), "node", "q", "s").repartition("g").sortWithinPartitions("g").mapInArrow(run, "node long, nbr long, sim float")
    return best(found.withColumn("fresh", F.lit(True)), k)


def descend(graph: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """One round of NN-descent."""
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    known = checkpoint(marks.join(worst, "node", "left").select(F.col("node").alias("member"), "q", "s", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least")))
    listed = graph.groupBy("nbr").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("nbr").alias("at"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = graph.select(F.col("node").alias("at"), F.col("nbr").alias("member"), "fresh")
    theirs = graph.select(F.col("nbr").alias("at"), F.col("node").alias("member"), "fresh")
    theirs = theirs.join(listed, "at", "left").select("at", F.pmod(F.xxhash64("member"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), "member", "fresh")
    own = own.join(listed, "at", "left").select("at", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "member", "fresh")
    rows = own.unionByName(theirs).join(known, "member").select("at", "block", "member", "fresh", "q", "s", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 2):
            x = matrix(t.column("q").combine_chunks(), t.column("s").combine_chunks())
            ids, fresh, least = (t.column(c).to_numpy() for c in ("member", "fresh", "least"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in spans(t, 2):
                f = fresh[a:b]
                if not f.any():
                    continue
                sim = x[a:b] @ x[a:b].T
                i, j = np.nonzero((sim > least[a:b, None]) & (f[:, None] | f[None, :]) & (ids[a:b, None] != ids[None, a:b]))
                out.append((ids[a:b][i], ids[a:b][j], sim[i, j]))
            if out:
                node, nbr, sim = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.lexsort((nbr, node))  # pairs that meet at several nodes go once
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(node[order]) != 0) | (np.diff(nbr[order]) != 0)
                node, nbr, sim = node[order[first]], nbr[order[first]], sim[order[first]]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(nbr), pa.array(sim)], ["node", "nbr", "sim"])

    found = rows.repartition("at", "block").sortWithinPartitions("at", "block").mapInArrow(run, "node long, nbr long, sim float")
    return best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k)


def build_graph(marks: DataFrame, dim: int, k: int = 12, trees: int = 16, settled: float = 0.05) -> DataFrame:
    """``node, nbr, sim, fresh``: each node's ``k`` nearest found.

    Rounds go on until less than the share ``settled`` of the edges is new; every round with a new edge
    raises similarities that are bounded, so there is a last one.
    """
    graph = checkpoint(first_graph(marks, marks.count(), dim, k, trees))
    share = 1.0
    while share >= settled:
        graph = checkpoint(descend(graph, marks, k))
        share = graph.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0.0
    return graph


# -- search -------------------------------------------------------------------------------------


def with_vectors(graph: DataFrame, marks: DataFrame) -> DataFrame:
    """``at, nbrs, qs, ss``: the neighbours of a node, in either direction, with their vectors; hubs have rows of ``BLOCK`` or so."""
    links = graph.select(F.col("node").alias("at"), "nbr").unionByName(graph.select(F.col("nbr").alias("at"), F.col("node").alias("nbr"))).distinct()
    sizes = links.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    links = checkpoint(links.join(sizes, "at", "left").select("at", F.pmod(F.xxhash64("nbr"), F.coalesce("blocks", F.lit(1))).alias("block"), "nbr"))
    rows = links.join(marks.withColumnRenamed("node", "nbr"), "nbr")
    held = F.collect_list(F.struct("nbr", "q", "s"))
    return rows.repartition("at").groupBy("at", "block").agg(held.alias("x")).select("at", F.col("x.nbr").alias("nbrs"), F.col("x.q").alias("qs"), F.col("x.s").alias("ss"))


def search(queries: DataFrame, graph: DataFrame, marks: DataFrame, beam: int, width: int) -> DataFrame:
    """``query_id, node, sim``: the best ``beam`` nodes that greedy search finds for each query.

    ``queries`` has ``query_id, start, q, s``: where its search begins, and its quantised vector.
    A beam is an array of ``struct<far, node, open>``, nearest first (``far`` is the negative similarity).
    """
    around = with_vectors(graph, marks).persist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for query, q, s, least, nbrs, qs, ss in zip(*[batch.column(c) for c in ("query_id", "q", "s", "least", "nbrs", "qs", "ss")], strict=True):
                own = np.frombuffer(q.as_py(), np.int8).astype(np.float64)
                others = np.frombuffer(b"".join(qs.as_py()), np.int8).reshape(-1, len(own)).astype(np.float64)
                sim = (others @ own * (np.array(ss.values, np.float64) * s.as_py())).astype(np.float32)  # whole numbers: the same in any order
                at = np.flatnonzero(sim > least.as_py())
                out.append((np.full(len(at), query.as_py()), np.array(nbrs.values)[at], sim[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "nbr", "sim"])

    one = F.array(F.struct(F.lit(-1.0).cast("float").alias("far"), F.col("start").alias("node"), F.lit(True).alias("open")))
    state = checkpoint(queries.select("query_id", "q", "s", one.alias("beam")))
    while not state.where(F.exists("beam", lambda x: x["open"])).isEmpty():
        turn = F.transform(F.slice(F.filter("beam", lambda x: x["open"]), 1, width), lambda x: x["node"])
        state = state.withColumn("turn", turn)
        least = F.when(F.size("beam") >= beam, -F.element_at("beam", -1)["far"]).otherwise(F.lit(-2.0)).cast("float")
        front = state.select("query_id", "q", "s", least.alias("least"), F.explode("turn").alias("at"))
        scored = front.join(around, "at").select("query_id", "q", "s", "least", "nbrs", "qs", "ss").mapInArrow(run, "query_id long, nbr long, sim float")
        new = scored.groupBy("query_id").agg(F.collect_set(F.struct((-F.col("sim")).alias("far"), F.col("nbr").alias("node"), F.lit(True).alias("open"))).alias("new"))
        seen = F.transform("beam", lambda x: x["node"])
        shut = F.transform("beam", lambda x: F.struct(x["far"].alias("far"), x["node"].alias("node"), (x["open"] & ~F.array_contains(F.col("turn"), x["node"])).alias("open")))
        fresh = F.filter(F.coalesce("new", F.array().cast(state.schema["beam"].dataType)), lambda x: ~F.array_contains(F.col("seen"), x["node"]))
        merged = state.join(new, "query_id", "left").withColumn("seen", seen).withColumn("beam", F.slice(F.sort_array(F.concat(shut, fresh)), 1, beam))
        state = checkpoint(merged.select("query_id", "q", "s", "beam"))
    around.unpersist()
    return state.select("query_id", F.inline("beam")).select("query_id", "node", (-F.col("far")).alias("sim"))


# -- the operator -------------------------------------------------------------------------------


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, k: int = 12, beam: int = 200, width: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of each row whose id ``every`` divides.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Rows whose vector is
    null, zero, or holds a null or non-finite component take no part, nor do rows with a null id. Of
    rows that repeat an id and its vector one counts. Fewer candidates than ``top`` are all returned; an empty
    table gives no rows. Vectors of other lengths are compared as if they ended in zeros.
    """
    rows = checkpoint(usable(vectors).distinct())
    nodes = checkpoint(rows.groupBy("v").agg(F.min("vec_id").alias("node")))
    dim = nodes.agg(F.max(F.size("v"))).first()[0]
    members = rows.join(nodes, "v").select("vec_id", "node")
    if dim is None:
        return members.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    marks = checkpoint(quantised(nodes, dim))
    graph = build_graph(marks, dim, k)
    members = checkpoint(members)
    asks = members.where(F.col("vec_id") % every == 0)
    starts = asks.select("node").distinct()  # one search for all queries with one vector
    found = search(starts.join(marks, "node").select(F.col("node").alias("query_id"), F.col("node").alias("start"), "q", "s"), graph, marks, beam, width)
    near = found.where(F.col("node") != F.col("query_id")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node"))).where(F.col("r") <= 4 * top)
    near = near.select("query_id", "node").unionByName(starts.select(F.col("node").alias("query_id"), "node"))
    # of the rows with one vector the smallest ids are enough: first within a salt, then in all
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    firsts = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= top + 1)
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = scaled(np.array(a.values)), scaled(np.array(b.values))
                n = min(len(x), len(y))
                sims.append(float(x[:n] @ y[:n]) / float(np.sqrt(x @ x) * np.sqrt(y @ y)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(sims, pa.float64())], ["query_id", "node", "score"])

    own = nodes.select(F.col("node").alias("query_id"), F.col("v").alias("a"))
    exact = near.join(nodes.select("node", F.col("v").alias("b")), "node").join(own, "query_id").select("query_id", "node", "a", "b").mapInArrow(run, "query_id long, node long, score double")
    pairs = checkpoint(exact.join(firsts.select("node", "vec_id"), "node").select(F.col("query_id").alias("start"), "vec_id", "score"))
    each = asks.select(F.col("vec_id").alias("query_id"), F.col("node").alias("start")).join(pairs, "start").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
