"""Operators of the object graph as joins, windows and aggregates over DataFrames."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _as_list(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def last_wins(df: DataFrame, key: str | list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row (E04-E06, D14): one aggregate that combines on the map side."""
    keys = _as_list(key)
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("__v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__v")[v].alias(v) for v in values])


def first_wins(df: DataFrame, key: str | list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of each key's first row in ``order``."""
    keys = _as_list(key)
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("__v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__v")[v].alias(v) for v in values])


def slice_rows(owners: DataFrame, items: DataFrame, key: str, start: str, size: str, pos: str, count: str) -> DataFrame:
    """Rows of each owner's range of positions (D05): an equi-join on ``key`` with the range as a residual.

    Ranges that are empty, negative or reach past ``count`` give nothing.
    """
    valid = (F.col(start) >= 0) & (F.col(size) > 0) & (F.col(start) + F.col(size) <= F.col(count))
    within = (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(start) + F.col(size))
    return owners.where(valid).join(items, key).where(within)


def asof(left: DataFrame, right: DataFrame, key: str | list[str], at: str, values: list[str], tie: str) -> DataFrame:
    """Left rows with ``values`` of the last right row not after them (B08); without one, null.

    Both sides are merged and one window carries the last right row forward, so the join never
    makes pairs; at one point right rows come first, in the order of ``tie``.
    """
    keys = _as_list(key)
    extra = [c for c in left.columns if c not in (*keys, at)]
    l_rows = left.select(*keys, at, F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("__tie"), F.struct(*[F.col(c) for c in extra]).alias("__own"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__v"))
    r_rows = right.select(*keys, at, F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(l_rows.schema["__own"].dataType).alias("__own"), F.struct(*values).alias("__v"))
    order = Window.partitionBy(*keys).orderBy(at, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = l_rows.unionByName(r_rows).withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return carried.select(*keys, at, *[F.col("__own")[c].alias(c) for c in extra], *[F.col("__v")[v].alias(v) for v in values])


def resolve_ranked(requests: DataFrame, request: str, candidates: list[tuple[DataFrame, Column]], targets: list[str], id_: str) -> DataFrame:
    """The best match of each request (A20, D08, D11): candidate tables in order of rank, each with its key.

    Every rank is an equi-join; the first rank that matches wins, then the smallest first target.
    """
    found = None
    for rank, (table, key) in enumerate(candidates, 1):
        part = requests.join(table.withColumn("__key", key), F.col(request) == F.col("__key")).select(id_, F.lit(rank).alias("rank"), *targets)
        found = part if found is None else found.unionByName(part)
    return first_wins(found, id_, [F.col("rank"), *[F.col(t) for t in targets]], ["rank", *targets])


def contiguous_prefix(df: DataFrame, key: str, n: str) -> DataFrame:
    """Rows whose numbers follow from the key's first without a gap."""
    w = Window.partitionBy(key).orderBy(n)
    first = F.min(n).over(Window.partitionBy(key))
    return df.withColumn("__gap", F.col(n) - first - F.row_number().over(w)).where(F.col("__gap") == -1).drop("__gap")


def offsets(df: DataFrame, key: str | list[str], order: str, size: Column, name: str = "offset") -> DataFrame:
    """Running start of each entry (E13, B07): the sum of the sizes before it."""
    w = Window.partitionBy(*_as_list(key)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def parent_of_level(df: DataFrame, key: str, order: str, level: str, deepest: int = 64) -> DataFrame:
    """``parent``: the last earlier row one level up, or null.

    The window keeps the last row of each level in a small map, so each row is read once. A level above
    ``deepest``, whose parent the map doesn't hold, is an error.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.array(*[F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in range(deepest)])
    return df.withColumn("parent", F.when(F.col(level) > deepest, F.raise_error(F.lit(f"a level above {deepest} has no parent here"))).when(F.col(level) > 0, F.try_element_at(lasts, F.col(level).cast("int"))))


def priority(column: Column, order: list[str], otherwise: int = 999) -> Column:
    """Place of a value in a list of names."""
    table = F.create_map(*[x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(F.try_element_at(table, column), F.lit(otherwise))


def upsert(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the patched values where a patch has the key."""
    new = patch.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = base.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, node, depth`` of all that each seed reaches (F04), cycles included.

    ``edges`` has ``src, dst``; ``seeds`` has ``seed``. Breadth first: each round joins the frontier with
    the edges and leaves out what was seen, until nothing is new: as many rounds as the longest way is deep. Rounds
    are checkpointed, in the shared folder if one is set.
    """
    kept = cut(edges.sparkSession)
    seen = kept(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    front = seen
    for depth in count(1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = kept(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = kept(seen.unionByName(front))


def cut(spark: SparkSession):
    """A function that cuts a DataFrame's lineage by a checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Only in local mode, where there is one machine, a temporary folder stands in for a missing setting.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:  # rounds that aren't cut double the plan each time
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return lambda df: df.checkpoint()
