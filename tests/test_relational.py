"""Relational operators on shapes that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R


def test_closure_follows_a_chain_to_its_end(spark):
    edges = spark.range(70).selectExpr("id AS src", "id + 1 AS dst").unionByName(spark.createDataFrame([(70, 3)], "src long, dst long"))
    got = {(r["node"], r["depth"]) for r in R.closure(edges.coalesce(1), spark.createDataFrame([(0,)], "seed long")).collect()}
    assert got == {(k, k) for k in range(71)}


def test_parents_at_any_level_or_an_error(spark):
    rows = spark.range(80).select(F.lit(1).alias("k"), "id", F.col("id").alias("level"))
    deep = R.parent_of_level(rows, "k", "id", "level", 79).collect()
    assert [r["parent"] for r in sorted(deep, key=lambda r: r["id"])] == [None, *range(79)]
    assert [r["parent"] for r in R.parent_of_level(rows.where("id <= 64"), "k", "id", "level").orderBy("id").collect()] == [None, *range(64)]
    with pytest.raises(Exception, match="level above 64"):
        R.parent_of_level(rows, "k", "id", "level").collect()
