"""Stored queries give their twin's rows on suppliers of larger tables: keys that outgrow a word with what is added to them, nations that aren't there."""

import duckdb
import pytest

from tessera.plans import stored

SF = "/root/testdata/sf0.001"
LARGE = [1, 1_615, 1_616, 5_999, 59_999, 2**31 - 1]
# the twin of stored_values casts keys to INTEGER, so it has none of these
LARGER = [2**31, 2**40 + 3]


def _folder(tmp_path, keys):
    """Tables of ``keys`` as suppliers, the last of them without a nation."""
    rows = ", ".join(f"({k}, 'Supplier#{k}', {99 if k == keys[-1] else at % 25}, {100.25 - 50 * at})" for at, k in enumerate(keys))
    c = duckdb.connect()
    c.sql(f"COPY (SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INTEGER AS s_nationkey, s_acctbal::DOUBLE AS s_acctbal FROM (VALUES {rows}) t(s_suppkey, s_name, s_nationkey, s_acctbal)) TO '{tmp_path}/supplier.parquet'")
    c.sql(f"COPY (SELECT * FROM '{SF}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    for t in ("supplier", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return c


def _same(spark, duck, folder, name):
    df = stored.QUERIES[name](spark, str(folder))
    twin = duck.sql(stored.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    rows = lambda columns, rows: sorted(repr(tuple(r[columns.index(k)] for k in sorted(columns))) for r in rows)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())


def test_values_of_large_keys(spark, tmp_path):
    _same(spark, _folder(tmp_path, LARGE), tmp_path, "stored_values")


@pytest.mark.parametrize(
    "name",
    [
        "stored_container",
        "stored_deref",
        "stored_names",
        "stored_null_pointers",
        "stored_objects",
        "stored_patch",
        "stored_preload",
        "stored_reach",
    ],
)
def test_larger_keys(spark, tmp_path, name):
    _same(spark, _folder(tmp_path, LARGE + LARGER), tmp_path, name)


def _odd(tmp_path):
    """Suppliers without a name, without a balance or without either, and with balances that aren't finite."""
    duck = _folder(tmp_path, LARGE)
    name = "CASE WHEN s_suppkey NOT IN (1, 1616) THEN s_name END"
    balance = "CASE s_suppkey WHEN 1 THEN -5 WHEN 1615 THEN NULL WHEN 1616 THEN NULL WHEN 5999 THEN '-Infinity'::DOUBLE WHEN 59999 THEN 'NaN'::DOUBLE ELSE s_acctbal END"
    duck.sql(f"CREATE TABLE given AS SELECT s_suppkey, {name} AS s_name, s_nationkey, {balance} AS s_acctbal FROM supplier")
    duck.sql(f"COPY given TO '{tmp_path}/supplier.parquet'")
    return duck


@pytest.mark.parametrize(
    "name",
    [
        "stored_container",
        "stored_deref",
        "stored_names",
        "stored_null_pointers",
        "stored_objects",
        "stored_patch",
        "stored_preload",
        "stored_reach",
        "stored_values",
    ],
)
def test_missing_names_and_odd_balances(spark, tmp_path, name):
    _same(spark, _odd(tmp_path), tmp_path, name)


def test_patch_of_names_with_quotes(spark, tmp_path):
    duck = _folder(tmp_path, LARGE)
    duck.sql("CREATE TABLE given AS SELECT s_suppkey, 'a \"b\\\\c\" d\\' AS s_name, s_nationkey, -1.5::DOUBLE AS s_acctbal FROM supplier")
    duck.sql(f"COPY given TO '{tmp_path}/supplier.parquet'")
    _same(spark, duck, tmp_path, "stored_patch")


def _keyless(tmp_path):
    """Suppliers without a key, nations without a key, a name or a region, and regions beyond the usual five."""
    duck = _folder(tmp_path, LARGE)
    duck.sql(
        "CREATE TABLE given AS SELECT * FROM supplier UNION ALL SELECT NULL, 'a', 3, -1.5 UNION ALL SELECT NULL, 'b', 8, 2.5 UNION ALL SELECT NULL, NULL, NULL, -2.5"
        " UNION ALL SELECT 6000 + n, 'n' || n, n, 1.5 FROM (VALUES (8), (11), (12), (27), (9999)) t(n)"
    )
    nations = [(8, None, 3), (11, None, 1), (1, None, 1), (12, "N", None), (14, None, None), (None, "without key", 2), (27, "far", 7), (9899, "farther", -3), (9999, "farthest", 2**31 - 1)]
    duck.sql("CREATE TABLE lands AS SELECT * FROM nation WHERE n_nationkey NOT IN (8, 11, 1, 12, 14)")
    duck.executemany("INSERT INTO lands VALUES (?, ?, ?)", nations)
    duck.sql(f"COPY given TO '{tmp_path}/supplier.parquet'")
    duck.sql(f"COPY lands TO '{tmp_path}/nation.parquet'")
    return duck


@pytest.mark.parametrize(
    "name",
    [
        "stored_container",
        "stored_deref",
        "stored_names",
        "stored_null_pointers",
        "stored_objects",
        "stored_packers",
        "stored_patch",
        "stored_preload",
        "stored_reach",
        "stored_values",
    ],
)
def test_missing_keys_names_and_regions(spark, tmp_path, name):
    _same(spark, _keyless(tmp_path), tmp_path, name)
