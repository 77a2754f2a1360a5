import duckdb
import pytest

from tidemark.plans import registry, relational

NAN = float("nan")
ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double"


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def by_sql(name, orders, table="orders"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{orders}')")
    return con.execute(registry.oracle_sql()[name]).fetchall()


def test_qcut_equals_its_sql(spark):
    got = registry.queries()["f15_qcut"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"o_orderkey": "bigint", "q": "int"}
    assert sorted(map(tuple, got.collect())) == sorted(by_sql("f15_qcut", "/root/testdata/sf0.001/orders.parquet"))


@pytest.mark.parametrize("sizes", [(2, 3, 5, 6), (11, 26, 101)])
def test_qcut_of_nulls_ties_and_small_groups(spark, tmp_path, sizes):
    prices = [None, 3.0, 3.0, NAN, -1.0, 0.0, 7.5]
    rows = [(1000 * g + i, None if g == 0 else f"s{g}", prices[(i * 5 + g) % 7]) for g, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["f15_qcut"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(by_sql("f15_qcut", f"{tmp_path}/orders.parquet/*.parquet"))


def test_qcut_of_a_group_of_one(spark, tmp_path):
    # Its SQL fails there: 0 / 0 is no INT.
    spark.createDataFrame([(1, "a", 2.0)], ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in registry.queries()["f15_qcut"](spark, str(tmp_path)).collect()] == [(1, 1)]


def parts(spark, path, n=600):
    """Parts with large groups, null brands, types, sizes and keys, and repeated keys."""
    some = lambda v, i, k: None if i % k == 0 else v
    rows = [(some(n - i // 2, i, 13), f"w{i % 4} x", some(f"b{i % 3}", i, 17), some(f"t{i % 2}", i, 19), some(i % 5, i, 23)) for i in range(1, n)]
    spark.createDataFrame(rows, PART).write.parquet(f"{path}/part.parquet")
    return f"{path}/part.parquet/*.parquet"


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_self_anti_sums_groups_instead_of_pairs(spark, tmp_path):
    files = parts(spark, tmp_path)
    got = registry.queries()["d07_self_anti_inequality"](spark, str(tmp_path))
    assert in_order(got.collect()) == in_order(by_sql("d07_self_anti_inequality", files, "part"))
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sibling_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "TILE", 7)
    monkeypatch.setattr(relational, "PAIRS_A_TASK", 1_000)
    files = parts(spark, tmp_path)
    want = in_order(by_sql("d19_sibling_equi", files, "part"))
    got = registry.queries()["d19_sibling_equi"](spark, str(tmp_path))
    # Rows of few bytes: without a number of their own all pairs were made in one task.
    assert got.rdd.getNumPartitions() >= len(want) / 1_000 > 4
    assert in_order(got.collect()) == want
