"""Queries against their SQL on copies of tables with shifted keys, and what must not grow with them."""

import pytest

import __spark_entry__ as driver

TABLES = "/root/testdata/sf0.01"


def copies(tmp_path, n, shifts):
    """A folder with the tables n times; shifts: table -> key -> shift of a copy."""
    import duckdb

    for t, keys in shifts.items():
        columns = ", ".join(f"{k} + i * {v} as {k}" for k, v in keys.items())
        duckdb.sql(f"copy (select * replace ({columns}) from read_parquet('{TABLES}/{t}.parquet'), range({n}) r(i)) to '{tmp_path}/{t}.parquet' (format parquet)")
    return str(tmp_path)


def as_sql(spark, name, folder, tables):
    """Sorted rows of a query and of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = driver.queries()[name](spark, folder)
    result = con.execute(driver.oracle_sql()[name])
    place = [[c[0] for c in result.description].index(c) for c in got.columns]
    return sorted(str(tuple(r)) for r in got.collect()), sorted(str(tuple(r[i] for i in place)) for r in result.fetchall())


@pytest.mark.parametrize("name, claims", [("lease_claims", 1000), ("all_lease_claims", 1500)])
def test_claims_of_more_than_a_thousand_workers(spark, tmp_path, name, claims):
    folder = copies(tmp_path, 30, {"orders": {"o_orderkey": 15_000}, "supplier": {"s_suppkey": 100}})
    got, want = as_sql(spark, name, folder, ("orders", "supplier"))
    assert got == want and len(got) == claims


def test_imports_without_items(spark, tmp_path):
    """Ten customers more than the orders know."""
    folder = copies(tmp_path, 2, {"customer": {"c_custkey": 10}, "orders": {"o_orderkey": 15_000}})
    import duckdb

    duckdb.sql(f"copy (select distinct on (c_custkey) * from read_parquet('{folder}/customer.parquet')) to '{folder}/once.parquet' (format parquet)")
    (tmp_path / "once.parquet").rename(tmp_path / "customer.parquet")
    got, want = as_sql(spark, "saved_imports", folder, ("orders", "customer"))
    assert got == want and sum(r.endswith(", 0, None)") for r in got) >= 10


@pytest.mark.parametrize("name", ["shown_reviews", "extract_aspects", "error_rows", "compare_products"])
def test_mentions_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch, name):
    """A task's rows do not grow with the table: no more than a hundredth of these rows, each side of the join."""
    from tessera import session

    monkeypatch.setattr(session, "ROWS_OF_TASK", 600)
    folder = copies(tmp_path, 1, {"orders": {"o_orderkey": 0}, "lineitem": {"l_orderkey": 0}})
    plan = driver.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and "], 100" in plan
    got, want = as_sql(spark, name, folder, ("orders", "lineitem"))
    assert got == want
