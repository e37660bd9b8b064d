import duckdb
import pytest

import __spark_entry__ as entry
from fringeworks import queries as visibility

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(visibility.queries()))
def test_query_equals_its_sql(spark, tables, name):
    found = visibility.queries()[name](spark, SF)
    wanted = tables.execute(visibility.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    rows = sorted(map(repr, (tuple(r) for r in found.select(*names).collect())))
    assert rows and rows == sorted(map(repr, wanted.fetchall()))


def test_every_query_has_its_sql_and_entry_runs(spark):
    assert set(visibility.queries()) == set(visibility.oracle_sql())
    assert set(visibility.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() == 512


def test_averaging_channels_does_not_shuffle(spark):
    plan = visibility.queries()["freq_avg_data"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "props" not in plan


def test_a_field_is_not_chosen_before_rows_are_averaged(spark):
    plan = visibility.queries()["split_after_time_avg"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan.split("field_id")[1] or "min_by" in plan
