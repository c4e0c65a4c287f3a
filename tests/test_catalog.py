"""Each query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from driftlog.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    def shown(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(shown, r)) for r in frame.astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.sql(f"create view events as select * from '{SF}/events.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_owner_plan_has_no_nested_loop(spark):
    plan = catalog.queries()["ring_owner"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan.split("Physical Plan")[-1] and "NestedLoop" not in plan.split("Physical Plan")[-1]
