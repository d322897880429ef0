"""Every query with an SQL twin gives the twin's rows."""

import glob
import os

import pytest

from sparkloom.plans import catalogue
from sparkloom.sources import sinks

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _value(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, oracle, sf_dir, name):
    mine = catalogue.queries()[name](spark, sf_dir)
    theirs = oracle.sql(catalogue.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in mine.columns]
    rows = sorted(tuple(map(_value, r)) for r in mine.collect())
    assert rows == sorted(tuple(_value(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", ["f12", "f13", "i04", "i05"])
def test_any_number_of_files(spark, oracle, sf_dir, monkeypatch, name):
    """Files of more rows than a report may have."""
    monkeypatch.setattr(sinks, "MOST_REPORT_ROWS", 5)
    test_equals_oracle(spark, oracle, sf_dir, name)


def test_no_cartesian_product(spark, sf_dir):
    for name, q in catalogue.queries().items():
        if name.startswith("q"):
            plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.queries()["q28"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(p_brand" in plan and "p_retailprice" not in plan
