"""The registered queries run on the small tables; those with an SQL twin equal it."""

import glob
import os

import pytest

from sparkloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows))), "rows are distinct"


def test_found_columns(spark, sf_dir):
    want = {
        "p3_found": ["record_id", "field_name", "part_index", "kind"], "p5_found": ["record_id", "defect"], "p6_ids": ["doc_id", "ids"], "p7_found": ["item_id", "doc_id"], "p8_found": ["doc_id_a", "doc_id_b"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, sf_dir).columns == columns


def test_oracle(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.oracle_sql().items():
        assert sorted(map(tuple, queries.queries()[name](spark, sf_dir).collect())) == sorted(c.sql(sql).fetchall())


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for f in glob.glob(f"{root}/sparkloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            with open(f, encoding="utf-8") as text:
                assert "sparkloom.llm" not in text.read(), f
