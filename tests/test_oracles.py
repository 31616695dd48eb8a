"""Every query with SQL of its own gives DuckDB's rows on the same tables."""

from pathlib import Path

import duckdb
import pytest

from scriptorium.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    assert mine and mine == rows(want.columns, want.fetchall())  # an empty result shows nothing


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_case_occurs(spark):
    """Queries whose result is a verdict or a label show each of them."""
    statuses = {r["status"] for r in catalog.QUERIES["scan_triage"](spark, SF).collect()}
    markers = [r["marker"] for r in catalog.QUERIES["printed_labels"](spark, SF).collect()]
    assert statuses == {"ok", "打不开", "需OCR"}
    assert any("印刷页码" in m for m in markers) and not all("印刷页码" in m for m in markers)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
