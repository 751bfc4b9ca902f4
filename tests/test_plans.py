"""Every query with SQL against DuckDB on the smallest tables, and the shape of the entry points."""

import sys
from pathlib import Path

import pytest

ROOT = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
pytest.importorskip("duckdb")
if not Path(ROOT).exists():
    pytest.skip("no tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from codeloom.plans import registry  # noqa: E402

CORE = {name: query for m in registry.modules() for name, query in m.QUERIES.items()}
SQL = {name: sql for m in registry.modules() for name, sql in m.SQL.items()}


def test_names():
    assert set(SQL) <= set(CORE)
    assert set(CORE) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import compare

    return compare.connect(ROOT)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    import compare

    got = CORE[name](spark, ROOT).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare.rows(got) == compare.rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
