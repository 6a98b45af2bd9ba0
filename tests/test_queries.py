"""Every registered query runs; those with SQL equal DuckDB's rows."""

import pytest

import __spark_entry__ as entry
from recordloom import registry
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    cols, rows = spark_rows(registry.queries()[name](spark, SF))
    if name in ORACLE:
        assert (cols, rows) == duck_rows(con, ORACLE[name])
    else:
        assert cols and len(cols) == len(set(cols))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"doc_id", "verdict", "reasons", "body_chars", "repeats"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cartesian_product(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
