"""Every query with SQL gives the same rows as DuckDB; the others run."""

import importlib
import pkgutil

import pytest
from oracle import same

import textloom.plans
from textloom.plans import registry

for module in pkgutil.iter_modules(textloom.plans.__path__):
    importlib.import_module(f"textloom.plans.{module.name}")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLE_SQL:
        same(df, registry.ORACLE_SQL[name], sf)
    else:
        assert df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "line", "line_text"]
