"""Every query with SQL equals it; every other one runs."""

import pytest
from conftest import canonical

from loamline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        got = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(got.fetchall(), names)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
