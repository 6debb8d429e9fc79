"""The contract: names, SQL and the flagship query."""

import __spark_entry__ as entry
from citeloom import plans


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(plans.queries()) <= set(q) and set(sql) <= set(q) and len(plans.queries()) > 120
    assert "p3_found" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["titleid", "journal", "cites_per_year", "rank"]
    assert 0 < df.count() <= 7
