"""Every registered query of the document operators against its SQL."""

import duckdb
import pytest

from notewright.plans import more, registry  # noqa: F401  more adds to registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    df, sql = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[sql.columns.index(c)] for c in cols)) for r in sql.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
