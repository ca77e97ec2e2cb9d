"""Every query of the engine agrees with its SQL on the given tables."""

import duckdb
import pytest

from mediaspan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.SQL:
        assert len(ours) > 0
        return
    theirs = duck.sql(registry.SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    columns = ", ".join(sorted(ours.column_names))
    duck.register("ours", ours)
    duck.register("theirs", theirs)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
