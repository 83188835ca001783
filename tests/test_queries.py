"""Every registered query of the table operators against its SQL."""

import pytest

from compare import duck, rows
from conftest import DATA
from shardloom.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    folder = f"{DATA}/sf0.001"
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck(folder, ORACLE_SQL[name]))
    else:
        assert len(got)


def test_sorted_merge_is_whole_and_in_order(spark):
    folder = f"{DATA}/sf0.001"
    got = QUERIES["sorted_merge_all"](spark, folder).toPandas()
    want = duck(folder, ORACLE_SQL["sorted_merge_all"])
    assert len(got) > 500 and got.o_orderkey.tolist() == want.o_orderkey.tolist() and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
