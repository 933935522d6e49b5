"""Every registered panel query against its SQL, and entry()."""

import pytest

import __spark_entry__
from loomspan.plans import queries as panel

from .compare import differ, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(panel.oracle_sql()))
def test_query(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert differ(got, con.execute(panel.oracle_sql()[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(panel.queries()) - set(panel.oracle_sql()) - {"j5_tree_walk_forward", "j1_full_log", "j7_tuned_trees"}))
def test_rows(spark, name):
    assert panel.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
