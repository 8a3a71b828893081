"""Every registered query against its SQL, and forms of one query against each other."""

import pytest

from asterism import oracles, registry

from .conftest import DATA
from .oracle import connect, same


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_against_sql(spark, data, duck, name):
    same(registry.queries()[name](spark, data), duck, oracles.SQL[name])


@pytest.mark.parametrize("a, b", [("ssb_q21", "plan_ir_q21"), ("ssb_q31", "plan_ir_q31"), ("ssb_q22", "sql_q22"), ("ssb_q33", "sql_q33")])
def test_forms_agree(spark, data, a, b):
    q = registry.queries()
    assert q[a](spark, data).collect() == q[b](spark, data).collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).schema.names == ["lo_revenue", "d_year", "p_brand1"]
    assert set(e.oracle_sql()) <= set(e.queries())
