"""Every registered query against its oracle on the smallest data (see oracle_check.py for larger ones)."""

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLES:
        made = QUERIES[name](spark, SF)  # compared with brute force in the operator's own tests
        assert made.count() > 0 and len(set(made.columns)) == len(made.columns)
        return
    _, problems = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert not problems


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
