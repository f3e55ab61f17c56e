"""Every registered query of the library against its DuckDB SQL; those without SQL must at least give rows."""

import pytest

from siltstone.plans import catalogue
from tests.oracle import SF, compare

NAMES = sorted(catalogue.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.oracles()])
def test_oracle(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.oracles()])
def test_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
