"""Every query with an oracle, on the smallest tables; ``tests/oracle_check.py`` takes larger ones."""

import pytest

import __spark_entry__ as entry
import oracle_check

from flightline.plans import oracles


@pytest.mark.parametrize("name", sorted(oracles.build()))
def test_query_equals_oracle(spark, sf_dir, name):
    con = oracle_check.connect(sf_dir)
    text, ok = oracle_check.compare(
        spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert ok, text


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not entry.entry(spark).isEmpty()
