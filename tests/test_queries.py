"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
import check


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query(spark, duck, sf_dir, name):
    problem = check.compare(spark, duck, sf_dir, name)
    assert problem in ("", "no rows" if name == "pseudo_label" else "")


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    assert len(spark_entry.queries()) >= 64


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
