"""Every registered query beside its SQL on the smallest test tables."""

import pytest

import checks
from checks import verify
from conftest import SF

checks.load_all()


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, con, name):
    ok, note = verify.compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as project

    rows = {r["case_id"]: r for r in project.entry(spark).collect()}
    assert len(rows) == 25
    assert rows[3]["score"] == 0.0 and rows[4]["score"] == 1.0
    assert set(project.oracle_sql()) <= set(project.queries())
    assert project.revenue_cases(spark, SF).count() == len(verify.connect(SF).execute(project.REVENUE_SQL).fetchall())


def test_statements_of_one_small_file_are_parsed_on_all_cores(spark):
    parsed = checks.QUERIES["order_key_positions"](spark, SF)
    assert parsed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
