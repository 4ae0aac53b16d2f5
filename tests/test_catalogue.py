import os

import pytest

from corpusloom.plans import catalogue
from tests.compare import DATA, database, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() >= 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    a, b = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert a.schema == b.schema and a.count() > 0
