"""Every catalog query against its SQL, over the smallest shared tables."""

import os

import pytest

from __spark_entry__ import entry
from cedarlog.plans.catalog import queries
from cedarlog.plans.oracle import oracle_sql
from tests.check_oracle import connect, difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    want = con.execute(oracle_sql()[name]).to_arrow_table()
    assert want.num_rows > 0
    assert difference(queries()[name](spark, SF_DIR).toArrow(), want) is None


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
