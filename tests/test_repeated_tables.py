"""Queries against their SQL over a table of events of which many have one time."""

import os

import pytest
from pyspark.sql import functions as F

from cedarlog.plans.catalog import queries
from cedarlog.plans.oracle import oracle_sql
from tests.check_oracle import TABLES, connect, difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF_DIR}/{name}.parquet", folder / f"{name}.parquet")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.date_trunc("hour", "ts"))
    events.toPandas().to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize(
    "name", ["store_replayed_batch", "prune_store", "reenrich_changed", "stream_follow"]
)
def test_rows_of_one_time_keep_their_order(spark, repeated, name):
    want = connect(repeated).execute(oracle_sql()[name]).to_arrow_table()
    assert difference(queries()[name](spark, repeated).toArrow(), want) is None
