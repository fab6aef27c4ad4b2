"""Log lines of a table of events that is one row group."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cedarlog.plans import catalog
from cedarlog.plans import fixtures as fx

N = 2001


@pytest.fixture
def one_row_group(tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 1000, raising=False)
    events = {
        "event_id": pa.array(range(N)), "ts": pa.array([1704067200000000 + i for i in range(N)], pa.timestamp("us")),
        "user_id": pa.array([i % 1500 for i in range(N)]), "event_type": pa.array(["view"] * N),
        "value": pa.array([5.0] * N), "props": pa.array(['{"k": 7}'] * N),
    }
    pq.write_table(pa.table(events), tmp_path / "events.parquet", row_group_size=N)
    return str(tmp_path)


def test_lines_are_rendered_by_several_tasks(spark, one_row_group):
    for lines in (fx.syslog_lines(spark, one_row_group), fx.access_lines(spark, one_row_group), fx.error_lines(spark, one_row_group)):
        shares = [r["count"] for r in lines.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(shares) == N
        assert len(shares) == 3 and max(shares) < 1000


def test_a_sites_files_do_not_grow_in_number(spark, one_row_group, tmp_path, monkeypatch):
    """A stream of a file at a time has a batch for each."""
    monkeypatch.setattr(fx, "TASK_ROWS", 100)
    catalog._site_lines(spark, one_row_group, f"{tmp_path}/web")
    found = [glob.glob(f"{tmp_path}/web/logs/www{site}.example.com/part-*") for site in range(4)]
    assert all(1 <= len(files) <= 4 for files in found)
    assert sum(len(open(path).readlines()) for files in found for path in files) == N
