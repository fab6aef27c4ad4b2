"""The query that writes files by kind of event writes them from as many tasks as read the events."""

import os

import pytest

from cedarlog.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_no_task_writes_all_lines(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, label: str(tmp_path / label))
    got = {(r.event_type, r.status): r.lines for r in catalog.queries()["file_outcomes"](spark, str(tmp_path)).collect()}
    assert got == {(r.event_type, "read"): r["count"] for r in events.groupBy("event_type").count().collect()} | {("broken", "unreadable"): 0, ("none", "missing"): 0}
    written = [n for n in os.listdir(tmp_path / "outcomes" / "event_type=view") if n.startswith("part-")]
    assert len(written) > 1
