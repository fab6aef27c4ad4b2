import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cedarlog.operators.geo import prepare_ranges
from cedarlog.operators.rules import SSHD
from cedarlog.plans.fixtures import raw_ranges
from cedarlog.sources.files import WebSet
from cedarlog.sources.follow import LogFollowReader, LogFollowSource, last_line_end, resume_offset, shares
from cedarlog.sources.store import LogStore
from cedarlog.streaming.follow import IdReader, follow
from cedarlog.streaming.ingest import follow_sets, stream_lines, stream_syslog, stream_web_logs
from tests.test_store import make_rows
from tests.test_syslog import line

ACCESS = '81.2.69.142 - - [15/Jul/2026:12:00:00 +0000] "GET /{} HTTP/1.1" 200 12 "-" "curl/8"\n'


def test_syslog_stream_survives_bad_lines_and_restarts(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = LogStore(spark, str(tmp_path / "store"))

    def run():
        stream_syslog(
            stream_lines(spark, str(landing), max_files=1), store, str(tmp_path / "cp"), SSHD,
            rejects_path=str(tmp_path / "rejects"), available_now=True,
        ).awaitTermination()
        return sorted((r.id, r.host) for r in store.read("syslog").collect())

    (landing / "a.json").write_text(line(HOST="a") + "\n\n{bad\n" + line(HOST="b") + "\n")
    assert run() == [(1, "a"), (2, "b")]
    (landing / "b.json").write_text(line(HOST="c") + "\n")
    assert run() == [(1, "a"), (2, "b"), (3, "c")]
    assert run() == [(1, "a"), (2, "b"), (3, "c")]
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["{bad"]
    assert all("ssh_user" in json.loads(r.raw)["enriched"] for r in store.read("syslog").collect())


def test_follow_store(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append("syslog", make_rows(spark, 0, 10), order_by=["r_isodate"])
    seen = []

    def run():
        follow(
            store, "syslog", lambda rows, _: seen.append([r.id for r in rows.collect()]), str(tmp_path / "cp"),
            last=5, available_now=True, clock=lambda: dt.datetime(2024, 1, 31), host="h1", since="9h",
        ).awaitTermination()

    run()
    assert seen == [[6, 9]]
    store.append("syslog", make_rows(spark, 0, 10), order_by=["r_isodate"])
    run()
    assert seen == [[6, 9], [13, 16, 19]]


def test_follow_shows_each_row_once(spark, tmp_path):
    """Days of a batch, rewrites and restarts in between do not matter."""
    store = LogStore(spark, str(tmp_path / "store"))
    seen = []

    def run():
        follow(
            store, "syslog", lambda rows, _: seen.extend(r.id for r in rows.collect()), str(tmp_path / "cp"),
            available_now=True,
        ).awaitTermination()

    for n in range(3):
        store.append("syslog", make_rows(spark, 0, 60), ("w", n), order_by=["r_isodate"])
        run()
        store.reenrich(SSHD, everything=True)
        store.compact("syslog", "2024-01-30")
        run()
    assert sorted(seen) == list(range(1, 181))


def test_follow_waits_for_a_batch_that_is_not_whole(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for n in range(3):
        store.append("syslog", make_rows(spark, 0, 10), ("w", n), order_by=["r_isodate"])
    reader = IdReader(store.data_path("syslog"), 0, 0)
    (mark,) = store._names(f"{store.data_path('syslog')}/ids=*/batch=w-1/_SUCCESS")
    store._delete(mark)
    assert reader.latestOffset() == {"last": 10}
    store.append("syslog", make_rows(spark, 0, 10), ("w", 1), order_by=["r_isodate"])
    assert reader.latestOffset() == {"last": 30}
    store.compact("syslog", "2024-02-01")
    assert IdReader(store.data_path("syslog"), 10, 0).latestOffset() == {"last": 30}
    few = IdReader(store.data_path("syslog"), 10, 15)
    assert few.latestOffset() == {"last": 25}
    few.partitions({"last": 10}, {"last": 25})
    assert few.latestOffset() == {"last": 30} == few.latestOffset()
    assert IdReader(str(tmp_path / "none"), 7, 0).latestOffset() == {"last": 7}


def test_a_poll_looks_into_new_folders_only(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    for n in range(4):
        store.append("syslog", make_rows(spark, 0, 5), ("w", n))
    looked = []
    whole = IdReader._whole
    monkeypatch.setattr(IdReader, "_whole", lambda self, folder: looked.append(folder) or whole(self, folder))
    reader = IdReader(store.data_path("syslog"), 15, 0)
    assert reader.latestOffset() == {"last": 20} and len(looked) == 1
    reader.partitions({"last": 15}, {"last": 20})
    assert reader.latestOffset() == {"last": 20} and len(looked) == 1


def test_last_line_end(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"one\ntwo\npart")
    assert last_line_end(str(path), 12, 0) == 8
    assert last_line_end(str(path), 12, 8) == 8
    path.write_bytes(b"x" * 200_000 + b"\n" + b"y" * 100_000)
    assert last_line_end(str(path), 300_001, 0) == 200_001


def test_resume_offset():
    known = {"inode": 5, "offset": 10}
    assert resume_offset(known, 5, 10) == 10
    assert resume_offset(known, 5, 9) == 0
    assert resume_offset(known, 6, 99) == 0
    assert resume_offset(None, 6, 99) is None


def read_all(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += batch.to_pydict()["value"]
    return out


def test_slices_cover_every_line_once(tmp_path):
    path = tmp_path / "f.log"
    texts = [f"line {'x' * (i * 7 % 40)} {i}" for i in range(300)]
    path.write_text("\n".join(texts) + "\nunfinished")
    for chunk in (1, 13, 64, 100_000):
        reader = LogFollowReader({"path": str(tmp_path / "*.log"), "startingOffset": "earliest", "chunkBytes": chunk})
        assert read_all(reader, reader.initialOffset(), reader.latestOffset()) == texts


def test_offsets_over_growth_rotation_and_truncation(tmp_path):
    path = tmp_path / "f.log"
    path.write_text("old\n")
    reader = LogFollowReader({"path": str(tmp_path / "*.log")})
    at = reader.initialOffset()

    def step():
        nonlocal at
        end = reader.latestOffset()
        got, at = read_all(reader, at, end), end
        return got

    assert step() == []
    with open(path, "a") as handle:
        handle.write("new\npar")
    assert step() == ["new"]
    with open(path, "a") as handle:
        handle.write("tial\n")
    assert step() == ["partial"]
    os.rename(path, tmp_path / "f.1")
    path.write_text("rotated\n")
    (tmp_path / "g.log").write_text("fresh\n")
    assert step() == ["rotated", "fresh"]
    path.write_text("cut\n")
    assert step() == ["cut"]
    assert step() == []


def test_rotation_loses_no_line(tmp_path):
    path = tmp_path / "f.log"
    path.write_text("one\n")
    reader = LogFollowReader({"path": str(tmp_path / "*.log"), "startingOffset": "earliest"})
    at = reader.initialOffset()
    assert at[str(path)]["offset"] == 0
    end = reader.latestOffset()
    # between planning and reading: more lines, then a rotation
    with open(path, "a") as handle:
        handle.write("two\n")
    os.rename(path, tmp_path / "f.log.1")
    path.write_text("three\n")
    assert read_all(reader, at, end) == ["one"]
    later = reader.latestOffset()
    assert read_all(reader, end, later) == ["two", "three"]
    os.remove(tmp_path / "f.log.1")
    with pytest.raises(FileNotFoundError):
        read_all(reader, end, later)


def steps(reader, at):
    """The batches until nothing new is there: (lines, bytes of a batch)."""
    while (end := reader.latestOffset()) != at:
        parts = reader.partitions(at, end)
        yield [line for part in parts for batch in reader.read(part) for line in batch.to_pydict()["value"]], sum(p.end - p.start for p in parts)
        at = end


def test_shares_of_a_batch():
    assert shares({"a": 5, "b": 100, "c": 100}, 65) == {"a": 5, "b": 30, "c": 30}
    assert shares({"a": 5, "b": 9}, 50) == {"a": 5, "b": 9}
    assert shares({"a": 5, "b": 9, "c": 7}, 1) == {"a": 1, "b": 1, "c": 1}
    assert shares({}, 4) == {}


@pytest.mark.parametrize("most", [1, 40, 700, 100_000])
def test_batches_are_bounded(tmp_path, most):
    texts = {n: [f"{n} line {'x' * (i * 13 % 60)} {i}" for i in range(60 * k + 1)] for k, n in enumerate("abc")}
    for n, rows in texts.items():
        (tmp_path / f"{n}.log").write_text("\n".join(rows) + "\nunfinished")
    reader = LogFollowReader({"path": str(tmp_path / "*.log"), "startingOffset": "earliest", "maxBytesPerBatch": most})
    got, sizes = zip(*steps(reader, {str(tmp_path / f"{n}.log"): {"inode": os.stat(tmp_path / f"{n}.log").st_ino, "offset": 0} for n in "abc"}), strict=True)
    assert max(sizes) <= most + 3 * 80
    assert len(sizes) >= sum(len("\n".join(rows)) for rows in texts.values()) / (most + 3 * 80)
    seen = [line for lines in got for line in lines]
    for n, rows in texts.items():
        assert [line for line in seen if line.startswith(n)] == rows


def test_a_bounded_rest_of_a_rotated_file_comes_first(tmp_path):
    path = tmp_path / "f.log"
    old, new = [f"old {i}" for i in range(50)], [f"new {i}" for i in range(50)]
    path.write_text("\n".join(old) + "\n")
    reader = LogFollowReader({"path": str(path), "startingOffset": "earliest", "maxBytesPerBatch": 100})
    at = reader.initialOffset()
    end = reader.latestOffset()
    first = read_all(reader, at, end)
    os.rename(path, tmp_path / "f.log.1")
    path.write_text("\n".join(new) + "\n")
    rest = [line for lines, _ in steps(reader, end) for line in lines]
    assert 0 < len(first) < 50 and first + rest == old + new


def test_a_backlog_over_restarts(spark, tmp_path):
    """Several bounded batches, stopped in between: each line comes once."""
    spark.dataSource.register(LogFollowSource)
    texts = [f"line {i} {'y' * (i % 50)}" for i in range(3000)]
    (tmp_path / "f.log").write_text("\n".join(texts) + "\n")
    seen = {}  # by number: a batch that was stopped before its commit comes again

    def write(batch, number):
        seen[number] = [r.value for r in batch.collect()]

    frame = spark.readStream.format("logfollow").options(path=str(tmp_path / "f.log"), startingOffset="earliest", maxBytesPerBatch=20_000).load()
    for wanted in (2, 4, 0):
        query = frame.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(write).start()
        while query.isActive and len(seen) < wanted:
            time.sleep(0.02)
        if not wanted:
            query.processAllAvailable()
        query.stop()
    assert [line for number in sorted(seen) for line in seen[number]] == texts
    assert len(seen) >= 5 and max(sum(len(r) + 1 for r in rows) for rows in seen.values()) <= 20_000


def test_damaged_bytes_reach_the_reject(spark, tmp_path):
    spark.dataSource.register(LogFollowSource)
    (tmp_path / "f.log").write_bytes(b"\xff\xfe{}\n")
    lines = spark.readStream.format("logfollow").options(path=str(tmp_path / "*.log"), startingOffset="earliest").load()
    store = LogStore(spark, str(tmp_path / "store"))
    query = stream_syslog(lines, store, str(tmp_path / "cp"), rejects_path=str(tmp_path / "rejects"))
    query.processAllAvailable()
    query.stop()
    assert [r.reject_reason for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["not valid UTF-8"]


def test_web_logs_follow_growing_files(spark, tmp_path):
    spark.dataSource.register(LogFollowSource)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "www.a.org:443-access.log").write_text(ACCESS.format("old"))
    web_set = WebSet("site", access=f"{logs}/*-access.log")
    store = LogStore(spark, str(tmp_path / "store"))
    table = prepare_ranges(raw_ranges(spark)).cache()
    frames = follow_sets(spark, [web_set], {"startingOffset": "earliest"})

    def run():
        ((_, kind), frame), = frames.items()
        query = stream_web_logs(
            frame, store, str(tmp_path / "cp"), web_set, kind, "web01", ranges=table, flush_seconds=1
        )
        query.processAllAvailable()
        query.stop()
        return [(r.request, r.vhost, r.vhost_port) for r in store.read("http_access").collect()]

    assert run() == [("/old", "www.a.org", 443)]
    with open(logs / "www.a.org:443-access.log", "a") as handle:
        handle.write(ACCESS.format("new") + "garbage\n" + ACCESS.format("half")[:-1])
    (logs / "b-access.log").write_text(ACCESS.format("other"))
    run()
    rows = store.read("http_access")
    assert sorted((r.request or "-", r.vhost) for r in rows.collect()) == [
        ("-", "www.a.org"), ("/new", "www.a.org"), ("/old", "www.a.org"), ("/other", "b"),
    ]
    assert rows.filter(F.col("raw").contains('"iso_code":"GB"')).count() == 3
