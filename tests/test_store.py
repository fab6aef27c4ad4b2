import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cedarlog.operators.rules import SSHD, Field, Rule
from cedarlog.sources import store as store_module
from cedarlog.sources.store import LogStore

AS_OF = dt.datetime(2024, 1, 31)


def make_rows(spark, first, count, program="sshd", step="1 hour"):
    """One row per hour going back from AS_OF."""
    return spark.range(first, first + count).select(
        *(F.expr(f"timestamp'2024-01-31 00:00:00Z' - id * interval {step}").alias(c) for c in ("c_isodate", "r_isodate", "s_isodate")),
        F.lit("auth").alias("facility"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("host"),
        F.lit("r").alias("host_from"),
        F.lit(None).cast("bigint").alias("pid"),
        F.lit("info").alias("priority"),
        F.lit(program).alias("program"),
        F.lit("10.0.0.1").alias("sourceip"),
        F.format_string(
            '{"MESSAGE":"Failed password for u%d from 10.0.0.%d port %d ssh2","PROGRAM":"%s","enriched":{"k":%d}}',
            "id", F.col("id") % 250, F.col("id") + 1000, F.lit(program), F.col("id") % 10,
        ).alias("raw"),
    )


@pytest.fixture
def store(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append("syslog", make_rows(spark, 100, 100), order_by=["r_isodate"])
    store.append("syslog", make_rows(spark, 0, 100, "cron"), order_by=["r_isodate"])
    return store


def ids(df):
    return [r.id for r in df.collect()]


def test_append_numbers_on(spark, store):
    assert store.max_id("syslog") == 200
    got = store.read("syslog").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 201))
    assert [r.r_isodate for r in got] == sorted(r.r_isodate for r in got)
    assert {r.id_base for r in got} == {0, 100}
    assert store.max_id("http_error") == 0 and store.read("http_error").count() == 0


def test_repeated_batch_changes_nothing(spark, store):
    for _ in range(2):
        assert store.append("syslog", make_rows(spark, 0, 30), ("w", 4), ["r_isodate"]) == 230
    assert store.append("syslog", make_rows(spark, 0, 10), ("w", 5), ["r_isodate"]) == 240
    assert store.append("syslog", make_rows(spark, 0, 30), ("w", 4), ["r_isodate"]) == 240
    assert sorted(ids(store.read("syslog"))) == list(range(1, 241))


@pytest.mark.parametrize("asc", [False, True])
@pytest.mark.parametrize("step", [7, 1 << 20])
@pytest.mark.parametrize("filters", [{"program": "sshd"}, {"field": "k=3"}, {"host": "nope"}])
def test_newest_equals_a_full_sort(store, filters, step, asc):
    everything = store.matching("syslog", **filters).orderBy(F.col("id").asc() if asc else F.col("id").desc())
    got = ids(store.newest("syslog", 12, asc=asc, first_step=step, **filters))
    assert got == ids(everything)[:12]


def test_tail_and_cursor(store):
    assert ids(store.tail("syslog", 3)) == [198, 199, 200]
    assert ids(store.after("syslog", 150, host="h1"))[0] > 150
    assert len(ids(store.after("syslog", 95))) == 105


def test_window_prunes_days(store):
    frame = store.matching("syslog", since="30h", column="r_isodate", as_of=AS_OF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert frame.count() == 31
    assert store.matching("syslog", since="30h", as_of=AS_OF).count() == 31


def test_register(spark, store):
    store.register()
    got = spark.sql("SELECT count(*) AS n FROM syslog WHERE program = 'sshd' AND host = 'h1'").first().n
    assert got == store.matching("syslog", program="sshd", host="h1").count() > 0


def test_promote(spark, store):
    before = {r.id: r.raw for r in store.read("syslog").collect()}
    store.promote("syslog", ["k"])
    store.append("syslog", make_rows(spark, 0, 10), order_by=["r_isodate"])
    rows = store.read("syslog")
    assert rows.filter("field_k_text IS NULL").count() == 0
    assert {r.id: r.raw for r in rows.filter("id <= 200").collect()} == before
    found = store.matching("syslog", field="k>7").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(field_k_number,7.0)" in plan and "raw" not in plan.split("ReadSchema")[1]
    assert found.count() == 42
    assert store.promoted("syslog") == ["k"]
    with pytest.raises(ValueError):
        store.promote("syslog", ["a-b"])


def test_prune(store):
    keep = {r.id for r in store.read("syslog").filter("r_isodate >= timestamp'2024-01-28 00:00:00Z' - interval 5 hours").collect()}
    gone = 200 - len(keep)
    assert store.prune("syslog", "77h", AS_OF, dry_run=True) == gone
    assert store.read("syslog").count() == 200
    assert store.prune("syslog", "77h", AS_OF) == gone
    assert set(ids(store.read("syslog"))) == keep
    assert store.prune("syslog", "77h", AS_OF) == 0
    with pytest.raises(ValueError):
        store.prune("syslog", None, AS_OF)


def test_prune_everything_keeps_the_sequence(spark, store):
    assert store.prune("syslog", "0d", AS_OF + dt.timedelta(days=1)) == 200
    assert store.read("syslog").count() == 0
    assert store.append("syslog", make_rows(spark, 0, 5)) == 205
    assert sorted(ids(store.read("syslog"))) == [201, 202, 203, 204, 205]


def test_prune_by_another_column_keeps_null(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    rows = spark.sql("""
        SELECT timestamp'2024-01-30 00:00:00Z' AS r_isodate, e AS err_isodate, 'h' AS host, 'v' AS vhost, 1 AS vhost_port,
          '' AS client_ip, '' AS loglevel, 1L AS pid, '' AS code, '' AS server, '' AS request, '' AS message, '{}' AS raw
        FROM VALUES (timestamp'2020-01-01 00:00:00Z'), (NULL), (timestamp'2024-01-30 00:00:00Z') t(e)
    """)
    store.append("http_error", rows)
    assert store.prune("http_error", "90", AS_OF, "err_isodate") == 1
    assert sorted(str(r.err_isodate) for r in store.read("http_error").collect())[-1] == "None"
    assert store.read("http_error").count() == 2


def block(store):
    return {r.id: json.loads(r.raw).get("enriched") for r in store.read("syslog").collect()}


def test_reenrich(store):
    before = block(store)
    report = store.reenrich(SSHD, program="sshd", dry_run=True)
    assert report == {"scanned": 100, "changed": 100} and block(store) == before
    assert store.reenrich(SSHD, program="sshd") == report
    after = block(store)
    assert all(set(after[i]) == {"ssh_user", "ssh_src_ip", "ssh_src_port"} for i in range(1, 101))
    assert all(after[i] == before[i] for i in range(101, 201))
    assert store.reenrich(SSHD, program="sshd") == {"scanned": 100, "changed": 0}
    # A rule that no longer matches takes its block away.
    assert store.reenrich([Rule("none", "never", (Field("x", 0),))], everything=True) == {"scanned": 200, "changed": 200}
    assert set(map(str, block(store).values())) == {"None"}
    assert len(block(store)) == 200


@pytest.mark.parametrize(("limit", "scanned"), [(0, 1), (1, 1), (17, 17), (500, 200)])
def test_reenrich_limit(store, limit, scanned):
    report = store.reenrich(SSHD, everything=True, limit=limit)
    assert report["scanned"] == scanned
    changed = {i for i, b in block(store).items() if not b or "k" not in b}
    assert changed == set(range(1, scanned + 1))


def test_reenrich_guards(store):
    with pytest.raises(ValueError):
        store.reenrich(SSHD)
    with pytest.raises(ValueError):
        store.reenrich([], everything=True)
    with pytest.raises(ValueError):
        store.reenrich(SSHD, since="1d", column="id", as_of=AS_OF)


def test_reenrich_refreshes_promoted_fields(store):
    store.promote("syslog", ["ssh_user"])
    assert store.matching("syslog", field="ssh_user=u150").count() == 0
    store.reenrich(SSHD, everything=True)
    assert store.matching("syslog", field="ssh_user=u150").count() == 1


def test_two_writers_at_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(2) as pool:
        runs = [
            pool.submit(store.append, "syslog", make_rows(spark, 0, 40, name), (name, n), ["r_isodate"])
            for n in range(2)
            for name in ("left", "right")
        ]
        for run in runs:
            run.result()
    rows = store.read("syslog")
    assert sorted(ids(rows)) == list(range(1, 161))
    assert {r.program: r["count"] for r in rows.groupBy("program").count().collect()} == {"left": 80, "right": 80}


def test_a_repeat_on_another_day_replaces(spark, store):
    late = make_rows(spark, 0, 30).withColumn("r_isodate", F.expr("r_isodate + interval 30 days"))
    store.append("syslog", late, ("w", 0))
    store.append("syslog", make_rows(spark, 0, 30), ("w", 0))
    assert sorted(ids(store.read("syslog"))) == list(range(1, 231))
    assert store.read("syslog").filter("r_isodate > timestamp'2024-02-01 00:00:00Z'").count() == 0


def test_a_stored_batch_keeps_its_receipt_time(spark, store):
    rows = make_rows(spark, 0, 3).withColumn("r_isodate", F.expr("timestamp'2024-02-03 04:05:06Z'"))
    store.append("syslog", rows, ("w", 3))
    assert store.batch_time("syslog", ("w", 3)) == dt.datetime(2024, 2, 3, 4, 5, 6, tzinfo=dt.timezone.utc)
    assert store.batch_time("syslog", ("w", 4)) > dt.datetime(2024, 2, 4, tzinfo=dt.timezone.utc)


def test_a_batch_is_invisible_until_it_is_whole(spark, store):
    store.append("syslog", make_rows(spark, 0, 10), ("w", 0))
    (mark,) = store._names(f"{store.data_path('syslog')}/ids=*/batch=w-0/_SUCCESS")
    store._delete(mark)  # as while Spark is writing, and after a lost driver
    assert store.read("syslog").count() == 200 and len(store.batches("syslog")) == 2
    store.append("syslog", make_rows(spark, 0, 5), ("x", 0))
    store.append("syslog", make_rows(spark, 0, 10), ("w", 0))
    assert sorted(ids(store.read("syslog"))) == list(range(1, 216))


def test_append_refuses_rows_without_receipt_time(spark, store):
    bad = make_rows(spark, 0, 3).withColumn("r_isodate", F.expr("CASE WHEN host <> 'h0' THEN r_isodate END"))
    with pytest.raises(Exception, match="no r_isodate"):
        store.append("syslog", bad)
    assert store.read("syslog").count() == 200


@pytest.mark.parametrize("put", [0, 1, 3])
def test_a_lost_overwrite_is_finished_later(spark, store, put):
    """The driver dies while Spark puts partitions in place of old ones: the old one of the next is gone."""
    want = {r.id: r.raw for r in store.read("syslog").collect()}
    data = store.data_path("syslog")
    store._rows("syslog").where("day = date'2024-01-29'").write.partitionBy("ids", "batch", "day").parquet(f"{data}/.spark-staging-x")
    places = [p.split(".spark-staging-x/")[1] for p in store._names(f"{data}/.spark-staging-x/ids=*/batch=*/day=*")]
    for k, place in enumerate(places[: put + 1]):
        store._delete(f"{data}/{place}")
        if k < put:
            fs, target = store._fs(f"{data}/{place}")
            fs.rename(store._fs(f"{data}/.spark-staging-x/{place}")[1], target)
    fresh = LogStore(spark, store.root)
    assert (fresh.read("syslog").count() < 200) == (put < len(places))
    fresh.recover("syslog")
    assert {r.id: r.raw for r in fresh.read("syslog").collect()} == want
    assert fresh._names(f"{data}/.spark-staging-*") == []


def test_compact(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    for n in range(4):
        store.append("syslog", make_rows(spark, 0, 60, f"p{n}"), ("w", n), ["r_isodate"])
    want = sorted((r.id, r.raw) for r in store.read("syslog").collect())
    days = sorted(str(r.day) for r in store.read("syslog").select("day").distinct().collect())
    store.compact("syslog", days[-2])
    assert len(store.batches("syslog")) == 4  # all have rows of the last day
    store.compact("syslog", days[-1])
    assert sorted((r.id, r.raw) for r in store.read("syslog").collect()) == want
    assert [b[:2] for b in store.batches("syslog")] == [(0, 240)]
    assert ids(store.newest("syslog", 7, first_step=5)) == list(range(240, 233, -1))
    assert ids(store.newest("syslog", 7, asc=True, first_step=5)) == list(range(1, 8))
    assert ids(store.after("syslog", 100)) == list(range(101, 241))
    assert sorted(ids(store.between("syslog", 60, 120))) == list(range(61, 121))
    store.append("syslog", make_rows(spark, 0, 5), ("w", 4), ["r_isodate"])
    assert ids(store.newest("syslog", 6, first_step=2)) == [245, 244, 243, 242, 241, 240]


def test_a_lost_compaction_shows_no_row_twice(spark, store, monkeypatch):
    want = sorted((r.id, r.raw) for r in store.read("syslog").collect())

    def dying(path):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_delete", dying)
    with pytest.raises(RuntimeError):
        store.compact("syslog", "2024-02-01")
    monkeypatch.undo()
    assert sorted((r.id, r.raw) for r in store.read("syslog").collect()) == want
    assert len(store._listed("syslog")[0]) == 3 and len(store.batches("syslog")) == 1
    store.compact("syslog", "2024-02-01")
    assert sorted((r.id, r.raw) for r in store.read("syslog").collect()) == want
    assert len(store._listed("syslog")[0]) == 1


def test_reenrich_reads_only_its_days(spark, store, monkeypatch):
    seen = []
    run = store_module.maintenance.reenrich
    monkeypatch.setattr(store_module.maintenance, "reenrich", lambda df, *a: (seen.append(df), run(df, *a))[1])
    store.reenrich(SSHD, since="30h", as_of=AS_OF, dry_run=True)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_promotion_goes_on_where_it_stopped(spark, store, monkeypatch):
    overwrite, done = store._overwrite, []

    def dying(source_name, rows):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(rows)
        overwrite(source_name, rows)

    monkeypatch.setattr(store, "_overwrite", dying)
    with pytest.raises(RuntimeError):
        store.promote("syslog", ["k"])
    monkeypatch.undo()
    assert store.promoted("syslog") == []
    assert store.matching("syslog", field="k>7").count() == 40
    store.fill("syslog")
    assert store.promoted("syslog") == ["k"]
    assert store.read("syslog").filter("field_k_text IS NULL").count() == 0
    assert store.matching("syslog", field="k>7").count() == 40


def distinct(store, by, since):
    return store.distinct_estimate("syslog", by, since, AS_OF).first().n


def test_distinct_from_sketches_alone(spark, store):
    """With every batch sketched, a window of whole days reads no row of the store."""
    assert distinct(store, "program", "9d") == 2  # no sketches yet: all from rows
    store.sketch("syslog")
    for row in (store.sketches("syslog").select("ids").distinct().collect(), store.batches("syslog")):
        assert len(row) == 2
    for path in store._names(f"{store.data_path('syslog')}/ids=*/batch=*/day=*"):
        store._delete(path)
    assert [distinct(store, by, "9d") for by in ("program", "host", "host_from", "priority")] == [2, 3, 1, 1]
    assert distinct(store, "host", "36h") == 3  # the half day is gone, the whole day is a sketch


def test_sketches_follow_the_rows(spark, store):
    store.sketch("syslog")
    one = make_rows(spark, 0, 30).withColumn("host", F.concat(F.lit("new"), F.col("r_isodate").cast("string")))
    store.append("syslog", one, ("w", 1), ["r_isodate"])
    assert distinct(store, "host", "20d") == 33
    store.append("syslog", one.withColumn("host", F.lit("other")), ("w", 1), ["r_isodate"])  # the batch comes again
    assert distinct(store, "host", "20d") == 4
    store._drop_sketches("syslog", list(store._sketched("syslog"))[:2])  # as a lost driver leaves them
    assert distinct(store, "host", "20d") == 4
    store.sketch("syslog")
    store.compact("syslog", "2024-01-31")
    assert len(store.batches("syslog")) == len(store._sketched("syslog")) == 1
    assert (distinct(store, "host", "20d"), distinct(store, "program", "20d")) == (4, 2)
    store.prune("syslog", "36h", AS_OF)
    assert (distinct(store, "host", "20d"), distinct(store, "program", "20d")) == (4, 2)
    assert distinct(store, "program", "12h") == store.matching("syslog", since="12h", as_of=AS_OF).select("program").distinct().count()


def test_error_of_sketches(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "wide"))
    for part in range(2):
        rows = make_rows(spark, 15_000 * part, 20_000, step="1 minute")
        store.append("syslog", rows.withColumn("host", F.concat(F.lit("h"), F.date_format("r_isodate", "yyyyMMddHHmm"))))
        store.sketch("syslog")
    for since, n in (("60d", 35_000), ("10d", 14_401), ("100h", 6001)):
        assert abs(distinct(store, "host", since) - n) < 0.05 * n


def test_record_paths_in_sql(spark, store):
    store.append("syslog", make_rows(spark, 0, 1).withColumn("raw", F.lit("no json")))
    store.register()
    got = spark.sql("SELECT record:enriched.k::int AS k, count(*) AS n FROM syslog GROUP BY 1 ORDER BY 1 NULLS LAST").collect()
    assert [tuple(r) for r in got] == [*((k, 20) for k in range(10)), (None, 1)]
    assert "try_parse_json" not in spark.sql("SELECT host FROM syslog")._jdf.queryExecution().executedPlan().toString()
