import bisect
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cedarlog.operators import context
from cedarlog.operators.context import context_around
from cedarlog.operators.geo import countries_of, prepare_ranges
from cedarlog.operators.ids import assign_ids, nth_id

RANGES = "start_ip bigint, end_ip bigint, country string"


def text(number):
    return ".".join(str(number >> shift & 255) for shift in (24, 16, 8, 0))


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_smallest_covering_range_wins(spark, broadcast):
    rnd = random.Random(7)
    ranges = []
    for n in range(60):
        low = rnd.randrange(0, 1 << 20)
        ranges.append((low, low + rnd.choice([0, 3, 200, 70000, 300000]), f"c{n}"))
    ips = [rnd.randrange(0, 1 << 21) for _ in range(400)] + [r[0] for r in ranges] + [r[1] for r in ranges]
    frame = spark.createDataFrame([(i, text(ip)) for i, ip in enumerate(ips)], "n int, ip string")
    got = {r.n: r.country for r in countries_of(frame, "ip", spark.createDataFrame(ranges, RANGES), broadcast=broadcast).collect()}
    assert len(got) == len(ips)
    for n, ip in enumerate(ips):
        covering = [(high - low, name) for low, high, name in ranges if low <= ip <= high]
        assert got[n] == (min(covering)[1] if covering else None)


def test_no_address(spark):
    frame = spark.createDataFrame([("::1",), (None,), ("1.2.3",), ("0.0.0.1",), ("0.0.0.1",)], "ip string")
    table = prepare_ranges(spark.createDataFrame([(0, 10, "ZZ")], RANGES))
    got = sorted((r.ip or "", r.country) for r in countries_of(frame, "ip", table, prepared=True).collect())
    assert got == [("", None), ("0.0.0.1", "ZZ"), ("0.0.0.1", "ZZ"), ("1.2.3", None), ("::1", None)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    anchors=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-300, 300)), max_size=25),
    rows=st.lists(st.tuples(st.sampled_from("abc"), st.integers(-400, 400)), min_size=1, max_size=80),
    before=st.sampled_from([0, 1, 7, 60]),
    after=st.sampled_from([0, 5, 60]),
    broadcast_rows=st.sampled_from([0, 1000]),
)
def test_context_equals_brute_force(spark, anchors, rows, before, after, broadcast_rows):
    context.BROADCAST_ROWS = broadcast_rows
    marks = spark.createDataFrame(anchors, "host string, s bigint").select("host", F.timestamp_seconds("s").alias("ts"))
    log = spark.createDataFrame([(n, h, s) for n, (h, s) in enumerate(rows)], "n int, host string, s bigint").select(
        "n", "host", F.timestamp_seconds("s").alias("r_isodate")
    )
    got = sorted(r.n for r in context_around(marks, log, f"{before}s", f"{after}s").collect())
    want = [n for n, (h, s) in enumerate(rows) if any(h == g and a - before <= s <= a + after for g, a in anchors)]
    assert got == want


def test_context_forms_no_pairs(spark):
    """One host, every row an anchor: output and join input stay linear."""
    log = spark.range(20000).select(F.lit("h").alias("host"), F.timestamp_millis("id").alias("r_isodate"))
    anchors = log.withColumnRenamed("r_isodate", "ts")
    assert context_around(anchors, log, "10s", "10s").count() == 20000


def test_joins_are_hash_joins(spark):
    rows = spark.createDataFrame([("1.2.3.4", "h")], "ip string, host string").withColumn("r_isodate", F.timestamp_seconds(F.lit(1)))
    table = prepare_ranges(spark.createDataFrame([(0, 10, "ZZ")], RANGES))
    marks = rows.select("host", F.col("r_isodate").alias("ts"))
    frames = [countries_of(rows, "ip", table, prepared=True, broadcast=b) for b in (True, False)]
    for frame in [*frames, context_around(marks, rows, "1m", "2m")]:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "HashJoin" in plan
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ids_are_dense_and_ordered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), (F.col("id") % 3).alias("g"))
    got = assign_ids(rows, 40, ["n"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(41, 5041))
    assert [r.n for r in got] == list(range(5000))


def test_ids_of_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("n"))
    numbered = assign_ids(rows, 0, ["n"], partitions=4)
    assert sorted(r.id for r in numbered.collect()) == list(range(1, 3001))


def test_ids_in_arrival_order(spark):
    got = assign_ids(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "n")).orderBy("id").collect()
    assert [(r.id, r.n) for r in got] == [(i + 1, i) for i in range(1000)]


def test_nth_id(spark):
    values = sorted({n * n % 99991 for n in range(1, 4000)})
    frame = spark.createDataFrame([(v,) for v in values], "id bigint")
    for n in (1, 2, 1777, len(values)):
        assert nth_id(frame, n, block=16, fan=10) == values[n - 1]
    assert nth_id(frame, len(values) + 1, block=16, fan=10) is None
    assert nth_id(frame.limit(0), 1) is None
    assert bisect.bisect(values, 5) > 0
