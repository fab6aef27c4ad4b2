"""Headline queries on one machine; prints one JSON line.

    BENCH_SF_DIR   test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_COPIES   times each event is stored in the query store (default 20: 2 M rows at sf0.1)

Ingest steps read text lines and drop their output. The other queries read a
store, built beforehand and not timed. Every time is the best of three runs, with
building the plan included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cedarlog import configure  # noqa: E402
from cedarlog.operators import rules, stats  # noqa: E402
from cedarlog.operators.context import context_around  # noqa: E402
from cedarlog.operators.syslog import ingest_syslog  # noqa: E402
from cedarlog.operators.weblogs import parse_http_access, parse_http_error  # noqa: E402
from cedarlog.plans import fixtures as fx  # noqa: E402
from cedarlog.session import materialize, scratch_path  # noqa: E402
from cedarlog.sources.files import read_lines  # noqa: E402
from cedarlog.sources.store import LogStore  # noqa: E402

RUNS = 3


def build_store(spark: SparkSession, sf_dir: str, copies: int) -> LogStore:
    """Each parsed row ``copies`` times, a few seconds apart."""
    store = LogStore(spark, scratch_path(spark, "bench-store"))
    for name, build in (("syslog", fx.syslog_rows), ("http_access", fx.access_rows)):
        rows = materialize(build(spark, sf_dir), "bench-rows").repartition(spark.sparkContext.defaultParallelism)
        spread = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        times = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp"]
        shifted = spread.withColumns({t: F.col(t) + F.make_dt_interval(secs=F.col("copy") * 3) for t in times})
        store.append(name, shifted, order_by=["r_isodate"])
    store.promote("syslog", ["k"])
    return store


def text_files(spark: SparkSession, lines: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    lines.select("value").repartition(spark.sparkContext.defaultParallelism).write.text(path)
    return path


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "20"))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    syslog = text_files(spark, fx.syslog_lines(spark, sf_dir), "bench-syslog")
    access = text_files(spark, fx.access_lines(spark, sf_dir), "bench-access")
    error = text_files(spark, fx.error_lines(spark, sf_dir), "bench-error")
    store = build_store(spark, sf_dir, copies)
    ranges = materialize(fx.geo_ranges(spark), "bench-ranges")
    window = {"as_of": fx.AS_OF, "partitioned": True}
    received = {"column": "r_isodate", "as_of": fx.AS_OF}
    anchors = store.read("syslog").filter("program = 'cron' AND pid % 1000 = 0").select(F.col("r_isodate").alias("ts"), "host")

    def logged() -> DataFrame:
        return store.read("syslog")

    queries = {
        "ingest_syslog_parse": lambda: noop(ingest_syslog(read_lines(spark, syslog))),
        "ingest_syslog_enrich": lambda: noop(ingest_syslog(read_lines(spark, syslog), rules.SSHD)),
        "ingest_access_parse": lambda: noop(parse_http_access(read_lines(spark, access), "web01")),
        "ingest_error_parse": lambda: noop(parse_http_error(read_lines(spark, error), "web01")),
        "stats_24h": lambda: stats.stats(logged(), "syslog", since="24h", column="r_isodate", **window).collect(),
        "stats_30d": lambda: stats.stats(logged(), "syslog", since="30d", column="r_isodate", **window).collect(),
        "distinct_hosts_24h": lambda: stats.distinct_in_window(logged(), "syslog", "host", "24h", **window).collect(),
        "distinct_hosts_30d": lambda: stats.distinct_in_window(logged(), "syslog", "host", "30d", **window).collect(),
        "countries_30d": lambda: stats.countries_in_window(
            store.read("http_access"), "http_access", "client_ip", ranges, "30d", prepared=True, **window
        ).collect(),
        "field_equal_24h": lambda: store.matching("syslog", field="tag=view-7", since="24h", **received).count(),
        "field_regex_24h": lambda: store.matching("syslog", field="tag~^view-[12]", since="24h", **received).count(),
        "field_promoted_30d": lambda: store.matching("syslog", field="k>=98", since="30d", **received).count(),
        "newest_20": lambda: store.newest("syslog", 20, program="sshd%").collect(),
        "context_10m": lambda: noop(context_around(anchors, logged().select("id", "host", "r_isodate"), "10m", "10m")),
    }
    times = {}
    for name, run in queries.items():
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    result = {
        "metric": "total of best query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "store_rows": {name: store.max_id(name) for name in ("syslog", "http_access")},
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
