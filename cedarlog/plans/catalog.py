"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.operators import maintenance, promote, rules, stats
from cedarlog.operators.context import context_around
from cedarlog.operators.filters import build_filter
from cedarlog.operators.geo import geoip_join
from cedarlog.operators.ids import assign_ids
from cedarlog.operators.networks import prepare_networks
from cedarlog.operators.search import after, display, search, tail, to_json_lines, to_tsv
from cedarlog.operators.syslog import ingest_report, parse_syslog, split_rejects
from cedarlog.plans import fixtures as fx
from cedarlog.session import configure, materialize, scratch_path
from cedarlog.sources import files
from cedarlog.sources.files import WebSet, parse_web_lines, read_web_sets, tag_vhost
from cedarlog.sources.store import LogStore
from cedarlog.streaming.follow import follow
from cedarlog.streaming.ingest import stream_lines, stream_syslog, stream_web_logs

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

SYSLOG_COLUMNS = [
    "c_isodate", "r_isodate", "s_isodate", "facility", "host", "host_from", "pid", "priority", "program", "sourceip",
]
ACCESS_COLUMNS = [
    "r_isodate", "req_isodate", "host", "vhost", "vhost_port", "client_ip", "ident", "auth", "method", "request",
    "http_version", "status", "bytes", "referrer", "user_agent",
]
ERROR_COLUMNS = [
    "r_isodate", "err_isodate", "host", "vhost", "vhost_port", "client_ip", "loglevel", "pid", "code", "server",
    "request", "message",
]


def query(name: str):
    """Register a query; session options are set and times come out without a zone."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fx.zoneless(build(configure(spark), sf_dir))

        _QUERIES[name] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- parsing -----------------------------------------------------------------


@query("syslog_ingest")
def syslog_ingest(spark, sf_dir):
    return fx.syslog_rows(spark, sf_dir).select("id", *SYSLOG_COLUMNS, "raw")


@query("syslog_rejects")
def syslog_rejects(spark, sf_dir):
    parsed = parse_syslog(fx.syslog_lines(spark, sf_dir))
    return split_rejects(parsed).rejected.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("ingest_counts")
def ingest_counts(spark, sf_dir):
    return ingest_report(parse_syslog(fx.syslog_lines(spark, sf_dir)))


@query("http_access_ingest")
def http_access_ingest(spark, sf_dir):
    return fx.access_rows(spark, sf_dir).select("id", *ACCESS_COLUMNS)


@query("http_error_ingest")
def http_error_ingest(spark, sf_dir):
    return fx.error_rows(spark, sf_dir).select("id", *ERROR_COLUMNS, "raw")


@query("http_raw_record")
def http_raw_record(spark, sf_dir):
    return fx.access_rows(spark, sf_dir).select("id", "raw")


@query("vhost_from_path")
def vhost_from_path(spark, sf_dir):
    lines = fx.access_lines(spark, sf_dir)
    vhost, port = tag_vhost(F.col("path"), fx.WEB_SET)
    return lines.groupBy(vhost.alias("vhost"), port.alias("vhost_port")).agg(F.count("*").alias("n"))


@query("web_sets_ingest")
def web_sets_ingest(spark, sf_dir):
    """Two sets written out as files and read back: one by glob, one by a plain path."""
    root = scratch_path(spark, "websets")
    for kind, lines in (("access", fx.access_lines(spark, sf_dir)), ("error", fx.error_lines(spark, sf_dir))):
        site = F.regexp_extract("path", r"(www[0-9]+)\.example", 1)
        lines.select("value", site.alias("site")).write.partitionBy("site").text(f"{root}/{kind}")
    config = {
        "geoip": "all",
        "sites": {
            "access": f"{root}/access/site=*/*.txt",
            "error": f"{root}/error/site=*/*.txt",
            "vhost": "www.example.com",
            "vhost_port": 443,
        },
        "plain": {"access": f"{root}/access/site=www1", "vhost_port": 8080, "geoip": None},
    }
    rows = read_web_sets(spark, config, "web01", ranges={"all": fx.raw_ranges(spark)})
    country = records.json_text(F.col("raw"), "enriched", "geoip", "http_clientip", "country", "iso_code")
    error_country = records.json_text(F.col("raw"), "enriched", "geoip", "http_error_client_ip", "country", "iso_code")
    counts = [
        rows[kind]
        .groupBy("vhost", "vhost_port", where.alias("country"))
        .agg(F.count("*").alias("n"))
        .withColumn("kind", F.lit(kind))
        for kind, where in (("access", country), ("error", error_country))
    ]
    return counts[0].unionByName(counts[1])


# -- display and output ------------------------------------------------------


@query("display_syslog")
def display_syslog(spark, sf_dir):
    return display(fx.syslog_rows(spark, sf_dir), "syslog", with_id=True)


@query("tsv_rows")
def tsv_rows(spark, sf_dir):
    return to_tsv(display(fx.document_rows(spark, sf_dir), "syslog", with_id=True))


@query("json_rows")
def json_rows(spark, sf_dir):
    return to_json_lines(fx.error_rows(spark, sf_dir).filter(build_filter("http_error", code="AH00150")))


@query("adhoc_sql")
def adhoc_sql(spark, sf_dir):
    """Mail traffic per host and day, asked in SQL of the registered store."""
    _stored(spark, sf_dir).register()
    return spark.sql("""
        SELECT host, day, count(*) AS n, max(r_isodate) AS latest, count(DISTINCT sourceip) AS senders
        FROM syslog WHERE facility = 'mail' GROUP BY host, day
    """)


@query("adhoc_record_path")
def adhoc_record_path(spark, sf_dir):
    """Fields of the stored records asked for by path, in SQL of the registered store."""
    _stored(spark, sf_dir).register()
    return spark.sql("""
        SELECT record:enriched.tag::string AS tag, record:enriched.k::int AS k, record:HOST::string AS host,
               count(*) AS n, count(record:absent.key) AS absent
        FROM syslog GROUP BY ALL
    """)


# -- filters -----------------------------------------------------------------


@query("search_http_status")
def search_http_status(spark, sf_dir):
    wanted = build_filter("http_access", status="404", host="web01", method="POST")
    return fx.access_rows(spark, sf_dir).filter(wanted).select("id", "client_ip", "status", "request")


@query("search_program_like")
def search_program_like(spark, sf_dir):
    wanted = build_filter("syslog", program="sshd%", host="w_b%3")
    return fx.syslog_rows(spark, sf_dir).filter(wanted).select("id", "program", "host")


@query("search_message")
def search_message(spark, sf_dir):
    return fx.document_rows(spark, sf_dir).filter(build_filter("syslog", message="The_of")).select("id", "program")


@query("search_since")
def search_since(spark, sf_dir):
    wanted = build_filter("syslog", since="36h", as_of=fx.AS_OF)
    return fx.syslog_rows(spark, sf_dir).filter(wanted).select("id", "s_isodate", "program")


def _by_field(*fields: str, **others) -> Query:
    def build(spark, sf_dir):
        wanted = build_filter("syslog", field=fields, as_of=fx.AS_OF, **others)
        return fx.syslog_rows(spark, sf_dir).filter(wanted).select("id", "program")

    return build


for _name, _fields, _others in (
    ("field_eq", ("tag=view-7",), {}),
    ("field_eq_numeric", ("k=38",), {}),
    ("field_ne", ("k!=38",), {}),
    ("field_regex", ("tag~^(view|click)-[12][0-9]$",), {}),
    ("field_not_regex", ("k!~^[0-4]",), {}),
    ("field_contains", ("tag=~W-2",), {}),
    ("field_regex_words", (r"tag~\mview\M|\y1[[:digit:]]$",), {}),
    ("field_regex_classes", (r"tag~(?i)^[[:alpha:]]{4,5}-[^[:digit:]3-9]?[0-2\d]{2}?$", r"tag!~[[:<:]]4"), {}),
    ("field_regex_literal", ("tag~***=w-1",), {}),
    ("field_gt_numeric", ("k>41.5",), {}),
    ("field_gt_text", ("tag>purchase-5",), {}),
    ("field_dotted_key", ("v.x>=2500", "v.x<5000"), {}),
    ("field_multi", ("k>=20", "tag!=error-38"), {"program": "sshd%", "since": "10d", "message": "FAILED%port 40"}),
):
    query(_name)(_by_field(*_fields, **_others))


_REPEATED = ("tag=view-7", "tag!=view-7", "tag~^view-[12]", "tag!~^view", "tag=~W-2", "tag>purchase-5", "tag=old")


@query("field_repeated_key")
def field_repeated_key(spark, sf_dir):
    """Records whose enriched block has ``tag`` twice; every operator goes by the last."""
    twice = F.replace(F.col("value"), F.lit('"enriched":{'), F.lit('"enriched":{"tag":"old",'))
    lines = fx.syslog_lines(spark, sf_dir).select("event_id", twice.alias("value"))
    rows = materialize(split_rejects(parse_syslog(lines, keep=["event_id"])).accepted, "repeated")
    found = [
        rows.filter(build_filter("syslog", field=text)).select(F.lit(text).alias("field"), (F.col("event_id") + 1).alias("id"))
        for text in _REPEATED
    ]
    return reduce(DataFrame.unionByName, found)


# -- newest, oldest, tail ----------------------------------------------------


@query("search_newest")
def search_newest(spark, sf_dir):
    return display(search(fx.syslog_rows(spark, sf_dir), "syslog", limit=50, program="nginx"), "syslog", with_id=True)


@query("search_oldest")
def search_oldest(spark, sf_dir):
    found = search(fx.error_rows(spark, sf_dir), "http_error", asc=True, limit=0, loglevel="crit")
    return display(found, "http_error", "err_isodate", with_id=True)


@query("tail_last")
def tail_last(spark, sf_dir):
    return display(tail(fx.access_rows(spark, sf_dir), "http_access", status="500"), "http_access", with_id=True)


@query("tail_after_cursor")
def tail_after_cursor(spark, sf_dir):
    rows = after(fx.syslog_rows(spark, sf_dir), "syslog", 500, program="cron", since="20d", as_of=fx.AS_OF)
    return display(rows, "syslog", with_id=True)


# -- statistics --------------------------------------------------------------


@query("stats_program")
def stats_program(spark, sf_dir):
    return stats.stats(fx.syslog_rows(spark, sf_dir), "syslog")


@query("stats_status")
def stats_status(spark, sf_dir):
    return stats.shown_key(stats.stats(fx.access_rows(spark, sf_dir), "http_access", by="status"))


@query("stats_code")
def stats_code(spark, sf_dir):
    return stats.stats(fx.error_rows(spark, sf_dir), "http_error", by="code", limit=40)


@query("stats_host_since")
def stats_host_since(spark, sf_dir):
    return stats.stats(fx.syslog_rows(spark, sf_dir), "syslog", by="host", since="5d", as_of=fx.AS_OF, limit=5)


@query("top_values_window")
def top_values_window(spark, sf_dir):
    return stats.top_values(fx.access_rows(spark, sf_dir), "http_access", "client_ip", "1w", fx.AS_OF, limit=30)


@query("distinct_hosts_window")
def distinct_hosts_window(spark, sf_dir):
    sys_rows, web_rows = fx.syslog_rows(spark, sf_dir), fx.access_rows(spark, sf_dir)
    parts = [
        ("host", stats.distinct_in_window(sys_rows, "syslog", "host", "24h", fx.AS_OF)),
        ("program", stats.distinct_in_window(sys_rows, "syslog", "program", "30d", fx.AS_OF)),
        ("client_ip", stats.distinct_in_window(web_rows, "http_access", "client_ip", "3d", fx.AS_OF)),
    ]
    named = [frame.select(F.lit(name).alias("dimension"), "n") for name, frame in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("distinct_sketched_window")
def distinct_sketched_window(spark, sf_dir):
    """Sketches of stored batches and of one appended later, beside the exact count: within 5 %, three deviations."""
    store = LogStore(spark, scratch_path(spark, "store"))
    late = F.col("r_isodate") >= F.lit("2024-01-25 00:00:00+00:00").cast("timestamp")
    for name, rows in (("syslog", fx.syslog_rows(spark, sf_dir)), ("http_access", fx.access_rows(spark, sf_dir))):
        store.append(name, rows.filter(~late))
        store.sketch(name)
        store.append(name, rows.filter(late))
    parts = []
    for name, by, since in (("syslog", "host", "24h"), ("syslog", "program", "30d"), ("http_access", "client_ip", "30d"), ("http_access", "client_ip", "100h")):
        exact = stats.distinct_in_window(store.read(name), name, by, since, fx.AS_OF, partitioned=True)
        about = store.distinct_estimate(name, by, since, fx.AS_OF).withColumnRenamed("n", "about")
        both = exact.withColumn("_", F.lit(1)).join(about.withColumn("_", F.lit(1)), "_")
        parts.append(both.select(F.lit(by).alias("dimension"), F.lit(since).alias("since"), "n", (F.abs(F.col("about") - F.col("n")) <= F.col("n") * 0.05).alias("near")))
    return reduce(DataFrame.unionByName, parts)


@query("countries_window")
def countries_window(spark, sf_dir):
    rows, table = fx.access_rows(spark, sf_dir), fx.geo_ranges(spark)
    return stats.countries_in_window(rows, "http_access", "client_ip", table, "2w", fx.AS_OF, prepared=True)


@query("file_outcomes")
def file_outcomes(spark, sf_dir):
    """Files by kind of event, one that is broken among them, and one that is not there: what became of each."""
    base = scratch_path(spark, "outcomes")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.concat("event_id", F.lit(" "), "props").alias("value"))
    lines.write.partitionBy("event_type").text(base)
    broken = spark.range(1).coalesce(1).select(F.lit("not gzip").alias("value"))
    broken.write.option("compression", "none").text(f"{base}/event_type=broken")
    (name,) = _file_names(spark, f"{base}/event_type=broken/part-*")
    _rename(spark, name, f"{name}.gz")
    found = files.file_outcomes(spark, [f"{base}/event_type=*/part-*", f"{base}/event_type=none/part-0"])
    kind = F.regexp_extract("path", "event_type=([a-z]+)/", 1)
    return found.groupBy(kind.alias("event_type"), "status").agg(F.sum("lines").alias("lines"))


def _file_names(spark, pattern: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [s.getPath().toString() for s in found]


def _rename(spark, old: str, new: str) -> None:
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new)]
    paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*paths)


@query("geoip_networks")
def geoip_networks(spark, sf_dir):
    """Places by nested networks of both families; the record of each event gets what is known of its address."""
    table = materialize(prepare_networks(fx.networks(spark, sf_dir)), "networks")
    rows = fx.addressed_events(spark, sf_dir).withColumn("raw", F.to_json(F.struct(F.struct(F.col("address").alias("peer")).alias("enriched"))))
    located = geoip_join(rows, "peer", table)
    place = ("enriched", "geoip", "peer")
    return located.select(
        "id", "address", records.json_text(F.col("raw"), *place, "country", "iso_code").alias("country"),
        records.json_text(F.col("raw"), *place, "city", "geoname_id").try_cast("bigint").alias("city"),
    )


@query("geoip_country")
def geoip_country(spark, sf_dir):
    rows = geoip_join(fx.access_rows(spark, sf_dir), "http_clientip", fx.geo_ranges(spark), prepared=True)
    geo = ("enriched", "geoip", "http_clientip", "country", "iso_code")
    return rows.select("id", "client_ip", records.json_text(F.col("raw"), *geo).alias("country"))


@query("context_join")
def context_join(spark, sf_dir):
    """Rows logged within ten minutes of an expensive purchase on the same host."""
    anchors = (
        fx.events(spark, sf_dir)
        .filter("event_type = 'purchase' AND value >= 60")
        .select("ts", F.expr("concat('web', user_id % 9)").alias("host"))
    )
    rows = context_around(anchors, fx.syslog_rows(spark, sf_dir), "10m", "20m")
    return rows.select("id", "host", "r_isodate", "program")


# -- rules -------------------------------------------------------------------


@query("enrich_sshd")
def enrich_sshd(spark, sf_dir):
    rows = rules.enrich(fx.syslog_rows(spark, sf_dir), rules.SSHD)
    return rows.select(
        "id",
        records.enriched_block(F.col("raw")).alias("enriched"),
        records.message(F.col("raw")).alias("message"),
    )


def _bare_lines(spark, sf_dir) -> DataFrame:
    return fx.syslog_rows(spark, sf_dir).select("id", records.message(F.col("raw")).alias("value"))


@query("enrich_fields")
def enrich_fields(spark, sf_dir):
    lines = rules.as_records(_bare_lines(spark, sf_dir), program="sshd")
    return rules.enrich_fields(lines, rules.SSHD).select("id", "fields")


@query("enrich_full")
def enrich_full(spark, sf_dir):
    lines = rules.as_records(_bare_lines(spark, sf_dir), program="sshd-session")
    return rules.enrich_full(lines, rules.SSHD).select("id", "raw")


@query("enrich_explain")
def enrich_explain(spark, sf_dir):
    return rules.enrich_explain(fx.syslog_rows(spark, sf_dir), rules.SSHD).select("id", "matched", "rule", "fields")


@query("rule_coverage")
def rule_coverage(spark, sf_dir):
    return rules.rule_coverage(fx.syslog_rows(spark, sf_dir), rules.SSHD)


# -- maintenance -------------------------------------------------------------


@query("dense_ids")
def dense_ids(spark, sf_dir):
    rows = split_rejects(parse_syslog(fx.syslog_lines(spark, sf_dir), keep=["event_id"])).accepted
    return assign_ids(rows, 100, ["r_isodate", "event_id"]).select("id", "event_id", "program")


@query("promoted_fields")
def promoted_fields(spark, sf_dir):
    rows = promote.promote_fields(fx.syslog_rows(spark, sf_dir), ["k", "tag"])
    return rows.select("id", "field_k_text", "field_k_number", "field_k_json", "field_tag_text")


def _stored(spark, sf_dir, sources=("syslog",)) -> LogStore:
    """A store holding the rendered rows, in two batches."""
    store = LogStore(spark, scratch_path(spark, "store"))
    half = F.col("r_isodate") < F.lit("2024-01-16 00:00:00+00:00").cast("timestamp")
    build = {"syslog": fx.syslog_rows, "http_access": fx.access_rows, "http_error": fx.error_rows}
    for name in sources:
        rows = materialize(build[name](spark, sf_dir), "rows")  # parsed once, not for each pass of each batch
        store.append(name, rows.filter(half), order_by=["r_isodate", "id"])
        store.append(name, rows.filter(~half), order_by=["r_isodate", "id"])
    return store


@query("prune_survivors")
def prune_survivors(spark, sf_dir):
    rows = maintenance.prune_survivors(fx.error_rows(spark, sf_dir), "http_error", "12d", fx.AS_OF, "err_isodate")
    return rows.select("id", "err_isodate")


@query("prune_store")
def prune_store(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.prune("syslog", "250h", fx.AS_OF)
    return store.read("syslog").select("id", "r_isodate", "program")


@query("prune_store_requests")
def prune_store_requests(spark, sf_dir):
    """By request time; rows without one stay."""
    store = _stored(spark, sf_dir, ("http_access",))
    gone = store.prune("http_access", "12d", fx.AS_OF, column="req_isodate")
    return store.read("http_access").select("id", "r_isodate", "req_isodate", F.lit(gone).cast("bigint").alias("gone"))


@query("store_replayed_batch")
def store_replayed_batch(spark, sf_dir):
    """A batch that comes again, its rows on other days, replaces its first attempt."""
    store = LogStore(spark, scratch_path(spark, "store"))
    rows = materialize(fx.syslog_rows(spark, sf_dir), "rows")
    late = rows.withColumn("r_isodate", F.expr("r_isodate + INTERVAL 1 DAY"))
    for attempt in (late, rows):
        store.append("syslog", attempt, ("writer", 1), ["r_isodate", "id"])
    return store.read("syslog").select("id", "r_isodate", "program")


@query("store_compacted")
def store_compacted(spark, sf_dir):
    """Three batches that share all days, merged day by day; the newest rows come from the merged folders."""
    store = LogStore(spark, scratch_path(spark, "store"))
    rows = materialize(fx.syslog_rows(spark, sf_dir), "rows")
    for part in range(3):
        store.append("syslog", rows.filter(f"pid % 3 = {part}" + (" OR pid IS NULL" if part == 0 else "")))
    for (day,) in store.read("syslog").select(F.col("day").cast("string")).distinct().collect():
        store.compact("syslog", day)
    files = store.read("syslog").groupBy("day").agg(F.countDistinct("id_base").alias("folders"))
    whole = store.newest("syslog", 10_000_000)
    joined = whole.join(files, "day").select("r_isodate", "host", "pid", "program", "folders")
    return joined


@query("prune_dry_run")
def prune_dry_run(spark, sf_dir):
    return maintenance.prune_dry_run(fx.syslog_rows(spark, sf_dir), "syslog", "250h", fx.AS_OF)


@query("reenrich_changed")
def reenrich_changed(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.reenrich(rules.SSHD, program="sshd", since="20d", as_of=fx.AS_OF)
    return store.read("syslog").select("id", "r_isodate", records.enriched_block(F.col("raw")).alias("enriched"))


@query("reenrich_counts")
def reenrich_counts(spark, sf_dir):
    rows = rules.enrich(fx.syslog_rows(spark, sf_dir), rules.SSHD)
    scope = maintenance.reenrich_scope(since="20d", as_of=fx.AS_OF)
    return maintenance.reenrich_report(maintenance.reenrich(rows, rules.SSHD, scope))


@query("store_newest")
def store_newest(spark, sf_dir):
    """Newest rows by a promoted field, read from the end of the store backwards."""
    store = _stored(spark, sf_dir)
    store.promote("syslog", ["k"])
    rows = store.newest(
        "syslog", 40, first_step=64, field="k>=90", program="sshd%", since="25d", column="r_isodate", as_of=fx.AS_OF
    )
    return display(rows, "syslog", with_id=True)


@query("store_stats_window")
def store_stats_window(spark, sf_dir):
    store = _stored(spark, sf_dir)
    return stats.stats(
        store.read("syslog"), "syslog", by="program", since="8d", column="r_isodate", as_of=fx.AS_OF, partitioned=True
    )


# -- streaming ---------------------------------------------------------------


@query("stream_syslog_ingest")
def stream_syslog_ingest(spark, sf_dir):
    """Lines land as files, a stream stores and enriches them; the rejects are kept as well."""
    landing, base = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    fx.syslog_lines(spark, sf_dir).select("value").repartition(4).write.text(landing)
    store = LogStore(spark, f"{base}/store")
    run = stream_syslog(
        stream_lines(spark, landing, max_files=2), store, f"{base}/checkpoint", rules.SSHD,
        rejects_path=f"{base}/rejects", available_now=True,
    )
    run.awaitTermination()
    stored = store.read("syslog")
    user = records.enriched_text(F.col("raw"), "ssh_user").alias("ssh_user")
    good = stored.select("r_isodate", "host", "program", "pid", user, records.message(F.col("raw")).alias("message"))
    bad = spark.read.parquet(f"{base}/rejects").select(F.col("reject_reason").alias("message"))
    return good.unionByName(bad, allowMissingColumns=True)


# Files that a site's lines are written as at most. A stream of a file at a time has as many batches, whatever
# the number of lines; Spark reads a large file in splits.
SITE_FILES = 4


def _site_lines(spark, sf_dir, base: str) -> None:
    lines = fx.access_lines(spark, sf_dir, deal=False)
    for site in range(4):
        own = lines.filter(F.col("path").contains(f"www{site}.")).select("value")
        own.coalesce(SITE_FILES).write.text(f"{base}/logs/www{site}.example.com")


_STREAMED = ["vhost", "vhost_port", "client_ip", "method", "request", "status", "bytes", "referrer", "user_agent"]


@query("stream_http_ingest")
def stream_http_ingest(spark, sf_dir):
    base = scratch_path(spark, "web")
    _site_lines(spark, sf_dir, base)
    web_set = WebSet("site", access=f"{base}/logs/*/*", vhost="www.example.com", vhost_port=443)
    store = LogStore(spark, f"{base}/store")
    run = stream_web_logs(
        stream_lines(spark, f"{base}/logs/*"), store, f"{base}/checkpoint", web_set, "access", "web01",
        ranges=materialize(fx.geo_ranges(spark), "ranges"), available_now=True,
    )
    run.awaitTermination()
    return store.read("http_access").select("req_isodate", *_STREAMED)


@query("stream_two_sets")
def stream_two_sets(spark, sf_dir):
    """Two sets stored into one table by two streams at once; ids are given out once each."""
    base = scratch_path(spark, "web")
    _site_lines(spark, sf_dir, base)
    store = LogStore(spark, f"{base}/store")
    runs = []
    for name, sites, port in (("first", "www[01]*", 443), ("second", "www[23]*", 8443)):
        web_set = WebSet(name, access=f"{base}/logs/{sites}/*", vhost=f"{name}.example.com", vhost_port=port)
        lines = stream_lines(spark, f"{base}/logs/{sites}", max_files=1)
        runs.append(stream_web_logs(lines, store, f"{base}/checkpoint-{name}", web_set, "access", "web01", available_now=True))
    for run in runs:
        run.awaitTermination()
    rows = store.read("http_access")
    same = rows.groupBy("id").agg(F.count("*").alias("rows_of_id"))
    return rows.join(same, "id").select("req_isodate", *_STREAMED, "rows_of_id")


@query("stream_follow")
def stream_follow(spark, sf_dir):
    """Three batches of several days each, followed with a restart after each; rows rewritten meanwhile come once."""
    base = scratch_path(spark, "follow")
    store = LogStore(spark, f"{base}/store")
    rows = materialize(fx.syslog_rows(spark, sf_dir), "rows")

    def emit(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for low, high in (("2000-01-01", "2024-01-12"), ("2024-01-12", "2024-01-22"), ("2024-01-22", "2100-01-01")):
        part = rows.filter(f"r_isodate >= timestamp'{low} 00:00:00Z' AND r_isodate < timestamp'{high} 00:00:00Z'")
        store.append("syslog", part, order_by=["r_isodate", "id"])
        follow(
            store, "syslog", emit, f"{base}/checkpoint", last=100, available_now=True, clock=lambda: fx.AS_OF,
            program="sshd", since="25d",
        ).awaitTermination()
        store.reenrich(rules.SSHD, everything=True)
    seen = spark.read.parquet(f"{base}/out")
    return seen.groupBy("id", "s_isodate", "host", "program").agg(F.count("*").alias("times"))
