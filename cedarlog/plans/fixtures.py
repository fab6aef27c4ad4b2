"""Log text rendered from the test tables.

Each function writes every row of a table as a log line, good or damaged, the
way a daemon would. Queries parse the lines back; the SQL they are compared with
computes the expected columns from the table itself and never sees a line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.functions.once import with_once
from cedarlog.operators.geo import prepare_ranges
from cedarlog.operators.syslog import parse_syslog, split_rejects
from cedarlog.operators.weblogs import parse_http_access, parse_http_error
from cedarlog.sources.files import WebSet

# Every window ends here; the test events cover the 30 days before.
AS_OF = dt.datetime(2024, 1, 31)

WEB_SET = WebSet(
    name="site",
    access="/srv/logs/web/*-access.log",
    error="/srv/logs/web/*-error.log",
)

# Rows that one task renders as lines, addresses or networks and parses.
TASK_ROWS = 100_000

# Address ranges with countries; one lies inside another.
RANGES = (
    ("81.2.69.0", "81.2.69.255", "GB"),
    ("81.2.69.160", "81.2.69.191", "IE"),
    ("203.0.113.0", "203.0.113.127", "AU"),
    ("203.0.113.128", "203.0.113.255", "NZ"),
    ("11.0.0.0", "12.255.255.255", "US"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """Events with an instant for ``ts`` and the number inside ``props`` as ``k``.

    A row group is read by one task, and one holds up to a million short rows, each of
    them a line to be rendered and parsed; so the rows are dealt out before that,
    unless lines are only written.
    """
    rows = table(spark, sf_dir, "events")
    return (
        (_dealt(rows, "event_id") if deal else rows)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    )


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    tasks = -(-rows.count() // TASK_ROWS)  # from the files' footers
    return rows.repartition(tasks, key) if tasks > 1 else rows


def _text(expression: str) -> Column:
    return F.expr(expression)


def _enriched_members() -> Column:
    """``k`` is absent, a string, a decimal, null or an integer, by kind of event."""
    return F.expr("""
        concat_ws(',',
          CASE WHEN event_type = 'click' THEN NULL
               WHEN event_type = 'purchase' THEN concat('"k":"', k, '"')
               WHEN event_type = 'signup' THEN concat('"k":', k, '.0')
               WHEN event_type = 'view' AND value >= 10 AND value < 20 THEN '"k":null'
               ELSE concat('"k":', k) END,
          concat('"v.x":', round(value * 100)),
          concat('"tag":"', event_type, '-', k, '"'))
    """)


def _syslog_record(without: str | None = None) -> Column:
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    late = F.expr("ts - make_dt_interval(0, 0, 0, user_id % 5)")
    sshd = F.col("event_type").isin("error", "signup")
    members = {
        "C_ISODATE": F.date_format("ts", stamp),
        "R_ISODATE": F.date_format("ts", stamp),
        "S_ISODATE": F.date_format(late, stamp),
        "FACILITY": F.when(sshd, "auth").when(F.col("event_type") == "click", "mail").otherwise("daemon"),
        "HOST": _text("concat('web', user_id % 9)"),
        "HOST_FROM": _text("concat('relay', user_id % 2)"),
        "PRIORITY": F.when(F.col("event_type") == "error", "err").otherwise("info"),
        "PROGRAM": F.expr(
            "CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sshd-session' WHEN 'view' THEN 'nginx'"
            " WHEN 'click' THEN 'postfix/smtpd' ELSE 'cron' END"
        ),
        "SOURCEIP": _text("concat('10.0.', user_id % 4, '.', user_id % 250)"),
        "PID": F.expr(
            "CASE WHEN value >= 2 AND value < 3 THEN '7120033.250117' WHEN value >= 3 AND value < 4 THEN NULL"
            " WHEN value >= 4 AND value < 5 THEN '9223372036854775808' ELSE CAST(1000 + event_id AS STRING) END"
        ),
        "MESSAGE": F.when(
            sshd,
            _text(
                "concat('Failed password for invalid user u', user_id, ' from 203.0.113.', user_id % 250,"
                " ' port ', 40000 + event_id % 1000, ' ssh2')"
            ),
        ).otherwise(_text("concat(event_type, ' by user ', user_id, ' for ', CAST(round(value * 100) AS BIGINT))")),
    }
    kept = [value.alias(name) for name, value in members.items() if name != without]
    return F.to_json(F.struct(*kept))


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, value)``; small values give the five kinds of damaged line."""
    record = _syslog_record()
    value = F.col("value")
    with_block = F.concat(F.rtrim(record, F.lit("}")), F.lit(',"enriched":{'), _enriched_members(), F.lit("}}"))
    no_date = F.regexp_replace(record, '"C_ISODATE":"[^"]*"', '"C_ISODATE":"10:30"')
    line = (
        F.when(value < 0.25, no_date)
        .when(value < 0.5, "{not json")
        .when(value < 1.0, _syslog_record(without="PROGRAM"))
        .when(value < 1.5, F.concat(F.lit("["), record, F.lit("]")))
        .when(value < 2.0, F.concat(F.rtrim(_syslog_record(without="HOST"), F.lit("}")), F.lit(',"HOST":null}')))
        .otherwise(with_block)
    )
    rendered = with_once(events(spark, sf_dir), "line", line)
    return rendered.select("event_id", F.col("line").alias("value"))


def syslog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, accepted rows, numbered like the events they stem from."""
    parsed = parse_syslog(syslog_lines(spark, sf_dir), keep=["event_id"])
    good = split_rejects(parsed).accepted
    return good.withColumn("id", F.col("event_id") + 1).drop("event_id")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One syslog record per document, the whole text as its message."""
    docs = table(spark, sf_dir, "documents")
    stamp = F.lit("2024-01-01T00:00:00Z")
    record = F.struct(
        *(stamp.alias(k) for k in ("C_ISODATE", "R_ISODATE", "S_ISODATE")),
        F.lit("user").alias("FACILITY"),
        F.col("source").alias("HOST"),
        F.col("source").alias("HOST_FROM"),
        F.lit("notice").alias("PRIORITY"),
        F.col("lang").alias("PROGRAM"),
        F.lit("192.0.2.1").alias("SOURCEIP"),
        F.col("text").alias("MESSAGE"),
    )
    lines = docs.select("doc_id", F.to_json(record).alias("value"))
    good = split_rejects(parse_syslog(lines, keep=["doc_id"])).accepted
    return good.withColumn("id", F.col("doc_id")).drop("doc_id")


def _path(kind: str) -> Column:
    return _text(f"concat('/srv/logs/web/www', user_id % 4, '.example.com:443-{kind}.log')")


def access_lines(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """``(event_id, ts, path, value)``: common format for views and clicks, else combined."""
    line = F.expr(r"""
        CASE WHEN value < 1 THEN concat('garbage ', event_id) ELSE concat(
          CASE WHEN user_id % 2 = 0 THEN '81.2.69.' ELSE '10.9.8.' END, user_id % 250, ' - ',
          CASE WHEN event_type = 'signup' THEN 'frank' ELSE '-' END, ' [',
          CASE WHEN event_type = 'error'
               THEN concat(date_format(ts - INTERVAL '7' HOUR, 'dd/MMM/yyyy:HH:mm:ss'), ' -0700')
               ELSE concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000') END, '] "',
          CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, ' /item/', k, ' HTTP/1.1" ',
          CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 304 WHEN 'click' THEN 200
                          WHEN 'signup' THEN 302 ELSE 404 END, ' ',
          CASE WHEN event_type = 'view' THEN '-' ELSE CAST(100 + event_id % 5000 AS STRING) END,
          CASE WHEN event_type IN ('view', 'click') THEN ''
               ELSE concat(' "https://example.org/?u=', user_id, '" "agent/', k, ' (\\"quoted\\")"') END) END
    """)
    rendered = with_once(events(spark, sf_dir, deal), "line", line)
    return rendered.select("event_id", "ts", _path("access").alias("path"), F.col("line").alias("value"))


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, path, value)`` in the three layouts, by kind of event."""
    line = F.expr(r"""
        CASE WHEN value < 1 THEN concat('garbage ', event_id)
             WHEN event_type IN ('error', 'view') THEN concat(
               '[', date_format(ts, 'EEE MMM dd HH:mm:ss.SSSSSS yyyy'), '] [core:error] [pid ', 1000 + event_id,
               ':tid 140', event_id, '] [client 81.2.69.', user_id % 250, ':', 1024 + event_id % 5000, '] AH00',
               100 + k, ': File does not exist: /var/www/', k)
             WHEN event_type IN ('click', 'signup') THEN concat(
               '[', date_format(ts, 'EEE MMM dd HH:mm:ss yyyy'), '] [warn] [client 10.9.8.', user_id % 250,
               '] File does not exist: /var/www/', k)
             ELSE concat(
               date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [crit] ', 1000 + event_id, '#0: *', event_id,
               ' open() "/x/', k, '" failed (2: No such file or directory), client: 203.0.113.', user_id % 250,
               ', server: s', user_id % 4, '.example.com, request: "GET /x/', k, ' HTTP/1.1", host: "h', user_id % 4,
               '.example.com"') END
    """)
    rendered = with_once(events(spark, sf_dir), "line", line)
    return rendered.select("event_id", "ts", _path("error").alias("path"), F.col("line").alias("value"))


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_http_access(
        access_lines(spark, sf_dir), "web01", "www.example.com", 443, F.col("ts"), keep=["event_id"]
    )
    return rows.withColumn("id", F.col("event_id") + 1).drop("event_id")


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_http_error(
        error_lines(spark, sf_dir), "web01", "www.example.com", 443, F.col("ts"), keep=["event_id"]
    )
    return rows.withColumn("id", F.col("event_id") + 1).drop("event_id")


def _number(address: str) -> int:
    return sum(int(part) << shift for part, shift in zip(address.split("."), (24, 16, 8, 0)))


def raw_ranges(spark: SparkSession) -> DataFrame:
    rows = [(_number(low), _number(high), country) for low, high, country in RANGES]
    return spark.createDataFrame(rows, "start_ip bigint, end_ip bigint, country string")


def geo_ranges(spark: SparkSession) -> DataFrame:
    return prepare_ranges(raw_ranges(spark))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of two families, nested: one for each nation, one in it for each customer, a range that is no prefix."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    dealt = _dealt(customer, "k")  # Python reads each network
    country = """concat('{"country":{"iso_code":"N', n, '"}}')"""
    city = """concat('{"country":{"iso_code":"N', n, '"},"city":{"geoname_id":', k, '}}')"""
    kinds = [
        nation.selectExpr("concat('2001:db8:', lower(hex(n)), '::/48') AS network", f"{country} AS place"),
        nation.selectExpr("concat('10.', n, '.0.0/16') AS network", f"{country} AS place"),
        nation.selectExpr("concat('10.', n, '.0.7') AS first", "concat('10.', n, '.0.19') AS last", """concat('{"country":{"iso_code":"R', n, '"}}') AS place"""),
        dealt.selectExpr("concat('2001:DB8:', hex(n), ':0:', hex(k div 65536), ':', hex(k % 65536), '::/96') AS network", f"{city} AS place"),
        customer.where("k BETWEEN 1 AND 250").selectExpr("concat('10.', n, '.', k, '.0/24') AS network", f"{city} AS place"),
    ]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def addressed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, address)``: events with an address of their user's customer network or of near ones, in several spellings."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    rows = _dealt(table(spark, sf_dir, "events"), "event_id").select("event_id", (F.col("user_id") + 1).alias("k"))
    address = F.expr("""
        CASE event_id % 8
          WHEN 0 THEN concat('2001:db8:', lower(hex(n)), ':0:0:', lower(hex(k)), '::', lower(hex(event_id % 4096)))
          WHEN 1 THEN concat('2001:0DB8:', lpad(hex(n), 4, '0'), ':0000:0000:', lpad(hex(k), 4, '0'), ':0000:0001')
          WHEN 2 THEN concat('2001:db8:', lower(hex(n)), ':ffff::', lower(hex(event_id % 4096)))
          WHEN 3 THEN concat('10.', n, '.0.', event_id % 32)
          WHEN 4 THEN concat('10.', n, '.', k, '.', event_id % 256)
          WHEN 5 THEN concat('::ffff:10.', n, '.', k, '.9')
          WHEN 6 THEN '2001:db9::1' ELSE 'unknown' END""")
    return rows.join(customer, "k").select((F.col("event_id") + 1).alias("id"), address.alias("address"))


def zoneless(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times, for comparison with tables that have no zone."""
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    )
