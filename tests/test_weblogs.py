import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from cedarlog.functions.text import access_time, canonical_ip, error_time, is_ip
from cedarlog.operators.filters import build_filter
from cedarlog.operators.geo import geoip_join
from cedarlog.operators.weblogs import parse_http_access, parse_http_error
from cedarlog.plans.fixtures import raw_ranges

TAGS = ("edge7", "shop.test", 8443, "2025-03-03 20:00:00")
COMBINED = (
    '198.51.100.23 - mira [03/Mar/2025:18:42:07 +0000] "PUT /shelf/9 HTTP/1.1" 201 77 "https://books.test/" "reader/3.1"'
)


def access(lines, *values):
    frame = parse_http_access(lines(*values), *TAGS)
    return [r.asDict() for r in frame.withColumn("req_isodate", F.col("req_isodate").cast("string")).collect()]


def error(lines, *values):
    frame = parse_http_error(lines(*values), *TAGS)
    return [r.asDict() for r in frame.withColumn("err_isodate", F.col("err_isodate").cast("string")).collect()]


def test_combined(lines):
    (row,) = access(lines, COMBINED)
    want = {
        "host": "edge7", "vhost": "shop.test", "vhost_port": 8443, "client_ip": "198.51.100.23", "auth": "mira",
        "method": "PUT", "request": "/shelf/9", "http_version": "1.1", "status": 201, "bytes": 77,
        "referrer": "https://books.test/", "user_agent": "reader/3.1", "req_isodate": "2025-03-03 18:42:07",
    }
    assert {k: row[k] for k in want} == want
    raw = json.loads(row["raw"])
    assert raw["MESSAGE"] == COMBINED
    assert raw["enriched"]["http_clientip"] == "198.51.100.23"


def test_common(lines):
    (row,) = access(lines, '172.20.4.9 - - [21/Jan/2025:05:06:07 +0000] "HEAD /up HTTP/1.1" 206 -')
    assert (row["status"], row["bytes"], row["referrer"], row["user_agent"]) == (206, None, None, None)


def test_other_lines_are_kept(lines):
    rows = access(lines, "words in no layout", "", "  \t", None)
    assert len(rows) == 1
    filled = {k for k, v in rows[0].items() if v is not None}
    assert filled == {"r_isodate", "host", "vhost", "vhost_port", "raw"}
    assert json.loads(rows[0]["raw"]) == {"MESSAGE": "words in no layout"}


def test_odd_requests(lines):
    stamp = "[21/Jan/2025:05:06:07 +0000]"
    rows = access(
        lines,
        f'10.0.0.1 - - {stamp} "\\x16\\x03" 400 0 "-" "-"',
        f'10.0.0.1 - - {stamp} "GET /old" 200 5 "-" "a \\"b\\" c"',
        f'10.0.0.1 - - {stamp} "GET /x HTTP/1.1" 200 5 "-" "{"m" * 20000}"',
        f'10.0.0.1 - - {stamp} "GET /\x01 HTTP/1.1" 200 5 "-" "ctl"',
    )
    by_agent = {r["user_agent"][:7]: r for r in rows}
    assert by_agent["-"]["request"] == "\\x16\\x03" and by_agent["-"]["method"] is None
    assert by_agent['a \\"b\\"']["request"] == "/old" and by_agent['a \\"b\\"']["http_version"] is None
    assert len(by_agent["mmmmmmm"]["user_agent"]) == 20000
    assert by_agent["ctl"]["request"] == "/\x01"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("04/Feb/2019:23:01:59 -0330", "2019-02-05 02:31:59"),
        ("04/fEB/2019:23:01:59+0000", "2019-02-04 23:01:59"),
        ("04/Fev/2019:23:01:59 +0000", None),
        ("42/Aug/2024:01:02:03 +0000", None),
        ("before lunch", None),
    ],
)
def test_access_time(lines, text, want):
    assert lines(text).select(access_time(F.col("value")).cast("string")).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2019/02/04 23:01:59", "2019-02-04 23:01:59"),
        ("Mon Feb 04 23:01:59 2019", "2019-02-04 23:01:59"),
        ("Mon Feb  4 23:01:59.654321 2019", "2019-02-04 23:01:59.654321"),
        ("Mon Fev 04 23:01:59 2019", None),
        ("at noon", None),
    ],
)
def test_error_time(lines, text, want):
    assert lines(text).select(error_time(F.col("value")).cast("string")).first()[0] == want


def test_apache24(lines):
    (row,) = error(
        lines,
        "[Mon Feb 04 23:01:59.654321 2019] [proxy:warn] [pid 771:tid 8812] [client 172.20.4.9:5050] AH00321:"
        " the backend is slow: /srv/app",
    )
    assert (row["loglevel"], row["pid"], row["code"], row["client_ip"]) == ("warn", 771, "AH00321", "172.20.4.9")
    assert row["err_isodate"] == "2019-02-04 23:01:59.654321"
    assert json.loads(row["raw"])["enriched"]["http_error_module"] == "proxy"


def test_apache24_ipv6(lines):
    (row,) = error(lines, "[Mon Feb 04 23:01:59 2019] [core:error] [pid 1] [client 2001:db8:7::9:443] AH00321: gone")
    assert row["client_ip"] == "2001:db8:7::9"


def test_apache22(lines):
    (row,) = error(
        lines, "[Mon Feb 04 23:01:59 2019] [notice] [client 172.20.4.9] index of /srv/pub is not shown"
    )
    assert (row["loglevel"], row["pid"], row["code"]) == ("notice", None, None)
    assert row["message"] == "index of /srv/pub is not shown"
    assert row["err_isodate"] == "2019-02-04 23:01:59"


def test_nginx(lines):
    (row,) = error(
        lines,
        '2019/02/04 23:01:59 [warn] 771#0: *15 upstream "app" timed out (110: slow), client:'
        ' 172.20.4.9, server: shop.test, request: "GET /cart HTTP/1.1", host: "shop.test"',
    )
    assert (row["loglevel"], row["pid"], row["server"]) == ("warn", 771, "shop.test")
    assert row["request"] == "GET /cart HTTP/1.1"
    assert row["message"] == 'upstream "app" timed out (110: slow)'


def test_other_error_line(lines):
    (row,) = error(lines, "words in no layout either", " ")
    assert {k for k, v in row.items() if v is not None} == {"r_isodate", "host", "vhost", "vhost_port", "raw"}


@pytest.mark.parametrize(("address", "country"), [("203.0.113.9", "AU"), ("172.20.4.9", None)])
def test_geoip_in_record(spark, lines, address, country):
    rows = parse_http_access(lines(COMBINED.replace("198.51.100.23", address)), *TAGS)
    row = geoip_join(rows, "http_clientip", raw_ranges(spark), ip_column="client_ip").first()
    block = json.loads(row.raw)["enriched"]
    assert block["http_verb"] == "PUT"
    if country is None:
        assert "geoip" not in block
    else:
        assert block["geoip"] == {"http_clientip": {"country": {"iso_code": country}}}


def test_values_of_any_width_are_kept(lines):
    host, auth, method = "h" * 300, "u" * 300, "M" * 40
    line = f'172.20.4.9 - {auth} [21/Jan/2025:05:06:07 +0000] "{method} /x HTTP/1.1" 200 5'
    row = parse_http_access(lines(line), host, "v" * 300).first()
    assert (row.host, row.vhost, row.auth, row.method) == (host, "v" * 300, auth, method)
    assert row.r_isodate is not None


def test_one_spelling_for_each_address(spark):
    rng = random.Random(4)
    cases = ["::", "::1", "0:0:0:0:0:0:0:1", "2001:DB8::0:1", "1::", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:0", "fe80::00ab", "10.0.0.1"]
    for _ in range(300):
        groups = [rng.choice(["0", "0", "0000", "00a", "BEEF", "1"]) for _ in range(8)]
        cases.append(":".join(groups))
    frame = spark.createDataFrame([(c,) for c in cases], "value string").where(is_ip(F.col("value")))
    got = {r[0]: r[1] for r in frame.select("value", canonical_ip(F.col("value"))).collect()}
    assert len(got) == len(set(cases))
    assert got == {c: str(ipaddress.ip_address(":".join(f"{int(g, 16):x}" for g in c.split(":")) if c.count(":") == 7 and "::" not in c else c)) for c in set(cases)}
    mapped = spark.createDataFrame([("::ffff:10.0.0.1",), ("0:0::FFFF:a00:1",)], "value string")
    assert len({r[0] for r in mapped.select(canonical_ip(F.col("value"))).collect()}) == 1


def test_addresses_match_in_any_spelling(lines):
    line = '2001:DB8:0:0::9 - - [21/Jan/2025:05:06:07 +0000] "GET / HTTP/1.1" 200 5'
    rows = parse_http_access(lines(line), *TAGS)
    assert rows.first().client_ip == "2001:db8::9"
    assert rows.filter(build_filter("http_access", client_ip="2001:0db8::0:9")).count() == 1
