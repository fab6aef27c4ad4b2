import ipaddress
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cedarlog.functions.text import address_bytes
from cedarlog.operators import networks
from cedarlog.operators.geo import countries_of, geoip_join
from cedarlog.operators.networks import _bounds, _prefixes, places_of, prepare_networks

TABLE = "network string, first string, last string, place string"


def number(text):
    address = ipaddress.ip_address(text)
    return int(address) | 0xFFFF << 32 if address.version == 4 else int(address)


def test_bytes_of_addresses(spark):
    texts = ["::", "::1", "1::", "2001:DB8::a:0:1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "255.0.10.1", "0.0.0.0"]
    bad = ["1.2.3", "1.2.3.256", ":::", "1::2::3", "g::", "", None, "1:2:3"]
    got = spark.createDataFrame([(t,) for t in texts + bad], "t string").select("t", address_bytes(F.col("t")).alias("b")).collect()
    assert {r.t: r.b and int.from_bytes(r.b) for r in got} == {t: number(t) for t in texts} | dict.fromkeys(bad)
    assert all(r.b is None or len(r.b) == 16 for r in got)


def test_ranges_are_cut_into_their_prefixes():
    rnd = random.Random(4)
    for _ in range(200):
        low = rnd.getrandbits(rnd.choice([8, 40, 128]))
        high = min(low + rnd.getrandbits(rnd.choice([1, 9, 60, 120])), (1 << 128) - 1)
        at = low
        for first, length in _prefixes(low, high):
            assert first == at and first % (1 << (128 - length)) == 0
            at += 1 << (128 - length)
        assert at == high + 1
    assert _bounds("10.1.2.3/8", None, None) == (number("10.0.0.0"), number("10.255.255.255"))
    assert [_bounds(*x) for x in (("x", None, None), (None, "::2", "::1"), (None, None, None), (None, "1.1.1.1", "no"))] == [None] * 4


def random_networks(rnd):
    """Nested and overlapping networks and ranges of both families, close to each other."""
    rows = [("::/0", None, None, '{"n":"all"}')]
    for n in range(150):
        place = json.dumps({"n": n})
        if rnd.random() < 0.5:
            low = number("2001:db8::") + (rnd.getrandbits(6) << 90) + (rnd.getrandbits(3) << rnd.choice([16, 60, 64])) + rnd.getrandbits(4)
            length = rnd.choice([20, 32, 33, 44, 48, 56, 64, 65, 80, 112, 127, 128])
            rows.append((str(ipaddress.ip_network((low, length), strict=False)), None, None, place))
        elif rnd.random() < 0.5:
            low = (10 << 24) + rnd.getrandbits(18)
            rows.append((str(ipaddress.ip_network((low, rnd.choice([8, 12, 16, 20, 24, 30, 31, 32])), strict=False)), None, None, place))
        else:
            low = (10 << 24) + rnd.getrandbits(18)
            rows.append((None, str(ipaddress.ip_address(low)), str(ipaddress.ip_address(low + rnd.choice([0, 5, 700, 70_000]))), place))
    return rows


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_smallest_network_wins(spark, broadcast):
    rnd = random.Random(11)
    rows = random_networks(rnd)
    table = prepare_networks(spark.createDataFrame([*rows, ("bad", None, None, "{}"), ("::/1", None, None, None)], TABLE))
    bounds = [(*_bounds(a, b, c), p) for a, b, c, p in rows]
    points = [x + d for low, high, _ in bounds for x in (low, high) for d in (-1, 0, 1) if 0 <= x + d < 1 << 128]
    texts = [str(ipaddress.ip_address(p & 0xFFFFFFFF)) if p >> 32 == 0xFFFF and rnd.random() < 0.7 else str(ipaddress.IPv6Address(p)) for p in points]
    texts += ["nothing", None, "10.0.0.7", "10.0.0.7"]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, ip string")
    got = {r.n: r.place for r in places_of(frame, "ip", table, broadcast).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        if text in (None, "nothing"):
            assert got[n] is None
        else:
            at = number(text)
            assert got[n] == min((high - low, place) for low, high, place in bounds if low <= at <= high)[1], text
    assert table.groupBy("level", "bucket").count().agg(F.max("count")).first()[0] <= 65_536


def test_places_in_records(spark):
    place = '{"country":{"iso_code":"SE"},"city":{"names":{"en":"Umea"}}}'
    table = prepare_networks(spark.createDataFrame([("2001:db8::/32", place)], "network string, place string"))
    raw = ['{"enriched":{"peer":"2001:DB8::7","geoip":{"other":{"country":{"iso_code":"NO"}}}}}', '{"enriched":{"peer":"::1"}}', "{}"]
    rows = spark.createDataFrame([(t,) for t in raw], "raw string")
    got = [json.loads(r.raw) for r in geoip_join(rows, "peer", table).collect()]
    assert got[0]["enriched"]["geoip"] == {"other": {"country": {"iso_code": "NO"}}, "peer": json.loads(place)}
    assert got[1:] == [json.loads(t) for t in raw[1:]]
    frame = spark.createDataFrame([("2001:db8::1",), ("10.0.0.1",)], "ip string")
    assert [r.country for r in countries_of(frame, "ip", table).orderBy("ip").collect()] == [None, "SE"]


def test_no_networks(spark):
    table = prepare_networks(spark.createDataFrame([], TABLE))
    frame = spark.createDataFrame([("::1",)], "ip string")
    for broadcast in (True, False):
        assert [r.place for r in places_of(frame, "ip", table, broadcast).collect()] == [None]


def test_buckets_of_one_stretch_pass_together(monkeypatch):
    """They are most of a large table; only buckets with more are gone through one by one."""
    size = (65_535).to_bytes(16)
    alone = [(96, n.to_bytes(12), 0, 65_535, size, f"p{n}") for n in range(2_000)]
    nested = [(112, b"n" * 14, 0, 65_535, size, "wide"), (112, b"n" * 14, 8, 15, b"\0" * 16, "in it"), (112, b"n" * 14, 16, 23, b"\0" * 16, "in it")]
    names = ["level", "bucket", "low", "high", "size", "place"]
    table = pa.table(dict(zip(names, zip(*alone, *nested))), pa.schema(list(zip(names, [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()]))))
    calls, painted = [], networks._painted
    monkeypatch.setattr(networks, "_painted", lambda *given: calls.append(len(given[0])) or painted(*given))
    got = [tuple(r.values()) for b in networks._disjoint(iter(table.to_batches(max_chunksize=700))) for r in b.to_pylist()]
    owners = [(0, 7, 0), (8, 15, 1), (16, 23, 2), (24, 65_535, 0)]
    assert sorted(got) == sorted([*alone, *((*nested[k][:2], low, high, *nested[k][4:]) for low, high, k in owners)])
    assert calls == [3]


def test_rows_of_one_address_are_dealt_out(spark, monkeypatch):
    """Rows of a frequent text, of none and of one that is no address go to several tasks, each row once."""
    monkeypatch.setattr(networks, "HOT_ROWS", 10)
    table = prepare_networks(spark.createDataFrame([("10.0.0.0/8", "{}"), ("10.1.0.0/16", '{"n":1}')], "network string, place string"))
    texts = {"10.0.0.1": "{}", "10.1.0.1": '{"n":1}', "11.0.0.1": None, "unknown": None, None: None}
    asked = [(n, text) for n, text in enumerate([*texts] * 40)] + [(200, "10.2.0.0"), (200, "10.2.0.0")]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = places_of(spark.createDataFrame(asked, "n int, ip string"), "ip", table, False)
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted((r.n, str(r.ip), r.place) for r in got) == sorted((n, str(text), texts.get(text, "{}")) for n, text in asked)
    assert all(len({r.task for r in got if r.ip == text}) > 1 for text in texts)
