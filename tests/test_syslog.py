import json

import pytest
from pyspark.sql import functions as F

from cedarlog.operators import rules
from cedarlog.operators.geo import prepare_ranges
from cedarlog.operators.syslog import ingest_report, ingest_syslog, parse_syslog, split_rejects
from cedarlog.plans.fixtures import raw_ranges

RECORD = {
    "C_ISODATE": "2026-07-15T00:00:00Z",
    "R_ISODATE": "2026-07-15T00:00:00Z",
    "S_ISODATE": "2026-07-15T00:00:00Z",
    "FACILITY": "auth",
    "HOST": "gate",
    "HOST_FROM": "gate",
    "PRIORITY": "info",
    "PROGRAM": "sshd",
    "SOURCEIP": "10.0.0.1",
    "MESSAGE": "Failed password for invalid user opal from 203.0.113.77 port 48123 ssh2",
}


def line(**changes):
    return json.dumps({k: v for k, v in {**RECORD, **changes}.items() if v is not ...})


@pytest.mark.parametrize(
    ("changes", "pid"),
    [
        ({}, None),
        ({"PID": "25446"}, 25446),
        ({"PID": 25446}, 25446),
        ({"PID": "7120033.250117"}, None),
        ({"PID": "notanumber"}, None),
        ({"PID": " 42"}, None),
        ({"PID": "+5"}, None),
        ({"PID": "5\n"}, None),
        ({"PID": "9223372036854775807"}, 9223372036854775807),
        ({"PID": "9223372036854775808"}, None),
    ],
)
def test_pid(lines, changes, pid):
    text = line(**changes)
    row = parse_syslog(lines(text)).first()
    assert row.reject_reason is None
    assert row.pid == pid
    assert row.raw == text


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("{ not valid json", "not valid JSON"),
        (line() + " x", "not valid JSON"),
        (line() + ',"end"] {}', "not valid JSON"),
        (line() + line(), "not valid JSON"),
        (line().replace('"', "'"), "not valid JSON"),
        ("[" + line() + "]", "not a JSON object"),
        ('"text"', "not a JSON object"),
        ("null", "not a JSON object"),
        (line(PROGRAM=...), "PROGRAM is missing"),
        (line(HOST=None), "HOST is missing"),
        (line(R_ISODATE="yesterday-ish"), "R_ISODATE is not a time"),
        (line(PRIORITY="p" * 65, PROGRAM="q" * 300), None),
        (line(C_ISODATE="10:30"), "C_ISODATE is not a time"),
        (line(S_ISODATE="2026-07"), "S_ISODATE is not a time"),
        (line(SOURCEIP="10.0.0.256"), "SOURCEIP is not an address"),
        (line(SOURCEIP="2001:db8::1"), None),
        (line(SOURCEIP="::ffff:10.0.0.1"), None),
        (line(SOURCEIP="1::2::3"), "SOURCEIP is not an address"),
        (line(SOURCEIP="1:2:3:4:5:6:7:8"), None),
        (line(SOURCEIP="1:2:3"), "SOURCEIP is not an address"),
        ("  " + line() + " \t", None),
    ],
)
def test_rejects(lines, text, reason):
    assert parse_syslog(lines(text)).first().reject_reason == reason


def test_good_rows_survive_bad_ones(lines):
    parsed = parse_syslog(lines(line(), "{", "  ", "\t", line(HOST="b")))
    good, bad = split_rejects(parsed)
    assert sorted(r.host for r in good.collect()) == ["b", "gate"]
    assert [r.raw for r in bad.collect()] == ["{"]
    assert ingest_report(parsed).first().asDict() == {"ingested": 2, "total": 3}


def test_repeated_key_keeps_the_last(lines):
    text = line()[:-1] + ',"HOST":"last"}'
    row = parse_syslog(lines(text)).first()
    assert row.host == "last"
    assert json.loads(row.raw) == {**RECORD, "HOST": "last"}
    assert row.raw.count('"HOST"') == 1


def test_time_zone_is_honoured(lines):
    row = parse_syslog(lines(line(S_ISODATE="2026-07-15T02:00:00+02:00"))).select(
        F.col("s_isodate").cast("string").alias("s")
    ).first()
    assert row.s == "2026-07-15 00:00:00"


@pytest.mark.parametrize("program", ["sshd", "sshd-session"])
def test_enriched(lines, program):
    row = ingest_syslog(lines(line(PROGRAM=program)), rules.SSHD).first()
    assert json.loads(row.raw) == {
        **RECORD,
        "PROGRAM": program,
        "enriched": {"ssh_user": "opal", "ssh_src_ip": "203.0.113.77", "ssh_src_port": 48123},
    }
    assert row.raw.startswith(line(PROGRAM=program)[:-1] + ',"enriched":{"ssh_src_ip"')


def test_old_block_is_replaced(lines):
    row = ingest_syslog(lines(line(enriched={"old": 1})), rules.SSHD).first()
    assert set(json.loads(row.raw)["enriched"]) == {"ssh_user", "ssh_src_ip", "ssh_src_port"}
    assert row.raw.count("enriched") == 1


def test_enriched_with_country(spark, lines):
    table = prepare_ranges(raw_ranges(spark))
    frame = lines(line(), line(MESSAGE="Failed password for root from 10.0.0.1 port 1 ssh2"), line(PROGRAM="cron"))
    blocks = [json.loads(r.raw).get("enriched") for r in ingest_syslog(frame, rules.SSHD, ranges=table).collect()]
    found = {b["ssh_user"]: b.get("geoip") for b in blocks if b}
    assert found == {"opal": {"ssh_src_ip": {"country": {"iso_code": "AU"}}}, "root": None}
    assert len(blocks) == 3


def test_not_enriched(lines):
    cron = line(PROGRAM="cron")
    assert ingest_syslog(lines(cron), rules.SSHD).first().raw == cron
    assert ingest_syslog(lines(line())).first().raw == line()
