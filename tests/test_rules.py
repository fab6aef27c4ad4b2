import json
import random
import re

import pytest

from cedarlog.operators import rules as rules_module
from cedarlog.operators.rules import SSHD, Field, Rule, as_records, enrich_explain, enrich_fields, enrich_full, literal_runs, rule_coverage

LINE = '{"PROGRAM":"sshd-session","MESSAGE":"Failed password for invalid user opal from 203.0.113.77 port 48123 ssh2"}'


def test_fields_only(lines):
    got = json.loads(enrich_fields(as_records(lines(LINE)), SSHD).first().fields)
    assert got == {"ssh_user": "opal", "ssh_src_ip": "203.0.113.77", "ssh_src_port": 48123}


def test_full(lines):
    got = json.loads(enrich_full(as_records(lines(LINE)), SSHD).first().raw)
    assert got["PROGRAM"] == "sshd-session"
    assert got["MESSAGE"].startswith("Failed password")
    assert got["enriched"]["ssh_user"] == "opal"


def test_full_without_match(lines):
    frame = as_records(lines("this does not match any rule", ""), program="sshd-session")
    assert [json.loads(r.raw) for r in enrich_full(frame, SSHD).collect()] == [
        {"MESSAGE": "this does not match any rule", "PROGRAM": "sshd-session"}
    ]
    assert enrich_fields(frame, SSHD).first().fields == "{}"


def test_explain(lines):
    row = enrich_explain(as_records(lines(LINE)), SSHD).first()
    assert (row.matched, row.rule) == (True, "sshd")
    assert json.loads(row.fields)["ssh_user"] == "opal"
    row = enrich_explain(as_records(lines("nothing")), SSHD).first()
    assert (row.matched, row.rule, row.fields) == (False, None, None)


def test_first_match_wins_and_control_characters_survive(lines):
    rules = (
        Rule("a", r"x=(\S+)(?: y=(\S+))?", (Field("x", 1), Field("y", 2))),
        Rule("b", r"x=", (Field("z", 0),)),
    )
    frame = as_records(lines("pre x=1 post", "x=\x01q y=2", "y=3"))
    got = sorted(r.fields for r in enrich_fields(frame, rules).collect())
    assert [json.loads(g) for g in got] == [{"x": "1"}, {"x": "\x01q", "y": "2"}, {}]


def test_coverage(spark):
    rows = spark.createDataFrame([("sshd", LINE), ("sshd", LINE), ("cron", "{}"), ("sshd", '{"MESSAGE":"x"}')], "program string, raw string")
    got = {(r.program, r.rule, r.matched): r.n for r in rule_coverage(rows, SSHD).collect()}
    assert got == {("sshd", "sshd", True): 2, ("cron", None, False): 1, ("sshd", None, False): 1}


@pytest.mark.parametrize(
    ("pattern", "runs"),
    [
        (r"^Failed \S+ for (x)?user", ["Failed ", " for ", "user"]),
        (r"ab*c+d?e{2}f", ["a", "c", "f"]),
        (r"a[bc]d[]x]e[^]y]f\.g", ["a", "d", "e", "f.g"]),
        (r"a|b", []),
        (r"(a|b)c", ["c"]),
        (r"(?i)abc", []),
        (r"(?:a)bc\d\/", ["bc", "/"]),
        (r"a[[:x:]]", []),
        ("", []),
    ],
)
def test_literal_runs(pattern, runs):
    assert [run for _, run in literal_runs(pattern)] == runs


def many_rules(rnd, n):
    """Rules of several kinds of gates, some of which overlap, with fields of all types."""
    out = []
    for k in range(n):
        gate = rnd.choice([None, rf"\Aprog{k % 7}", rf"\Aprog{k % 7}-x", rf"^prog{k % 7}$", r"og[23]", rf"\Aprog[{k % 7}]"])
        pattern = rnd.choice([rf"word{k % 40} id=(\d+)(?: by (\w+))?", rf"^start{k % 9} (\S+)()", rf"(?i)UPPER{k % 30} (\S*) ?(\S*)", rf"a{k % 20}|b{k % 20}()()"])
        fields = (Field("n", 1, rnd.choice(["long", "string", "double"])), Field(f"who{k % 3}", 2), Field("all", 0))
        groups = re.compile(pattern).groups
        out.append(Rule(f"rule{k}", pattern, tuple(f for f in fields if f.group <= groups and f.group), gate))
    return [r for r in out if r.fields]


def test_many_rules_match_as_few_do(spark, monkeypatch):
    rnd = random.Random(6)
    rules = many_rules(rnd, 120)
    words = [f"word{k} id={k * 7}" for k in range(45)] + [f"start{k} x\\u0001y" for k in range(10)] + [f"upper{k} q r" for k in range(32)] + ["a3", "b19", "nothing", ""]
    rows = [json.dumps({"PROGRAM": f"prog{rnd.randrange(9)}{rnd.choice(['', '-x', 'z'])}", "MESSAGE": rnd.choice(words) + rnd.choice([" by me", "", " é"])}).replace("\\\\u", "\\u")
            for _ in range(1500)] + ['{"MESSAGE":"word3 id=4"}', "{}", "no"]
    frame = as_records(spark.createDataFrame([(r,) for r in rows], "value string"))

    def run():
        return sorted(((r.raw, r.matched, r.rule, r.fields) for r in enrich_explain(frame, rules).collect()), key=repr)

    many = run()
    monkeypatch.setattr(rules_module, "MANY", 1000)
    few = run()
    assert [(r[:3], json.loads(r[3] or "0")) for r in many] == [(r[:3], json.loads(r[3] or "0")) for r in few]
    assert len({str(r[2]) for r in many}) > 30


def test_addresses_of_many_rules(spark, monkeypatch):
    """Which group is the address depends on the rule."""
    from cedarlog.operators.networks import prepare_networks

    rules = [Rule(f"r{k}", rf"m{k} (\S+) (\S+)", (Field("peer", 1 + k % 2, ip=True), Field("other", 2 - k % 2))) for k in range(20)]
    table = prepare_networks(spark.createDataFrame([("2001:db8::/32", '{"country":{"iso_code":"IS"}}')], "network string, place string"))
    rows = as_records(spark.createDataFrame([(f"m{k} " + ("2001:db8::1 x" if k % 2 == 0 else "x 2001:db8::1"),) for k in range(20)], "value string"))
    for limit in (rules_module.MANY, 100):
        monkeypatch.setattr(rules_module, "MANY", limit)
        got = [json.loads(r.raw)["enriched"] for r in rules_module.enrich(rows, rules, ranges=table).collect()]
        assert len(got) == 20 and all(g["geoip"]["peer"]["country"]["iso_code"] == "IS" and g["other"] == "x" for g in got)
