import pytest
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.operators.syslog import ingest_report, parse_syslog
from cedarlog.plans.fixtures import raw_ranges
from cedarlog.sources.files import WebSet, file_outcomes, glob_text, local_path, openable, read_syslog_json, read_web_sets, tag_vhost, web_sets


def vhost(spark, web_set, path):
    name, port = tag_vhost(F.lit(path), web_set)
    return tuple(spark.range(1).select(name, port).first())


@pytest.mark.parametrize(
    ("web_set", "path", "want"),
    [
        (WebSet("s", "/srv/web/*/hits.log"), "/srv/web/shop.test/hits.log", ("shop.test", None)),
        (WebSet("s", "/srv/web/*-hits.log"), "/srv/web/shop.test:8443-hits.log", ("shop.test", 8443)),
        (WebSet("s", "/srv/*/hits.log", vhost_port=81), "/srv/c.d/hits.log", ("c.d", 81)),
        (WebSet("s", "/l/*/a.log", vhost="v", vhost_port=8443), "/l/x:1/a.log", ("v", 8443)),
        (WebSet("intranet", "/srv/all.log"), "/srv/all.log", ("intranet", None)),
        (WebSet("intranet", "/l/*.log"), "/l/.log", ("intranet", None)),
        (WebSet("intranet", "/l/*.log"), "/other/x.log", ("intranet", None)),
        (WebSet("s", "/l/v?+[1]/*"), "/l/v7+[1]/x", ("7x", None)),
    ],
)
def test_vhost(spark, web_set, path, want):
    assert vhost(spark, web_set, path) == want


def test_captures_are_joined(spark):
    assert spark.range(1).select(glob_text(F.lit("/srv/logs/alpha/beta.log"), "/srv/logs/*/*.log")).first()[0] == "alphabeta"
    assert spark.range(1).select(glob_text(F.lit("/a"), None)).first()[0] is None


def test_sets():
    config = {
        "geoip": "g", "state_dir": "/x", "pid_dir": "/y", "a": {"access": "/a"}, "b": {"error": "/b", "geoip": None},
        "c": "text",
    }
    assert [(s.name, s.geoip) for s in web_sets(config)] == [("a", "g"), ("b", None)]
    assert [s.name for s in web_sets(config, "b")] == ["b"]


def test_local_path(spark):
    got = spark.range(1).select(
        local_path(F.lit("file:///a/b%20c+d")), local_path(F.lit("/a/b")), local_path(F.lit("hdfs://n:1/a"))
    ).first()
    assert tuple(got) == ("/a/b c+d", "/a/b", "/a")


def test_read_syslog_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"A":1}\n\n   \n{"B":2}\r\n')
    frame = read_syslog_json(spark, [str(tmp_path / "one.json"), str(tmp_path / "missing.json")])
    assert frame.count() == 2
    assert ingest_report(parse_syslog(frame)).first().asDict() == {"ingested": 0, "total": 2}
    with pytest.raises(ValueError):
        read_syslog_json(spark, [])


def test_read_web_sets(spark, tmp_path):
    line = '81.2.69.142 - - [15/Jul/2026:12:00:00 +0000] "GET / HTTP/1.1" 200 12 "-" "curl/8"\n'
    for site in ("www.a.org", "www.b.org_8443"):
        (tmp_path / site).mkdir()
        (tmp_path / site / "access.log").write_text(line + "junk\n\n")
    (tmp_path / "www.a.org" / "error.log").write_text("junk\n")
    config = {
        "geoip": "g",
        "all": {"access": f"{tmp_path}/*/access.log", "error": f"{tmp_path}/*/error.log", "vhost_port": 80},
        "none": {"access": f"{tmp_path}/nothing/*.log"},
        "plain": {"access": f"{tmp_path}/www.a.org/access.log", "geoip": None},
    }
    rows = read_web_sets(spark, config, "web01", "2026-07-15 12:00:00", ranges={"g": raw_ranges(spark)})
    country = records.json_text(F.col("raw"), "enriched", "geoip", "http_clientip", "country", "iso_code")
    got = sorted(
        (r.vhost, r.vhost_port or 0, r.status or 0, r.country or "")
        for r in rows["access"].withColumn("country", country).collect()
    )
    assert got == [
        ("plain", 0, 0, ""),
        ("plain", 0, 200, ""),
        ("www.a.org", 80, 0, ""),
        ("www.a.org", 80, 200, "GB"),
        ("www.b.org_8443", 80, 0, ""),
        ("www.b.org_8443", 80, 200, "GB"),
    ]
    assert rows["error"].first().vhost == "www.a.org"


def test_unreadable_files_are_told_apart(spark, tmp_path):
    """Readable, blank and empty files, one that is no archive although its name says so, one that is not there."""
    (tmp_path / "a.json").write_text("{}\n{}\n")
    (tmp_path / "blank.json").write_text("\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "z.json.gz").write_bytes(b"no archive")
    asked = [f"{tmp_path}/*.json", f"{tmp_path}/z.json.gz", f"{tmp_path}/none.json"]
    got = {(r.path.rsplit("/", 1)[1], r.status, r.lines) for r in file_outcomes(spark, asked).collect()}
    want = {("a.json", "read", 2), ("blank.json", "read", 1), ("empty.json", "empty", 0), ("z.json.gz", "unreadable", 0), ("none.json", "missing", 0)}
    assert got == want
    with pytest.warns(UserWarning, match="none.json is missing"):
        assert read_syslog_json(spark, asked).count() == 2
    assert openable(spark, [f"{tmp_path}/none*"]) == ([], [(f"{tmp_path}/none*", "missing")])
    assert [r.status for r in file_outcomes(spark, f"{tmp_path}/none").collect()] == ["missing"]


def test_a_file_that_may_not_be_opened(spark, tmp_path, monkeypatch):
    """Others of its pattern are read."""
    for name in "abc":
        (tmp_path / f"{name}.json").write_text("{}\n")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path))
    kind = type(files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    ask = kind.__getattr__

    def access(self, name):
        real = ask(self, name)
        if name != "access":
            return real
        return lambda path, action: real(spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/nowhere") if "b.json" in path.toString() else path, action)

    monkeypatch.setattr(kind, "__getattr__", access)
    present, problems = openable(spark, f"{tmp_path}/*.json")
    assert [p.rsplit("/", 1)[1] for p in present] == ["a.json", "c.json"]
    assert [(p.rsplit("/", 1)[1], s) for p, s in problems] == [("b.json", "unreadable")]


def test_every_file_is_asked(spark, tmp_path, monkeypatch):
    """However many a pattern matches; an empty file that may not be opened is not called empty."""
    for n in range(10_001):
        (tmp_path / f"{n:05d}.json").touch()
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path))
    kind = type(files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    ask = kind.__getattr__

    def access(self, name):
        real = ask(self, name)
        if name != "access":
            return real
        nowhere = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/nowhere")
        return lambda path, action: real(nowhere, action) if "/07000.json" in path.toString() else None

    monkeypatch.setattr(kind, "__getattr__", access)
    present, problems = openable(spark, f"{tmp_path}/*.json")
    assert len(present) == 10_000
    assert [(p.rsplit("/", 1)[1], s) for p, s in problems] == [("07000.json", "unreadable")]
