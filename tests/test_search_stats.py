import datetime as dt

import pytest

from cedarlog.operators import stats
from cedarlog.operators.search import after, display, search, tail, to_json_lines, to_tsv
from cedarlog.sources.sinks import write_json_lines, write_tsv


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 5 == 0 else f"p{i % 3}", "h", f'{{"MESSAGE":"m{i}"}}') for i in range(1, 31)]
    return spark.createDataFrame(data, "id bigint, program string, host string, raw string").selectExpr(
        "*", "timestamp'2024-01-30 00:00:00Z' - make_interval(0,0,0,id) AS s_isodate"
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_newest_and_oldest(rows):
    assert ids(search(rows, "syslog", limit=3)) == [30, 29, 28]
    assert ids(search(rows, "syslog", limit=2, asc=True, program="p1")) == [1, 4]
    assert len(ids(search(rows, "syslog", limit=0))) == 20
    assert len(ids(search(rows, "syslog", limit=None))) == 20


def test_tail_and_cursor(rows):
    assert ids(tail(rows, "syslog", lines=3)) == [28, 29, 30]
    assert len(ids(tail(rows, "syslog", lines=-1))) == 10
    assert ids(after(rows, "syslog", 26, program="p1")) == [28]


def test_display(rows):
    assert display(rows, "syslog").columns == ["time", "host", "program", "message"]
    assert display(rows, "syslog", with_id=True).first().message == "m1"
    with pytest.raises(ValueError):
        display(rows, "syslog", "nope")


def test_tsv(spark, tmp_path):
    frame = spark.createDataFrame(
        [(5, "t", "h", "p", "two\nlines\t\r\nhere"), (6, None, ' "h" ', "\\p", "")], "id int, time string, a string, b string, c string"
    )
    want = ["5\tt\th\tp\ttwo lines here", '6\t\t "h" \t\\p\t']
    assert [r.line for r in to_tsv(frame).collect()] == want
    write_tsv(frame.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().split("\n")[:-1] == ["id\ttime\ta\tb\tc", *want]


def test_json_lines(rows, tmp_path):
    assert to_json_lines(rows).columns == ["line"]
    write_json_lines(rows.filter("id = 3"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == '{"MESSAGE":"m3"}\n'


def test_stats_order(rows):
    got = [(r["key"], r["count"]) for r in stats.stats(rows, "syslog").collect()]
    assert got == [("p0", 8), ("p1", 8), ("p2", 8), (None, 6)]
    tied = rows.filter("id <= 12").filter("program IS NULL OR program <> 'p0'")
    tied = tied.filter("program IS NULL OR id IN (1, 4, 2, 8)")
    assert [r["key"] for r in stats.stats(tied, "syslog").collect()] == ["p1", "p2", None]
    assert stats.shown_key(stats.stats(rows, "syslog")).collect()[-1]["key"] == "(null)"
    assert stats.stats(rows, "syslog", limit=1).count() == 1


def test_stats_arguments(rows):
    for bad in ({"by": "raw"}, {"column": "raw"}, {"since": "1d"}):
        with pytest.raises(ValueError):
            stats.stats(rows, "syslog", **bad)


def test_stats_does_not_read_raw(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    frame = stats.stats(spark.read.parquet(str(tmp_path / "t")), "syslog", by="program", since="90d", as_of=dt.datetime(2024, 1, 31))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan
