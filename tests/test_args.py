import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cedarlog.functions.args import like_pattern, looks_numeric, parse_duration, parse_field


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12", dt.timedelta(days=12)),
        ("45d", dt.timedelta(days=45)),
        ("7h", dt.timedelta(hours=7)),
        ("55m", dt.timedelta(minutes=55)),
        ("19 s", dt.timedelta(seconds=19)),
        ("3W", dt.timedelta(weeks=3)),
    ],
)
def test_duration(text, want):
    assert parse_duration(text) == want


@pytest.mark.parametrize("text", ["4q", "", "-1d", "1.5h", "d", "5 d d"])
def test_bad_duration(text):
    with pytest.raises(ValueError):
        parse_duration(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("peer=198.51.100.7", ("peer", "=", "198.51.100.7")),
        ("mark!=ZX9", ("mark", "!=", "ZX9")),
        ("load >= 17", ("load", ">=", "17")),
        ("k==x", ("k", "=", "=x")),
        ("a.b<>", ("a.b", "<>", "")),
        ("u=~/admin\nx", ("u", "=~", "/admin\nx")),
        ("u!~^a", ("u", "!~", "^a")),
    ],
)
def test_field(text, want):
    assert parse_field(text) == want


@pytest.mark.parametrize("text", ["justtext", "=x", "a b=c", "é=1"])
def test_bad_field(text):
    with pytest.raises(ValueError):
        parse_field(text)


@pytest.mark.parametrize(("text", "want"), [("3120", 1), ("-7.25", 1), ("0", 1), ("0042", 0), ("8.1.3", 0), ("", 0), ("2e5", 0)])
def test_looks_numeric(text, want):
    assert looks_numeric(text) == bool(want)


@given(st.integers(-(10**30), 10**30))
def test_integers_look_numeric(n):
    assert looks_numeric(str(n))


def test_like_pattern():
    assert like_pattern(r"a\b\%\\c_") == r"ab\%\\c_"
    with pytest.raises(ValueError):
        like_pattern("a\\")
