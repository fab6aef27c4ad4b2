import pytest
from pyspark.sql import functions as F

from cedarlog.functions.patterns import java_pattern
from cedarlog.operators.filters import build_filter

# pattern, texts it is found in, texts it is not found in
CASES = [
    (r"a.c", ["abc", "a\nc", "xa.cx"], ["ac"]),
    (r"^ab$", ["ab"], ["ab\n", "\nab", "xab"]),
    (r"(?n)^ab$", ["ab\n", "x\nab", "ab"], ["xab"]),
    (r"(?n)a.b", ["axb"], ["a\nb"]),
    (r"(?p)a[^x]b", ["ayb"], ["a\nb", "axb"]),
    (r"(?w)^b.*d$", ["a\nb\nd\ne"], ["ab"]),
    (r"a[^x]b", ["a\nb"], ["axb"]),
    (r"\mcat\M", ["a cat.", "cat"], ["scat", "cats", "_cat"]),
    (r"[[:<:]]cat[[:>:]]", ["cat-1"], ["cat1"]),
    (r"\ycat", ["cats"], ["scat"]),
    (r"\Ycat", ["scat"], ["cat", "a cat"]),
    (r"\Acat\Z", ["cat"], ["cat\n", "a cat"]),
    (r"a\bc", ["a\bc"], ["ac", "a c"]),
    (r"a\Bc", ["a\\c"], ["ac"]),
    (r"\x41!\103\e", ["A!C\x1b"], ["A!C"]),
    (r"\cA\v", ["\x01\x0b"], ["\x01\n"]),
    (r"[[:alpha:]_]+[[:digit:]]", ["é1", "_2"], ["1", "a"]),
    (r"^[[:upper:]][[:lower:]]$", ["Éa"], ["aa", "ÉA"]),
    (r"^[[:punct:]]+$", [".,!?"], ["a."]),
    (r"^[]a-]+$", ["]-a"], ["b", ""]),
    (r"^[^]]$", ["a", "["], ["]"]),
    (r"^[a\]&&b\d]+$", ["]&a7b"], ["c", "\\"]),
    (r"^[[=a=][.b.]]$", ["a", "b"], ["=", "."]),
    (r"^[\w.]+$", ["a_1.é"], ["a b"]),
    (r"^\W\D\S$", ["-ab"], ["aab", "-1b", "-a "]),
    (r"(?i)STRASSE|ÉCOLE", ["strasse", "école"], ["straße"]),
    (r"a{2}?b{1,}", ["aab", "aabbb"], ["ab"]),
    (r"^a{0,2}$", ["", "aa"], ["aaa"]),
    (r"a{x}", ["a{x}"], ["ax"]),
    (r"^(ab|c)\1$", ["abab", "cc"], ["abc"]),
    (r"(a)(b)\2\1", ["abba"], ["abab"]),
    (r"^(?:a|)b$", ["ab", "b"], ["a"]),
    (r"a(?=b)(?!bc)", ["abd"], ["abc"]),
    (r"(?<=x)a(?<!ya)", ["xa"], ["a"]),
    (r"(?x) a b # c" + "\n d", ["abd"], ["a b d"]),
    (r"a(?#remark)b", ["ab"], ["aremarkb"]),
    (r"***=a.c*", ["xa.c*"], ["abc"]),
    (r"(?q)a.c", ["a.c"], ["abc"]),
    (r"***:^a$", ["a"], ["ab"]),
    (r"(?e)a\.b[\d]", ["a.b\\", "a.bd"], ["a.b1"]),
    (r"", ["", "x"], []),
    (r"\.\-\/\é", [".-/é"], ["x"]),
    ("a\n#b c", ["a\n#b c"], ["ab"]),
]


def test_patterns_find_what_the_dialect_finds(spark):
    rows = [(java_pattern(p), p, t, found) for p, yes, no in CASES for texts, found in ((yes, True), (no, False)) for t in texts]
    got = spark.createDataFrame(rows, "java string, pattern string, text string, found boolean").withColumn("is", F.expr("text RLIKE java"))
    assert [(r.pattern, r.text, r.java) for r in got.collect() if r["is"] != r.found] == []


@pytest.mark.parametrize(
    "bad",
    ["a**", "a+*", "*a", "(*a)", "^*", "a|*", "a{2}{3}", "a{3,2}", "a{256}", "a{2", "(a", "a)", "[a", "[[:nope:]]", "[b-a]", "[a-[:alpha:]]", "\\q", "a\\",
     "(?<n>a)", "(?>a)", "a(?i)b", "(?b)a", "***a", r"\1", r"(a\1)", r"[\D]", r"\x", r"\u12", "[[.ab.]]", "\\my+\\m*"],
)
def test_what_the_dialect_does_not_allow(bad):
    with pytest.raises(ValueError):
        java_pattern(bad)
    with pytest.raises(ValueError):
        build_filter("syslog", field=f"k~{bad}")
