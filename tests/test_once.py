from pyspark.sql import functions as F

from cedarlog.functions.once import with_once
from cedarlog.operators.syslog import parse_syslog


def test_values_are_computed_once_by_a_projection(spark):
    """A generator's own expression is interpreted where a stage is too long to be fused."""
    texts = spark.range(3).select(F.concat(F.lit("a"), "id").alias("t"))
    found = with_once(texts, "x", F.upper("t")).filter("x = 'A1' OR x = 'A2'").select("x", F.reverse("x").alias("y"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(__once" in plan and plan.count("upper(") == 1
    assert sorted(r.y for r in found.collect()) == ["1A", "2A"]


def test_lines_are_parsed_few_times(spark, lines):
    """Whole line: check, members, keys; the enriched block comes with the members."""
    rows = parse_syslog(lines('{"a":1}')).filter(F.col("raw").contains("x") & F.col("raw").contains("y"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_object_keys(") + plan.count("invoke(JsonExpressionUtils.jsonObjectKeys(") <= 2
    assert "get_json_object" not in plan
