from pyspark.sql import functions as F

from cedarlog.functions.text import address_bytes, is_ip


def test_dotted_tails_are_bytes(spark):
    """Each part of an IPv6 address's dotted tail is at most 255."""
    texts = ["::ffff:10.3.1400.9", "::ffff:256.0.0.1", "::ffff:10.3.0.999", "::ffff:10.3.255.9", "64:ff9b::192.0.2.33", "10.3.1400.17"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    got = {r.a: (r.ip, r.known) for r in rows.select("a", is_ip(F.col("a")).alias("ip"), address_bytes(F.col("a")).isNotNull().alias("known")).collect()}
    assert got == {t: (t in texts[3:5], t in texts[3:5]) for t in texts}
