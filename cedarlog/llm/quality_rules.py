"""Host-level quality rules, in DataFrame functions only.

Each text is measured and judged by base rules. The failures are counted per host,
the hosts' rates are shrunk towards a beta prior fitted to all hosts, and the hosts'
verdicts go back to their documents.

* NULL and empty texts have no words, so they fail the base rules.
* Documents without a host (NULL) are judged by the base rules alone.
* Repeated rows count once each and come back once each. An empty table gives no rows.
* ``id_col``, ``text_col`` and ``host_col`` are read; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm.rows import column, nested
from cedarlog.session import fits_broadcast, materialize

#: Hosts with a verdict against them that are sent to every task at most; beyond it both sides are shuffled.
BROADCAST_HOSTS = 100_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a plain column would be copied into every use."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(grams: Column) -> Column:
    """Words that lie in a 3-word window that the text has twice or more.

    Windows are sorted with their places; equal neighbours are repeats. Each
    repeat adds the words up to the next one, three at most: n log n for any text.
    """

    def repeats(order: Column) -> Column:
        again = F.filter(
            order,
            lambda w, i: (w["g"] == F.get(order, i + 1)["g"]) | ((i > 0) & (w["g"] == F.get(order, i - 1)["g"])),
        )
        return F.sort_array(F.transform(again, lambda w: w["i"]))

    def reach(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
            F.lit(0),
            lambda acc, n: acc + n,
        )

    order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return _let(order, lambda o: _let(repeats(o), reach))


def _windows(words: Column, join) -> Column:
    """``join`` of each three consecutive words."""
    inner = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(inner, lambda w, i: join(w, F.get(words, i + 1), F.get(words, i + 2)))


def _repeat_words(words: Column) -> Column:
    """As :func:`_covered`. Where all windows' hashes differ, no window repeats and nothing is sorted."""
    exact = _covered(_windows(words, lambda *w: F.concat_ws(" ", *w)))
    return _let(
        _windows(words, F.xxhash64),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact),
    )


def _replaced(text: Column, chars: str, by: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _words(text: Column) -> Column:
    return F.filter(F.split(_replaced(text, SPACES[1:], " "), " "), lambda w: w != "")


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; one row per row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("_text"))
    t = F.col("_text")
    words = _words(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("again")
        ),
    )
    found = base.select(
        "doc_id",
        "host",
        of_words.alias("_w"),
        (F.length(t) - F.length(_replaced(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return found.select(
        "doc_id", "host", F.col("_w.n").cast("long").alias("n_words"), F.col("_w.chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("_w.again").cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(judged: DataFrame, max_rate: float = 0.5, least_rows: int = 1) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_failed; one row per host.

    The prior is the beta distribution with the mean and variance of the hosts'
    rates, each host weighing alike and its binomial noise taken off (method of
    moments). Without spread, or with a single host, the prior weighs as much as a
    mean host. Counts are summed before the shuffle, so a host with a third of all
    rows costs one row per task.
    """
    counts = (
        judged.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    share = F.col("n_failed") / F.col("n_docs")
    moments = counts.agg(
        F.avg(share).alias("_mean"),
        F.coalesce(F.var_samp(share), F.lit(0.0)).alias("_var"),
        F.avg(share * (1 - share) / F.col("n_docs")).alias("_noise"),
        F.avg("n_docs").alias("_size"),
    )
    spread = F.col("_var") - F.col("_noise")
    room = F.col("_mean") * (1 - F.col("_mean"))
    weight = F.when((spread > 0) & (room > spread), room / spread - 1).otherwise(F.col("_size"))
    prior = moments.select(F.col("_mean"), weight.alias("_weight"))
    return (
        counts.crossJoin(F.broadcast(prior))  # one row by construction
        .withColumn("rate", (F.col("n_failed") + F.col("_mean") * F.col("_weight")) / (F.col("n_docs") + F.col("_weight")))
        .select("host", "n_docs", "n_failed", "rate", ((F.col("rate") > max_rate) & (F.col("n_docs") >= least_rows)).alias("host_failed"))
    )


def apply_host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The measures, ``base_failed``, ``host_failed`` and ``kept`` of each row.

    A host is rejected when its shrunk failure rate is over ``max_rate``. The
    measures, not the texts, are written once to the shared folder, since both the
    counts and the rows read them. Only rejected hosts take part in the join.
    """
    judged = materialize(
        text_measures(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed(min_words, max_repeat_percent)),
        "quality-measures",
    )
    bad = host_verdicts(judged, max_rate).where("host_failed").select("host", "host_failed")
    if fits_broadcast(bad, BROADCAST_HOSTS):
        joined = judged.join(F.broadcast(bad), "host", "left")
    else:
        joined = judged.join(bad, "host", "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        failed.alias("host_failed"), (~F.col("base_failed") & ~failed).alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host is not rejected; columns stay.

    Rows and their base verdicts are written once, so the texts are judged once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    failed = _let(
        _words(text), lambda w: (F.size(w) < min_words) | (100 * _repeat_words(w) > max_repeat_percent * F.size(w))
    )
    judged = materialize(docs.select(nested(docs), column(host_col).cast("string").alias("host"), failed.alias("base_failed")), "quality-judged")
    bad = host_verdicts(judged.select("host", "base_failed"), max_rate).where("host_failed").select("host")
    hosts = F.broadcast(bad) if fits_broadcast(bad, BROADCAST_HOSTS) else bad
    return judged.where(~F.col("base_failed")).join(hosts, "host", "left_anti").select("row.*")
