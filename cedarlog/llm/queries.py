"""The operators as queries over the whole given tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cedarlog
import corpus_pipeline
from cedarlog.llm import (
    decontaminate,
    fixity,
    line_dedup,
    ngram_join,
    packing,
    quality_model,
    quality_rules,
    resampling,
    site_template,
    toxicity,
    transducer,
    wavelet,
    whitening,
)
from cedarlog.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application.

    The package goes to the shared folder as a zip file, and from there to the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(cedarlog.__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    uri = f"{scratch_path(spark, 'package')}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(uri)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    stream = files.create(target)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    context.addPyFile(files.makeQualified(target).toString())
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages as records of archive files, and a second replica of which some were damaged.

    256 page ids go to a file, records stand in the order of their ids; pages without
    an id go to files by a hash. In the second replica, by the page id modulo 101: 3 has a byte changed, 5 is cut off by its last line ends, 7 is gone; and
    11 is stored once more past the end of its file.
    """
    record = fixity.warc_record(F.col("url"), F.lit("2024-01-01T00:00:00Z"), F.col("html"))
    file = F.coalesce(F.floor(F.col("page_id") / 256).cast("string"), F.concat(F.lit("null-"), F.pmod(F.xxhash64("url", "html"), F.lit(4096))))
    order = Window.partitionBy("file").orderBy("page_id", "url", "payload").rowsBetween(Window.unboundedPreceding, 0)
    sized = pages.select("page_id", F.concat(F.lit("part-"), file).alias("file"), record.alias("payload"), "url").withColumn(
        "size", F.octet_length("payload").cast("long")
    )
    first = sized.select("file", "page_id", "payload", "size", (F.sum("size").over(order) - F.col("size")).alias("offset"))
    mark = F.pmod(F.col("page_id"), F.lit(101))
    damaged = F.when(mark == 3, F.concat(F.lit("w"), F.expr("substring(payload, 2)"))).when(mark == 5, F.rtrim(F.col("payload"), F.lit("\r\n")))
    second = first.withColumn("payload", damaged.otherwise(F.col("payload")))
    kept = second.where(~F.coalesce(mark == 7, F.lit(False)))
    extra = second.where(mark == 11).withColumn("offset", F.col("offset") + 10_000_000_000)
    return first, kept.unionByName(extra)


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(*replicas(table(spark, sf_dir, "pages")))


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over the categories that ``labels`` has: low quality first, then toxic."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return wavelet.read_documents(files)


def op8_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op9_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_host_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract_text(table(spark, sf_dir, "pages")).drop("n_template")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _with_package(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    named = (
        op1_fuzzy_line_dedup,
        op2_merkle_fixity,
        op3_positional_index,
        op4_toxicity_chain,
        op5_fourier_quality,
        op6_min_bin_slack,
        op7_wavelet_tokens,
        op8_transducer_counts,
        op9_bayes_jaccard_join,
        op10_host_quality_rules,
        op11_site_template,
        op12_importance_resampling,
        op13_qdwh_whitening,
        pipeline,
    )
    return {f.__name__: _with_package(f) for f in named}
