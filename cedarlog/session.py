"""Session settings the library relies on, and where it may put scratch data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the options the library relies on; all can change at run time.

    Log times are compared in UTC, and a repeated JSON key keeps its last value.
    Parsing makes long generated methods. The JVM only interprets those above
    8000 bytes, so stages that exceed it are better left unfused. Shuffle
    partitions, AQE and the like are left to whoever sized the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


#: Private folders of local sessions without ``spark.checkpoint.dir``, by application.
_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (unit tests) gets a private
    temporary folder; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _private:
        _private[application] = tempfile.mkdtemp(prefix="cedarlog-")
    return _private[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/cedarlog/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two passes must see the same rows in the same partitions. The
    copy survives the loss of any executor. Who gives a ``path`` can delete the
    copy when done with it.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counting stops one row past that."""
    return df.limit(rows + 1).count() <= rows
