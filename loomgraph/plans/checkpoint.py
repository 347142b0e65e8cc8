"""Cutting the lineage of loops with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FALLBACK: list[str] = []

#: Spark's setting that removes the shuffle files of a finished execution.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a temporary folder where it is unset on a local master (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="loomgraph-core-"))
    return _FALLBACK[0]


def cut(df: DataFrame, label: str = "loop") -> DataFrame:
    """The rows of ``df`` as a written table: later rounds re-read them, also after an executor is lost."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path  # type: ignore[attr-defined]
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each execution go when it ends: for loops whose rounds are all written."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def is_cut(df: DataFrame) -> bool:
    return hasattr(df, "cut_path")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more; other frames are left alone."""
    for df in tables:
        if is_cut(df):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def placed(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the order of the columns, which must tell all rows apart.

    Rows are dealt by ranges and sorted within them, so no task sees all: only a count per range goes through one.
    """
    at = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    sizes = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    #: One row per range, so as many as there are partitions.
    both = at.withColumn("__part", part).join(F.broadcast(before), "__part")
    return both.select(*rows.columns, (F.col("__before") + F.col("__at") - F.shiftleft("__part", 33)).alias(name))
