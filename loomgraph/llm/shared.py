"""Tables in the folder that driver and executors share, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Spark's setting that removes the shuffle files of a finished execution.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _OWN[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new shared Parquet table and read it back: lineage ends there, so a lost
    executor costs a re-read. The table's rows keep no partitioning, so that joins on them shuffle
    directly and adaptive execution can split their hot keys. No later job asks for the shuffle files
    behind the table again, so they are removed with its writing and not at some later collection."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path  # type: ignore[attr-defined]
    return out


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(n for n in (f"{stem}_{k}" for k in range(len(taken) + 1)) if n not in taken)


def numbered(df: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """``df`` with a number for each row that stays the same whenever it is read, and the name of their column.

    Rows of Parquet files are numbered by file, in the order of the names, and by place in it; other rows are staged.
    """
    name = free_name("row", df)
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            file, place = free_name("file", df), free_name("place", df)
            placed = df.withColumn(file, F.col("_metadata.file_path")).withColumn(place, F.col("_metadata.row_index"))
            files = placed.select(F.col(file).alias("of")).distinct().withColumn("number", F.row_number().over(W.orderBy("of")))
            #: 2**38 rows to a file and 2**25 files.
            number = F.shiftleft(F.col("number").cast("long"), 38) + F.col(place)
            return placed.join(stage(files, label), F.col(file) == F.col("of")).select(*df.columns, number.alias(name)), name
        except AnalysisException:
            pass
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label), name


def discard(df: DataFrame) -> None:
    """Delete a staged table that no result refers to any more."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def realign(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an aggregated table by a hash of its join key, which is unique in it, so that the join adds an exchange
    of its own to both sides; only then can adaptive execution split a hot key of the other side."""
    return df.repartition(F.xxhash64(*keys))
