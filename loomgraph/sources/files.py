"""Source trees as tables (O-01 to O-04, O-18, J-2)."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import SourceRefused
from loomgraph.functions import predicates as P


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as (path, content), by Spark's own reader; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "^/*\\Q" + base + "\\E/", "")
    return raw.select(rel.alias("path"), "content", "length")


def ignore_regex(patterns: list[str]) -> str:
    """One regex for simple ignore patterns: a name matches any component, one with a slash starts at the root, a final slash means directories."""
    parts = []
    for p in patterns:
        body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z").replace(".*", "[^/]*")
        parts.append(("^" if "/" in p.strip("/") or p.startswith("/") else "(^|.*/)") + body + ("/.*" if p.endswith("/") else "(/.*|$)"))
    return "|".join(f"(?:{p})" for p in parts)


def discover(files: DataFrame, languages: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """O-01: files with a registered language that no pattern ignores, with ``language``, in path order."""
    own = files.withColumn("language", P.language("path")).where("language is not null")
    if languages:
        own = own.where(F.col("language").isin(languages))
    if ignored:
        own = own.where(~F.col("path").rlike(ignore_regex(ignored)))
    return own.orderBy("path")


def directories(files: DataFrame) -> DataFrame:
    """O-02: directories to watch: those of source files and all above them."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    every = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(every).alias("directory")).distinct()


def file_records(files: DataFrame) -> DataFrame:
    """(path, hash, language, bytes) of contents."""
    return files.select("path", F.sha2("content", 256).alias("hash"), P.language("path").alias("language"), F.length("content").alias("bytes"))


def slice_source(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """O-18: (memory_id, source, refusal): the bytes of a node's span as text, or why not: missing, bad_span, not_utf8, hash_mismatch.

    Spans are byte ranges, so the cut is made on the binary column; the digest of the cut must be the node's.
    """
    joined = nodes.select("memory_id", "file_path", "content_hash", "start_byte", "end_byte").join(contents.select(F.col("path").alias("p"), "content"), F.col("file_path") == F.col("p"), "left")
    cut = F.substring("content", F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    bad = (F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte")) | (F.col("end_byte") > F.length("content"))
    text = F.try_validate_utf8(cut.cast("string"))
    refusal = (
        F.when(F.col("content").isNull(), F.lit("missing"))
        .when(F.coalesce(bad, F.lit(True)), F.lit("bad_span"))
        .when(text.isNull(), F.lit("not_utf8"))
        .when(F.sha2(cut, 256) != F.col("content_hash"), F.lit("hash_mismatch"))
    )
    return joined.select("memory_id", refusal.alias("refusal"), F.when(refusal.isNull(), text).alias("source"))


def read_page(sliced: DataFrame, memory_id: str, offset: int = 0, limit: int = 8000) -> str:
    """The read verb: ``limit`` characters (20,000 at most) of one symbol's source from ``offset``; raises if it is refused."""
    row = sliced.where(F.col("memory_id") == memory_id).select("refusal", F.substring("source", offset + 1, min(limit, 20_000)).alias("text")).head()
    if row is None:
        raise SourceRefused("missing")
    if row["refusal"]:
        raise SourceRefused(row["refusal"])
    return row["text"]
