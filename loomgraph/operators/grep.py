"""Search in source text with context, and containment joins (J-5, J-6, O-91, O-93, O-94)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_BYTES = 256 * 1024
SHOWN = 2000


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, line_no, line) from files; those with NUL bytes are not text, and longer lines than LINE_BYTES are skipped. Numbers count from 0."""
    own = files.where(~F.contains(F.col(text), F.lit("\0")))
    out = own.select("path", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return out.where(F.octet_length("line") <= LINE_BYTES)


def grep(files: DataFrame, pattern: str, context: int = 0, per_file: int | None = None, overall: int | None = None, text: str = "text") -> DataFrame:
    """O-93, O-94: (path, line_no, line, is_match) of lines that match and ``context`` (at most 10) lines around them.

    Caps count matches in path and line order; context belongs to matches that are kept. Windows run within files only, and
    only the overall cap ranks matches across files. Lines are cut to 2,000 characters.
    """
    context = min(context, 10)
    rows = lines(files, text).withColumn("hit", F.col("line").rlike("(?ms)" + pattern))
    if overall is not None:
        #: Matches before a file are a prefix sum over files that have any; within the file they are counted in line order.
        per = rows.where("hit").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        kept = F.least(F.col("n"), F.lit(per_file)) if per_file is not None else F.col("n")
        sums = per.select(F.col("path").alias("p"), (F.sum(kept).over(W.orderBy("path")) - kept).alias("before"))
        own = rows.join(sums, F.col("path") == F.col("p"))
    else:
        own = rows.withColumn("before", F.lit(0))
    nth = F.sum(F.col("hit").cast("long")).over(W.partitionBy("path").orderBy("line_no"))
    keep = F.col("hit")
    ranked = own.withColumn("nth", nth)
    if per_file is not None:
        keep = keep & (F.col("nth") <= per_file)
    if overall is not None:
        keep = keep & (F.col("before") + F.col("nth") <= overall)
    marked = ranked.withColumn("is_match", keep)
    around = W.partitionBy("path").orderBy("line_no").rowsBetween(-context, context)
    shown = marked.withColumn("near", F.max(F.col("is_match").cast("int")).over(around)).where("near = 1")
    return shown.select("path", "line_no", F.substring("line", 1, SHOWN).alias("line"), "is_match")


def containing(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-5, J-6, O-91: hits (path, line_no) with the smallest symbol whose lines hold them, then by name and id; others keep a null symbol."""
    spans = nodes.select(F.col("file_path").alias("path"), "memory_id", "symbol_name", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    inside = hits.select("path", "line_no").distinct().join(spans, "path").where("line_no between a and b")
    best = inside.groupBy("path", "line_no").agg(F.min_by(F.struct("memory_id", "symbol_name"), F.struct(F.col("b") - F.col("a"), "symbol_name", "memory_id")).alias("s"))
    return hits.join(best, ["path", "line_no"], "left").select(*hits.columns, F.col("s.memory_id").alias("memory_id"), F.col("s.symbol_name").alias("symbol_name"))


def field_usage(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """J-13: (memory_id, field, uses): lines of candidates (memory_id, line, already blanked) that use a field; ``fields`` (field) is a type's, few by nature."""
    joined = candidates.join(F.broadcast(fields), F.col("line").contains(F.col("field")))
    access = F.concat(F.lit(r"\.\s*\Q"), "field", F.lit(r"\E\b(?!\s*\()"))
    start = F.concat(F.lit(r"\b\Q"), "field", F.lit(r"\E\s*:(?!:)"))
    uses = joined.where(F.regexp_like("line", access) | F.regexp_like("line", start))
    return uses.groupBy("memory_id", "field").agg(F.count(F.lit(1)).alias("uses"))
