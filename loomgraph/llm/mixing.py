"""Mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.shared import free_name, numbered, stage

WORD = r"[^\x20\x09-\x0D]+"


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only: 28 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Targets by source: shares of the total by weight, none above ``most`` times its source's size.

    ``sizes`` has one row per source (source, source_size). Sources are ranked by code point, null last,
    and ``weights`` repeat over the ranks. What a capped source cannot take is reshared by weight until
    no source is above its cap: sorted by cap over weight, the first source whose share of what is left
    stays below its cap, and all after it, are the uncapped ones.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (
        capped.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left") / F.sum("weight").over(rest))
        .withColumn("fits", F.col("share") * F.col("weight") <= F.col("cap"))
    )
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "share"))).over(W.partitionBy())
    return level.withColumn("level", first["share"]).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target")
    )


def systematic_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: str = "mix",
    block_rows: int = 4096,
    row: str | None = None,
) -> DataFrame:
    """Copies of every document in a mix of sources: (doc_id, source, size, source_size, target, copies, taken).

    Expected copies are the source's target over its size, alike for all its documents. They are summed
    along the source, one random offset is added, and a document is emitted once per integer boundary
    that its interval crosses. Documents stand in the order of their size class (eighths of a power of
    two), then block, size and key, so that the words taken come near the target too. The prefix sums
    have three levels: size classes of a source (some hundreds), blocks of about ``block_rows`` rows of a class,
    dealt by a hash of the key, both summed over counts alone, and rows within their block. No task sees a whole source.

    Null text has size 0; null sources are one source; documents of a source without any word get no
    copies; null keys and repeated rows count as rows of their own; an empty table gives an empty result.
    Reruns agree: order and offsets come from hashes of key and source. ``row`` may name a column that numbers the
    rows; it is handed on as ``row`` and decides between rows that agree in all else.
    """
    rows = docs.select(*([F.col(row).alias("row")] if row else []), F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mix_sizes(stage(rows, "sizes"), weights, most, seed, block_rows)


def mix_sizes(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: str = "mix", block_rows: int = 4096) -> DataFrame:
    """As :func:`systematic_mix`, from (doc_id, source, size) and, if there is one, row."""
    own = ["row"] if "row" in rows.columns else []
    named = rows.withColumn("part", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    bits = F.bin("size")
    classed = named.withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(totals.select("source", "source_size"), weights, most).withColumnRenamed("source", "t_source")
    targets = (
        targets.join(totals.select(F.col("source").alias("n_source"), "n_docs"), F.col("t_source").eqNullSafe(F.col("n_source")))
        .withColumn("part", F.coalesce(F.concat(F.lit("s"), "t_source"), F.lit("n")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_rows)).cast("int"))
        .withColumn("offset", fraction(F.lit(seed), F.col("part")))
        .select("part", "source_size", "target", "rate", "blocks", "offset")
    )
    targets = stage(targets, "targets")  # of known size: Spark broadcasts it below its own threshold only
    dealt = classed.join(targets, "part").withColumn("block", F.floor(fraction(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) * F.col("blocks")).cast("int"))
    sums = dealt.groupBy("part", "class", "block").agg(F.count(F.lit(1)).alias("in_block"))
    upto_class = W.partitionBy("part").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    upto_block = W.partitionBy("part", "class").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    classes = sums.groupBy("part", "class").agg(F.sum("in_block").alias("in_class"))
    bases = classes.select("part", "class", F.coalesce(F.sum("in_class").over(upto_class), F.lit(0)).alias("base"))
    within = sums.select("part", "class", "block", F.coalesce(F.sum("in_block").over(upto_block), F.lit(0)).alias("inner"))
    starts = within.join(bases, ["part", "class"]).select("part", "class", "block", (F.col("base") + F.col("inner")).alias("start"))
    inside = W.partitionBy("part", "class", "block").orderBy("size", F.col("doc_id").asc_nulls_last(), *own)
    placed = (
        dealt.withColumn("at", F.row_number().over(inside))
        .join(starts, ["part", "class", "block"])
        .withColumn("place", F.col("start") + F.col("at"))
    )
    upto = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(upto(F.col("place")) - upto(F.col("place") - 1), F.lit(int(most))).cast("long")
    return placed.withColumn("copies", copies).select(*own, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns. Keys may repeat or be null.

    Options are those of :func:`systematic_mix`. Copies are dealt by key, so reruns agree unless keys repeat.
    """
    rows, row = numbered(docs)
    copies = systematic_mix(rows, text, source, key, row=row, **options).where("copies > 0")
    picked = copies.select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times := free_name("times", rows)))
    return rows.join(picked, row).withColumn(times, F.explode(times)).select(docs.columns)
