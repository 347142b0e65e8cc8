"""Differences, set operations and incremental change (J-2 to J-4, O-95 to O-100, O-124 to O-127, O-133, O-136)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.checkpoint import placed


def full_diff(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """J-3, J-4, O-98, O-99: (keys, change) with change added, removed, modified or unchanged by a full outer join; null digests differ from all others but null."""
    a = before.select(*keys, F.col(digest).alias("__before"), F.lit(True).alias("__was"))
    b = after.select(*keys, F.col(digest).alias("__after"), F.lit(True).alias("__is"))
    change = F.when(F.col("__was").isNull(), F.lit("added")).when(F.col("__is").isNull(), F.lit("removed")).when(F.col("__before").eqNullSafe(F.col("__after")), F.lit("unchanged")).otherwise(F.lit("modified"))
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def verdict(changes: DataFrame, complete: bool) -> DataFrame:
    """O-98: one row: counts by change, and differences, none or unknown; without complete coverage an empty diff proves nothing."""
    of = lambda c: F.count_if(F.col("change") == c).alias(c)
    counts = changes.agg(of("added"), of("removed"), of("modified"))
    total = F.col("added") + F.col("removed") + F.col("modified")
    return counts.withColumn("verdict", F.when(total > 0, F.lit("differences")).otherwise(F.lit("none" if complete else "unknown")))


def bounded(changes: DataFrame, limit: int | None, file: str = "file_path", name: str = "symbol_name") -> DataFrame:
    """O-95: the first ``limit`` changes, or all: files in path order, in each added, removed, modified, then by name and the other columns; ``row_no`` counts from 1."""
    place = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    rows = changes.where("change <> 'unchanged'").withColumn("__kind", place)
    order = [file, "__kind", name, *[c for c in changes.columns if c not in (file, name, "change")]]
    if limit is None:
        return placed(rows, *order, name="__row").select(*changes.columns, (F.col("__row") + 1).cast("int").alias("row_no"))
    return rows.orderBy(*order).limit(limit).withColumn("row_no", F.row_number().over(W.orderBy(*order))).drop("__kind")


def live_state(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """J-2: (path, state) of live files: exact_match, changed, not_indexed, or unavailable where the live hash is null."""
    joined = live.select("path", F.col("hash").alias("now")).join(indexed.select("path", F.col("hash").alias("then"), F.lit(True).alias("known")), "path", "left")
    state = F.when(F.col("now").isNull(), F.lit("unavailable")).when(F.col("known").isNull(), F.lit("not_indexed")).when(F.col("now") == F.col("then"), F.lit("exact_match")).otherwise(F.lit("changed"))
    return joined.select("path", state.alias("state"))


def freshness(live: DataFrame, indexed: DataFrame, most: int | None = None) -> DataFrame:
    """O-133: one row (status, differing, population): fresh only if both path sets and all hashes agree; unknown for an empty population, or one of more than ``most`` paths."""
    diff = full_diff(indexed, live, ["path"], "hash")
    facts = diff.agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("change") != "unchanged").alias("differing"))
    n = F.col("population")
    return facts.select(F.when((n == 0) | (F.lit(False) if most is None else n > most), F.lit("unknown")).when(F.col("differing") > 0, F.lit("stale")).otherwise(F.lit("fresh")).alias("status"), "differing", "population")


def baseline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """O-97: (key, change): dead symbols that are new or resolved; the key is name, path and kind, joined by tabs."""
    key = lambda df: df.where(F.col("reachability_class").isin("dead", "orphan")).select(F.concat_ws("\t", "symbol_name", "file_path", "kind").alias("key")).distinct()
    a, b = key(before), key(after)
    return b.subtract(a).withColumn("change", F.lit("new")).union(a.subtract(b).withColumn("change", F.lit("resolved")))


def regression(before: DataFrame, after: DataFrame, threshold: int = 0) -> DataFrame:
    """O-97: one row of deltas; any positive one is a regression, and exceeds the threshold if above it."""
    count = lambda df, name: df.agg(*[F.count_if(F.col("reachability_class") == c).alias(f"{name}_{c}") for c in ("dead", "orphan")])
    both = count(before, "old").join(F.broadcast(count(after, "new")))
    deltas = both.select((F.col("new_dead") - F.col("old_dead")).alias("dead_delta"), (F.col("new_orphan") - F.col("old_orphan")).alias("orphan_delta"))
    worst = F.greatest("dead_delta", "orphan_delta")
    return deltas.withColumn("is_regression", worst > 0).withColumn("exceeds_threshold", worst > threshold)


def impact_union(execution: DataFrame, structural: DataFrame) -> DataFrame:
    """O-100: (node, depth, by_execution, by_structure), the lesser depth of both."""
    a = execution.groupBy("node").agg(F.min("depth").alias("e"))
    b = structural.groupBy("node").agg(F.min("depth").alias("s"))
    return a.join(b, "node", "full").select("node", F.least("e", "s").alias("depth"), F.col("e").isNotNull().alias("by_execution"), F.col("s").isNotNull().alias("by_structure"))


def traverse(edges: DataFrame, accesses: DataFrame, now_ms: int, rate: float = 0.1, most: float = 1.0) -> DataFrame:
    """O-124: edges after accesses (src, dst, kind), one step of weight for each, up to ``most``."""
    n = accesses.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("hits"))
    joined = edges.join(n, ["src", "dst", "kind"], "left").na.fill(0, ["hits"])
    hit = F.col("hits") > 0
    return joined.withColumns(
        {
            "weight": F.when(hit, F.greatest("weight", F.least(F.col("weight") + F.col("hits") * rate, F.lit(most)))).otherwise(F.col("weight")),
            "access_count": F.col("access_count") + F.col("hits"),
            "last_accessed_ms": F.when(hit, F.lit(now_ms)).otherwise(F.col("last_accessed_ms")),
        }
    ).drop("hits")


def decay(edges: DataFrame, now_ms: int, stale_ms: int, factor: float = 0.9, least: float = 0.1) -> DataFrame:
    """O-124: edges never or long ago accessed lose weight, down to ``least``."""
    stale = F.col("last_accessed_ms").isNull() | (F.lit(now_ms) - F.col("last_accessed_ms") > stale_ms)
    return edges.withColumn("weight", F.when(stale, F.greatest(F.col("weight") * factor, F.lit(least))).otherwise(F.col("weight")))


def restore_plasticity(edges: DataFrame, snapshot: DataFrame) -> DataFrame:
    """O-125: weights and counts of a snapshot put back by (src, dst, kind); a pair's other kinds keep theirs."""
    old = snapshot.select("src", "dst", "kind", F.col("weight").alias("w"), F.col("access_count").alias("a"))
    joined = edges.join(old, ["src", "dst", "kind"], "left")
    return joined.withColumn("weight", F.coalesce("w", "weight")).withColumn("access_count", F.coalesce("a", "access_count")).drop("w", "a")


def invalidate_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-126: nodes and edges without those of the given files (file_path)."""
    gone = nodes.join(files, "file_path", "left_semi").select("memory_id")
    kept = edges.join(gone.select(F.col("memory_id").alias("src")), "src", "left_anti").join(gone.select(F.col("memory_id").alias("dst")), "dst", "left_anti")
    return nodes.join(files, "file_path", "left_anti"), kept.select(edges.columns)


def selective_invalidation(before: DataFrame, after: DataFrame) -> DataFrame:
    """O-127: (memory_id, fate): kept when name, kind and hash agree, else removed; new ids are new."""
    sig = F.struct("symbol_name", "kind", "content_hash")
    diff = full_diff(before.withColumn("sig", sig), after.withColumn("sig", sig), ["memory_id"], "sig")
    return diff.select("memory_id", F.when(F.col("change") == "unchanged", F.lit("kept")).when(F.col("change") == "added", F.lit("new")).otherwise(F.lit("removed")).alias("fate"))


def lost_capabilities(before: DataFrame, after: DataFrame) -> DataFrame:
    """O-136: complete (capability, configuration, language) triples that a new generation would lose; any row refuses it."""
    own = lambda df: df.where("status = 'complete'").select("capability", "configuration", "language")
    return own(before).subtract(own(after))
