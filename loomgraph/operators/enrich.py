"""Node and file enrichment (O-62, O-71 to O-77, O-92)."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.plans import blocks
from loomgraph.plans import walk as walks
from loomgraph.plans.checkpoint import cut, discard, placed, tidy

COUPLING = ["calls", "implements", "references", "type_of"]

#: After so many levels what was seen is written as one table, so that plans of deep graphs do not grow.
_COMPACT = 8

#: Levels that betweenness finds in rounds before tasks may go on alone, and the steps and nodes of a graph that a task may hold.
_DEEP, _HELD = 5, 1 << 24

#: Up to so many nodes are looked up by their ids in the plan, which scans push down; more are joined.
_FEW = 1_000


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-71: (memory_id, fan_in, fan_out, stability), the share of incoming couplings, null without any."""
    own = edges.where(F.col("kind").isin(COUPLING))
    count = lambda end, name: own.groupBy(F.col(end).alias("memory_id")).agg(F.count(F.lit(1)).alias(name))
    joined = nodes.select("memory_id").join(count("dst", "fan_in"), "memory_id", "left").join(count("src", "fan_out"), "memory_id", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return joined.withColumn("stability", F.when(total > 0, F.round(F.col("fan_in") / total, 6)))


def depth_from_entries(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """O-76: (memory_id, depth) from alive symbols that nothing uses and alive ones with ``main`` in their name."""
    alive = nodes.where(F.col("reachability_class").isin("wired", "public_api"))
    fans = fan_counts(nodes, edges).select("memory_id", "fan_in")
    start = alive.join(fans, "memory_id").where((F.col("fan_in") == 0) | F.col("symbol_name").contains("main")).select(F.lit("*").alias("root"), F.col("memory_id").alias("node"))
    seen = walks.walk(walks.steps(edges, walks.REACHABLE_OUT), start, max_depth)
    return seen.select(F.col("node").alias("memory_id"), "depth")


def test_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-77: (memory_id) that test_only nodes reach."""
    start = nodes.where("reachability_class = 'test_only'").select(F.col("memory_id").alias("node"))
    return walks.reach(walks.steps(edges, walks.REACHABLE_OUT), start).select(F.col("node").alias("memory_id"))


def upper_percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """The element at place ceil((n - 1) * p) of the sorted values, in one row ``value``: not percentile_disc.

    Ranks come from counts by value, so the sort is over distinct values only.
    """
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("value"))).withColumn("total", F.sum("n").over(W.partitionBy()))
    return upto.where(F.col("upto") > F.ceil((F.col("total") - 1) * F.lit(p))).agg(F.min("value").alias("value"))


def rank_percentile(rows: DataFrame, column: str, tie: str) -> DataFrame:
    """O-92: rows with ``percentile`` = place / (n - 1) by value, ties by ``tie``; a single row has 0."""
    own = placed(rows, column, tie, name="__place")
    n = F.col("__rows")
    percentile = F.when(n > 1, F.round(F.col("__place") / (n - 1), 6)).otherwise(F.lit(0.0))
    return own.join(F.broadcast(own.agg(F.count(F.lit(1)).alias("__rows")))).select(*rows.columns, percentile.alias("percentile"))


def file_risk(nodes: DataFrame, churn: DataFrame) -> DataFrame:
    """O-72: (file_path, raw, percentile). ``nodes`` has fan_in, centrality, reachability_class and has_test_path; ``churn`` (path, churn_90d, unique_authors_90d)."""
    p90 = upper_percentile(nodes, "fan_in", 0.9).select(F.col("value").alias("fan90")).join(F.broadcast(upper_percentile(nodes, "centrality", 0.9).select(F.col("value").alias("cen90"))))
    own = nodes.join(F.broadcast(p90))
    facts = own.groupBy("file_path").agg(
        F.bool_or(F.col("fan_in") > F.col("fan90")).alias("a"),
        F.bool_or(F.col("centrality") > F.col("cen90")).alias("b"),
        (F.count_if(F.col("reachability_class").isin("dead", "orphan")) * 2 > F.count(F.lit(1))).alias("c"),
        F.bool_or((F.col("reachability_class") == "wired") & ~F.col("has_test_path")).alias("d"),
    )
    joined = facts.join(churn.withColumnRenamed("path", "file_path"), "file_path", "left")
    add = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))
    raw = add(F.col("a"), 2.0) + add(F.col("b"), 2.0) + add(F.col("c"), 1.0) + add(F.col("d"), 1.5) + add(F.col("churn_90d") > 15, 1.5) + add(F.col("unique_authors_90d") > 3, 1.0)
    return rank_percentile(joined.select("file_path", raw.alias("raw")), "raw", "file_path")


def _leaving(edges: DataFrame, end: str, few: list[str], all_of_them: DataFrame) -> DataFrame:
    """Edges with an end among nodes (from): ``few`` of them if there are no more than ``_FEW``, else the table."""
    return edges.where(F.col(end).isin(few)) if len(few) <= _FEW else edges.join(all_of_them.select(F.col("from").alias(end)), end, "left_semi")


def expand(edges: DataFrame, seeds: DataFrame, max_total: int = 50, max_per_seed: int = 20, max_depth: int = 3, attenuation: float = 0.5) -> DataFrame:
    """O-62: best-first neighbours of seeds: (seed, node, score, depth), at most ``max_per_seed`` each and ``max_total`` together.

    A node's score is kind weight * edge weight * confidence of the edge that reaches it, times attenuation ** depth. Of a node's ways
    only the best ``max_per_seed`` to nodes other than seeds can be taken: before a later one comes up, all of these have been taken
    or found taken, and the seed is full. So each round looks up the ways of few nodes, and each seed's best-first order then runs
    on its own part. Among equal scores the smaller id comes first; a node belongs to the seed that scores it best.
    """
    names = {r["seed"] for r in seeds.select("seed").distinct().collect()}  # seeds are a request, not a table
    asked = seeds.select(F.col("seed").alias("seed_id")).distinct()
    weights = P.mapped("kind", {k: str(v) for k, v in model.EXPANSION_WEIGHTS.items()}).cast("double")
    w = (weights * F.coalesce("weight", F.lit(1.0)) * F.coalesce("confidence", F.lit(0.7))).alias("w")
    frontier, known = cut(seeds.select(F.col("seed"), F.col("seed").alias("from")).distinct(), "expand"), None
    for depth in range(max_depth):
        fresh = frontier.select("from").distinct()
        if known is not None:
            fresh = fresh.join(known.select("from").distinct(), "from", "left_anti")
        fresh = cut(fresh, "expand")
        few = [r["from"] for r in fresh.take(_FEW + 1)]
        one = lambda a, b: _leaving(edges, a, few, fresh).select(F.col(a).alias("from"), F.col(b).alias("to"), w)  # noqa: E731, B023
        ways = one("src", "dst").union(one("dst", "src")).where("from <> to").join(asked, F.col("to") == F.col("seed_id"), "left_anti")
        best = W.partitionBy("from").orderBy(F.desc("w"), "to")
        found = cut(ways.groupBy("from", "to").agg(F.max("w").alias("w")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_per_seed).drop("r"), "expand")
        known = found if known is None else known.unionByName(found)
        near = cut(frontier.join(known, "from"), "expand")
        local = near if depth == 0 else local.unionByName(near)
        frontier = near.select("seed", F.col("to").alias("from")).distinct()
        if depth + 1 < max_depth:
            frontier = cut(frontier, "expand")
    local = local.distinct()

    def best_first(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, out, done = pdf["seed"].iloc[0], [], set(names)
        ways: dict[str, list[tuple[str, float]]] = {}
        for a, b, w in zip(pdf["from"], pdf["to"], pdf["w"]):
            ways.setdefault(a, []).append((b, w))
        heap = [(-w * attenuation, b, 1) for b, w in ways.get(seed, [])]
        heapq.heapify(heap)
        while heap and len(out) < max_per_seed:
            score, node, depth = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            out.append((seed, node, -score, depth))
            if depth < max_depth:
                for b, w in ways.get(node, []):
                    heapq.heappush(heap, (-w * attenuation ** (depth + 1), b, depth + 1))
        return pd.DataFrame(out, columns=["seed", "node", "score", "depth"])

    found = local.groupBy("seed").applyInPandas(best_first, "seed string, node string, score double, depth int")
    own = W.partitionBy("node").orderBy(F.desc("score"), "seed")
    return found.withColumn("r", F.row_number().over(own)).where("r = 1").drop("r").orderBy(F.desc("score"), "node").limit(max_total)


def betweenness(nodes: DataFrame, edges: DataFrame, samples: int = 100) -> DataFrame:
    """O-75: (memory_id, betweenness) from shortest paths out of at most ``samples`` sources, picked by stride in id order.

    Brandes' two sweeps, each round for all sources at once (:mod:`loomgraph.plans.blocks`): forward, levels and path counts;
    backward, level by level, the dependency of a node on each of its sources. What was seen is a bit for each node and source,
    kept by parts of nodes; a part writes its bits only in rounds that reach it, and the last ones count. Of a graph that goes on
    for ``_DEEP`` levels, where rounds reach few nodes each, the rest is left to tasks that hold the graph if its steps and nodes
    are no more than ``_HELD``; no task holds a larger one.
    """
    ids = cut(nodes.select("memory_id"), "ids")
    n = ids.count()
    stride = max(1, n // max(1, min(n, samples)))
    sources = placed(ids, "memory_id", name="at").where(F.col("at") % stride == 0).orderBy("at").limit(min(n, samples)).select(F.col("memory_id").alias("name"), F.expr(f"cast(at div {stride} as int)").alias("s"))
    named = cut(edges.where(F.col("kind").isin(model.ADMISSION["structural"])).select("src", "dst").where("src <> dst").distinct(), "brandes")
    ends = ids.union(named.select("src")).union(named.select("dst")).toDF("name").distinct()
    names = cut(placed(ends, "name", name="id"), "names")
    number = lambda end, to: names.select(F.col("name").alias(end), F.col("id").alias(to))
    pairs = cut(named.join(number("src", "from"), "src").join(number("dst", "to"), "dst").select("from", "to"), "brandes")
    wide = max(1, min(n, samples))
    out = blocks.blocked(pairs, wide)
    size = {"steps": pairs.count(), "nodes": names.count()}
    discard(named)
    part = F.expr(f"cast(v div {out.size} as int)").alias("part")

    def reached(table: DataFrame) -> list[int]:
        """Parts with rows of a level: one row of each has its bits."""
        return [r["part"] for r in table.where("seen is not null").select("part").collect()]

    start = sources.join(names, "name").select("s", F.col("id").alias("v"), F.lit(1.0).alias("sigma")).select(part, "s", "v", "sigma")
    levels, parts, bits, scores = [], [], [], []
    sums, held = start, sum(size.values()) <= _HELD
    with tidy(ids.sparkSession):
        while not held or len(levels) < _DEEP:
            seen = [b.where("seen is not null").select("part", "round", "seen") for b in bits]
            found = cut(blocks.of_parts(["part", "s", "v", "sigma", "at", "x", "round", "seen"], [sums, *seen], blocks.fresh(out.size, wide, len(levels)), blocks.LEVEL), "brandes")
            if not (there := reached(found)):
                break
            levels.append(found)
            parts.append(there)
            bits.append(found)
            if len(levels) % _COMPACT == 0:
                last = F.max_by("seen", "round").alias("seen")
                bits = [cut(blocks.together(["part", "round", "seen"], *bits).where("seen is not null").groupBy("part").agg(last, F.max("round").alias("round")), "seen")]
            sums = out.summed(found.where("v is not null"), "sigma", there, out.ahead(there))
        if held and len(levels) == _DEEP:
            scores.append(blocks.dependencies(out.steps, [level.where("v is not null") for level in levels], out.size, size["nodes"], wide))
        elif len(levels) > 2:
            back = blocks.blocked(pairs.select(F.col("to").alias("from"), F.col("from").alias("to")), wide)
            shares = levels[-1].where("v is not null").select("part", "s", "v", (1 / F.col("sigma")).alias("share"))
            # The sources themselves, level 0, get nothing from their own paths; the last level passes nothing on.
            for at in range(len(levels) - 2, 0, -1):
                ahead, own = back.ahead(parts[at + 1]), set(parts[at])
                sums = back.summed(shares, "share", parts[at + 1], ahead and {b for b in ahead if b >> 32 in own})
                level = levels[at].where("v is not null").select("part", "s", "v", "sigma")
                shares = cut(blocks.of_parts(["part", "s", "v", "sigma", "at", "x"], [level, blocks.named(sums, "part", own)], blocks.returned(out.size, wide), blocks.SHARE), "brandes")
                scores.append(shares.where("delta > 0").select("v", "delta"))
        total = reduce(DataFrame.unionByName, scores) if scores else start.limit(0).select("v", F.col("sigma").alias("delta"))
        score = cut(total.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("betweenness")), "brandes")
    discard(pairs, out.table, *levels, *bits)
    return ids.join(score.join(names, "id").select(F.col("name").alias("memory_id"), "betweenness"), "memory_id", "left").na.fill(0.0, ["betweenness"])
