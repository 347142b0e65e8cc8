"""Graph traversal as loops of joins (O-28, O-50 to O-63, O-76, O-77).

A loop holds the frontier and the visited set as written tables. Every round is one join of the frontier with the edges,
an anti-join with what was visited, and one write; many roots are walked at once. A hot node's edges stay splittable, as
both sides of the join come from tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.plans.checkpoint import cut, discard, is_cut

#: After so many rounds the visited set is written as one table, so that plans of deep walks do not grow.
_COMPACT = 8

#: Steps in a list of :func:`packed`, about.
_LIST = 10_000


@dataclass(frozen=True)
class WalkSpec:
    """O-28: which edges a walk follows, which way, and what it skips."""

    kinds: tuple[str, ...]
    direction: str = "out"
    skip_test_modules: bool = False
    trait_bridge: bool = False


CLASSIFIER_CALLS = WalkSpec(tuple(model.ADMISSION["call"]), skip_test_modules=True)
REACHABILITY_TRACE = CLASSIFIER_CALLS
REACHABLE_OUT = WalkSpec(tuple(model.ADMISSION["structural"]))
STRUCTURAL_REVERSE = WalkSpec(tuple(model.ADMISSION["structural"]), "in")
DEPENDENTS = WalkSpec(tuple(model.ADMISSION["dependency"]), "in", trait_bridge=True)
TEST_CALLERS = WalkSpec(tuple(model.ADMISSION["dependency"]), "in")
#: O-40: only kinds that carry a structural relation.
IMPACT = WalkSpec(tuple(model.IMPACT_RELATIONS), "in")


def without_tests(spec: WalkSpec) -> WalkSpec:
    return replace(spec, skip_test_modules=False)


def steps(edges: DataFrame, spec: WalkSpec, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (from, to) pairs that a walk may take. Test modules are pruned on both ends, once, before the loop."""
    own = edges.where(F.col("kind").isin(list(spec.kinds)))
    a, b = ("src", "dst") if spec.direction == "out" else ("dst", "src")
    pairs = own.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct()
    if spec.skip_test_modules and nodes is not None:
        tests = nodes.where(P.is_test_module("is_test_only", "kind", "symbol_name")).select(F.col("memory_id").alias("t"))
        for end in ("from", "to"):
            pairs = pairs.join(tests, F.col(end) == F.col("t"), "left_anti")
    return pairs


def packed_steps(edges: DataFrame, spec: WalkSpec) -> DataFrame:
    """Steps of a walk as lists (:func:`packed`); test modules are kept."""
    a, b = ("src", "dst") if spec.direction == "out" else ("dst", "src")
    return packed(edges.where(F.col("kind").isin(list(spec.kinds))).select(F.col(a).alias("from"), F.col(b).alias("to")))


def packed(pairs: DataFrame) -> DataFrame:
    """(from, to: a list), written: a node's steps in lists, which rounds join at a fraction of the rows.

    Nodes with more than ``_LIST`` steps have several lists, dealt by the far end, so a hot node stays splittable.
    """
    pairs = pairs.where("from is not null and to is not null")
    hot = cut(pairs.groupBy("from").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _LIST), "hot")
    part = F.coalesce(F.pmod(F.xxhash64("to"), F.ceil(F.col("n") / _LIST)), F.lit(0))
    lists = cut(pairs.join(hot, "from", "left").groupBy("from", part.alias("part")).agg(F.collect_list("to").alias("to")).select("from", "to"), "steps")
    discard(hot)
    return lists


def walk(
    pairs: DataFrame, roots: DataFrame, max_depth: int | None = None, within: DataFrame | None = None, stop_at: DataFrame | None = None, target: DataFrame | None = None
) -> DataFrame:
    """O-50: breadth-first reach of every root: (root, node, depth), roots at depth 0, each pair once with its least depth.

    ``pairs`` is (from, to); ``roots`` has a column ``root`` or (root, node). Nodes at ``max_depth`` are reached but not
    expanded. ``within`` (node) confines the walk, roots aside; nodes of ``stop_at`` (node) are reached but not left; a walk
    ends early once every row of ``target`` (root, node) is reached. Null ends are ignored; self-loops and cycles end.
    """
    start = roots if "node" in roots.columns else roots.select("root", F.col("root").alias("node"))
    known = pairs.where("from is not null and to is not null")
    edges = known if is_cut(pairs) else cut(known.select("from", "to"), "steps")
    frontier = cut(start.where("node is not null").select("root", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, parts, depth = frontier, [frontier], 0
    while max_depth is None or depth < max_depth:
        if target is not None and not target.join(seen, ["root", "node"], "left_anti").take(1):
            break
        ahead = frontier if stop_at is None else frontier.join(stop_at, "node", "left_anti")
        hop = ahead.select("root", F.col("node").alias("from")).join(edges, "from")
        found = hop.select("root", F.col("to").alias("node")).distinct()
        if within is not None:
            found = found.join(within, "node", "left_semi")
        fresh = found.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node")
        depth += 1
        frontier = cut(fresh.withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.take(1):
            discard(frontier)
            break
        seen = seen.unionByName(frontier)
        parts.append(frontier)
        if len(parts) > _COMPACT:
            seen = cut(seen, "seen")
            discard(*parts[:-1])
            parts = [seen, frontier]
    discard(edges)
    return seen


def reach(pairs: DataFrame, roots: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """O-57, O-61: (node) reachable from any of many roots, roots included; roots outside ``within`` are dropped."""
    start = roots.select("node").distinct()
    if within is not None:
        start = start.join(within, "node", "left_semi")
    return walk(pairs, start.select(F.lit("*").alias("root"), "node"), within=within).select("node")


def impact(edges: DataFrame, nodes: DataFrame, targets: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """O-53: structural dependents with a deterministic shortest path, and how many lie just beyond the depth.

    Returns (root, node, depth, path) where ``path`` lists (dependent, dependency, relation) from the target outwards, and
    (root, depth_cutoff_nodes). Among arrivals of one round the parent with the least (file, name, kind, id) wins, then the
    least relation.
    """
    own = edges.where(F.col("kind").isin(list(IMPACT.kinds)))
    key = nodes.select(F.col("memory_id").alias("from"), F.struct("file_path", "symbol_name", "kind", F.col("memory_id").alias("id")).alias("rank"))
    pairs = cut(own.select(F.col("dst").alias("from"), F.col("src").alias("to"), P.mapped("kind", model.IMPACT_RELATIONS).alias("relation")).distinct().join(key, "from"), "steps")
    empty = F.array().cast("array<struct<dependent:string,dependency:string,relation:string>>")
    frontier = cut(targets.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), empty.alias("path")), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 2):
        hop = frontier.select("root", F.col("node").alias("from"), "path").join(pairs, "from").where("to <> root")
        hop = hop.join(seen.select("root", F.col("node").alias("to")), ["root", "to"], "left_anti")
        if depth > max_depth:
            beyond = hop.groupBy("root").agg(F.countDistinct("to").alias("depth_cutoff_nodes"))
            break
        step = F.struct(F.col("to").alias("dependent"), F.col("from").alias("dependency"), "relation")
        best = hop.groupBy("root", "to").agg(F.min_by(F.concat("path", F.array(step)), F.struct("rank", "relation")).alias("path"))
        frontier = cut(best.select("root", F.col("to").alias("node"), F.lit(depth).alias("depth"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0"), targets.join(beyond, "root", "left").select("root", F.coalesce("depth_cutoff_nodes", F.lit(0)).cast("long").alias("depth_cutoff_nodes"))


def chains(pairs: DataFrame, roots: DataFrame, rank: DataFrame, max_depth: int, terminal: DataFrame | None = None) -> DataFrame:
    """O-56, O-58, O-59, O-60: walks that carry their chain: (root, node, depth, chain), the root first.

    ``rank`` is (node, rank): among parents of one round the least rank wins. ``terminal`` nodes are recorded, not expanded.
    """
    edges = cut(pairs, "steps")
    frontier = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("chain")), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 1):
        ahead = frontier if terminal is None else frontier.join(terminal, "node", "left_anti")
        hop = ahead.join(rank, "node").select("root", F.col("node").alias("from"), "chain", "rank").join(edges, "from")
        fresh = hop.join(seen.select("root", F.col("node").alias("to")), ["root", "to"], "left_anti")
        best = fresh.groupBy("root", "to").agg(F.min_by("chain", F.struct("rank", "from")).alias("chain"))
        frontier = cut(best.select("root", F.col("to").alias("node"), F.lit(depth).alias("depth"), F.concat("chain", F.array("to")).alias("chain")), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def trait_bridge_seeds(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """O-54: (root, node): abstractions that a root or its containers implement, and what they contain; never the root itself."""
    holds = edges.where("kind = 'contains'")
    anchors = roots.select("root", F.col("root").alias("anchor")).union(roots.join(holds, F.col("dst") == F.col("root")).select("root", F.col("src").alias("anchor")))
    up = edges.where(F.col("kind").isin("implements", "has_impl")).select(F.col("src").alias("anchor"), F.col("dst").alias("node"))
    targets = anchors.join(up, "anchor").select("root", "node").distinct()
    inner = targets.join(holds, F.col("src") == F.col("node")).select("root", F.col("dst").alias("node"))
    return targets.union(inner).distinct().where("root <> node")


def name_bridge(nodes: DataFrame) -> DataFrame:
    """O-55: (impl_method, trait_method) by the names ``impl T for X::m`` and ``T::m``."""
    pattern = r"^impl (.+) for (.+)::([^:]+)$"
    n = F.col("symbol_name")
    impl = nodes.where(n.rlike(pattern)).select(
        F.col("memory_id").alias("impl_method"), F.concat(F.regexp_replace(F.regexp_extract(n, pattern, 1), "<.*$", ""), F.lit("::"), F.regexp_extract(n, pattern, 3)).alias("name")
    )
    return impl.join(nodes.where(~n.startswith("impl ")).select(F.col("memory_id").alias("trait_method"), F.col("symbol_name").alias("name")), "name").select("impl_method", "trait_method")


def dependents(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """O-52: (root, node, depth): reverse walk over dependency edges from the target and its trait-bridge seeds, targets left out."""
    seeds = targets.select("root", F.col("root").alias("node")).union(trait_bridge_seeds(nodes, edges, targets))
    return walk(steps(edges, DEPENDENTS), seeds, max_depth).where("depth > 0")


def upward(parents: DataFrame, start: DataFrame) -> DataFrame:
    """O-63: (node) of ``start`` closed over (child, parent) rows."""
    return reach(parents.select(F.col("child").alias("from"), F.col("parent").alias("to")), start)
