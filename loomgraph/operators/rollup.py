"""Aggregations over the graph (O-64 to O-86, O-139)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-64: (metric, n): nodes, edges, and edges by kind."""
    by_kind = edges.groupBy(F.concat(F.lit("kind:"), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    total = by_kind.agg(F.lit("edges").alias("metric"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return nodes.agg(F.lit("nodes").alias("metric"), F.count(F.lit(1)).alias("n")).union(total).union(by_kind)


def class_summary(nodes: DataFrame) -> DataFrame:
    """O-65: one row with a count for each of the nine classes, zeros included."""
    return nodes.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("reachability_class") == c).alias(c) for c in model.CLASSES])


def class_percentages(nodes: DataFrame) -> DataFrame:
    """O-66: (reachability_class, n, percent)."""
    counts = nodes.groupBy("reachability_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def scoped_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the relationship scope (O-38) of their source node."""
    tests = nodes.select(F.col("memory_id").alias("src"), F.col("is_test_only").alias("src_test"))
    return edges.join(tests, "src", "left").withColumn("relation_scope", P.relationship_scope("scope", "src_test"))


def fan_in_breakdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-67 counts: uses of a node by scope and evidence: (memory_id, all, production, tests, conditional, provider_calls, structural_call_hints, field_uses)."""
    own = scoped_edges(nodes, edges.where(F.col("kind").isin("calls", "field_of")))
    call, proven = F.col("kind") == "calls", F.col("source").isin("Scip", "Both")
    return own.groupBy(F.col("dst").alias("memory_id")).agg(
        F.count(F.lit(1)).alias("all"),
        *[F.count_if(F.col("relation_scope") == s).alias(s) for s in ("production", "tests", "conditional")],
        F.count_if(call & proven).alias("provider_calls"),
        F.count_if(call & ~proven).alias("structural_call_hints"),
        F.count_if(F.col("kind") == "field_of").alias("field_uses"),
    )


def hotspots(nodes: DataFrame, edges: DataFrame, scope: str = "production", least: int = 20) -> DataFrame:
    """O-67: symbols with a fan-in of ``least`` or more in a scope, most used first; every row says how many were considered.

    The scope ``production`` leaves nodes out of the population that the syntax proves to be tests.
    """
    population = nodes.where(~F.coalesce("is_test_only", F.lit(False))) if scope == "production" else nodes
    joined = population.join(fan_in_breakdown(nodes, edges), "memory_id", "left").na.fill(0, ["all", "production", "tests", "conditional", "provider_calls", "structural_call_hints", "field_uses"])
    considered = population.agg(F.count(F.lit(1)).alias("considered_symbols"))
    rows = joined.withColumn("fan_in", F.col(scope)).where(F.col("fan_in") >= least).join(F.broadcast(considered))
    return rows.select("memory_id", "symbol_name", "kind", "file_path", "line_start", "fan_in", "production", "tests", "conditional", "provider_calls", "structural_call_hints", "field_uses", "considered_symbols").orderBy(
        F.desc("fan_in"), "file_path", "line_start", "symbol_name", "kind", "memory_id"
    )


def dead_ratios(nodes: DataFrame, unit: str = "unit", percent: int = 10) -> DataFrame:
    """O-68: units whose callables are unreached to at least ``percent`` in a hundred, in basis points, integers throughout."""
    own = nodes.where(P.has_role("kind", "callable"))
    counts = own.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reachability_class").isin("dead", "orphan")).alias("dead"))
    return counts.where((F.col("total") > 0) & (F.col("dead") * 100 >= F.col("total") * percent)).withColumn("basis_points", F.expr("dead * 10000 div total"))


def dead_files(nodes: DataFrame, most: int = 10) -> DataFrame:
    """O-68: files with most unreached callables, then by path."""
    own = nodes.where(P.has_role("kind", "callable") & F.col("reachability_class").isin("dead", "orphan"))
    return own.groupBy("file_path").agg(F.count(F.lit(1)).alias("dead")).orderBy(F.desc("dead"), "file_path").limit(most)


def unit_overview(nodes: DataFrame, unit: str = "unit") -> DataFrame:
    """O-69: owned nodes, callables and health per unit; unowned nodes form a row with a null unit."""
    bucket = P.overview_bucket("reachability_class")
    return nodes.groupBy(F.col(unit).alias("unit")).agg(
        F.count(F.lit(1)).alias("owned"), F.count_if(P.has_role("kind", "callable")).alias("callables"), *[F.count_if(bucket == b).alias(b) for b in ("alive", "dead", "test")]
    )


def key_types(nodes: DataFrame, edges: DataFrame, unit: str = "unit", most: int = 5) -> DataFrame:
    """O-69, O-89: the most used structs, enums and traits of each unit."""
    fan = edges.where(F.col("kind").isin("calls", "field_of")).groupBy(F.col("dst").alias("memory_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    own = nodes.where(F.col("kind").isin("struct", "enum", "trait")).join(fan, "memory_id")
    order = W.partitionBy(unit).orderBy(F.desc("fan_in"), "symbol_name", "kind", "memory_id")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(F.col(unit).alias("unit"), "place", "memory_id", "symbol_name", "kind", "fan_in")


def unit_dependencies(nodes: DataFrame, edges: DataFrame, unit: str = "unit") -> DataFrame:
    """O-69: distinct unit pairs joined by a depends_on edge."""
    of = lambda end, name: nodes.select(F.col("memory_id").alias(end), F.col(unit).alias(name))
    own = edges.where("kind = 'depends_on'").join(of("src", "from_unit"), "src").join(of("dst", "to_unit"), "dst")
    return own.where("from_unit <> to_unit").select("from_unit", "to_unit").distinct()


def dependencies(nodes: DataFrame, edges: DataFrame, scope: DataFrame) -> DataFrame:
    """O-70: relations across the border of a set of files: (file, direction, relation, n); kinds count separately.

    ``scope`` is (file_path). A dependency leads out of it, a dependent leads in; edges without a relation are left out.
    """
    inside = scope.select(F.col("file_path").alias("f")).distinct()
    own = edges.withColumn("relation", P.mapped("kind", model.DEPENDENCY_RELATIONS)).where("relation is not null")
    files = nodes.select("memory_id", "file_path").join(inside.withColumn("in", F.lit(True)), F.col("file_path") == F.col("f"), "left").select("memory_id", "file_path", F.coalesce("in", F.lit(False)).alias("in"))
    end = lambda side: files.select(F.col("memory_id").alias(side), F.col("file_path").alias(f"{side}_file"), F.col("in").alias(f"{side}_in"))
    crossing = own.join(end("src"), "src").join(end("dst"), "dst").where("src_in <> dst_in")
    out = F.col("src_in")
    return (
        crossing.groupBy(F.when(out, F.col("dst_file")).otherwise(F.col("src_file")).alias("file"), F.when(out, F.lit("dependency")).otherwise(F.lit("dependent")).alias("direction"), "relation")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("file", "direction", "relation")
    )


def call_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-78: one row: live callables, those at an end of a call, proven calls, and the ratio (null without live callables)."""
    calls = edges.where("kind = 'calls'")
    ends = calls.select(F.explode(F.array("src", "dst")).alias("memory_id")).distinct()
    live = nodes.where(P.has_role("kind", "callable") & ~F.col("reachability_class").isin("dead", "orphan")).select("memory_id")
    a = live.join(ends.withColumn("hit", F.lit(1)), "memory_id", "left").agg(F.count(F.lit(1)).alias("live_callables"), F.count("hit").alias("touched"))
    b = calls.agg(F.count(F.lit(1)).alias("call_edges"), F.count_if(F.col("source").isin("Scip", "Both")).alias("proven_calls"))
    return a.join(F.broadcast(b)).withColumn("ratio", F.when(F.col("live_callables") > 0, F.round(F.col("touched") / F.col("live_callables"), 6)))


def type_totals(children: DataFrame) -> DataFrame:
    """O-81: members by role."""
    return children.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def type_members(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Members of types (memory_id as ``type_id``): contained symbols, and their implementations: (type_id, role, member_id), each once."""
    kind = nodes.select(F.col("memory_id").alias("member_id"), F.col("kind").alias("member_kind"), "visibility", "has_body")
    asked = types.join(nodes.select(F.col("memory_id").alias("type_id"), F.col("kind").alias("type_kind")), "type_id")
    held = edges.where("kind = 'contains'").select(F.col("src").alias("type_id"), F.col("dst").alias("member_id")).join(asked, "type_id").join(kind, "member_id")
    abstract = P.has_role("type_kind", "abstraction")
    role = (
        F.when(P.has_role("member_kind", "callable") & abstract & F.coalesce("has_body", F.lit(False)), F.lit("provided_method"))
        .when(P.has_role("member_kind", "callable") & abstract, F.lit("required_method"))
        .when(P.has_role("member_kind", "callable") & (F.col("visibility") == "pub"), F.lit("public_method"))
        .when(P.has_role("member_kind", "callable"), F.lit("private_method"))
        .when(F.col("member_kind").isin("enum_variant", "variant"), F.lit("variant"))
        .when(P.has_role("member_kind", "data_member"), F.lit("field"))
        .when(F.col("member_kind") == "impl", F.lit("impl_block"))
    )
    link = lambda kind_name, a, b, label: edges.where(F.col("kind") == kind_name).select(F.col(a).alias("type_id"), F.col(b).alias("member_id")).join(asked, "type_id").select("type_id", F.lit(label).alias("role"), "member_id")
    parts = held.select("type_id", role.alias("role"), "member_id").where("role is not null")
    parts = parts.union(link("implements", "src", "dst", "implemented_trait")).union(link("implements", "dst", "src", "implementor"))
    return parts.union(link("field_of", "src", "dst", "field_type_ref")).distinct()


def action_tiers(nodes: DataFrame) -> DataFrame:
    """O-84: (tier, files, symbols) over dead and suspected nodes outside generated files, plus tests."""
    tier = (
        F.when((F.col("reachability_class") == "dead") & F.col("rustc_flagged_dead"), F.lit("dead_confirmed"))
        .when(F.col("reachability_class").isin("dead", "suspected"), F.lit("investigate"))
        .when(F.col("reachability_class") == "test_only", F.lit("test_only"))
    )
    own = nodes.where(~P.is_generated("file_path")).withColumn("tier", tier).where("tier is not null")
    return own.groupBy("tier").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def file_tiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-85: per file with a dead symbol: counts, retained symbols, links from other files' modules, and whether all of it is dead."""
    uses = edges.where("kind = 'contains'").select("src", "dst").join(nodes.select(F.col("memory_id").alias("src"), F.col("file_path").alias("src_file"), F.col("kind").alias("src_kind")), "src")
    linked = uses.where("src_kind = 'module'").join(nodes.select(F.col("memory_id").alias("dst"), F.col("file_path").alias("dst_file")), "dst").where("src_file <> dst_file").select(F.col("dst_file").alias("file_path")).distinct()
    counts = nodes.groupBy("file_path").agg(
        F.count_if(F.col("reachability_class") == "dead").alias("dead"), F.count(F.lit(1)).alias("total"), F.count_if((F.col("entry_retain").bitwiseAND(8)) != 0).alias("retained")
    )
    out = counts.where("dead > 0").join(linked.withColumn("linked", F.lit(True)), "file_path", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return out.withColumn("fully_dead", (F.col("dead") == F.col("total")) & (F.col("retained") == 0) & ~F.col("linked"))


def distinct_callers(edges: DataFrame) -> DataFrame:
    """O-86: (callee, call_sites, callers)."""
    return edges.where("kind = 'calls'").groupBy(F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("call_sites"), F.countDistinct("src").alias("callers"))
