"""Graph construction from extracted symbols and relations (O-90, O-101 to O-108, J-9 to J-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.operators.search import resolve_with_locality


def qualified_name() -> Column:
    """The parent's name and the own one, joined by ``::``."""
    return F.when(F.coalesce("parent", F.lit("")) != "", F.concat_ws("::", "parent", "name")).otherwise(F.col("name"))


def identify(symbols: DataFrame) -> DataFrame:
    """O-90: symbols with ``symbol_name`` (qualified), ``ordinal`` among declarations of that name in their file, and ``memory_id``.

    The ordinal follows (start_byte, end_byte, kind); the id is half a SHA-256 over path, name and, from the second one on, ordinal.
    """
    named = symbols.withColumn("symbol_name", qualified_name())
    order = W.partitionBy("file_path", "symbol_name").orderBy("start_byte", "end_byte", "kind")
    counted = named.withColumn("ordinal", F.row_number().over(order) - 1)
    key = F.concat(F.concat_ws(":", "file_path", "symbol_name"), F.when(F.col("ordinal") > 0, F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.lit("")))
    return counted.withColumn("memory_id", F.substring(F.sha2(key, 256), 1, 32))


def contains_edges(ids: DataFrame) -> DataFrame:
    """Containment from each symbol's parent in the same file; a parent declared several times gives its first declaration."""
    parents = ids.where("ordinal = 0").select(F.col("file_path").alias("f"), F.col("symbol_name").alias("p"), F.col("memory_id").alias("src"))
    own = ids.where(F.coalesce("parent", F.lit("")) != "")
    joined = own.join(parents, (F.col("file_path") == F.col("f")) & (F.col("parent") == F.col("p")))
    return joined.where("src <> memory_id").select("src", F.col("memory_id").alias("dst"), F.lit("contains").alias("kind"), F.coalesce("is_test_only", F.lit(False)).alias("test"))


def relation_edges(ids: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Edges from ``relations`` ARRAY<STRUCT<tag, target>> by the build-time resolver; markers of Rust's Send kind are skipped.

    ``implements`` gives has_impl back from the abstraction too. ``domains`` (file_path, domain) confines a relation to its own domain (O-104).
    """
    rel = ids.select("memory_id", "file_path", F.coalesce("is_test_only", F.lit(False)).alias("test"), F.explode("relations").alias("r")).select(
        "memory_id", "file_path", "test", F.col("r.tag").alias("kind"), F.col("r.target").alias("target")
    )
    rel = rel.where(~(F.col("kind").isin("extends", "implements") & F.col("target").isin(model.MARKER_TRAITS)))
    rel = rel.withColumn("rel_id", F.sha2(F.concat_ws("\x00", "memory_id", "kind", "target"), 256)).dropDuplicates(["rel_id"])
    asked = rel.select("rel_id", "target", F.col("file_path").alias("file"))
    pool = ids.where(P.has_role("kind", "definition"))  # an import is no target; what it names is
    hit = resolve_with_locality(pool, asked) if domains is None else _resolve_in_domain(pool, asked, domains)
    bound = rel.join(hit.select("rel_id", F.col("memory_id").alias("dst")), "rel_id").select(F.col("memory_id").alias("src"), "dst", "kind", "test")
    back = bound.where("kind = 'implements'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("has_impl").alias("kind"), "test")
    return bound.union(back).where("src <> dst")


def _resolve_in_domain(ids: DataFrame, asked: DataFrame, domains: DataFrame) -> DataFrame:
    """The resolver within domains: the domain becomes the last segment of every name and target, so that only names of the same domain match."""
    where = domains.select(F.col("file_path").alias("d_file"), F.concat(F.lit("::@"), "domain").alias("d"))
    pool = ids.join(where, F.col("file_path") == F.col("d_file")).select("memory_id", "file_path", F.concat("symbol_name", "d").alias("symbol_name"))
    tagged = asked.join(where, F.col("file") == F.col("d_file")).select("rel_id", F.concat("target", "d").alias("target"), "file")
    return resolve_with_locality(pool, tagged)


def build_graph(symbols: DataFrame, domains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """O-101: (nodes, edges). Edges are unique by (src, dst, kind); a test declaration makes its edges test-scoped."""
    ids = identify(symbols)
    raw = contains_edges(ids).union(relation_edges(ids, domains))
    weight = P.mapped("kind", {k: str(v) for k, v in model.BUILD_WEIGHTS.items()}).cast("double")
    edges = raw.groupBy("src", "dst", "kind").agg(F.bool_and("test").alias("test")).select(
        "src", "dst", "kind", weight.alias("weight"), F.lit("TreeSitter").alias("source"), F.when(F.col("test"), F.lit("Test")).otherwise(F.lit("Production")).alias("scope"), F.lit(0.7).alias("confidence")
    )
    return ids.drop("relations", "parent", "name"), edges


def external_anchors(unresolved: DataFrame) -> DataFrame:
    """O-102: one node per external abstraction named by relations that ask for one."""
    return unresolved.where("synthesize_external").select(F.col("target").alias("symbol_name")).distinct().select(
        F.substring(F.sha2(F.concat(F.lit("<external>:"), "symbol_name"), 256), 1, 32).alias("memory_id"), "symbol_name", F.lit("trait").alias("kind"), F.lit("<external>").alias("file_path")
    )


def document_containment(modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """O-103: (src, dst) from a module to the top-level definitions of the one document it names: ``modules`` is (memory_id, candidate path)."""
    known = nodes.select(F.col("file_path").alias("candidate")).distinct()
    sole = modules.join(known, "candidate").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("document")).where("n = 1")
    top = nodes.where(P.has_role("kind", "definition") & ~F.col("symbol_name").contains("::")).select(F.col("file_path").alias("document"), F.col("memory_id").alias("dst"))
    return sole.join(top, "document").where("memory_id <> dst").select(F.col("memory_id").alias("src"), "dst")


def receiver_methods(methods: DataFrame, types: DataFrame) -> DataFrame:
    """J-9: (method, type) by package directory and receiver name where exactly one type has both."""
    sole = types.groupBy(F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"), F.col("symbol_name").alias("receiver")).agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("type")).where("n = 1")
    own = methods.select(F.col("memory_id").alias("method"), F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"), "receiver")
    return own.join(sole, ["dir", "receiver"]).select("method", "type")


def crate_dependencies(dependencies: DataFrame, crate_roots: DataFrame) -> DataFrame:
    """O-105: depends_on edges between root modules: ``dependencies`` is (from_crate, to_crate), ``crate_roots`` (crate, memory_id)."""
    a = crate_roots.select(F.col("crate").alias("from_crate"), F.col("memory_id").alias("src"))
    b = crate_roots.select(F.col("crate").alias("to_crate"), F.col("memory_id").alias("dst"))
    return dependencies.join(a, "from_crate").join(b, "to_crate").where("src <> dst").select("src", "dst", F.lit("depends_on").alias("kind")).distinct()


def fuse_edges(edges: DataFrame, proven: DataFrame) -> DataFrame:
    """O-106: compiler edges merged in: an edge known from both sources has confidence 0.95, one from the compiler alone 0.9."""
    keys = ["src", "dst", "kind"]
    new = proven.select(*keys, F.lit(True).alias("__p")).distinct()
    joined = edges.join(new, keys, "full")
    both = F.col("__p") & F.col("source").isNotNull()
    return joined.select(
        *keys,
        F.when(both, F.lit("Both")).when(F.col("__p"), F.lit("Scip")).otherwise(F.col("source")).alias("source"),
        F.when(both, F.lit(0.95)).when(F.col("__p"), F.lit(0.9)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("scope", F.lit("Production")).alias("scope"),
    )


def reference_kind(symbol: str) -> Column:
    """O-107: a reference to a type descriptor is a type use, anything else a reference, never a call."""
    return F.when(F.col(symbol).endswith("#"), F.lit("type_of")).otherwise(F.lit("references"))


def project_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-108: unique (caller, callee) edges from call facts (caller, callee, path) with the scope of their sites, and the pairs whose sites disagree, which are an error."""
    scoped = calls.withColumn("scope", F.when(P.source_path_is_test("path"), F.lit("Test")).otherwise(F.lit("Production")))
    pairs = scoped.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("scope").alias("scopes"), F.min("scope").alias("scope"))
    edges = pairs.where("scopes = 1").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"), "scope", F.lit(0.9).alias("confidence"), "sites")
    return edges, pairs.where("scopes > 1").select("caller", "callee")


def join_provider(provider: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-10: provider symbols (provider_symbol_id, language, path, start_byte, end_byte, name) joined to the one node with their extent and name, and those that found none, which withhold negative claims."""
    key = ["language", "path", "start_byte", "end_byte"]
    own = nodes.select("memory_id", "symbol_name", P.language("file_path").alias("language"), F.col("file_path").alias("path"), "start_byte", "end_byte")
    hits = provider.join(own, key).where(P.short_name("symbol_name") == F.col("name"))
    joined = hits.groupBy("provider_symbol_id").agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("memory_id")).where("n = 1").select("provider_symbol_id", "memory_id")
    return joined, provider.join(joined, "provider_symbol_id", "left_anti").select("provider_symbol_id", "name")
