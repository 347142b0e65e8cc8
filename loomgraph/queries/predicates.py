"""Queries of single predicates and scalar functions over the projected nodes, edges and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.functions import source_text as S
from loomgraph.queries.base import over, query


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_BASE = "regexp_extract(path, '[^/]*$')"
_TEST_FILE = f"(list_contains(string_split(path, '/'), 'tests') OR starts_with({_BASE}, 'test_') OR regexp_matches(path, '_tests?[.]rs$'))"
_EXT = "regexp_extract(path, '[^/][.]([^./]+)$', 1)"

query("o03_language_registry", over("files") + f"SELECT path, {_case(_EXT, model.LANGUAGES)} AS language FROM files")(lambda t: t.files.select("path", P.language("path").alias("language")))

query(
    "o01_registered_sources",
    over("files") + f"SELECT path FROM files WHERE {_EXT} IN {_list(model.LANGUAGES)} AND NOT list_has_any(string_split(path, '/'), ['testdata', 'vendor', 'third_party', 'node_modules']) ORDER BY path",
)(lambda t: t.files.where(P.language("path").isNotNull() & ~P.is_excluded_path("path")).select("path").orderBy("path"))

query(
    "o02_source_directories",
    over("files") + f"SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS files FROM files WHERE {_EXT} IN {_list(model.LANGUAGES)} GROUP BY 1",
)(lambda t: t.files.where(P.language("path").isNotNull()).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.count(F.lit(1)).alias("files")))

query("o29_is_test_file", over("files") + f"SELECT path, {_TEST_FILE} AS is_test FROM files")(lambda t: t.files.select("path", P.is_test_file("path").alias("is_test")))

query(
    "o30_node_is_test",
    over("nodes") + "SELECT memory_id, coalesce(is_test_only, list_contains(string_split(file_path, '/'), 'tests') OR starts_with(regexp_extract(file_path, '[^/]*$'), 'test_') OR regexp_matches(file_path, '_tests?[.]rs$')) AS is_test FROM nodes",
)(lambda t: t.nodes.select("memory_id", P.node_is_test("is_test_only", "file_path").alias("is_test")))

query(
    "o31_test_modules",
    over("nodes") + "SELECT memory_id, coalesce(is_test_only, (kind = 'module' AND symbol_name = 'tests') OR starts_with(symbol_name, 'tests::') OR contains(symbol_name, '::tests::')) AS is_test FROM nodes",
)(lambda t: t.nodes.select("memory_id", P.is_test_module("is_test_only", "kind", "symbol_name").alias("is_test")))

query(
    "o32_source_path_is_test",
    over("files")
    + f"""SELECT path, CASE {_case(_EXT, model.LANGUAGES)} WHEN 'rust' THEN {_TEST_FILE} WHEN 'go' THEN ends_with(path, '_test.go')
    WHEN 'python' THEN list_contains(string_split(path, '/'), 'tests') OR starts_with({_BASE}, 'test_') OR regexp_matches({_BASE}, '_test[.]pyi?$') OR {_BASE} = 'conftest.py'
    WHEN 'typescript' THEN regexp_matches({_BASE}, '[.](test|spec|e2e|stories)[.][cm]?[jt]sx?$') OR regexp_matches(path, '(^|/)__tests__/') ELSE false END AS is_test FROM files""",
)(lambda t: t.files.select("path", P.source_path_is_test("path").alias("is_test")))

query("o33_deletable_visibility", over("nodes") + "SELECT memory_id, visibility IN ('private', 'pub(crate)', 'pub(super)') OR starts_with(visibility, 'pub(in ') AS deletable FROM nodes")(
    lambda t: t.nodes.select("memory_id", P.deletable("visibility").alias("deletable"))
)
query("o34_generated_paths", over("files") + "SELECT path, regexp_matches(path, '(^|/)target/(.*/)?build/(.*/)?out(/|$)') AS generated FROM files")(
    lambda t: t.files.select("path", P.is_generated("path").alias("generated"))
)
query("o35_under_test_dir", over("files") + "SELECT path, list_has_any(string_split(path, '/'), ['tests', 'examples', 'benches']) AS under FROM files")(
    lambda t: t.files.select("path", P.under_test_dir("path").alias("under"))
)
query("o36_crate_name", over("files") + "SELECT path, nullif(regexp_extract(path, '^crates/([^/]+)/', 1), '') AS crate FROM files")(lambda t: t.files.select("path", P.crate_name("path").alias("crate")))
query("o37_short_name", over("nodes") + "SELECT memory_id, string_split(symbol_name, '::')[-1] AS short FROM nodes")(lambda t: t.nodes.select("memory_id", P.short_name("symbol_name").alias("short")))

query(
    "o23_kind_roles",
    over("nodes")
    + "SELECT kind, count(*) AS n, kind NOT IN ('use', 'import', 'export') AS definition, "
    + ", ".join(f"kind IN {_list(v)} AS {k}" for k, v in model.ROLES.items())
    + " FROM nodes GROUP BY kind",
)(lambda t: t.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", *[P.has_role("kind", r).alias(r) for r in ["definition", *model.ROLES]]))

query("o24_source_owners", over("nodes") + ", m AS (SELECT DISTINCT file_path AS document, regexp_extract(file_path, '^[^/]*') AS unit FROM nodes WHERE kind <> 'class') SELECT memory_id, unit FROM nodes LEFT JOIN m ON file_path = document")(
    lambda t: t.nodes.join(
        t.nodes.where("kind <> 'class'").select(F.col("file_path").alias("document"), F.substring_index("file_path", "/", 1).alias("unit")).distinct(), F.col("file_path") == F.col("document"), "left"
    ).select("memory_id", "unit")
)

query(
    "o25_filter_admits",
    over("nodes")
    + "SELECT memory_id, reachability_class NOT IN ('dead', 'orphan') AS live, reachability_class IN ('dead', 'orphan') AS dead, reachability_class = 'test_only' AS test_only FROM nodes",
)(lambda t: t.nodes.select("memory_id", *[P.filter_admits(f, "reachability_class").alias(f) for f in ("live", "dead", "test_only")]))

query(
    "o26_reverse_filter",
    over("nodes")
    + "SELECT reachability_class, reachability_class IN ('wired', 'public_api', 'structural', 'unclassified') AS wired, reachability_class IN ('dead', 'orphan') AS dead, reachability_class IN ('test_only', 'unclassified') AS test_only, count(*) AS n FROM nodes GROUP BY 1",
)(lambda t: t.nodes.groupBy("reachability_class").agg(F.count(F.lit(1)).alias("n")).select("reachability_class", *[P.reverse_filter(f, "reachability_class").alias(f) for f in ("wired", "dead", "test_only")], "n"))

query("o27_edge_admission", over("edges") + "SELECT kind, count(*) AS n, " + ", ".join(f"kind IN {_list(v)} AS {k}" for k, v in model.ADMISSION.items()) + " FROM edges GROUP BY kind")(
    lambda t: t.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", *[P.admits(a, "kind").alias(a) for a in model.ADMISSION])
)
query(
    "o38_relationship_scope",
    over("nodes", "edges")
    + "SELECT e.kind, CASE WHEN scope = 'Test' OR coalesce(is_test_only, false) THEN 'tests' WHEN scope = 'CfgGated' THEN 'conditional' ELSE 'production' END AS relation_scope, count(*) AS n FROM edges e LEFT JOIN nodes ON memory_id = src GROUP BY ALL",
)(
    lambda t: t.edges.select("src", "kind", "scope")
    .join(t.nodes.select("memory_id", "is_test_only"), F.col("src") == F.col("memory_id"), "left")
    .groupBy("kind", P.relationship_scope("scope", "is_test_only").alias("relation_scope"))
    .agg(F.count(F.lit(1)).alias("n"))
)
query("o39_dependency_relations", over("edges") + f", r AS (SELECT {_case('kind', model.DEPENDENCY_RELATIONS)} AS relation FROM edges) SELECT relation, count(*) AS n FROM r WHERE relation IS NOT NULL GROUP BY 1")(
    lambda t: t.edges.select(P.mapped("kind", model.DEPENDENCY_RELATIONS).alias("relation")).dropna().groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query("o40_impact_relations", over("edges") + f", r AS (SELECT {_case('kind', model.IMPACT_RELATIONS)} AS relation FROM edges) SELECT relation, count(*) AS n FROM r WHERE relation IS NOT NULL GROUP BY 1")(
    lambda t: t.edges.select(P.mapped("kind", model.IMPACT_RELATIONS).alias("relation")).dropna().groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "o41_visibility_labels",
    over("nodes")
    + "SELECT memory_id, CASE WHEN visibility <> '' THEN lower(visibility) WHEN starts_with(signature, 'pub(crate) ') THEN 'pub(crate)' WHEN starts_with(signature, 'pub(super) ') THEN 'pub(super)' WHEN starts_with(signature, 'pub ') THEN 'pub' ELSE 'private' END AS label FROM nodes",
)(lambda t: t.nodes.select("memory_id", P.visibility_label("visibility", "signature").alias("label")))
query(
    "o44_overview_buckets",
    over("nodes")
    + "SELECT CASE WHEN reachability_class IN ('wired', 'public_api', 'structural') THEN 'alive' WHEN reachability_class IN ('dead', 'orphan') THEN 'dead' WHEN reachability_class = 'test_only' THEN 'test' ELSE reachability_class END AS bucket, count(*) AS n FROM nodes GROUP BY 1",
)(lambda t: t.nodes.groupBy(P.overview_bucket("reachability_class").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))

_TYPES = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Option<Vec<' || p_type || '>>' WHEN 1 THEN '&''a mut ' || p_type WHEN 2 THEN 'HashMap<String, Arc<dyn ' || p_type || '>>' ELSE 'Handle<' || p_type || '>' END AS declared, p_type FROM {part}"""


@query(
    "o42_generic_leaves",
    "WITH d AS (SELECT p_partkey, replace(p_type, ' ', '_') AS p_type FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'Handle,' || p_type ELSE p_type END AS leaves FROM d",
)
def _(t):
    typed = t.sql(_TYPES).withColumn("declared", F.replace(F.col("declared"), F.col("p_type"), F.replace("p_type", F.lit(" "), F.lit("_"))))
    return typed.select("p_partkey", F.array_join(S.leaf_types_col("declared"), ",").alias("leaves"))


@query("o43_blank_lines", """SELECT doc_id, 'x = ' || repeat(' ', length(lang) + 2) || ' + 1 ' AS blank FROM documents""")
def _(t):
    lines = t.table("documents").select("doc_id", F.concat(F.lit('x = "'), "lang", F.lit('" + 1 // "'), "source").alias("line"))
    return lines.select("doc_id", S.blank_line_col("line").alias("blank"))


@query("o10_platform_conditions", "SELECT doc_id, doc_id % 3 = 0 AS conditional FROM documents")
def _(t):
    inner = F.when(F.col("doc_id") % 3 == 0, F.lit("#[cfg(any(unix, feature = \"x\"))]")).when(F.col("doc_id") % 3 == 1, F.lit("#[cfg(test)] // unix")).otherwise(F.lit("let unix = 1;"))
    return t.table("documents").select("doc_id", S.platform_col(F.concat_ws("\n", inner, F.lit("fn f() {}"))).alias("conditional"))


query("o49a_glob_match", over("nodes") + "SELECT memory_id FROM nodes WHERE regexp_matches(symbol_name, '^brand.*::.*red.*$', 'is')")(lambda t: t.nodes.where(P.glob_match("symbol_name", "brand*::*RED*")).select("memory_id"))

query(
    "o115_census_scope",
    over("files") + "SELECT path, list_has_any(string_split(path, '/'), ['testdata', 'vendor', 'third_party', 'node_modules']) AS excluded FROM files",
)(lambda t: t.files.select("path", P.is_excluded_path("path").alias("excluded")))

query(
    "o79_coverage_tier",
    over("nodes")
    + "SELECT file_path, CASE WHEN count(*) FILTER (kind = 'function') = 0 THEN 'not_applicable' WHEN NOT bool_or(k % 2 = 0) THEN 'unavailable' ELSE 'sufficient' END AS tier FROM nodes GROUP BY file_path",
)(
    lambda t: t.nodes.groupBy("file_path")
    .agg(F.count_if(P.has_role("kind", "callable")).alias("c"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("k") % 2 == 0).alias("a"))
    .select("file_path", P.coverage_tier(F.col("c"), F.col("n"), F.col("a")).alias("tier"))
)
query(
    "o80_aggregate_status",
    """WITH s AS (SELECT n_regionkey AS region, CASE WHEN n_regionkey = 0 THEN 'complete' WHEN n_regionkey = 1 THEN CASE n_nationkey % 2 WHEN 0 THEN 'complete' ELSE 'qualified' END
    WHEN n_regionkey = 2 THEN 'unavailable' WHEN n_regionkey = 3 THEN NULL ELSE CASE n_nationkey % 3 WHEN 0 THEN 'complete' ELSE 'partial' END END AS status FROM nation)
    SELECT region, CASE WHEN count(status) = 0 THEN 'not_applicable' WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_and(status IN ('complete', 'qualified')) THEN 'qualified' WHEN bool_and(status = 'unavailable') THEN 'unavailable' ELSE 'partial' END AS status FROM s GROUP BY region""",
)(
    lambda t: t.table("nation")
    .select(
        F.col("n_regionkey").alias("region"),
        F.expr("CASE n_regionkey WHEN 0 THEN 'complete' WHEN 1 THEN if(n_nationkey % 2 = 0, 'complete', 'qualified') WHEN 2 THEN 'unavailable' WHEN 3 THEN NULL ELSE if(n_nationkey % 3 = 0, 'complete', 'partial') END").alias("status"),
    )
    .groupBy("region")
    .agg(P.aggregate_status("status").alias("status"))
)
