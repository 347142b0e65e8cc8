"""Queries of name search, traversal and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.operators import search
from loomgraph.plans import walk as W
from loomgraph.queries.base import over, query

_IMPACT_KINDS = "('references', 'field_of', 'type_of', 'implements', 'extends')"
_DEPENDENCY = "('calls', 'implements', 'contains', 'references', 'type_of', 'field_of', 'has_impl')"


def _asked(t):
    """Requests by name: part and supplier names, some unknown, with a file each."""
    names = t.table("part").select(F.col("p_name").alias("query"), F.concat(F.lit("parts/"), "p_brand").alias("file"))
    names = names.union(t.table("supplier").select("s_name", F.lit("supply/x"))).union(t.table("nation").select(F.concat(F.lit("no such "), "n_name"), F.lit("geo")))
    return names.distinct()


_ASKED = ", asked AS (SELECT DISTINCT * FROM (SELECT p_name AS query, 'parts/' || p_brand AS file FROM part UNION ALL SELECT s_name, 'supply/x' FROM supplier UNION ALL SELECT 'no such ' || n_name, 'geo' FROM nation))"
_FOUND = (
    _ASKED
    + ", hits AS (SELECT DISTINCT asked.query, memory_id, file_path, CASE WHEN symbol_name = asked.query THEN 0 ELSE 1 END AS tier FROM asked JOIN nodes ON symbol_name = asked.query OR ends_with(symbol_name, '::' || asked.query)), "
    "best AS (SELECT *, min(tier) OVER (PARTITION BY query) AS top FROM hits)"
)

query(
    "o45_name_tiers",
    over("nodes")
    + ", q AS (SELECT unnest(['ASIA', 'red', 'Supplier#000000001']) AS query) SELECT query, memory_id, symbol_name, CASE WHEN symbol_name = query THEN 0 WHEN ends_with(symbol_name, '::' || query) THEN 1 ELSE 2 END AS tier FROM nodes JOIN q ON contains(symbol_name, query)",
)(lambda t: search.name_tiers(t.nodes, t.spark.createDataFrame([("ASIA",), ("red",), ("Supplier#000000001",)], "query string")))

query(
    "o46_resolve_unique",
    over("nodes")
    + _FOUND
    + """, c AS (SELECT a.query, a.file, count(memory_id) AS n, count(*) FILTER (file_path = file) AS m, min(memory_id) AS one, min(memory_id) FILTER (file_path = file) AS own FROM asked a LEFT JOIN best b ON a.query = b.query AND tier = top GROUP BY a.query, a.file)
    SELECT query, file, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 OR m = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one WHEN m = 1 THEN own END AS memory_id,
    CASE WHEN n > 1 AND m <> 1 THEN n ELSE 0 END AS candidates FROM c""",
)(lambda t: search.resolve_unique(t.nodes, _asked(t)).withColumn("candidates", F.size("candidates").cast("long")))

query(
    "o47_resolve_in_file",
    over("nodes")
    + _FOUND
    + """, c AS (SELECT a.query, a.file, count(memory_id) AS n, count(*) FILTER (file_path = file) AS m, min(memory_id) FILTER (file_path = file) AS own FROM asked a LEFT JOIN best b ON a.query = b.query AND tier = top GROUP BY a.query, a.file)
    SELECT query, file, CASE WHEN n = 0 THEN 'not_found_in_file' WHEN m = 1 THEN 'unique' ELSE 'wrong_file' END AS status, CASE WHEN m = 1 THEN own END AS memory_id FROM c""",
)(lambda t: search.resolve_in_file(t.nodes, _asked(t)))

query(
    "o48_resolve_with_locality",
    over("nodes")
    + """, r AS (SELECT p_partkey AS rel_id, p_name AS query, 'parts/' || p_brand AS file FROM part),
    h AS (SELECT rel_id, memory_id, symbol_name, file_path, CASE WHEN symbol_name = query THEN 0 ELSE 1 END AS tier, CASE WHEN file_path = file THEN 0 ELSE 2 END AS near FROM r JOIN nodes ON symbol_name = query OR ends_with(symbol_name, '::' || query)),
    o AS (SELECT *, row_number() OVER (PARTITION BY rel_id, tier, near ORDER BY length(symbol_name), symbol_name, file_path, memory_id) AS pos, count(*) OVER (PARTITION BY rel_id, tier) AS total FROM h),
    f AS (SELECT rel_id, memory_id, row_number() OVER (PARTITION BY rel_id ORDER BY tier, near) AS pick FROM o WHERE pos = 1 AND (near < 2 OR total = 1)),
    s AS (SELECT rel_id, min(memory_id) AS memory_id FROM (SELECT *, min(length(symbol_name)) OVER (PARTITION BY rel_id) AS least FROM h) WHERE length(symbol_name) = least GROUP BY rel_id HAVING count(*) = 1)
    SELECT rel_id, memory_id FROM f WHERE pick = 1 UNION ALL SELECT rel_id, memory_id FROM s WHERE rel_id NOT IN (SELECT rel_id FROM f)""",
)(lambda t: search.resolve_with_locality(t.nodes, t.table("part").select(F.col("p_partkey").alias("rel_id"), F.col("p_name").alias("target"), F.concat(F.lit("parts/"), "p_brand").alias("file"))))

query(
    "o49_search_by_name",
    over("nodes")
    + "SELECT 0 AS rank, symbol_name, file_path, line_start + 1 AS line, kind, memory_id, signature FROM nodes WHERE regexp_matches(symbol_name, '^.*::supplier#.*1$', 'is') AND kind = 'struct' ORDER BY rank, symbol_name, file_path, line, kind, memory_id LIMIT 20",
)(lambda t: search.search_by_name(t.nodes, "*::Supplier#*1", kind="STRUCT", definitions_only=True))

query(
    "o49b_search_by_path",
    over("nodes") + "SELECT file_path, line_start + 1 AS line, symbol_name, kind, memory_id FROM nodes WHERE starts_with(file_path, 'geo/') ORDER BY file_path, line, symbol_name, kind, memory_id LIMIT 20",
)(lambda t: search.search_by_path(t.nodes, "geo"))

query(
    "o49d_suggestions",
    over("nodes") + "SELECT DISTINCT symbol_name, levenshtein(lower(symbol_name), 'asja') AS distance FROM nodes WHERE levenshtein(lower(symbol_name), 'asja') <= 3 ORDER BY distance, symbol_name LIMIT 5",
)(lambda t: search.suggestions(t.nodes, "asja"))

query(
    "o49e_find",
    over("nodes") + "SELECT 'suggestion' AS what, symbol_name, levenshtein(lower(symbol_name), 'europ') AS distance FROM (SELECT DISTINCT symbol_name FROM nodes) WHERE levenshtein(lower(symbol_name), 'europ') <= 3 ORDER BY distance, symbol_name LIMIT 5",
)(lambda t: search.find(t.nodes, "EUROP")[0].select(F.lit("row").alias("what"), "symbol_name", F.lit(0).alias("distance")).union(search.find(t.nodes, "EUROP")[1].select(F.lit("suggestion"), "symbol_name", "distance")))


def _roots(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "root string")


def _bfs(kinds: str, a: str, b: str, roots: str, depth: int) -> str:
    return f""", step AS (SELECT DISTINCT {a} AS x, {b} AS y FROM edges WHERE kind IN {kinds}),
    r AS (SELECT id AS root, id AS node, 0 AS depth FROM (SELECT unnest({roots}) AS id) UNION SELECT root, y, depth + 1 FROM r JOIN step ON x = node WHERE depth < {depth})"""


_STRUCTURAL = "(" + ", ".join(f"'{k}'" for k in model.ADMISSION["structural"]) + ")"

query(
    "o50_walk",
    over("edges", recursive=True) + _bfs("('calls', 'references', 'type_of', 'field_of', 'extends')", "src", "dst", "['c0', 'c1', 'c2', 's3']", 2) + "SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node",
)(lambda t: W.walk(W.steps(t.edges, W.without_tests(W.CLASSIFIER_CALLS)), _roots(t, "c0", "c1", "c2", "s3"), 2))

query("o51_reachable", over("edges", recursive=True) + _bfs(_STRUCTURAL, "src", "dst", "['r1']", 2) + "SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node")(
    lambda t: W.walk(W.steps(t.edges, W.REACHABLE_OUT), _roots(t, "r1"), 2)
)


@query(
    "o52_dependents",
    over("nodes", "edges", recursive=True)
    + f""", step AS (SELECT DISTINCT dst AS x, src AS y FROM edges WHERE kind IN {_DEPENDENCY}),
    anchor AS (SELECT 's5' AS a UNION SELECT src FROM edges WHERE kind = 'contains' AND dst = 's5'), up AS (SELECT DISTINCT dst AS id FROM edges JOIN anchor ON src = a WHERE kind IN ('implements', 'has_impl')),
    seed AS (SELECT 's5' AS id UNION SELECT id FROM up WHERE id <> 's5' UNION SELECT dst FROM edges JOIN up ON src = id WHERE kind = 'contains' AND dst <> 's5'),
    r AS (SELECT id AS node, 0 AS depth FROM seed UNION SELECT y, depth + 1 FROM r JOIN step ON x = node WHERE depth < 2),
    d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT file_path, depth, count(*) AS n FROM d JOIN nodes ON node = memory_id WHERE depth > 0 GROUP BY ALL""",
)
def _(t):
    found = W.dependents(t.nodes, t.edges, _roots(t, "s5"), 2)
    return found.join(t.nodes, F.col("node") == F.col("memory_id")).groupBy("file_path", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o53_structural_impact",
    over("nodes", "edges")
    + f""", e AS (SELECT DISTINCT dst AS x, src AS y, CASE kind WHEN 'references' THEN 'references' WHEN 'implements' THEN 'implementation' WHEN 'extends' THEN 'inheritance' ELSE 'type_use' END AS relation FROM edges WHERE kind IN {_IMPACT_KINDS}),
    one AS (SELECT y AS node, min(relation) AS relation FROM e WHERE x = 'p8' AND y <> 'p8' GROUP BY y),
    hop AS (SELECT e.y AS node, one.node AS via, one.relation AS r1, e.relation AS r2, row_number() OVER (PARTITION BY e.y ORDER BY n.file_path, n.symbol_name, n.kind, n.memory_id, e.relation) AS pos FROM one JOIN e ON e.x = one.node JOIN nodes n ON n.memory_id = one.node
      WHERE e.y <> 'p8' AND e.y NOT IN (SELECT node FROM one))
    SELECT node, 1 AS depth, node || '<' || relation || '<p8' AS path FROM one UNION ALL SELECT node, 2, via || '<' || r1 || '<p8/' || node || '<' || r2 || '<' || via FROM hop WHERE pos = 1""",
)
def _(t):
    found, _ = W.impact(t.edges, t.nodes, _roots(t, "p8"), 2)
    return found.select("node", "depth", F.array_join(F.transform("path", lambda p: F.concat_ws("<", p["dependent"], p["relation"], p["dependency"])), "/").alias("path"))


@query(
    "o53_impact_cutoff",
    over("nodes", "edges", recursive=True)
    + _bfs(_IMPACT_KINDS, "dst", "src", "['p8', 'p1']", 2).replace("WHERE depth < 2", "WHERE depth < 2")
    + "SELECT root, count(*) FILTER (depth = 2) AS depth_cutoff_nodes FROM (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node) GROUP BY root",
)
def _(t):
    return W.impact(t.edges, t.nodes, _roots(t, "p8", "p1"), 1)[1]


query(
    "o54_trait_bridge",
    over("edges")
    + """, roots AS (SELECT DISTINCT src AS root FROM edges WHERE kind = 'implements'), anchor AS (SELECT root, root AS a FROM roots UNION SELECT root, src FROM roots JOIN edges ON dst = root WHERE kind = 'contains'),
    up AS (SELECT DISTINCT root, dst AS node FROM anchor JOIN edges ON src = a WHERE kind IN ('implements', 'has_impl'))
    SELECT DISTINCT root, node FROM (SELECT * FROM up UNION ALL SELECT root, dst FROM up JOIN edges ON src = node WHERE kind = 'contains') WHERE root <> node""",
)(lambda t: W.trait_bridge_seeds(t.nodes, t.edges, t.edges.where("kind = 'implements'").select(F.col("src").alias("root")).distinct()))

query(
    "o55_name_bridge",
    "SELECT 'i' || s_suppkey AS impl_method, 't' || n_nationkey AS trait_method FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)(
    lambda t: W.name_bridge(
        t.table("supplier")
        .join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("i"), "s_suppkey").alias("memory_id"), F.concat(F.lit("impl "), "n_name", F.lit("<T> for "), "s_name", F.lit("::run")).alias("symbol_name"))
        .union(t.table("nation").select(F.concat(F.lit("t"), "n_nationkey"), F.concat("n_name", F.lit("::run"))))
    )
)


def _calls_in(t):
    return t.edges.where("kind = 'calls'").select(F.col("dst").alias("from"), F.col("src").alias("to")).distinct()


def _rank(t):
    return t.nodes.select(F.col("memory_id").alias("node"), F.struct("file_path", "symbol_name", "memory_id").alias("rank"))


@query(
    "o56_reverse_calls",
    over("nodes", "edges")
    + """, c AS (SELECT DISTINCT dst AS x, src AS y FROM edges WHERE kind = 'calls'), one AS (SELECT y AS node FROM c WHERE x = 's2'),
    two AS (SELECT c.y AS node, one.node AS via, row_number() OVER (PARTITION BY c.y ORDER BY n.file_path, n.symbol_name, n.memory_id) AS pos FROM one JOIN nodes n ON n.memory_id = one.node JOIN c ON c.x = one.node WHERE c.y NOT IN (SELECT node FROM one) AND c.y <> 's2')
    SELECT node, 1 AS depth, 's2>' || node AS chain FROM one UNION ALL SELECT node, 2, 's2>' || via || '>' || node FROM two WHERE pos = 1""",
)
def _(t):
    found = W.chains(_calls_in(t), _roots(t, "s2"), _rank(t), 3, terminal=t.nodes.where("kind = 'class'").select(F.col("memory_id").alias("node")))
    return found.where("depth > 0").select("node", "depth", F.array_join("chain", ">").alias("chain"))


query(
    "o57_forward_liveness",
    over("nodes", "edges", recursive=True)
    + ", ok AS (SELECT memory_id AS id FROM nodes WHERE NOT starts_with(file_path, 'supply/ALGERIA')), step AS (SELECT DISTINCT src AS x, dst AS y FROM edges JOIN ok ON dst = id WHERE kind = 'calls'), r AS (SELECT memory_id AS node FROM nodes WHERE file_path = 'market/AUTOMOBILE' UNION SELECT y FROM r JOIN step ON x = node) SELECT node FROM r",
)(
    lambda t: W.reach(
        t.edges.where("kind = 'calls'").select(F.col("src").alias("from"), F.col("dst").alias("to")),
        t.nodes.where("file_path = 'market/AUTOMOBILE'").select(F.col("memory_id").alias("node")),
        within=t.nodes.where(~F.col("file_path").startswith("supply/ALGERIA")).select(F.col("memory_id").alias("node")),
    )
)

query(
    "o58_test_callers",
    over("nodes", "edges") + "SELECT DISTINCT dst AS root, src AS node FROM edges JOIN nodes ON src = memory_id WHERE edges.kind = 'calls' AND dst IN ('s1', 's2', 's9') AND is_test_only",
)(
    lambda t: W.chains(_calls_in(t), _roots(t, "s1", "s2", "s9"), _rank(t), 1)
    .where("depth > 0")
    .join(t.nodes.where("is_test_only").select(F.col("memory_id").alias("node")), "node", "left_semi")
    .select("root", "node")
)

query(
    "o59_test_chains",
    over("nodes", "edges")
    + "SELECT memory_id AS test_root, dst AS node, 2 AS links FROM nodes JOIN edges ON src = memory_id WHERE is_test_root AND edges.kind = 'calls' AND dst IN ('s0', 's1')",
)(
    lambda t: W.chains(_calls_in(t), _roots(t, "s0", "s1"), _rank(t), 1, terminal=t.nodes.where("is_test_root").select(F.col("memory_id").alias("node")))
    .where("depth > 0")
    .join(t.nodes.where("is_test_root").select(F.col("memory_id").alias("node")), "node", "left_semi")
    .select(F.col("node").alias("test_root"), F.col("root").alias("node"), F.size("chain").alias("links"))
)

query(
    "o60_traced_path",
    over("edges", recursive=True) + _bfs("('calls', 'references', 'type_of', 'field_of', 'extends')", "src", "dst", "['c0']", 2) + "SELECT root, node, min(depth) AS depth FROM r WHERE node IN ('s1', 's2', 's3') GROUP BY root, node",
)(
    lambda t: W.walk(W.steps(t.edges, W.without_tests(W.REACHABILITY_TRACE)), _roots(t, "c0"), 2).where(F.col("node").isin("s1", "s2", "s3"))
)

query(
    "o61_multi_root_reach",
    over("steps", recursive=True) + ", r AS (SELECT min(src) AS node FROM steps UNION SELECT dst FROM r JOIN steps ON src = node) SELECT node FROM r",
)(lambda t: W.reach(t.steps.select(F.col("src").alias("from"), F.col("dst").alias("to")), t.steps.agg(F.min("src").alias("node"))))

query(
    "o63_unit_closure",
    "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey % 6 = 0 UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey % 6 = 0",
)(
    lambda t: W.upward(
        t.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")),
        t.table("nation").where("n_nationkey % 6 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node")),
    )
)
