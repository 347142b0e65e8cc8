"""Queries of classification, dead code, differences and incremental change."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.operators import changes as D
from loomgraph.operators import classify as C
from loomgraph.queries.base import over, query

_CALL = "('calls', 'references', 'type_of', 'field_of', 'extends')"


def _roots(t):
    """Production: classes of the first segment; test: test roots; public API: structs that are pub."""
    pick = lambda cond, role: t.nodes.where(cond).select(F.lit(role).alias("role"), F.col("memory_id").alias("node"))
    return pick("file_path = 'market/AUTOMOBILE' and k % 5 = 0", "production").union(pick("is_test_root", "test")).union(pick("kind = 'struct' and visibility = 'pub'", "public_api"))


_ROOTS = """, roots AS (SELECT 'production' AS role, memory_id AS node FROM nodes WHERE file_path = 'market/AUTOMOBILE' AND k % 5 = 0 UNION ALL SELECT 'test', memory_id FROM nodes WHERE is_test_root UNION ALL SELECT 'public_api', memory_id FROM nodes WHERE kind = 'struct' AND visibility = 'pub'),
step AS (SELECT DISTINCT src AS x, dst AS y FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id WHERE edges.kind IN ('calls', 'references', 'type_of', 'field_of', 'extends') AND NOT coalesce(a.is_test_only, false) AND NOT coalesce(b.is_test_only, false)),
anystep AS (SELECT DISTINCT src AS x, dst AS y FROM edges WHERE kind IN ('calls', 'references', 'type_of', 'field_of', 'extends')),
wired AS (SELECT node FROM roots WHERE role = 'production' UNION SELECT y FROM wired JOIN step ON x = node),
api AS (SELECT node FROM roots WHERE role = 'public_api' UNION SELECT y FROM api JOIN step ON x = node),
test AS (SELECT node FROM roots WHERE role = 'test' UNION SELECT y FROM test JOIN anystep ON x = node),
reached AS (SELECT node, min(r) AS r FROM (SELECT node, 0 AS r FROM wired UNION ALL SELECT node, 1 FROM api UNION ALL SELECT node, 3 FROM test) GROUP BY node)"""

query("o96_reach_sets", over("nodes", "edges", recursive=True) + _ROOTS + " SELECT node, r AS rank FROM reached")(lambda t: C.reach_sets(t.nodes, t.edges, _roots(t)))

query(
    "o109_roots",
    over("nodes")
    + """, e AS (SELECT 'bin' AS entry, 'market/BUILDING' AS f UNION ALL SELECT 'bench', 'market/FURNITURE' UNION ALL SELECT 'lib', 'supply' UNION ALL SELECT 'test', 'orders/1996'),
    h AS (SELECT * FROM nodes JOIN e ON file_path = f OR (starts_with(file_path, f || '/') AND entry IN ('lib', 'test')))
    SELECT 'production' AS role, memory_id AS node FROM h WHERE entry IN ('bin', 'bench') UNION SELECT 'production', memory_id FROM nodes WHERE entry_retain & 7 <> 0 UNION SELECT 'test', memory_id FROM nodes WHERE is_test_root AND kind = 'function'
    UNION SELECT 'test', memory_id FROM h WHERE entry = 'test' UNION SELECT 'public_api', memory_id FROM h WHERE entry = 'lib' AND visibility = 'pub' AND kind IN ('struct', 'trait') AND NOT coalesce(is_test_only, false)""",
)(lambda t: C.roots(t.nodes, t.spark.createDataFrame([("bin", "market/BUILDING"), ("bench", "market/FURNITURE"), ("lib", "supply"), ("test", "orders/1996")], "kind string, file_path string")))

query(
    "j12_entry_suffix",
    over("nodes")
    + """, e AS (SELECT unnest(['./market/BUILDING', '/home/x/repo/market/FURNITURE', 'OUSEHOLD', 'G', 'supply/none']) AS entry_file), p AS (SELECT DISTINCT file_path FROM nodes)
    SELECT entry_file, file_path FROM p JOIN e ON ends_with(regexp_replace(entry_file, '^[.]/', ''), file_path) OR ends_with(file_path, regexp_replace(entry_file, '^[.]/', ''))""",
)(lambda t: C.entry_files(t.nodes, t.spark.createDataFrame([("./market/BUILDING",), ("/home/x/repo/market/FURNITURE",), ("OUSEHOLD",), ("G",), ("supply/none",)], "entry_file string")))

#: P1 has no callable inside a type and no field, so passes 6, 8 and 9 change nothing here; unit tests cover them.
_CLASSES = (
    _ROOTS
    + """, s1 AS (SELECT memory_id AS node, kind, file_path, visibility, coalesce(r, 4) AS r FROM nodes LEFT JOIN reached ON memory_id = node),
    s2 AS (SELECT node, kind, file_path, visibility, CASE WHEN r = 4 AND kind IN ('use', 'const', 'static', 'type_alias', 'macro', 'module') AND file_path IN (SELECT file_path FROM s1 WHERE r <= 1) THEN 2 ELSE r END AS r FROM s1),
    called AS (SELECT dst AS node FROM edges WHERE kind IN ('calls', 'references') AND src <> dst UNION SELECT dst FROM edges JOIN reached ON src = node WHERE kind IN ('calls', 'references', 'type_of', 'field_of', 'extends') AND src <> dst),
    s3 AS (SELECT node, kind, file_path, visibility, CASE WHEN r = 1 AND node IN (SELECT node FROM roots WHERE role = 'public_api') AND node NOT IN (SELECT node FROM called) THEN 7 ELSE r END AS r FROM s2),
    s4 AS (SELECT node, kind, file_path, CASE WHEN r = 4 AND NOT (visibility IN ('private', 'pub(crate)', 'pub(super)')) THEN 7 ELSE r END AS r FROM s3),
    kids AS (SELECT src AS node, min(r) AS best FROM edges JOIN s4 ON dst = node WHERE edges.kind = 'contains' AND r <= 3 GROUP BY src),
    s5 AS (SELECT s4.node, CASE WHEN kind IN ('impl', 'trait', 'module') AND r IN (4, 7) AND best IS NOT NULL THEN best ELSE r END AS r FROM s4 LEFT JOIN kids ON s4.node = kids.node),
    final AS (SELECT node AS memory_id, ['wired', 'public_api', 'structural', 'test_only', 'dead', 'orphan', 'unclassified', 'suspected', 'excluded'][r + 1] AS reachability_class FROM s5)"""
)
query("o110_classify", over("nodes", "edges", recursive=True) + _CLASSES + " SELECT * FROM final")(lambda t: C.classify(t.nodes, t.edges, _roots(t)))
query("o110_class_counts", over("nodes", "edges", recursive=True) + _CLASSES + " SELECT reachability_class, count(*) AS n FROM final GROUP BY 1")(
    lambda t: C.classify(t.nodes, t.edges, _roots(t)).groupBy("reachability_class").agg(F.count(F.lit(1)).alias("n"))
)


def _state(t):
    return t.nodes.select(F.col("memory_id").alias("node"), P.class_rank("reachability_class").alias("rank"))


_RANKS = ", st AS (SELECT memory_id AS node, kind, symbol_name, file_path, (k % 9)::INT AS r FROM nodes)"

query(
    "o110_structural_kinds",
    over("nodes") + _RANKS + "SELECT node, CASE WHEN r = 4 AND kind = 'module' AND file_path IN (SELECT file_path FROM st WHERE r <= 1) THEN 2 ELSE r END AS rank FROM st",
)(lambda t: C.structural_kinds(t.nodes, _state(t)))

def _owned(t):
    """Suppliers as traits that hold the orders' functions that call them: containment in reverse of calls."""
    nodes = t.nodes.withColumn("kind", F.when(F.col("kind") == "struct", F.lit("trait")).otherwise(F.col("kind")))
    held = t.edges.where("kind = 'calls' and src like 'o%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("contains").alias("kind"))
    return nodes, held


query(
    "o111_trait_rescue",
    over("nodes", "edges")
    + """SELECT e.src AS node, min(CASE WHEN coalesce(c.is_test_only, false) THEN greatest(t.tier, 3) ELSE t.tier END)::INT AS tier FROM edges e JOIN nodes c ON c.memory_id = e.src
    JOIN (SELECT memory_id, CASE k % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 END AS tier FROM nodes WHERE kind = 'struct') t ON t.memory_id = e.dst
    WHERE e.kind = 'calls' AND starts_with(e.src, 'o') AND c.k % 9 = 4 AND t.tier IS NOT NULL GROUP BY 1""",
)(lambda t: C.guard_tiers(*_owned(t), _state(t)))

query(
    "o112_real_callers",
    over("nodes", "edges")
    + "SELECT DISTINCT dst AS node FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id WHERE src <> dst AND b.kind = 'struct' AND ((edges.kind IN ('calls', 'references') AND a.k % 2 = 0) OR (edges.kind IN ('calls', 'references', 'type_of', 'field_of', 'extends') AND a.k % 9 < 4))",
)(
    lambda t: C.real_callers(
        t.edges,
        t.nodes.where("k % 9 < 4").select(F.col("memory_id").alias("node")),
        t.nodes.where("kind = 'struct'").select(F.col("memory_id").alias("node")),
        t.nodes.where("k % 2 = 0").select(F.col("memory_id").alias("node")),
    )
)

query(
    "o113_abstract_rules",
    over("nodes")
    + """, u AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), i AS (SELECT DISTINCT o_custkey AS c, s FROM u JOIN orders ON o = o_orderkey), ok AS (SELECT DISTINCT s FROM i JOIN orders ON o_custkey = c WHERE o_orderkey % 9 < 4)
    SELECT DISTINCT 'o' || o AS node FROM u JOIN ok USING (s) WHERE o % 9 = 4 AND o % 7 = 0""",
)(
    lambda t: (lambda nodes, held, by_class: C.abstract_rules(
        nodes,
        held.union(by_class).union(by_class.select("src", F.col("dst").alias("o")).join(held.select(F.col("dst").alias("o"), F.col("src").alias("s")), "o").select("src", F.col("s").alias("dst"), F.lit("implements").alias("kind")).distinct()),
        _state(t),
    ))(*_owned(t), t.edges.where("kind = 'calls' and src like 'c%'").select("src", "dst", F.lit("contains").alias("kind")))
)

query(
    "o114_field_parents",
    over("nodes") + _RANKS + ", alive AS (SELECT symbol_name FROM st WHERE r <= 2 AND kind IN ('struct', 'class')), f AS (SELECT * FROM st) SELECT node, CASE WHEN r = 4 AND kind = 'trait' AND string_split(symbol_name, '::')[1] IN (SELECT symbol_name FROM alive) THEN 2 ELSE r END AS rank FROM f",
)(lambda t: C.field_parents(t.nodes.withColumn("kind", F.when(F.col("kind") == "trait", F.lit("field")).otherwise(F.col("kind"))), _state(t)))

query(
    "o110_container_rollup",
    over("nodes", "edges") + _RANKS + ", kids AS (SELECT src, min(r) AS best FROM edges JOIN st ON dst = node WHERE edges.kind = 'contains' AND r <= 3 GROUP BY src) SELECT node, CASE WHEN kind IN ('trait', 'module') AND r IN (4, 7) AND best IS NOT NULL THEN best ELSE r END AS rank FROM st LEFT JOIN kids ON node = src",
)(lambda t: C.container_rollup(t.nodes, t.edges, _state(t)))

query(
    "o116_orphan_files",
    over("files") + "SELECT path FROM files WHERE ends_with(path, '.rs') AND regexp_matches(path, '^(src|crates/[^/]+/src)/') AND doc_id % 2 = 0",
)(lambda t: C.orphan_files(t.files, t.files.where("doc_id % 2 = 1").select(F.col("path").alias("file_path"))))


def _verdicts(t, complete=True):
    calls = t.edges.where("kind = 'calls'")
    live = calls.where("scope <> 'Test'").select(F.col("dst").alias("node"))
    tests = calls.where("scope = 'Test'").select(F.col("dst").alias("node"))
    return C.callable_verdicts(t.nodes, live, tests, complete)


_VERDICTS = """, live AS (SELECT DISTINCT dst FROM edges WHERE kind = 'calls' AND scope <> 'Test'), tests AS (SELECT DISTINCT dst FROM edges WHERE kind = 'calls' AND scope = 'Test'),
v AS (SELECT *, CASE WHEN kind <> 'function' THEN CASE WHEN reachability_class IN ('dead', 'orphan') THEN 'structural_candidate' WHEN reachability_class IN ('unclassified', 'suspected') THEN 'unknown' ELSE 'live' END
  WHEN memory_id IN (SELECT dst FROM live) THEN 'live_production' WHEN memory_id IN (SELECT dst FROM tests) THEN 'live_test' WHEN coalesce(is_test_only, false) THEN 'retained_test' ELSE 'unreached' END AS verdict FROM nodes)"""

query("o117_verdicts", over("nodes", "edges") + _VERDICTS + " SELECT memory_id, verdict FROM v")(_verdicts)
query("o117_incomplete_evidence", over("nodes", "edges") + _VERDICTS + " SELECT CASE WHEN verdict = 'unreached' THEN 'unknown' ELSE verdict END AS verdict, count(*) AS n FROM v GROUP BY 1")(
    lambda t: _verdicts(t, complete=False).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
)
query("o118_dead_candidates", over("nodes", "edges") + _VERDICTS + " SELECT file_path, symbol_name, kind, memory_id, verdict FROM v WHERE verdict IN ('unreached', 'structural_candidate', 'unknown')")(
    lambda t: C.dead_candidates(t.nodes, _verdicts(t))
)
query(
    "o82_dead_summary",
    over("nodes", "edges") + _VERDICTS + " SELECT count(*) AS observed, count(*) FILTER (verdict IN ('unreached', 'structural_candidate', 'unknown')) AS candidates, count(*) FILTER (verdict = 'unreached') AS unreached, count(*) FILTER (verdict = 'structural_candidate') AS structural, count(*) FILTER (verdict = 'unknown') AS unknown FROM v",
)(lambda t: C.dead_summary(_verdicts(t)))

_ACTIONS = """, x AS (SELECT dst, bool_or(n.reachability_class NOT IN ('dead', 'orphan', 'unclassified', 'test_only')) AS alive, bool_or(n.reachability_class = 'test_only') AS tested FROM edges JOIN nodes n ON src = n.memory_id WHERE edges.kind IN ('calls', 'references', 'type_of', 'field_of', 'implements', 'extends', 'has_impl') GROUP BY dst),
g AS (SELECT bool_or(has_platform_cfg) AS cfg FROM nodes),
a AS (SELECT memory_id, CASE WHEN coalesce(alive, false) THEN 'alive_dependent' WHEN coalesce(tested, false) THEN 'test_dependent' WHEN reachability_class <> 'dead' THEN 'not_dead' WHEN NOT rustc_flagged_dead THEN 'not_confirmed'
  WHEN NOT visibility IN ('private', 'pub(crate)', 'pub(super)') THEN 'visible' WHEN cfg THEN 'platform_condition' END AS cause FROM nodes LEFT JOIN x ON dst = memory_id, g WHERE reachability_class IN ('dead', 'suspected'))"""
query(
    "o119_dead_actions",
    over("nodes", "edges") + _ACTIONS + " SELECT memory_id, CASE WHEN cause IS NULL THEN 'safe_delete' WHEN cause = 'test_dependent' THEN 'test_only' ELSE 'needs_review' END AS action, cause FROM a",
)(lambda t: C.dead_actions(t.nodes, t.edges))
query("o120_withhold_causes", over("nodes", "edges") + _ACTIONS + " SELECT cause, count(*) AS n FROM a GROUP BY 1")(lambda t: C.dead_actions(t.nodes, t.edges).groupBy("cause").agg(F.count(F.lit(1)).alias("n")))
query(
    "o119_greatest_fixpoint",
    over("nodes", "edges", recursive=True)
    + """, e AS (SELECT src, dst FROM edges WHERE kind = 'contains'), safe AS (SELECT memory_id FROM nodes WHERE k % 4 <> 1 AND kind IN ('namespace', 'struct', 'class')), unsafe AS (SELECT src AS node FROM e WHERE src NOT IN (SELECT memory_id FROM safe) UNION SELECT dst FROM unsafe JOIN e ON src = node)
    SELECT memory_id, CASE WHEN kind NOT IN ('namespace', 'struct', 'class') OR k % 4 = 1 THEN 'needs_review' WHEN memory_id IN (SELECT node FROM unsafe) THEN 'needs_review' ELSE 'safe_delete' END AS action FROM nodes""",
)(
    lambda t: C.dead_actions(
        t.nodes.withColumns({"reachability_class": F.lit("dead"), "rustc_flagged_dead": F.col("kind").isin("namespace", "struct", "class") & (F.col("k") % 4 != 1), "visibility": F.lit("private"), "has_platform_cfg": F.lit(False), "entry_retain": F.lit(0)}),
        t.edges.where("kind = 'contains'"),
    ).select("memory_id", "action")
)
query(
    "o121_dead_reasons",
    over("nodes", "edges")
    + """, u AS (SELECT dst, min(CASE WHEN e.kind = 'contains' AND n.reachability_class IN ('dead', 'orphan') THEN string_split(n.symbol_name, '::')[-1] END) AS parent, count(*) FILTER (e.kind IN ('calls', 'implements', 'references', 'type_of', 'field_of', 'has_impl')) AS c,
    count(*) FILTER (e.kind IN ('calls', 'implements', 'references', 'type_of', 'field_of', 'has_impl') AND n.reachability_class = 'test_only') AS q FROM edges e JOIN nodes n ON src = n.memory_id GROUP BY dst)
    SELECT memory_id, CASE WHEN parent IS NOT NULL THEN 'dead_parent' WHEN coalesce(c, 0) = 0 THEN 'no_incoming' WHEN c = q THEN 'tests_only' ELSE 'no_path' END AS reason, parent FROM nodes LEFT JOIN u ON dst = memory_id WHERE reachability_class = 'dead'""",
)(lambda t: C.dead_reasons(t.nodes, t.edges))
query(
    "o122_suppression",
    over("nodes", "edges") + _ACTIONS + " SELECT 'unknown' AS action, count(*) AS n FROM a",
)(lambda t: C.suppress(C.dead_actions(t.nodes, t.edges), t.nodes, "unavailable", ["rust"]).groupBy("action").agg(F.count(F.lit(1)).alias("n")))
query(
    "o123_apply_oracle",
    over("nodes")
    + """, d AS (SELECT s_suppkey AS d, file_path, line_start, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN 'other' END AS subject FROM supplier JOIN nodes ON memory_id = 's' || s_suppkey),
    h AS (SELECT d.d, d.subject, n.memory_id, n.symbol_name, count(*) OVER (PARTITION BY d.d) AS c FROM d JOIN nodes n ON n.file_path = d.file_path AND n.line_start = d.line_start)
    SELECT memory_id, memory_id IN (SELECT memory_id FROM h WHERE c = 1 AND (subject IS NULL OR subject = string_split(symbol_name, '::')[-1])) AS flagged FROM nodes""",
)(
    lambda t: C.apply_oracle(
        t.nodes,
        t.nodes.where("kind = 'struct'").select(
            F.col("file_path").alias("file_name"), (F.col("line_start") + 1).alias("line"), F.when(F.col("k") % 2 == 0, P.short_name("symbol_name")).when(F.col("k") % 3 == 0, F.lit("other")).alias("subject")
        ),
        True,
    ).select("memory_id", F.col("rustc_flagged_dead").alias("flagged"))
)

# ---- differences: orders before and after a fixed perturbation


def _versions(t):
    base = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("h"))
    before = base.where("o_orderkey % 7 <> 0")
    after = base.where("o_orderkey % 5 <> 0").withColumn("h", F.when(F.col("o_orderkey") % 11 == 0, F.lit("X")).otherwise(F.col("h")))
    shape = lambda df: df.select(F.concat(F.lit("o"), "o_orderkey").alias("symbol_name"), F.concat(F.lit("f"), (F.col("c") % 50).cast("string")).alias("file_path"), "h")
    return shape(before), shape(after)


_DIFF = """WITH v AS (SELECT 'o' || o_orderkey AS symbol_name, 'f' || (o_custkey % 50) AS file_path, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'added' END WHEN o_orderkey % 5 = 0 THEN 'removed'
  WHEN o_orderkey % 11 = 0 AND o_orderstatus <> 'X' THEN 'modified' ELSE 'unchanged' END AS change FROM orders), d AS (SELECT * FROM v WHERE change IS NOT NULL)"""


def _diff(t):
    return D.full_diff(*_versions(t), ["symbol_name", "file_path"], "h")


query("j03_symbol_diff", _DIFF + " SELECT symbol_name, file_path, change FROM d")(_diff)
query("o98_diff_verdict", _DIFF + " SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, 'differences' AS verdict FROM d")(lambda t: D.verdict(_diff(t), False))
query(
    "o95_bounded_diff",
    _DIFF
    + " SELECT symbol_name, file_path, change, row_number() OVER (ORDER BY file_path, CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, symbol_name)::INT AS row_no FROM d WHERE change <> 'unchanged' QUALIFY row_no <= 100",
)(lambda t: D.bounded(_diff(t), 100))
query("j04_file_diff", _DIFF + ", f AS (SELECT file_path, count(*) FILTER (change <> 'added') AS b, count(*) FILTER (change <> 'removed') AS a FROM d GROUP BY 1) SELECT file_path, CASE WHEN a = b THEN 'unchanged' ELSE 'modified' END AS change FROM f")(
    lambda t: D.full_diff(*[v.groupBy("file_path").agg(F.count(F.lit(1)).alias("h")) for v in _versions(t)], ["file_path"], "h")
)
query(
    "j02_live_state",
    "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'unavailable' WHEN doc_id % 4 = 0 THEN 'not_indexed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'exact_match' END AS state FROM documents",
)(
    lambda t: D.live_state(
        t.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.when(F.col("doc_id") % 13 != 0, F.concat("source", F.when(F.col("doc_id") % 3 == 0, F.lit("!")).otherwise(F.lit("")))).alias("hash")),
        t.table("documents").where("doc_id % 4 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("source").alias("hash")),
    )
)
query("o133_freshness", "SELECT 'stale' AS status, count(*) FILTER (doc_id % 10 = 0) AS differing, count(*) AS population FROM documents")(
    lambda t: D.freshness(
        t.table("documents").where("doc_id % 20 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 == 0, F.lit("x")).otherwise(F.md5("text")).alias("hash")),
        t.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash")),
    )
)
query(
    "o97_baseline_diff",
    over("nodes")
    + ", d AS (SELECT symbol_name || chr(9) || file_path || chr(9) || kind AS key, bool_or(reachability_class IN ('dead', 'orphan')) AS old, bool_or(k % 4 = 0) AS new FROM nodes GROUP BY 1) SELECT key, CASE WHEN new THEN 'new' ELSE 'resolved' END AS change FROM d WHERE old <> new",
)(lambda t: D.baseline_diff(t.nodes, t.nodes.withColumn("reachability_class", F.when(F.col("k") % 4 == 0, F.lit("dead")).otherwise(F.lit("wired")))))
query(
    "o97_regression",
    over("nodes") + "SELECT count(*) FILTER (k % 4 = 0) - count(*) FILTER (reachability_class = 'dead') AS dead_delta, -count(*) FILTER (reachability_class = 'orphan') AS orphan_delta, true AS is_regression, true AS exceeds_threshold FROM nodes",
)(lambda t: D.regression(t.nodes, t.nodes.withColumn("reachability_class", F.when(F.col("k") % 4 == 0, F.lit("dead")).otherwise(F.lit("wired"))), 5))
query(
    "o99_change_set",
    "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'added' WHEN doc_id % 8 = 0 THEN 'removed' WHEN doc_id % 6 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM documents) SELECT change, count(*) AS n FROM f GROUP BY 1",
)(
    lambda t: D.full_diff(
        t.table("documents").where("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash")),
        t.table("documents").where("doc_id % 9 = 0 or doc_id % 8 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 6 == 0, F.lit("x")).otherwise(F.sha2("text", 256)).alias("hash")),
        ["path"],
        "hash",
    ).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "o100_impact_union",
    over("edges")
    + ", a AS (SELECT src AS node, 1 AS d FROM edges WHERE kind = 'calls' AND dst = 's1'), b AS (SELECT DISTINCT src AS node, 2 AS d FROM edges WHERE kind = 'references' AND dst IN ('p1', 'p2')) SELECT coalesce(a.node, b.node) AS node, least(a.d, b.d) AS depth, a.node IS NOT NULL AS by_execution, b.node IS NOT NULL AS by_structure FROM (SELECT DISTINCT * FROM a) a FULL JOIN b ON a.node = b.node",
)(
    lambda t: D.impact_union(
        t.edges.where("kind = 'calls' and dst = 's1'").select(F.col("src").alias("node"), F.lit(1).alias("depth")), t.edges.where("kind = 'references' and dst in ('p1', 'p2')").select(F.col("src").alias("node"), F.lit(2).alias("depth"))
    )
)


def _weighted(t):
    """Calls of customers with an age and a use per later order line."""
    e = t.edges.where("kind = 'calls' and src like 'c%'").select("src", "dst", "kind")
    k = F.expr("cast(substring(dst, 2) as bigint)")
    return e.withColumns({"weight": F.lit(0.5), "access_count": k % 3, "last_accessed_ms": F.when(k % 4 > 0, k % 4 * 1000)})


query(
    "o124_traverse",
    "WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, count(l_orderkey) AS hits, o_orderkey AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 2 GROUP BY ALL) SELECT src, dst, round(CASE WHEN hits > 0 THEN greatest(0.5, least(0.5 + 0.125 * hits, 1.0)) ELSE 0.5 END, 6)::DOUBLE AS weight, (k % 3 + hits)::BIGINT AS access_count FROM e",
)(
    lambda t: D.traverse(
        _weighted(t),
        t.table("lineitem").where("l_linenumber > 2").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("calls").alias("kind")),
        9000,
        rate=0.125,
    ).select("src", "dst", F.round("weight", 6).alias("weight"), "access_count")
)
query("o124_decay", "SELECT 'o' || o_orderkey AS dst, CASE WHEN o_orderkey % 4 < 3 THEN 0.25 ELSE 0.5 END::DOUBLE AS weight FROM orders")(
    lambda t: D.decay(_weighted(t), 4000, 1500, factor=0.5, least=0.25).select("dst", "weight")
)
query("o125_restore_plasticity", "SELECT 'o' || o_orderkey AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS weight, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_orderkey % 3 END::BIGINT AS access_count FROM orders")(
    lambda t: D.restore_plasticity(_weighted(t), _weighted(t).where("cast(substring(dst, 2) as bigint) % 2 = 0").withColumns({"weight": F.lit(0.75), "access_count": F.lit(7).cast("bigint")})).select("dst", "weight", "access_count")
)
query(
    "o126_invalidate_files",
    over("nodes", "edges") + ", gone AS (SELECT memory_id FROM nodes WHERE starts_with(file_path, 'supply/')) SELECT (SELECT count(*) FROM nodes WHERE memory_id NOT IN (SELECT memory_id FROM gone)) AS nodes, count(*) AS edges FROM edges WHERE src NOT IN (SELECT memory_id FROM gone) AND dst NOT IN (SELECT memory_id FROM gone)",
)(
    lambda t: (lambda r: r[0].agg(F.count(F.lit(1)).alias("nodes")).join(r[1].agg(F.count(F.lit(1)).alias("edges"))))(
        D.invalidate_files(t.nodes, t.edges, t.nodes.where(F.col("file_path").startswith("supply/")).select("file_path").distinct())
    )
)
query(
    "o127_selective_invalidation",
    over("nodes") + "SELECT memory_id, CASE WHEN k % 6 = 0 THEN 'new' WHEN k % 5 = 0 THEN 'removed' WHEN k % 4 = 0 THEN 'removed' ELSE 'kept' END AS fate FROM nodes",
)(
    lambda t: D.selective_invalidation(
        t.nodes.where("k % 6 <> 0").withColumn("content_hash", F.md5("signature")),
        t.nodes.where("k % 6 = 0 or k % 5 <> 0").withColumn("content_hash", F.when(F.col("k") % 4 == 0, F.lit("x")).otherwise(F.md5("signature"))),
    )
)
query(
    "o136_lost_capabilities",
    "SELECT DISTINCT c_mktsegment AS capability, 'default' AS configuration, n_name AS language FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND n_regionkey = 0",
)(
    lambda t: (lambda base: D.lost_capabilities(base, base.where("not (capability = 'MACHINERY' and r = 0)")))(
        t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("capability"), F.lit("default").alias("configuration"), F.col("n_name").alias("language"), F.lit("complete").alias("status"), F.col("n_regionkey").alias("r"))
    )
)
