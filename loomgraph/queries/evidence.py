"""Queries of evidence, graph construction and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators import build as B
from loomgraph.operators import enrich as N
from loomgraph.operators import evidence as E
from loomgraph.queries.base import over, query

#: Receipts from suppliers over units, which are nations: r0 and r1 by language, some units alone.
_RECEIPTS = """SELECT 'prov' || s_suppkey % 4 AS provider, 'v' || s_suppkey % 2 AS version, 'calls' AS capability, 'default' AS configuration, 'lang' || n_regionkey AS language,
CASE WHEN s_suppkey % 9 = 0 THEN 'language' ELSE 'unit' END AS scope_kind, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'unit' || n_nationkey END AS scope_id, CASE WHEN s_suppkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS status FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
_REQUIRED = "SELECT 'lang' || n_regionkey AS language, 'unit' || n_nationkey AS unit FROM {nation}"
_BASE = f"WITH rc AS ({_RECEIPTS}), q AS ({_REQUIRED})".replace("{supplier}", "supplier").replace("{nation}", "nation") + (
    ", c AS (SELECT q.language, q.unit, provider, version, status, CASE WHEN scope_kind = 'language' THEN 1 ELSE 3 END AS spec FROM q JOIN rc ON rc.language = q.language AND (scope_kind = 'language' OR scope_id = q.unit))"
)


def _rc(t):
    return t.sql(_RECEIPTS)


def _req(t):
    return t.sql(_REQUIRED)


query(
    "o128_resolve_provider",
    _BASE
    + ", h AS (SELECT provider FROM c WHERE status = 'complete' AND language = 'lang0' GROUP BY provider HAVING count(DISTINCT unit) = (SELECT count(*) FROM q WHERE language = 'lang0')) SELECT CASE count(*) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'complete' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(provider) END AS provider FROM h",
)(lambda t: E.resolve_provider(_rc(t), "calls", _req(t).where("language = 'lang0'")))
query(
    "o129_most_specific",
    _BASE
    + """, o AS (SELECT *, rank() OVER (PARTITION BY language, unit ORDER BY spec DESC) AS r FROM c WHERE provider = 'prov1'), p AS (SELECT language, unit, count(*) AS n, min(status) AS status, min(version) AS version FROM o WHERE r = 1 GROUP BY ALL), v AS (SELECT count(DISTINCT version) AS vs FROM p)
    SELECT q.language, q.unit, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' WHEN vs > 1 THEN 'mixed_versions' ELSE 'resolved' END AS outcome, CASE WHEN n = 1 AND vs <= 1 THEN status END AS status, CASE WHEN n = 1 AND vs <= 1 THEN version END AS version FROM q LEFT JOIN p USING (language, unit), v""",
)(lambda t: E.most_specific(_rc(t), "calls", _req(t), "prov1"))
query(
    "o130_assess_language",
    _BASE
    + """, b AS (SELECT language, unit, bool_or(status = 'complete') AS f, bool_or(status = 'partial') AS p FROM c GROUP BY ALL), g AS (SELECT q.language, count(*) AS scopes, count(*) FILTER (coalesce(f, false)) AS covered, count(*) FILTER (coalesce(p, false) AND NOT coalesce(f, false)) AS parts FROM q LEFT JOIN b USING (language, unit) GROUP BY 1)
    SELECT language, CASE WHEN covered = scopes THEN 'complete' WHEN parts + covered > 0 THEN 'partial' ELSE 'unavailable' END AS status, scopes, covered, CASE WHEN covered = scopes THEN NULL WHEN parts > 0 THEN 'partial_receipt' ELSE 'no_receipt' END AS gap FROM g""",
)(lambda t: E.assess(_rc(t), "calls", _req(t)))
query(
    "o131_capability_wrappers",
    _BASE + " SELECT DISTINCT language, 'unavailable' AS status, count(*) AS scopes, 0::BIGINT AS covered, 'no_receipt' AS gap FROM q GROUP BY language",
)(lambda t: E.assess(_rc(t), "callable_liveness", _req(t)))
query("o132_inventory_coverage", "SELECT 'lang' || r_regionkey AS language, CASE WHEN r_regionkey % 2 = 0 THEN 'partial' ELSE 'complete' END AS coverage FROM region")(
    lambda t: E.inventory_coverage(t.table("nation").where("n_regionkey % 2 = 0").select(F.concat(F.lit("lang"), "n_regionkey").alias("language")), t.table("region").select(F.concat(F.lit("lang"), "r_regionkey").alias("language")))
)
query(
    "o135_status_verdict",
    "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 'unindexed' WHEN n_nationkey % 6 = 1 THEN 'load_failed' WHEN n_nationkey % 6 = 2 THEN 'origin_mismatch' WHEN n_nationkey % 6 = 3 THEN 'stale' WHEN n_nationkey % 6 = 4 THEN 'calls_incomplete' ELSE 'ok' END AS verdict FROM nation",
)(
    lambda t: E.status_verdict(
        t.table("nation").select(
            F.col("n_nationkey").alias("k"), *[(F.col("n_nationkey") % 6 != i).alias(n) for i, n in ((0, "indexed"), (1, "loaded"), (2, "origin_matches"), (4, "calls_complete"))],
            F.when(F.col("n_nationkey") % 6 == 3, F.lit("stale")).otherwise(F.lit("fresh")).alias("freshness"),
        )
    ).select("k", "verdict")
)
query(
    "o137_unit_liveness",
    over("nodes")
    + "SELECT memory_id, file_path AS unit, CASE WHEN file_path = 'orders/1995' THEN k % 2 = 0 WHEN file_path = 'orders/1996' THEN k % 3 = 0 END AS production, CASE WHEN file_path = 'orders/1995' THEN false WHEN file_path = 'orders/1996' THEN k % 5 = 0 END AS test, CASE file_path WHEN 'orders/1995' THEN 'native' WHEN 'orders/1996' THEN 'calls' ELSE 'incomplete' END AS basis FROM nodes WHERE kind = 'function'",
)(
    lambda t: (lambda f: E.unit_liveness(
        f.select("memory_id", F.col("file_path").alias("unit")),
        f.where("file_path = 'orders/1995'").select(F.col("file_path").alias("unit"), "memory_id", (F.col("k") % 2 == 0).alias("production"), F.lit(False).alias("test")),
        f.select("memory_id", (F.col("k") % 3 == 0).alias("production"), (F.col("k") % 5 == 0).alias("test")),
        f.where("file_path = 'orders/1996'").select(F.col("file_path").alias("unit")),
    ))(t.nodes.where("kind = 'function'"))
)
query("o138_live_inputs", "SELECT r_regionkey, 'fresh' AS live_inputs FROM region")(lambda t: E.with_live_inputs(t.table("region").select("r_regionkey"), t.spark.createDataFrame([("fresh",)], "status string")))
query(
    "o139_risk_signals",
    over("nodes", "edges")
    + """, a AS (SELECT DISTINCT src AS node, 1 AS depth FROM edges WHERE kind = 'calls' AND dst IN ('s1', 's2') UNION ALL SELECT 'c1', 2 UNION ALL SELECT 'c2', 2)
    SELECT count(*) AS affected_symbols, count(DISTINCT file_path) AS affected_files, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(DISTINCT regexp_extract(file_path, '^[^/]*')) > 1 AS crosses_units, max(depth) AS max_depth,
    count(*) FILTER (is_test_only) AS tests, 0::BIGINT AS bindings FROM a JOIN nodes ON node = memory_id""",
)(
    lambda t: E.risk_signals(
        t.edges.where("kind = 'calls' and dst in ('s1', 's2')").select(F.col("src").alias("node"), F.lit(1).alias("depth")).distinct().union(t.spark.createDataFrame([("c1", 2), ("c2", 2)], "node string, depth int")),
        t.nodes,
        t.nodes.where("is_test_only").select(F.col("memory_id").alias("node")),
        t.nodes.where("kind = 'field'").select(F.col("memory_id").alias("node")),
    )
)

# ---- construction


def _symbols(t):
    """Suppliers as classes in their nation's file, parts as their methods; parts repeat names within a brand."""
    return t.sql(
        """SELECT 'src/' || n_name || '.py' AS file_path, s_name AS name, 'class' AS kind, '' AS parent, s_suppkey * 10 AS start_byte, s_suppkey * 10 + 9 AS end_byte, false AS is_test_only,
        CASE WHEN s_suppkey % 2 = 0 THEN array(named_struct('tag', 'extends', 'target', 'Supplier#' || lpad(CAST(s_suppkey + 1 AS STRING), 9, '0')), named_struct('tag', 'implements', 'target', 'Send')) ELSE array(named_struct('tag', 'implements', 'target', 'Nobody')) END AS relations FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT 'src/' || n_name || '.py', p_name, 'method', s_name, p_partkey * 10, p_partkey * 10 + 5, p_partkey % 2 = 0, array(named_struct('tag', 'references', 'target', s_name)) FROM {part} JOIN {supplier} ON s_suppkey = p_partkey % 100 JOIN {nation} ON s_nationkey = n_nationkey"""
    )


query(
    "o90_identify",
    """WITH m AS (SELECT 'src/' || n_name || '.py' AS file_path, s_name || '::' || p_name AS symbol_name, p_partkey FROM part JOIN supplier ON s_suppkey = p_partkey % 100 JOIN nation ON s_nationkey = n_nationkey)
    SELECT file_path, symbol_name, (row_number() OVER (PARTITION BY file_path, symbol_name ORDER BY p_partkey) - 1)::INT AS ordinal, substr(sha256(file_path || ':' || symbol_name || CASE WHEN row_number() OVER (PARTITION BY file_path, symbol_name ORDER BY p_partkey) > 1 THEN '#' || (row_number() OVER (PARTITION BY file_path, symbol_name ORDER BY p_partkey) - 1) ELSE '' END), 1, 32) AS memory_id FROM m
    UNION ALL SELECT 'src/' || n_name || '.py', s_name, 0, substr(sha256('src/' || n_name || '.py:' || s_name), 1, 32) FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)(lambda t: B.identify(_symbols(t)).select("file_path", "symbol_name", "ordinal", "memory_id"))
query(
    "o101_build_graph",
    """WITH p AS (SELECT p_partkey, p_name, s_suppkey, row_number() OVER (PARTITION BY s_suppkey, p_name ORDER BY p_partkey) AS ord FROM part JOIN supplier ON s_suppkey = p_partkey % 100)
    SELECT 'contains' AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'Test' ELSE 'Production' END AS scope, 1.0::DOUBLE AS weight, count(*) AS n FROM p GROUP BY 1, 2
    UNION ALL SELECT 'references', CASE WHEN p_partkey % 2 = 0 THEN 'Test' ELSE 'Production' END, 0.5, count(*) FROM p GROUP BY 1, 2
    UNION ALL SELECT 'extends', 'Production', 1.0, count(*) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 2 = 0""",
)(lambda t: B.build_graph(_symbols(t))[1].groupBy("kind", "scope", "weight").agg(F.count(F.lit(1)).alias("n")))
query(
    "o102_external_anchors", "SELECT DISTINCT p_brand AS symbol_name, substr(sha256('<external>:' || p_brand), 1, 32) AS memory_id, 'trait' AS kind, '<external>' AS file_path FROM part WHERE p_size > 10"
)(lambda t: B.external_anchors(t.table("part").select(F.col("p_brand").alias("target"), (F.col("p_size") > 10).alias("synthesize_external"))))
query(
    "o103_document_containment",
    over("nodes") + "SELECT 'm' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation WHERE n_nationkey % 2 = 0",
)(
    lambda t: B.document_containment(
        t.sql("SELECT 'm' || n_nationkey AS memory_id, 'geo/' || r_name AS candidate FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT 'm' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'none' ELSE 'market/BUILDING' END FROM {nation}"), t.nodes
    )
)
query(
    "o104_domain_guard",
    "SELECT 'extends' AS kind, count(*) AS n FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey WHERE a.s_suppkey % 2 = 0 AND x.n_regionkey = y.n_regionkey",
)(
    lambda t: B.relation_edges(
        B.identify(_symbols(t).where("kind = 'class'")), t.table("nation").select(F.concat(F.lit("src/"), "n_name", F.lit(".py")).alias("file_path"), F.concat(F.lit("d"), "n_regionkey").alias("domain"))
    ).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
)
query("o105_crate_dependencies", "SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'depends_on' AS kind FROM nation")(
    lambda t: B.crate_dependencies(
        t.table("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("from_crate"), F.concat(F.lit("N"), "n_nationkey").alias("to_crate")),
        t.sql("SELECT 'R' || r_regionkey AS crate, 'r' || r_regionkey AS memory_id FROM {region} UNION ALL SELECT 'N' || n_nationkey, 'n' || n_nationkey FROM {nation}"),
    )
)
query(
    "o106_fuse_edges",
    over("edges")
    + "SELECT source, kind, confidence, count(*) AS n FROM (SELECT kind, CASE WHEN kind = 'field_of' THEN 'Both' ELSE source END AS source, CAST(CASE WHEN kind = 'field_of' THEN 0.95 ELSE confidence END AS DOUBLE) AS confidence FROM edges WHERE kind IN ('field_of', 'contains') UNION ALL SELECT 'type_of', 'Scip', CAST(0.9 AS DOUBLE) FROM edges WHERE kind = 'type_of') GROUP BY ALL",
)(
    lambda t: B.fuse_edges(t.edges.where("kind in ('field_of', 'contains')"), t.edges.where("kind in ('field_of', 'type_of')")).groupBy("source", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))
)
query("o107_reference_kinds", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'type_of' ELSE 'references' END AS kind FROM part")(
    lambda t: t.table("part").withColumn("s", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit("#")).otherwise(F.lit("().")))).select("p_partkey", B.reference_kind("s").alias("kind"))
)
_SITES = "SELECT 'o' || l_orderkey AS caller, 's' || l_suppkey % 50 AS callee, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 'tests/a.py' ELSE 'src/a.py' END AS path FROM {lineitem}"
_PAIRS = ", p AS (SELECT caller, callee, count(*) AS sites, count(DISTINCT path) AS scopes, min(path) AS path FROM c GROUP BY ALL) "
query(
    "o108_calls_projection",
    "WITH c AS (" + _SITES.replace("{lineitem}", "lineitem") + ")" + _PAIRS + "SELECT caller AS src, callee AS dst, 'calls' AS kind, CASE WHEN path = 'tests/a.py' THEN 'Test' ELSE 'Production' END AS scope, 0.9::DOUBLE AS confidence, sites FROM p WHERE scopes = 1",
)(lambda t: B.project_calls(t.sql(_SITES))[0])
query("o108_scope_conflicts", "WITH c AS (" + _SITES.replace("{lineitem}", "lineitem") + ")" + _PAIRS + "SELECT caller, callee FROM p WHERE scopes > 1")(lambda t: B.project_calls(t.sql(_SITES))[1])
query(
    "j09_receiver_methods",
    "WITH t AS (SELECT p_partkey % 500 AS d, p_brand AS r, min('t' || p_partkey) AS type FROM part GROUP BY ALL HAVING count(*) = 1) SELECT 'm' || s_suppkey AS method, type FROM supplier JOIN part ON p_partkey = s_suppkey JOIN t ON d = s_suppkey % 500 AND r = p_brand",
)(
    lambda t: B.receiver_methods(
        t.sql("SELECT 'm' || s_suppkey AS memory_id, 'pkg' || s_suppkey % 500 || '/m.go' AS file_path, p_brand AS receiver FROM {supplier} JOIN {part} ON p_partkey = s_suppkey"),
        t.sql("SELECT 't' || p_partkey AS memory_id, 'pkg' || p_partkey % 500 || '/t' || p_partkey || '.go' AS file_path, p_brand AS symbol_name FROM {part}"),
    )
)
_PROVIDER = "SELECT 'q' || p_partkey AS provider_symbol_id, 'python' AS language, 'src/' || p_brand || '.py' AS path, p_partkey * 10 AS start_byte, p_partkey * 10 + 5 AS end_byte, CASE WHEN p_partkey % 6 = 0 THEN 'other' ELSE p_name END AS name FROM {part}"
query("j10_provider_join", "SELECT 'q' || p_partkey AS provider_symbol_id, 'n' || p_partkey AS memory_id FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 7 <> 0")(
    lambda t: B.join_provider(t.sql(_PROVIDER), t.sql("SELECT 'n' || p_partkey AS memory_id, 'X::' || p_name AS symbol_name, 'src/' || p_brand || '.py' AS file_path, p_partkey * 10 AS start_byte, p_partkey * 10 + 5 AS end_byte FROM {part} WHERE p_partkey % 7 <> 0"))[0]
)

# ---- enrichment

_COUPLED = "('calls', 'implements', 'references', 'type_of')"
_FANS = f", f AS (SELECT memory_id, (SELECT count(*) FROM edges WHERE dst = memory_id AND kind IN {_COUPLED}) AS fan_in, (SELECT count(*) FROM edges WHERE src = memory_id AND kind IN {_COUPLED}) AS fan_out FROM nodes)"
query("o71_fan_counts", over("nodes", "edges") + _FANS + "SELECT memory_id, fan_in, fan_out, CASE WHEN fan_in + fan_out > 0 THEN round(fan_in / (fan_in + fan_out), 6) END AS stability FROM f")(lambda t: N.fan_counts(t.nodes, t.edges))
query(
    "o72_file_risk",
    over("nodes", "edges")
    + _FANS
    + """, n AS (SELECT nodes.*, fan_in, fan_out AS centrality, k % 4 = 0 AS has_test_path FROM nodes JOIN f USING (memory_id)), o AS (SELECT (list(fan_in ORDER BY fan_in))[ceil((count(*) - 1) * 0.9)::INT + 1] AS f90, (list(centrality ORDER BY centrality))[ceil((count(*) - 1) * 0.9)::INT + 1] AS c90 FROM n),
    g AS (SELECT file_path, CASE WHEN bool_or(fan_in > f90) THEN 2.0 ELSE 0 END + CASE WHEN bool_or(centrality > c90) THEN 2.0 ELSE 0 END + CASE WHEN count(*) FILTER (reachability_class IN ('dead', 'orphan')) * 2 > count(*) THEN 1.0 ELSE 0 END + CASE WHEN bool_or(reachability_class = 'wired' AND NOT has_test_path) THEN 1.5 ELSE 0 END
    + CASE WHEN length(file_path) > 15 THEN 1.5 ELSE 0 END + CASE WHEN length(file_path) > 12 THEN 1.0 ELSE 0 END AS raw FROM n, o GROUP BY file_path)
    SELECT file_path, raw::DOUBLE AS raw, round((row_number() OVER (ORDER BY raw, file_path) - 1) / (count(*) OVER () - 1), 6) AS percentile FROM g""",
)(
    lambda t: N.file_risk(
        t.nodes.join(N.fan_counts(t.nodes, t.edges), "memory_id").withColumn("centrality", F.col("fan_out")).withColumn("has_test_path", F.col("k") % 4 == 0),
        t.nodes.select("file_path").distinct().select(F.col("file_path").alias("path"), F.when(F.length("file_path") > 15, 20).otherwise(3).alias("churn_90d"), F.when(F.length("file_path") > 12, 5).otherwise(1).alias("unique_authors_90d")),
    )
)
query("o92_rank_percentile", "SELECT p_partkey, round((row_number() OVER (ORDER BY p_size, p_partkey) - 1) / (count(*) OVER () - 1), 6) AS percentile FROM part")(
    lambda t: N.rank_percentile(t.table("part").select("p_partkey", "p_size"), "p_size", "p_partkey").select("p_partkey", "percentile")
)
_ADMITTED = "(" + ", ".join(f"'{k}'" for k in model.ADMISSION["structural"]) + ")"
query(
    "o76_depth_from_entries",
    over("nodes", "edges", recursive=True)
    + f""", u AS (SELECT DISTINCT dst FROM edges WHERE kind IN {_COUPLED}), step AS (SELECT DISTINCT src AS x, dst AS y FROM edges WHERE kind IN {_ADMITTED}), r AS (SELECT memory_id, 0 AS depth FROM nodes WHERE reachability_class IN ('wired', 'public_api') AND (memory_id NOT IN (SELECT dst FROM u) OR contains(symbol_name, 'main'))
    UNION SELECT y, depth + 1 FROM r JOIN step ON x = memory_id WHERE depth < 2) SELECT memory_id, min(depth) AS depth FROM r GROUP BY memory_id""",
)(lambda t: N.depth_from_entries(t.nodes, t.edges, 2))
query(
    "o77_test_reach",
    over("nodes", "edges", recursive=True) + f", step AS (SELECT DISTINCT src AS x, dst AS y FROM edges WHERE kind IN {_ADMITTED}), r AS (SELECT memory_id FROM nodes WHERE reachability_class = 'test_only' UNION SELECT y FROM r JOIN step ON x = memory_id) SELECT memory_id FROM r",
)(lambda t: N.test_reach(t.nodes, t.edges))
query(
    "o62_seed_expansion",
    over("edges")
    + """, w AS (SELECT src AS a, dst AS b, confidence * CASE kind WHEN 'contains' THEN 0.7 WHEN 'depends_on' THEN 0.5 END AS w FROM edges WHERE kind IN ('contains', 'depends_on') AND dst NOT LIKE 'c%' AND dst NOT LIKE 's%'), u AS (SELECT a, b, max(w) AS w FROM (SELECT * FROM w UNION ALL SELECT b, a, w FROM w) GROUP BY ALL)
    SELECT 'r0' AS seed, b AS node, round(w * 0.5, 6)::DOUBLE AS score, 1 AS depth FROM u WHERE a = 'r0'""",
)(
    lambda t: N.expand(
        t.edges.where("kind in ('contains', 'depends_on') and dst not like 'c%' and dst not like 's%'").withColumn("weight", F.lit(1.0)), t.spark.createDataFrame([("r0",)], "seed string"), max_depth=1
    ).withColumn("score", F.round("score", 6))
)
query("o75_betweenness", None)(lambda t: N.betweenness(t.nodes, t.edges))
#: The two above are held against SQL over a part of the graph; these run the operators' defaults over all of it.
query("o76_depth_from_entries_whole", None)(lambda t: N.depth_from_entries(t.nodes, t.edges))
query("o62_seed_expansion_whole", None)(lambda t: N.expand(t.edges.withColumn("weight", F.lit(1.0)), t.spark.createDataFrame([("r0",)], "seed string")).withColumn("score", F.round("score", 6)))
