"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators import rollup as R
from loomgraph.queries.base import over, query

_SCOPED = ", scoped AS (SELECT e.*, CASE WHEN scope = 'Test' OR coalesce(is_test_only, false) THEN 'tests' WHEN scope = 'CfgGated' THEN 'conditional' ELSE 'production' END AS rs FROM edges e LEFT JOIN nodes ON src = memory_id)"
_UNIT = "regexp_extract(file_path, '^[^/]*')"


def _units(t):
    return t.nodes.withColumn("unit", F.substring_index("file_path", "/", 1))


query(
    "o67_audit_hotspots",
    over("nodes", "edges")
    + _SCOPED
    + """, f AS (SELECT dst, count(*) FILTER (rs = 'production') AS production, count(*) FILTER (rs = 'tests') AS tests, count(*) FILTER (rs = 'conditional') AS conditional,
    count(*) FILTER (kind = 'calls' AND source IN ('Scip', 'Both')) AS provider_calls, count(*) FILTER (kind = 'calls' AND source = 'TreeSitter') AS structural_call_hints, count(*) FILTER (kind = 'field_of') AS field_uses FROM scoped WHERE kind IN ('calls', 'field_of') GROUP BY dst),
    p AS (SELECT * FROM nodes WHERE NOT coalesce(is_test_only, false))
    SELECT memory_id, symbol_name, kind, file_path, line_start, production AS fan_in, production, tests, conditional, provider_calls, structural_call_hints, field_uses, (SELECT count(*) FROM p) AS considered_symbols FROM p JOIN f ON dst = memory_id WHERE production >= 20""",
)(lambda t: R.hotspots(t.nodes, t.edges))

query("o64_graph_stats", over("nodes", "edges") + "SELECT 'nodes' AS metric, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'kind:' || kind, count(*) FROM edges GROUP BY kind")(
    lambda t: R.graph_stats(t.nodes, t.edges)
)
query("o65_class_summary", over("nodes") + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (reachability_class = '{c}') AS {c}" for c in model.CLASSES) + " FROM nodes")(lambda t: R.class_summary(t.nodes))
query("o66_class_percentages", over("nodes") + "SELECT reachability_class, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 6) AS percent FROM nodes GROUP BY 1")(lambda t: R.class_percentages(t.nodes))
query(
    "o68_dead_ratios",
    over("nodes")
    + ", c AS (SELECT file_path AS unit, count(*) AS total, count(*) FILTER (reachability_class IN ('dead', 'orphan')) AS dead FROM nodes WHERE kind = 'function' GROUP BY 1) SELECT unit, total, dead, dead * 10000 // total AS basis_points FROM c WHERE total > 0 AND dead * 100 >= 22 * total",
)(lambda t: R.dead_ratios(t.nodes.withColumn("unit", F.col("file_path")), percent=22))
query("o68_dead_files", over("nodes") + "SELECT file_path, count(*) AS dead FROM nodes WHERE kind = 'function' AND reachability_class IN ('dead', 'orphan') GROUP BY 1 ORDER BY dead DESC, file_path LIMIT 10")(lambda t: R.dead_files(t.nodes))
query(
    "o69_unit_overview",
    over("nodes")
    + f"SELECT {_UNIT} AS unit, count(*) AS owned, count(*) FILTER (kind = 'function') AS callables, count(*) FILTER (reachability_class IN ('wired', 'public_api', 'structural')) AS alive, count(*) FILTER (reachability_class IN ('dead', 'orphan')) AS dead, count(*) FILTER (reachability_class = 'test_only') AS test FROM nodes GROUP BY 1",
)(lambda t: R.unit_overview(_units(t)))
query(
    "o69_key_types",
    over("nodes", "edges")
    + ", f AS (SELECT dst, count(*) AS fan_in FROM edges WHERE kind IN ('calls', 'field_of') GROUP BY 1), o AS (SELECT file_path AS unit, row_number() OVER (PARTITION BY file_path ORDER BY fan_in DESC, symbol_name, kind, memory_id) AS place, memory_id, symbol_name, kind, fan_in FROM nodes JOIN f ON dst = memory_id WHERE kind IN ('struct', 'enum', 'trait')) SELECT * FROM o WHERE place <= 5",
)(lambda t: R.key_types(t.nodes.withColumn("unit", F.col("file_path")), t.edges))
query(
    "o69_unit_dependencies",
    over("nodes", "edges") + "SELECT DISTINCT a.file_path AS from_unit, b.file_path AS to_unit FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id WHERE edges.kind = 'depends_on' AND a.file_path <> b.file_path",
)(lambda t: R.unit_dependencies(t.nodes.withColumn("unit", F.col("file_path")), t.edges))
query(
    "o70_dependencies",
    over("nodes", "edges")
    + """, x AS (SELECT a.file_path AS sf, b.file_path AS df, CASE edges.kind WHEN 'calls' THEN 'call' WHEN 'references' THEN 'reference' WHEN 'type_of' THEN 'type_use' WHEN 'field_of' THEN 'type_use' WHEN 'implements' THEN 'implementation' WHEN 'extends' THEN 'inheritance' WHEN 'depends_on' THEN 'project_dependency' END AS relation
    FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id)
    SELECT CASE WHEN starts_with(sf, 'supply/') THEN df ELSE sf END AS file, CASE WHEN starts_with(sf, 'supply/') THEN 'dependency' ELSE 'dependent' END AS direction, relation, count(*) AS n FROM x WHERE relation IS NOT NULL AND starts_with(sf, 'supply/') <> starts_with(df, 'supply/') GROUP BY ALL""",
)(lambda t: R.dependencies(t.nodes, t.edges, t.nodes.where(F.col("file_path").startswith("supply/")).select("file_path")))
query(
    "o78_call_coverage",
    over("nodes", "edges")
    + """, e AS (SELECT src AS id FROM edges WHERE kind = 'calls' UNION SELECT dst FROM edges WHERE kind = 'calls'), l AS (SELECT memory_id FROM nodes WHERE kind = 'function' AND reachability_class NOT IN ('dead', 'orphan')),
    c AS (SELECT count(*) AS live_callables, count(id) AS touched FROM l LEFT JOIN e ON id = memory_id)
    SELECT live_callables, touched, (SELECT count(*) FROM edges WHERE kind = 'calls') AS call_edges, (SELECT count(*) FROM edges WHERE kind = 'calls' AND source <> 'TreeSitter') AS proven_calls, round(touched / live_callables, 6) AS ratio FROM c""",
)(lambda t: R.call_coverage(t.nodes, t.edges))
query(
    "o81_type_totals",
    over("nodes", "edges")
    + """, a AS (SELECT memory_id AS id, kind FROM nodes WHERE kind IN ('struct', 'trait')),
    m AS (SELECT src AS t, 'implemented_trait' AS role, dst AS m FROM edges JOIN a ON src = id WHERE edges.kind = 'implements' UNION SELECT dst, 'implementor', src FROM edges JOIN a ON dst = id WHERE edges.kind = 'implements' UNION SELECT src, 'field_type_ref', dst FROM edges JOIN a ON src = id WHERE edges.kind = 'field_of')
    SELECT role, count(*) AS n FROM m GROUP BY role""",
)(lambda t: R.type_totals(R.type_members(t.nodes, t.edges, t.nodes.where("kind in ('struct', 'trait')").select(F.col("memory_id").alias("type_id")))))
query(
    "o84_action_tiers",
    over("nodes")
    + ", x AS (SELECT file_path, CASE WHEN reachability_class = 'dead' AND rustc_flagged_dead THEN 'dead_confirmed' WHEN reachability_class IN ('dead', 'suspected') THEN 'investigate' WHEN reachability_class = 'test_only' THEN 'test_only' END AS tier FROM nodes) SELECT tier, count(DISTINCT file_path) AS files, count(*) AS symbols FROM x WHERE tier IS NOT NULL GROUP BY tier",
)(lambda t: R.action_tiers(t.nodes))
query(
    "o85_file_tiers",
    over("nodes", "edges")
    + """, l AS (SELECT DISTINCT b.file_path FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id WHERE edges.kind = 'contains' AND a.kind = 'module' AND a.file_path <> b.file_path),
    c AS (SELECT file_path, count(*) FILTER (reachability_class = 'dead') AS dead, count(*) AS total, count(*) FILTER (entry_retain & 8 <> 0) AS retained FROM nodes GROUP BY 1)
    SELECT c.file_path, dead, total, retained, l.file_path IS NOT NULL AS linked, dead = total AND retained = 0 AND l.file_path IS NULL AS fully_dead FROM c LEFT JOIN l USING (file_path) WHERE dead > 0""",
)(lambda t: R.file_tiers(t.nodes, t.edges))
query("o86_distinct_callers", over("edges") + "SELECT dst AS callee, count(*) AS call_sites, count(DISTINCT src) AS callers FROM edges WHERE kind = 'calls' GROUP BY 1")(lambda t: R.distinct_callers(t.edges))
query(
    "o83_dead_by_file",
    over("nodes") + "SELECT file_path, count(*) AS symbols, row_number() OVER (ORDER BY count(*) DESC, file_path) AS row_no FROM nodes WHERE reachability_class = 'dead' GROUP BY 1",
)(
    lambda t: t.nodes.where("reachability_class = 'dead'")
    .groupBy("file_path")
    .agg(F.count(F.lit(1)).alias("symbols"))
    .withColumn("row_no", F.expr("row_number() over (order by symbols desc, file_path)"))
)
