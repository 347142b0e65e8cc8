"""Queries of the public verbs over the supply graph as one generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.queries.base import over, query
from loomgraph.verbs import RECEIPTS, Graph

_CLASS = "('wired', 'public_api', 'structural', 'test_only', 'unclassified', 'suspected', 'excluded')"


def _graph(t, complete=True):
    receipts = [("prov", "v1", c, "default", "any", "language", None, "complete") for c in ("calls", "callable_liveness", "project_dependencies")] if complete else []
    inventory = t.spark.createDataFrame([("any", "unit")], "language string, unit string")
    return Graph(t.spark, {"nodes": t.nodes, "edges": t.edges, "receipts": t.spark.createDataFrame(receipts, RECEIPTS), "inventory": inventory}, "g1")


def _pick(result, *columns):
    return result.rows.select(*columns) if columns else result.rows


query("v_status", over("nodes") + "SELECT count(*) AS total, count(*) FILTER (reachability_class = 'wired') AS wired, NULL::BIGINT AS dead FROM nodes")(lambda t: _graph(t, False).status().rows.select("total", "wired", "dead"))
query("v_overview", over("nodes") + "SELECT regexp_extract(file_path, '^[^/]*') AS unit, count(*) AS owned, count(*) FILTER (kind = 'function') AS callables FROM nodes GROUP BY 1")(lambda t: _pick(_graph(t).overview(), "unit", "owned", "callables"))
query("v_find", over("nodes") + "SELECT memory_id, symbol_name FROM nodes WHERE symbol_name = 'ASIA'")(lambda t: _pick(_graph(t).find("ASIA"), "memory_id", "symbol_name"))
query(
    "v_type",
    over("nodes", "edges")
    + ", me AS (SELECT 's7' AS id), m AS (SELECT 'field_type_ref' AS role, dst AS member_id FROM edges, me WHERE src = id AND kind = 'field_of' UNION SELECT 'implemented_trait', dst FROM edges, me WHERE src = id AND kind = 'implements') SELECT role, member_id FROM m JOIN nodes ON member_id = memory_id ORDER BY role, file_path, symbol_name, member_id LIMIT 50",
)(lambda t: _pick(_graph(t).type(_graph(t).selector("s7")), "role", "member_id"))
query(
    "v_calls",
    over("nodes", "edges") + f"SELECT src AS memory_id, scope FROM edges JOIN nodes ON src = memory_id WHERE edges.kind = 'calls' AND dst = 'o96' AND reachability_class IN {_CLASS}",
)(lambda t: _pick(_graph(t).calls(_graph(t).selector("o96")), "memory_id", "scope"))
query("v_tests", over("nodes", "edges") + "SELECT DISTINCT memory_id AS node, 1 AS depth FROM edges JOIN nodes ON src = memory_id WHERE dst = 's3' AND edges.kind = 'calls' AND is_test_root ORDER BY node LIMIT 50")(
    lambda t: _pick(_graph(t).tests(_graph(t).selector("s3")), "node", "depth")
)
query(
    "v_assess",
    over("nodes", "edges")
    + """, a AS (SELECT DISTINCT src AS node, true AS e FROM edges WHERE kind = 'calls' AND dst = 's8'), b AS (SELECT DISTINCT src AS node, true AS s FROM edges WHERE kind IN ('references', 'field_of', 'type_of', 'implements', 'extends') AND dst = 's8')
    SELECT node, 1 AS depth, coalesce(e, false) AS by_execution, coalesce(s, false) AS by_structure FROM a FULL JOIN b USING (node) JOIN nodes ON node = memory_id ORDER BY file_path, symbol_name, node LIMIT 50""",
)(lambda t: _pick(_graph(t).assess(_graph(t).selector("s8"), depth=1), "node", "depth", "by_execution", "by_structure"))
query(
    "v_audit",
    over("nodes", "edges")
    + """, f AS (SELECT dst, count(*) FILTER (scope = 'Production' AND NOT coalesce(n.is_test_only, false)) AS fan_in FROM edges e LEFT JOIN nodes n ON src = n.memory_id WHERE e.kind IN ('calls', 'field_of') GROUP BY dst)
    SELECT memory_id, fan_in FROM f JOIN nodes ON dst = memory_id WHERE NOT coalesce(is_test_only, false) AND fan_in >= 20 ORDER BY fan_in DESC, file_path, line_start, symbol_name, kind, memory_id LIMIT 50""",
)(lambda t: _pick(_graph(t).audit(), "memory_id", "fan_in"))
query(
    "v_deps",
    over("nodes", "edges")
    + """, x AS (SELECT a.file_path AS sf, b.file_path AS df, edges.kind FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id WHERE edges.kind IN ('calls', 'references', 'type_of', 'field_of', 'implements', 'extends', 'depends_on')), y AS (SELECT CASE WHEN starts_with(sf, 'geo/ASIA') THEN df ELSE sf END AS file, CASE WHEN starts_with(sf, 'geo/ASIA') THEN 'dependency' ELSE 'dependent' END AS direction FROM x WHERE starts_with(sf, 'geo/ASIA') <> starts_with(df, 'geo/ASIA'))
    SELECT file, direction, count(*) AS n FROM y GROUP BY ALL ORDER BY file, direction LIMIT 50""",
)(lambda t: _pick(_graph(t).deps("geo/ASIA"), "file", "direction", "n"))
query("v_dead_without_evidence", over("nodes") + "SELECT count(*) AS unreached FROM nodes WHERE false")(
    lambda t: t.spark.createDataFrame([(_graph(t, False).dead().evidence["summary"]["unreached"],)], "unreached long")
)
query("v_diff", over("nodes") + "SELECT memory_id, 'removed' AS change, row_number() OVER (ORDER BY file_path, symbol_name)::INT AS row_no FROM nodes WHERE kind = 'struct' AND k % 10 = 0")(
    lambda t: (lambda n: Graph(t.spark, {"nodes": n, "edges": t.edges}).diff(n.where("k % 10 <> 0"), None).rows.select("memory_id", "change", "row_no"))(t.nodes.where("kind = 'struct'").withColumn("content_hash", F.md5("signature")))
)
query("v_stats", over("nodes", "edges") + "SELECT 'nodes' AS metric, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'kind:' || kind, count(*) FROM edges GROUP BY kind")(lambda t: _graph(t).stats())
query(
    "v_grep_context",
    "SELECT 'd' || doc_id AS path, line_no::INT AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE contains(line, '@mail') ORDER BY path, line_no LIMIT 50",
)(
    lambda t: Graph(t.spark, {"nodes": t.nodes, "edges": t.edges, "contents": t.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))})
    .grep_context("@mail")
    .rows.select("path", "line_no")
)
