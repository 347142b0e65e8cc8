"""Queries of joins, ranks, entry points, logs, generations, the schedule and the verbs that read one symbol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.operators import classify as C
from loomgraph.operators import evidence as E
from loomgraph.operators import grep, rollup, search
from loomgraph.plans import walk
from loomgraph.plans.checkpoint import folder
from loomgraph.queries.base import over, query
from loomgraph.queries.verbs import _graph
from loomgraph.sources import facts, scip
from loomgraph.sources.bundle import HEADS, Bundle
from loomgraph.streaming import watch
from loomgraph.verbs import Graph

# ---- joins and ranks

query(
    "j01_edge_endpoints",
    over("nodes", "edges") + "SELECT a.kind AS src_kind, edges.kind AS edge, b.kind AS dst_kind, count(*) AS n FROM edges JOIN nodes a ON src = a.memory_id JOIN nodes b ON dst = b.memory_id GROUP BY ALL",
)(
    lambda t: t.edges.withColumnRenamed("kind", "edge")
    .join(t.nodes.select(F.col("memory_id").alias("src"), F.col("kind").alias("src_kind")), "src")
    .join(t.nodes.select(F.col("memory_id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    .groupBy("src_kind", "edge", "dst_kind")
    .agg(F.count(F.lit(1)).alias("n"))
)
query(
    "j06_innermost_owner",
    """WITH o AS (SELECT DISTINCT 'f' || l_suppkey AS path, l_linenumber * 10 + l_partkey % 10 AS line FROM lineitem), d AS (SELECT 'f' || s_suppkey AS path, s_suppkey, unnest([{'n': 'A', 'a': 0, 'b': 100}, {'n': 'B', 'a': 20, 'b': 39}, {'n': 'C', 'a': 25, 'b': 44}]) AS s FROM supplier),
    r AS (SELECT o.path, line, s.n || s_suppkey AS src, row_number() OVER (PARTITION BY o.path, line ORDER BY s.b - s.a, s.a DESC) AS pos FROM o JOIN d ON o.path = d.path AND line BETWEEN s.a AND s.b) SELECT DISTINCT src, 'T' AS dst, 'references' AS kind FROM r WHERE pos = 1""",
)(
    lambda t: facts.reference_edges(
        t.table("lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("path"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("line"), F.lit("t").alias("symbol")).distinct(),
        t.sql("SELECT 'f' || s_suppkey AS path, s.a AS line_start, s.b AS line_end, s.n || s_suppkey AS memory_id, 'none' AS symbol FROM (SELECT s_suppkey, inline(array(named_struct('s', named_struct('n', 'A', 'a', 0, 'b', 100)), named_struct('s', named_struct('n', 'B', 'a', 20, 'b', 39)), named_struct('s', named_struct('n', 'C', 'a', 25, 'b', 44)))) FROM {supplier}) AS x")
        .union(t.spark.createDataFrame([("lib", 0, 0, "T", "t")], "path string, line_start int, line_end int, memory_id string, symbol string")),
    )
)
query("j07_population", over("nodes", "edges") + "SELECT memory_id FROM nodes WHERE kind = 'trait' AND memory_id IN (SELECT dst FROM edges WHERE kind = 'field_of')")(
    lambda t: t.nodes.where("kind = 'trait'").join(t.edges.where("kind = 'field_of'").select(F.col("dst").alias("memory_id")), "memory_id", "left_semi").select("memory_id")
)
query("j08_unreferenced", over("nodes", "edges") + "SELECT memory_id FROM nodes WHERE kind = 'function' AND memory_id NOT IN (SELECT src FROM edges WHERE kind = 'references')")(
    lambda t: t.nodes.where("kind = 'function'").join(t.edges.where("kind = 'references'").select(F.col("src").alias("memory_id")), "memory_id", "left_anti").select("memory_id")
)
query(
    "j11_diagnosed_symbols",
    over("nodes")
    + ", c AS (SELECT *, count(*) OVER (PARTITION BY file_path, line_start) AS n FROM nodes) SELECT memory_id, (n = 1 AND k % 3 = 0 AND k % 2 = 0) OR rustc_flagged_dead AS rustc_flagged_dead FROM c",
)(
    lambda t: C.apply_oracle(
        t.nodes,
        t.nodes.where("k % 3 = 0").select(F.col("file_path").alias("file_name"), (F.col("line_start") + 1).alias("line"), F.when(F.col("k") % 2 == 0, P.short_name("symbol_name")).otherwise(F.lit("another")).alias("subject")),
        False,
    ).select("memory_id", "rustc_flagged_dead")
)
query(
    "o89_top_per_group",
    over("nodes", "edges")
    + """, f AS (SELECT dst, count(*) AS fan_in FROM edges WHERE kind IN ('calls', 'field_of') GROUP BY 1), r AS (SELECT file_path AS unit, memory_id, fan_in, row_number() OVER (PARTITION BY file_path ORDER BY fan_in DESC, symbol_name, kind, memory_id) AS place FROM nodes JOIN f ON dst = memory_id WHERE kind IN ('struct', 'enum', 'trait'))
    SELECT unit, place::INT AS place, memory_id, fan_in FROM r WHERE place <= 3""",
)(lambda t: rollup.key_types(t.nodes.withColumn("unit", F.col("file_path")), t.edges, most=3).select("unit", "place", "memory_id", "fan_in"))
query(
    "o91_smallest_enclosing",
    over("nodes")
    + """, h AS (SELECT DISTINCT file_path AS path, unnest([5, 60, 151]) AS line_no FROM nodes), r AS (SELECT h.*, memory_id, row_number() OVER (PARTITION BY path, line_no ORDER BY line_end - line_start NULLS LAST, symbol_name, memory_id) AS pos FROM h LEFT JOIN nodes ON path = file_path AND line_no BETWEEN line_start AND line_end)
    SELECT path, line_no, memory_id FROM r WHERE pos = 1""",
)(lambda t: grep.containing(t.nodes.select(F.col("file_path").alias("path")).distinct().withColumn("line_no", F.explode(F.array(F.lit(5), F.lit(60), F.lit(151)))), t.nodes).select("path", "line_no", "memory_id"))

# ---- closed rules

_PRESETS = {"classifier_calls": walk.CLASSIFIER_CALLS, "reachability_trace": walk.REACHABILITY_TRACE, "reachable_out": walk.REACHABLE_OUT, "structural_reverse": walk.STRUCTURAL_REVERSE, "dependents": walk.DEPENDENTS, "test_callers": walk.TEST_CALLERS}
query(
    "o28_walk_presets",
    "SELECT * FROM (VALUES ('classifier_calls', 'out', true, false), ('reachability_trace', 'out', true, false), ('reachable_out', 'out', false, false), ('structural_reverse', 'in', false, false), ('dependents', 'in', false, true), ('test_callers', 'in', false, false)) AS v(preset, direction, skip_test_modules, trait_bridge)",
)(lambda t: t.spark.createDataFrame([(n, s.direction, s.skip_test_modules, s.trait_bridge) for n, s in _PRESETS.items()], "preset string, direction string, skip_test_modules boolean, trait_bridge boolean"))
_ASKED = ["a/b", "main.rs", "x.py", "name", "a.b", "mod::f", "f.tsx", ".", ""]
query("o49c_query_modes", "SELECT unnest(['a/b', 'main.rs', 'x.py', 'name', 'a.b', 'mod::f', 'f.tsx', '.', '']) AS query, unnest([true, true, true, false, false, false, true, false, false]) AS is_path")(
    lambda t: t.spark.createDataFrame([(q, search.is_path_query(q)) for q in _ASKED], "query string, is_path boolean")
)
query(
    "o134_classification_currency",
    """WITH s AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS authority, CASE WHEN k % 3 > 0 THEN 's' || k % 5 END AS stamp, CASE WHEN k % 7 > 0 THEN 's' || k % 4 END AS ident, k % 11 = 0 AS other, k % 13 = 0 AS stale FROM customer)
    SELECT k, CASE WHEN NOT authority THEN 'authority_missing,' ELSE '' END || CASE WHEN stamp IS NULL THEN 'stamp_absent,' ELSE '' END || CASE WHEN ident IS NULL THEN 'identity_unavailable,' ELSE '' END || CASE WHEN stamp <> ident THEN 'identity_mismatch,' ELSE '' END
    || CASE WHEN other THEN 'configuration_mismatch,' ELSE '' END || CASE WHEN stale THEN 'index_stale,' ELSE '' END AS failures FROM s""",
)(
    lambda t: E.classification_failures(
        t.sql(
            """SELECT c_custkey AS k, c_custkey % 2 = 0 AS authority, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_custkey % 5 END AS stamp, CASE WHEN c_custkey % 7 > 0 THEN 's' || c_custkey % 4 END AS graph_identity,
            CASE WHEN c_custkey % 11 = 0 THEN 'p2' ELSE 'p1' END AS prover, 'p1' AS expected_prover, CASE WHEN c_custkey % 13 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM {customer}"""
        )
    ).select("k", F.array_join(F.transform("failures", lambda f: F.concat(f, F.lit(","))), "").alias("failures"))
)
query(
    "o140_guidance",
    """SELECT tier, authority, scip, CASE WHEN tier = 'degenerate' THEN 'index_is_empty' WHEN tier = 'unavailable' OR NOT scip THEN 'add_call_evidence' WHEN authority THEN 'ready' ELSE 'refresh_classification' END AS code
    FROM (VALUES ('sufficient'), ('unavailable'), ('degenerate')) AS a(tier), (VALUES (true), (false)) AS b(authority), (VALUES (true), (false)) AS c(scip)""",
)(lambda t: t.spark.createDataFrame([(x, a, s, E.guidance(x, a, s)) for x in ("sufficient", "unavailable", "degenerate") for a in (True, False) for s in (True, False)], "tier string, authority boolean, scip boolean, code string"))

# ---- sources

query(
    "o15_entry_points",
    """WITH p AS (SELECT p_partkey AS k FROM part), c AS (SELECT k, 'c' || k AS n FROM p WHERE k % 3 = 0)
    SELECT 'tool' AS name, 'bin' AS kind, n || '/src/b.rs' AS file_path, n AS crate_name FROM c UNION ALL SELECT n, x.kind, n || '/' || x.f, n FROM (SELECT n, unnest([{'kind': 'lib', 'f': 'src'}, {'kind': 'bin', 'f': 'src/main.rs'}, {'kind': 'build', 'f': 'build.rs'}, {'kind': 'test', 'f': 'tests'}, {'kind': 'example', 'f': 'examples'}]) AS x FROM c)
    UNION ALL SELECT 'main', 'bin', 'cmd' || k || '/main.go', 'cmd' || k FROM p WHERE k % 3 = 1 UNION ALL SELECT DISTINCT 'lib', 'lib', 'pkg' || k % 50, 'pkg' || k % 50 FROM p WHERE k % 3 = 2""",
)(
    lambda t: facts.entry_points(
        t.sql(
            """SELECT CASE p_partkey % 3 WHEN 0 THEN 'c' || p_partkey || '/Cargo.toml' WHEN 1 THEN 'cmd' || p_partkey || '/main.go' ELSE 'pkg' || p_partkey % 50 || '/f' || p_partkey || '.go' END AS path,
            CAST(CASE p_partkey % 3 WHEN 0 THEN concat('[package]\nname = "c', p_partkey, '"\n[[bin]]\nname = "tool"\npath = "src/b.rs"\n') WHEN 1 THEN 'package main\n' ELSE '// text\npackage lib\n' END AS BINARY) AS content FROM {part}"""
        )
    )
)
query(
    "o16_git_log",
    """WITH e AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS who, count(*) OVER () AS total FROM events)
    SELECT event_type AS path, count(*) AS churn_90d, count(DISTINCT who) AS unique_authors_90d, min(event_id) * 90 // max(total) AS last_modified_days FROM e WHERE event_type <> 'purchase' GROUP BY 1""",
)(lambda t: facts.churn(t.sql("SELECT event_id AS line_no, CASE WHEN event_type = 'purchase' THEN 'commit|' || user_id ELSE concat('3\\t1\\t', event_type) END AS value FROM {events}")))


def _number(n):
    """A number from 0 below 2 ** 35 as a variable-length integer of the wire format: seven bits a byte, the least first, and a high bit on all bytes but the last."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    left = lambda i: F.shiftright(n.cast("long"), 7 * i)
    more = lambda i: F.when(left(i + 1) > 0, F.lit(128)).otherwise(F.lit(0))
    return F.concat(byte(left(0) % 128 + more(0)), *[F.when(left(i) > 0, byte(left(i) % 128 + more(i))).otherwise(F.lit(b"")) for i in range(1, 5)])


def _message(number: int, body):
    # A lambda, so that the plan holds the body once however deep messages nest.
    return F.get(F.transform(F.array(body.cast("binary")), lambda b: F.concat(F.lit(bytes([number << 3 | 2])), _number(F.length(b)), b)), F.lit(0))


def _indexes(t) -> DataFrame:
    """One index per supplier: a type on line 3, which implements the next one, and uses of two types on far lines; every ninth index is cut short."""
    name = lambda k: F.concat(F.lit("p"), k.cast("string"), F.lit("#"))
    k = F.col("s_suppkey")
    use = lambda line, symbol, roles: _message(2, F.concat(_message(1, F.concat(_number(line), F.lit(b"\x04\x09"))), _message(2, symbol), F.lit(bytes([24, roles]))))
    info = _message(3, F.concat(_message(1, name(k)), _message(4, F.concat(_message(1, name(k + 1)), F.lit(b"\x18\x01")))))
    document = F.concat(_message(1, F.concat(F.lit("f"), k.cast("string"))), use(F.lit(3), name(k), 1), use(k + 200, name(k + 1), 0), use(k + 300, name(k + 2), 8), info)
    body = F.concat(_message(1, F.lit("x")), _message(2, document))
    return t.table("supplier").select(F.concat(F.lit("i"), k).alias("path"), F.when(k % 9 == 0, F.substring(body, 1, 30)).otherwise(body).alias("content"))


query(
    "o11_index_bytes",
    """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 9 <> 0) SELECT 'f' || k AS path, 3 AS line, 'p' || k || '#' AS symbol, true AS is_definition FROM s
    UNION ALL SELECT 'f' || k, (k + 200)::INT, 'p' || k + 1 || '#', false FROM s UNION ALL SELECT 'f' || k, (k + 300)::INT, 'p' || k + 2 || '#', false FROM s""",
)(lambda t: scip.occurrences(_indexes(t)).select("path", "line", "symbol", "is_definition"))


@query("o11_implements", "SELECT 'f' || a.s_suppkey AS src, 'f' || b.s_suppkey AS dst, 'implements' AS kind FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 9 <> 0 AND b.s_suppkey % 9 <> 0")
def _(t):
    indexes = _indexes(t)
    return scip.implements_edges(scip.relationships(indexes), scip.occurrences(indexes).where("is_definition").select(F.col("path").alias("memory_id"), "symbol"))


# ---- generations and the schedule


def _bundle(t) -> Bundle:
    return Bundle(t.spark, f"{folder(t.spark)}/bundle-{uuid.uuid4().hex}")


def _parts(t, changed=False) -> DataFrame:
    return t.table("part").select(F.concat(F.lit("f"), F.col("p_partkey") % 100).alias("file_path"), "p_partkey", F.lit("new" if changed else "old").alias("state"))


@query("o19_snapshot_round_trip", over("nodes") + "SELECT memory_id, symbol_name, kind, file_path FROM nodes")
def _(t):
    bundle = _bundle(t)
    bundle.publish({"nodes": t.nodes})
    return bundle.open("nodes").select("memory_id", "symbol_name", "kind", "file_path")


@query("o20_published_generations", "SELECT 1 AS sequence, count(*) AS n FROM part UNION ALL SELECT 2, count(*) FROM supplier")
def _(t):
    bundle = _bundle(t)
    first, second = bundle.publish({"rows": t.table("part").select("p_partkey")}), bundle.publish({"rows": t.table("supplier").select("s_suppkey")})
    count = lambda g, n: bundle.open("rows", g).agg(F.lit(n).alias("sequence"), F.count(F.lit(1)).alias("n"))
    return count(first, 1).union(count(second, 2))


@query("o21_resolve_torn_head", "SELECT p_partkey, 'f' || p_partkey % 100 AS file_path, 'old' AS state FROM part")
def _(t):
    bundle = _bundle(t)
    bundle.publish({"rows": _parts(t)})
    bundle.publish({"rows": _parts(t, True)})
    torn = bundle._fs.create(bundle._path(f"{bundle.root}/{HEADS[bundle.resolve()['sequence'] % 2]}"), True)
    torn.write(bytearray(b'{"generation_id": "g0'))
    torn.close()
    return bundle.open("rows").select("p_partkey", "file_path", "state")


@query("s08_incremental_publish", "SELECT p_partkey, 'f' || p_partkey % 100 AS file_path, CASE WHEN p_partkey % 100 % 10 = 3 THEN 'new' ELSE 'old' END AS state FROM part WHERE p_partkey % 100 % 10 <> 7")
def _(t):
    bundle = _bundle(t)
    bundle.publish({"symbols": _parts(t)})
    watch.merge_generation(bundle, _parts(t, True).where("p_partkey % 100 % 10 = 3"), _parts(t).where("p_partkey % 100 % 10 = 7").select("file_path"))
    return bundle.open("symbols").select("p_partkey", "file_path", "state")


@query(
    "s05_schedule",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, 1 AS step, 'start' AS action, 1::BIGINT AS epoch FROM n UNION ALL SELECT user_id, 2, 'cancel', NULL FROM n WHERE n > 1 UNION ALL SELECT user_id, 3, 'start', n FROM n WHERE n > 1""",
)
def _(t):
    """Per user a schedule whose first run is still active when the other hints come: it is superseded once, and the next run covers all."""

    def run(key, pdf):
        import pandas as pd

        s = watch.Schedule(watching=True)
        said = [a for _ in range(int(pdf["n"].iloc[0])) for a in s.change()]
        said += s.finish(1, "cancelled" if s.active.get("cancelled") else "published")
        return pd.DataFrame([(key[0], i + 1, a[0], a[3] if a[0] == "start" else None) for i, a in enumerate(said)], columns=["user_id", "step", "action", "epoch"]).astype({"epoch": "Int64"})

    hints = t.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return hints.groupBy("user_id").applyInPandas(run, "user_id long, step int, action string, epoch long")


# ---- verbs that read one symbol, and dead with evidence


def _documents(t) -> Graph:
    """Documents as files of one callable each."""
    doc = t.table("documents").where("text is not null")
    content = F.encode("text", "UTF-8")
    path = F.concat(F.lit("d"), "doc_id")
    nodes = doc.select(
        path.alias("memory_id"), F.concat(F.lit("doc::"), path).alias("symbol_name"), path.alias("file_path"), F.lit("function").alias("kind"), F.lit(0).alias("start_byte"), F.length(content).alias("end_byte"),
        F.sha2(content, 256).alias("content_hash"), F.lit("unclassified").alias("reachability_class"), F.lit(0).alias("line_start"), F.lit(False).alias("is_test_root"), F.lit("").alias("signature"),
    )
    return Graph(t.spark, {"nodes": nodes, "edges": t.edges, "contents": doc.select(path.alias("path"), content.alias("content"))}, "g1")


query("v_read", "SELECT substr(text, 6, 200) AS source FROM documents WHERE doc_id = 3")(lambda t: (lambda g: t.spark.createDataFrame([(g.read(g.selector("d3"), 5, 200),)], "source string"))(_documents(t)))
query(
    "v_inspect",
    "SELECT 'callable' AS symbol, unnest(['source', 'structure', 'callers', 'tests', 'field_usage']) AS facet, unnest(['available', 'not_applicable', 'available', 'available', 'not_applicable']) AS state UNION ALL SELECT 'type', unnest(['source', 'structure', 'callers', 'tests', 'field_usage']), unnest(['unavailable', 'available', 'not_applicable', 'not_applicable', 'unavailable'])",
)(
    lambda t: t.spark.createDataFrame(
        [(n, f, x["state"]) for n, g, s in (("callable", _documents(t), "d3"), ("type", _graph(t), "s7")) for f, x in g.inspect(g.selector(s)).items() if f not in ("symbol", "selector")], "symbol string, facet string, state string"
    )
)
_DEAD = """, seeds AS (SELECT memory_id AS node FROM nodes WHERE entry_retain & 7 <> 0), tested AS (SELECT memory_id AS node FROM nodes WHERE is_test_root), c AS (SELECT src, dst FROM edges WHERE kind = 'calls'),
p AS (SELECT node FROM seeds UNION SELECT dst FROM p JOIN c ON src = node), q AS (SELECT node FROM tested UNION SELECT dst FROM q JOIN c ON src = node),
v AS (SELECT *, CASE WHEN kind <> 'function' THEN CASE WHEN reachability_class IN ('dead', 'orphan') THEN 'structural_candidate' WHEN reachability_class IN ('unclassified', 'suspected') THEN 'unknown' ELSE 'live' END
  WHEN memory_id IN (SELECT node FROM p) THEN 'live_production' WHEN memory_id IN (SELECT node FROM q) THEN 'live_test' WHEN coalesce(is_test_only, false) THEN 'retained_test' ELSE 'unreached' END AS verdict FROM nodes)"""
query("v_dead", over("nodes", "edges", recursive=True) + _DEAD + " SELECT file_path, symbol_name, kind, memory_id, verdict FROM v WHERE verdict IN ('unreached', 'structural_candidate', 'unknown') ORDER BY file_path, symbol_name, kind, memory_id LIMIT 100")(
    lambda t: _graph(t).dead(limit=100).rows
)
query("v_dead_summary", over("nodes", "edges", recursive=True) + _DEAD + " SELECT count(*) FILTER (verdict = 'unreached') AS unreached, count(*) FILTER (verdict = 'structural_candidate') AS structural FROM v")(
    lambda t: (lambda s: t.spark.createDataFrame([(s["unreached"], s["structural"])], "unreached long, structural long"))(_graph(t).dead().evidence["summary"])
)
