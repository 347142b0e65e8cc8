"""Queries of source search, paging, containment joins, sources, clones and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import clones, grep, paging
from loomgraph.queries.base import over, query
from loomgraph.sources import facts, files, python_extractor
from loomgraph.streaming import watch

_LINES = ", l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM files)"

query(
    "o93_context_lines",
    over("files")
    + _LINES
    + """, h AS (SELECT *, regexp_matches(line, '@mail') AS hit FROM l), c AS (SELECT *, max(hit::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h)
    SELECT path, line_no::INT AS line_no, substr(line, 1, 2000) AS line, hit AS is_match FROM c WHERE near = 1""",
)(lambda t: grep.grep(t.files, "@mail", context=2))

query(
    "o94_match_caps",
    over("files")
    + _LINES
    + """, h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS nth FROM l WHERE regexp_matches(line, 'the ')), k AS (SELECT *, row_number() OVER (ORDER BY path, line_no) AS pos FROM h WHERE nth <= 3)
    SELECT path, line_no::INT AS line_no, substr(line, 1, 2000) AS line, true AS is_match FROM k WHERE pos <= 200""",
)(lambda t: grep.grep(t.files, "the ", per_file=3, overall=200))

query(
    "j05_containing_symbols",
    over("files")
    + _LINES
    + """, h AS (SELECT path, line_no FROM l WHERE regexp_matches(line, '@mail')), s AS (SELECT f.path, 'a' || doc_id AS memory_id, 'outer' AS symbol_name, 0 AS a, 1000 AS b FROM files f UNION ALL SELECT path, 'b' || doc_id, 'inner', 2, 9 FROM files UNION ALL SELECT path, 'c' || doc_id, 'also', 2, 9 FROM files),
    r AS (SELECT h.path, h.line_no, memory_id, symbol_name, row_number() OVER (PARTITION BY h.path, h.line_no ORDER BY b - a, symbol_name, memory_id) AS pos FROM h JOIN s ON h.path = s.path AND line_no BETWEEN a AND b)
    SELECT path, line_no::INT AS line_no, memory_id, symbol_name FROM r WHERE pos = 1""",
)(
    lambda t: grep.containing(
        grep.grep(t.files, "@mail").where("is_match").select("path", "line_no"),
        t.files.select(
            F.col("path").alias("file_path"), F.explode(F.array(*[F.struct(F.concat(F.lit(p), "doc_id").alias("memory_id"), F.lit(n).alias("symbol_name"), F.lit(a).alias("line_start"), F.lit(b).alias("line_end")) for p, n, a, b in (("a", "outer", 0, 1000), ("b", "inner", 2, 9), ("c", "also", 2, 9))])).alias("s")
        ).select("file_path", "s.*"),
    )
)

query(
    "j13_field_usage",
    "SELECT 'd' || doc_id AS memory_id, 'size' AS field, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS uses FROM documents WHERE doc_id % 2 = 0",
)(
    lambda t: grep.field_usage(
        t.table("documents").select(
            F.concat(F.lit("d"), "doc_id").alias("memory_id"),
            F.explode(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("return self.size + 1")).otherwise(F.lit("self.size()")), F.when(F.col("doc_id") % 6 == 0, F.lit("Box { size: 3 }")).otherwise(F.lit("sizes::all()")))).alias("line"),
        ),
        t.spark.createDataFrame([("size",), ("width",)], "field string"),
    )
)

_ORDER = ["p_partkey"]
query("o87_page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")(lambda t: paging.page(t.table("part").select("p_partkey", "p_name"), _ORDER, 100, 50))
query(
    "o88_bounded_page",
    """WITH p AS (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100), s AS (SELECT *, sum(length('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') + 1) OVER (ORDER BY p_partkey) AS total FROM p) SELECT p_partkey, p_name FROM s WHERE total <= 1500""",
)(lambda t: paging.fit_rows(paging.page(t.table("part").select("p_partkey", "p_name"), _ORDER, 0, 100), _ORDER, 1500))
query("o22_json_rows", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")(lambda t: paging.to_json(t.table("region").select("r_regionkey", "r_name")))

query(
    "o18_source_slices",
    "SELECT 'd' || doc_id AS memory_id, CASE WHEN doc_id % 7 = 0 THEN 'bad_span' WHEN doc_id % 5 = 0 THEN 'hash_mismatch' END AS refusal, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'slice ' || doc_id END AS source FROM documents",
)(
    lambda t: files.slice_source(
        t.table("documents").select(
            F.concat(F.lit("d"), "doc_id").alias("memory_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(3).alias("start_byte"),
            F.when(F.col("doc_id") % 7 == 0, F.lit(10_000_000)).otherwise(9 + F.length(F.col("doc_id").cast("string"))).alias("end_byte"),
            F.sha2(F.concat(F.lit("slice "), F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("doc_id").cast("string"))), 256).alias("content_hash"),
        ),
        t.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(F.lit("é\n"), F.lit("slice "), "doc_id", F.lit("\n"), "text"), "UTF-8").alias("content")),
    )
)

query(
    "o73_churn",
    """WITH h AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_orderkey) AS d FROM orders), l AS (SELECT l_orderkey, 'parts/' || l_partkey % 50 AS path, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem),
    x AS (SELECT path, o_custkey % 20 AS who, d + r - 1 AS line_no FROM l JOIN h ON l_orderkey = o_orderkey), n AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS total)
    SELECT path, count(*) AS churn_90d, count(DISTINCT who) AS unique_authors_90d, min(line_no) * 90 // max(total) AS last_modified_days FROM x, n GROUP BY path""",
)(
    lambda t: facts.churn(
        t.sql(
            """SELECT row_number() OVER (ORDER BY k, n) - 1 AS line_no, value FROM (SELECT o_orderkey AS k, -1 AS n, 'commit|' || o_custkey % 20 AS value FROM {orders}
            UNION ALL SELECT l_orderkey, l_linenumber, '1\\t2\\tparts/' || l_partkey % 50 FROM {lineitem}) AS x"""
        )
    )
)

query(
    "o17_dead_diagnostics",
    "SELECT 's' || s_suppkey AS file_name, s_suppkey + 1 AS line, 'dead_code' AS code, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS subject, 'm' AS manifest_path FROM supplier WHERE s_suppkey % 4 <> 0",
)(
    lambda t: facts.dead_diagnostics(
        t.table("supplier").select(
            F.when(F.col("s_suppkey") % 8 == 0, F.lit("not json {"))
            .otherwise(
                F.concat(
                    F.lit('{"reason":"compiler-message","manifest_path":"m","message":{"code":{"code":"'), F.when(F.col("s_suppkey") % 4 == 0, F.lit("unused")).otherwise(F.lit("dead_code")),
                    F.lit('"},"message":"'), F.when(F.col("s_suppkey") % 3 == 0, F.lit("unused item")).otherwise(F.concat(F.lit("function `"), "s_name", F.lit("` is never `used`"))),
                    F.lit('","spans":[{"file_name":"x","line_start":1,"is_primary":false},{"file_name":"s'), "s_suppkey", F.lit('","line_start":'), F.col("s_suppkey") + 1, F.lit(',"is_primary":true}]}}'),
                )
            )
            .alias("value")
        )
    )
)

query(
    "o74_clone_groups",
    "WITH g AS (SELECT md5(text) AS fingerprint, count(*) AS size, min(len(string_split(text, chr(10)))) AS lines FROM documents GROUP BY 1) SELECT fingerprint, size, lines, lines * (size - 1) AS duplicated_lines FROM g WHERE size >= 2",
)(
    lambda t: clones.clone_groups(
        t.table("documents").select(F.md5("text").alias("fingerprint"), F.lit(1).cast("long").alias("line_start"), F.size(F.split("text", "\n")).cast("long").alias("line_end"))
    )
)

query(
    "o14_memberships",
    """WITH f AS (SELECT 'a/b' || n_regionkey || '/x' || n_nationkey || '.py' AS path, n_regionkey AS r FROM nation) SELECT path AS document_path, 'inner' || r AS project_unit_id, 'source_owner' AS kind FROM f WHERE r < 3
    UNION ALL SELECT path, 'outer', CASE WHEN r < 3 THEN 'path_context' ELSE 'source_owner' END FROM f""",
)(
    lambda t: facts.memberships(
        t.table("nation").select(F.concat(F.lit("a/b"), "n_regionkey", F.lit("/x"), "n_nationkey", F.lit(".py")).alias("path"), F.lit("python").alias("language")),
        t.table("region").where("r_regionkey < 3").select(F.concat(F.lit("inner"), "r_regionkey").alias("project_unit_id"), F.lit("python").alias("language_id"), F.concat(F.lit("a/b"), "r_regionkey").alias("root_path"), F.lit("package").alias("kind"))
        .union(t.spark.createDataFrame([("outer", "python", "a", "package"), ("all", "python", "", "workspace"), ("go", "go", "a", "module")], "a string, b string, c string, d string")),
    )
)

query(
    "o11_reference_edges",
    """WITH o AS (SELECT 'f' || l_suppkey AS path, l_linenumber * 10 + l_partkey % 10 AS line, 'p' || l_partkey % 40 || CASE WHEN l_partkey % 2 = 0 THEN '#' ELSE '' END AS symbol FROM lineitem),
    d AS (SELECT 'f' || s_suppkey AS path, 0 AS a, 100 AS b, 'F' || s_suppkey AS id FROM supplier UNION ALL SELECT 'f' || s_suppkey, 20, 39, 'G' || s_suppkey FROM supplier),
    r AS (SELECT o.*, id, row_number() OVER (PARTITION BY o.path, line, symbol ORDER BY b - a, -a, id) AS pos FROM o JOIN d ON o.path = d.path AND line BETWEEN a AND b)
    SELECT DISTINCT id AS src, 'P' || regexp_extract(symbol, '[0-9]+') AS dst, CASE WHEN ends_with(symbol, '#') THEN 'type_of' ELSE 'references' END AS kind FROM r WHERE pos = 1""",
)(
    lambda t: facts.reference_edges(
        t.table("lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("path"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("line"), F.concat(F.lit("p"), F.col("l_partkey") % 40, F.when(F.col("l_partkey") % 2 == 0, F.lit("#")).otherwise(F.lit(""))).alias("symbol")),
        t.sql("SELECT 'f' || s_suppkey AS path, 0 AS line_start, 100 AS line_end, 'F' || s_suppkey AS memory_id, 'none' AS symbol FROM {supplier} UNION ALL SELECT 'f' || s_suppkey, 20, 39, 'G' || s_suppkey, 'none' FROM {supplier}").union(
            t.spark.range(40).selectExpr("'lib' AS path", "0 AS line_start", "0 AS line_end", "'P' || id AS memory_id", "'p' || id || if(id % 2 = 0, '#', '') AS symbol")
        ),
    )
)

_EVENTS = """, e AS (SELECT ts, user_id, event_id, 'p' || event_id % 400 AS path, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS rank FROM events)"""
query(
    "s01_debounce",
    """WITH e AS (SELECT ts, 'p' || event_id % 400 AS path, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS rank FROM events), g AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts) >= ts - INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
    b AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM g)
    SELECT min(ts) AS first_ts, max(ts) + INTERVAL 10 MINUTE AS flush_ts, CASE WHEN count(DISTINCT path) > 256 THEN 0 ELSE count(DISTINCT path) END::INT AS paths, CASE WHEN count(DISTINCT path) > 256 THEN 'queue_overflow' WHEN max(rank) = 1 THEN 'git_state' ELSE 'filesystem' END AS reason, count(*) AS hints FROM b GROUP BY batch""",
)(
    lambda t: watch.debounce(
        t.table("events").select(F.col("ts"), F.concat(F.lit("p"), F.col("event_id") % 400).alias("path"), F.when(F.col("event_type") == "purchase", F.lit("git_state")).otherwise(F.lit("filesystem")).alias("reason")), "10 minutes"
    ).withColumn("paths", F.size("paths"))
)
query(
    "s02_bounded_batches",
    """WITH e AS (SELECT ts, user_id, 'p' || event_id % 400 AS path FROM events), g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM e), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM g),
    c AS (SELECT user_id, batch, count(DISTINCT path) AS n FROM b GROUP BY ALL) SELECT n > 4 AS overflow, count(*) AS batches FROM c GROUP BY 1""",
)(
    lambda t: watch.debounce(t.table("events").select("ts", "user_id", F.concat(F.lit("p"), F.col("event_id") % 400).alias("path"), F.lit("filesystem").alias("reason")), "12 hours", most=4, keys=["user_id"])
    .groupBy((F.col("reason") == "queue_overflow").alias("overflow"))
    .agg(F.count(F.lit(1)).alias("batches"))
)
query(
    "s03_reason_lattice",
    "SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'queue_overflow' WHEN 1 THEN 'git_state' ELSE 'filesystem' END AS reason FROM events GROUP BY 1",
)(
    lambda t: t.table("events")
    .groupBy("user_id")
    .agg(F.max(watch.reason_rank(F.when(F.col("event_type") == "purchase", F.lit("queue_overflow")).when(F.col("event_type") == "click", F.lit("git_state")).otherwise(F.lit("filesystem")))).alias("r"))
    .select("user_id", F.get(F.array(*[F.lit(r) for r in watch.REASONS]), F.col("r")).alias("reason"))
)
query(
    "s04_event_classes",
    over("files")
    + """SELECT path, CASE WHEN list_has_any(string_split(path, '/'), ['testdata', 'vendor', 'third_party', 'node_modules']) OR regexp_matches(path, '(^|/)target/(.*/)?build/(.*/)?out(/|$)') THEN 'ignored' WHEN ends_with(path, '.md') THEN 'other' ELSE 'source' END AS event_class FROM files
    UNION ALL SELECT '.git/HEAD', 'git_state' UNION ALL SELECT '.git/objects/x.py', 'ignored' UNION ALL SELECT 'a/Cargo.toml', 'project_control'""",
)(lambda t: watch.classify_events(t.files.select("path").union(t.spark.createDataFrame([(".git/HEAD",), (".git/objects/x.py",), ("a/Cargo.toml",)], "path string"))))
query(
    "s07_refresh_plan",
    "SELECT 'refresh_affected' AS plan, NULL::VARCHAR AS reason, count(*) AS affected FROM documents WHERE doc_id % 10 = 3",
)(
    lambda t: watch.refresh_plan(
        t.table("documents").select(
            "doc_id", F.md5("text").alias("before"), F.when(F.col("doc_id") % 10 == 3, F.lit("new")).otherwise(F.md5("text")).alias("after"), F.col("source").alias("surface_before"), F.col("source").alias("surface_after"),
            F.lit(False).alias("inputs_changed"), F.lit(False).alias("identity_changed"),
        )
    )
)


@query("p04_page_links", None)
def _(t):
    """P4: references from pages to the targets of their links, with their number."""
    links = t.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst"))
    return links.groupBy("page_id", "dst").agg(F.count(F.lit(1)).alias("n"))


from loomgraph.queries.base import ORACLE  # noqa: E402

ORACLE["p04_page_links"] = "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages) SELECT page_id, dst, count(*) AS n FROM l GROUP BY ALL"


#: A source of each language about the part ``#``, and its symbols: name, kind, parent, first and last line, relations.
_SOURCES = {
    "rust": (
        "// fn no() {}\npub struct P# {\n    pub key: Tag,\n}\nimpl Shape for P# {\n    fn area(&self) -> u32 {\n        helper#(\"fn x() {\")\n    }\n}\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn works() {}\n}\n",
        [("P#", "struct", "", 1, 3, ""), ("key", "field", "P#", 2, 2, "type_of:Tag"), ("Shape for P#", "impl", "", 4, 8, "implements:Shape"), ("area", "method", "P#", 5, 7, "calls:helper#"), ("tests", "module", "", 10, 13, ""), ("works", "function", "tests", 12, 12, "")],
    ),
    "go": (
        "package a\nimport \"net/http\"\ntype P# struct {\n\tKey Tag\n}\ntype Shape interface {\n\tArea() int\n}\nfunc (p *P#) Area() int {\n\treturn helper#(`func x() {`)\n}\nconst Max = #\n",
        [("http", "import", "", 1, 1, "references:http"), ("P#", "struct", "", 2, 4, ""), ("Key", "field", "P#", 3, 3, "type_of:Tag"), ("Shape", "trait", "", 5, 7, ""), ("Area", "method", "Shape", 6, 6, ""), ("Area", "method", "P#", 8, 10, "calls:helper#"), ("Max", "const", "", 11, 11, "")],
    ),
    "python": (
        "from a import b\nclass P#(Base):\n    key: Tag\n    def area(self):\n        return helper#('def x():')\nMAX = #\n",
        [("b", "import", "", 0, 0, "references:b"), ("P#", "class", "", 1, 4, "extends:Base"), ("key", "field", "P#", 2, 2, "type_of:Tag"), ("area", "method", "P#", 3, 4, "calls:helper#"), ("MAX", "const", "", 5, 5, "")],
    ),
    "typescript": (
        "import { a as b } from './c';\nexport class P# extends Base implements Shape {\n  private key: Tag;\n  area(): number {\n    return helper#('class x {');\n  }\n}\nexport interface Shape {\n  area(): number;\n}\nconst go = (x: number) => helper#(x);\n",
        [("b", "import", "", 0, 0, "references:a"), ("P#", "class", "", 1, 6, "extends:Base,implements:Shape"), ("key", "field", "P#", 2, 2, "type_of:Tag"), ("area", "method", "P#", 3, 5, "calls:helper#"), ("Shape", "interface", "", 7, 9, ""), ("area", "method", "Shape", 8, 8, ""), ("go", "callable_value", "", 10, 10, "calls:helper#")],
    ),
}


def _symbols(t, only=None):
    text = F.replace(F.get(F.array(*[F.lit(x) for x, _ in _SOURCES.values()]), F.col("l")), F.lit("#"), F.col("p_partkey").cast("string"))
    of = F.lit(list(_SOURCES).index(only)) if only else (F.col("p_partkey") % 5).cast("int")
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in _SOURCES]), F.col("l")), F.lit("unknown"))
    parts = t.table("part").select("p_partkey", of.alias("l"))
    found = python_extractor.extract(parts.select(F.concat(F.lit("src/f"), "p_partkey").alias("path"), name.alias("language"), F.coalesce(text, F.lit("")).cast("binary").alias("content")))
    links = F.array_join(F.transform("relations", lambda r: F.concat(r["tag"], F.lit(":"), r["target"])), ",")
    return found.select("file_path", "name", "kind", "parent", "line_start", "line_end", links.alias("links"))


def _symbols_sql(only=None):
    said = []
    for k, (language, (_, rows)) in enumerate(_SOURCES.items()):
        if only in (None, language):
            values = ", ".join("('{}', '{}', '{}', {}, {}, '{}')".format(*r) for r in rows)
            said.append(
                f"SELECT 'src/f' || p_partkey AS file_path, replace(name, '#', p_partkey::VARCHAR) AS name, kind, replace(parent, '#', p_partkey::VARCHAR) AS parent, a::INT AS line_start, b::INT AS line_end, "
                f"replace(links, '#', p_partkey::VARCHAR) AS links FROM part, (VALUES {values}) AS v(name, kind, parent, a, b, links)" + ("" if only else f" WHERE p_partkey % 5 = {k}")
            )
    return " UNION ALL ".join(said)


query("o04_extract_sources", _symbols_sql())(_symbols)
query("o05_rust_symbols", _symbols_sql("rust"))(lambda t: _symbols(t, "rust"))
query("o06_go_symbols", _symbols_sql("go"))(lambda t: _symbols(t, "go"))
query("o07_python_symbols", _symbols_sql("python"))(lambda t: _symbols(t, "python"))
query("o08_typescript_symbols", _symbols_sql("typescript"))(lambda t: _symbols(t, "typescript"))
