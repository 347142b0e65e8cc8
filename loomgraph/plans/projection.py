"""Projections of plain tables to the graph schema (P1 to P5).

The text of P1 and P3 is SQL that Spark and DuckDB read alike; it is the input of both sides of a comparison, not
an operator. ``{name}`` stands for an input table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

P1_NODES = """
SELECT memory_id, symbol_name, kind, file_path, is_test_only, k,
  CASE k % 5 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(crate)' WHEN 2 THEN 'private' WHEN 3 THEN '' ELSE 'pub(super)' END AS visibility,
  CASE WHEN k % 3 = 0 THEN 'pub fn x' WHEN k % 3 = 1 THEN 'pub(crate) fn x' ELSE 'fn x' END AS signature,
  CAST(k % 97 * 3 AS INT) AS line_start, CAST(k % 97 * 3 + k % 11 AS INT) AS line_end,
  CASE WHEN kind = 'function' THEN k % 7 <> 0 END AS has_body,
  coalesce(is_test_only, false) AND k % 3 = 0 AS is_test_root, k % 10 = 0 AS has_platform_cfg, k % 4 = 0 AS rustc_flagged_dead, CAST(k % 16 AS INT) AS entry_retain,
  CASE k % 9 WHEN 0 THEN 'wired' WHEN 1 THEN 'public_api' WHEN 2 THEN 'structural' WHEN 3 THEN 'test_only' WHEN 4 THEN 'dead' WHEN 5 THEN 'orphan'
    WHEN 6 THEN 'unclassified' WHEN 7 THEN 'suspected' ELSE 'excluded' END AS reachability_class
FROM (
  SELECT 'r' || r_regionkey AS memory_id, r_name AS symbol_name, 'module' AS kind, 'geo/' || r_name AS file_path, CAST(NULL AS BOOLEAN) AS is_test_only, CAST(r_regionkey AS BIGINT) AS k FROM {region}
  UNION ALL SELECT 'n' || n_nationkey, r_name || '::' || n_name, 'namespace', 'geo/' || r_name || '/' || n_name, false, CAST(n_nationkey AS BIGINT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL SELECT 's' || s_suppkey, n_name || '::' || s_name, 'struct', 'supply/' || n_name, false, s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, n_name || '::' || c_name, 'class', 'market/' || c_mktsegment, false, c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, p_brand || '::' || p_name, 'trait', 'parts/' || p_brand, false, p_partkey FROM {part}
  UNION ALL SELECT 'o' || o_orderkey, 'order::' || o_orderkey, 'function', 'orders/' || year(o_orderdate), o_orderpriority = '5-LOW', o_orderkey FROM {orders}
) AS base
"""

P1_EDGES = """
SELECT src, dst, kind, source, scope, CAST(CASE source WHEN 'Both' THEN 0.95 WHEN 'Scip' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence
FROM (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS kind, 'TreeSitter' AS source, 'Production' AS scope FROM {nation}
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', 'TreeSitter', 'Production' FROM {supplier}
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 'TreeSitter', 'Production' FROM {customer}
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls', 'Scip', CASE WHEN o_orderpriority = '5-LOW' THEN 'Test' ELSE 'Production' END FROM {orders}
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'references',
    CASE max(l_returnflag) WHEN 'R' THEN 'Scip' WHEN 'A' THEN 'Both' ELSE 'TreeSitter' END, CASE max(l_linestatus) WHEN 'O' THEN 'Production' ELSE 'CfgGated' END FROM {lineitem} GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'calls',
    CASE max(l_returnflag) WHEN 'R' THEN 'Scip' WHEN 'A' THEN 'Both' ELSE 'TreeSitter' END, CASE max(l_linestatus) WHEN 'O' THEN 'Production' ELSE 'CfgGated' END FROM {lineitem} GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'field_of', 'TreeSitter', 'Production' FROM {lineitem}
  UNION ALL SELECT 'p' || a.p_partkey, 'p' || b.p_partkey, 'related_to', 'TreeSitter', 'Production' FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey
  UNION ALL SELECT 's' || s_suppkey, 'p' || s_suppkey, 'implements', 'Both', 'Production' FROM {supplier} JOIN {part} ON p_partkey = s_suppkey
  UNION ALL SELECT 'p' || s_suppkey, 's' || s_suppkey, 'has_impl', 'Both', 'Production' FROM {supplier} JOIN {part} ON p_partkey = s_suppkey
  UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 'type_of', 'TreeSitter', 'Production' FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 's' || a.s_suppkey, 's' || b.s_suppkey, 'extends', 'TreeSitter', 'Production' FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey - 1 WHERE a.s_suppkey % 3 = 0
  UNION ALL SELECT 'n' || a.n_nationkey, 'n' || b.n_nationkey, 'depends_on', 'TreeSitter', 'Production' FROM {nation} a JOIN {nation} b ON b.n_nationkey = (a.n_nationkey + 7) % 25
) AS base
"""

#: P3: documents as files of a source tree.
P3_FILES = """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'crates/c' || doc_id % 7 || '/' ELSE '' END || CASE doc_id % 8 WHEN 0 THEN 'tests/' WHEN 1 THEN 'testdata/' WHEN 2 THEN 'target/x/build/y/out/' WHEN 3 THEN 'examples/' ELSE 'src/' END
  || CASE WHEN doc_id % 11 = 0 THEN 'test_' ELSE 'f' END || doc_id
  || CASE doc_id % 9 WHEN 0 THEN '.rs' WHEN 1 THEN '_test.go' WHEN 2 THEN '.py' WHEN 3 THEN '.spec.ts' WHEN 4 THEN '.md' WHEN 5 THEN '.stories.tsx' WHEN 6 THEN '_tests.rs' WHEN 7 THEN '.pyi' ELSE '.go' END AS path,
  doc_id, text, source, lang FROM {documents}
"""

#: P2 (a): steps between consecutive events of a user, a small cyclic graph.
P2_EDGES = """
SELECT DISTINCT src, dst FROM (
  SELECT user_id || ':' || event_type AS src, lead(user_id || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}
) AS steps WHERE dst IS NOT NULL AND src <> dst
"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations", "labels", "embeddings"]


def duck(text: str) -> str:
    """Projection SQL over the views that the comparison registers."""
    return text.format(**{t: t for t in TABLES})


class Tables:
    """Inputs of a scale factor and their projections, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(P1_NODES)

    @cached_property
    def edges(self) -> DataFrame:
        return self.sql(P1_EDGES)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(P3_FILES)

    @cached_property
    def steps(self) -> DataFrame:
        return self.sql(P2_EDGES)
