"""The public interface: verbs over one pinned generation.

Every verb returns a :class:`Result`: its rows as a DataFrame in their total order, the page, and the evidence that says
which population was examined and whether an empty answer may be read as none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.errors import InvalidRequest, SymbolAmbiguous, SymbolNotFound
from loomgraph.functions import predicates as P
from loomgraph.functions import source_text
from loomgraph.operators import changes, classify, evidence, grep, paging, rollup, search
from loomgraph.plans import walk
from loomgraph.sources import files
from loomgraph.sources.bundle import Bundle

RECEIPTS = "provider string, version string, capability string, configuration string, language string, scope_kind string, scope_id string, status string"


@dataclass
class Result:
    """``status`` is complete or qualified; a qualified empty answer proves nothing. ``evidence`` holds counts and reasons."""

    operation: str
    generation: str
    rows: DataFrame
    status: str
    evidence: dict = field(default_factory=dict)
    page: dict | None = None

    def json(self) -> DataFrame:
        """The page's rows as JSON, as many as fit under the size ceiling."""
        return paging.to_json(self.rows)


class Graph:
    """Verbs over tables ``nodes`` and ``edges``, and where present ``files``, ``receipts``, ``inventory`` (language, unit) and ``bindings``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], generation: str = "unpublished", repository: str = "repository") -> None:
        self.spark, self.tables, self.generation, self.repository = spark, tables, generation, repository
        self.nodes, self.edges = tables["nodes"], tables["edges"]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Graph:
        """The newest valid generation of a bundle; later publications don't change what is read."""
        bundle = Bundle(spark, root)
        head = bundle.resolve()
        return cls(spark, {t: bundle.open(t, head["generation_id"]) for t in head["tables"]}, head["generation_id"], root)

    # ---- shared

    def selector(self, memory_id: str) -> str:
        """A symbol's public name, valid for this generation alone."""
        return f"sym-v1.{memory_id}.{paging.digest(self.repository, self.generation, memory_id)}"

    def resolve(self, symbol: str, file: str | None = None, callables: bool = False) -> dict:
        """The one node that a selector or name means; raises with candidates or suggestions otherwise."""
        if symbol.startswith("sym-v1."):
            memory_id = symbol.split(".")[1] if symbol.count(".") == 2 else ""
            row = self.nodes.where(F.col("memory_id") == memory_id).head() if symbol == self.selector(memory_id) else None
            if row is None:
                raise SymbolNotFound(symbol, [])
            return row.asDict()
        pool = self.nodes.where(P.has_role("kind", "callable" if callables else "definition"))
        asked = self.spark.createDataFrame([(symbol, file or "")], "query string, file string")
        hit = (search.resolve_in_file if file else search.resolve_unique)(pool, asked).head()
        if hit["status"] == "unique":
            return self.nodes.where(F.col("memory_id") == hit["memory_id"]).head().asDict()
        if hit["status"].startswith("not_found"):
            raise SymbolNotFound(symbol, [r["symbol_name"] for r in search.suggestions(self.nodes, symbol).collect()])
        raise SymbolAmbiguous(symbol, sorted((hit["candidates"] if "candidates" in hit else []) or []))

    def authority(self, capability: str) -> tuple[str, dict]:
        """Status of a capability over all languages, and it by language."""
        if "receipts" not in self.tables or "inventory" not in self.tables:
            return "unavailable", {}
        by = evidence.assess(self.tables["receipts"], capability, self.tables["inventory"])
        rows = {r["language"]: r["status"] for r in by.collect()}  # one row per language
        if not rows:
            return "not_applicable", rows
        return ("complete" if set(rows.values()) == {"complete"} else "unavailable" if set(rows.values()) == {"unavailable"} else "partial"), rows

    def _result(self, operation: str, rows: DataFrame, order: list, capability: str | None, limit: int, most: int, cursor: str | None, request: tuple, **facts: object) -> Result:
        if not 1 <= limit <= most:
            raise InvalidRequest(f"limit must be 1 to {most}")
        status, by = self.authority(capability) if capability else ("complete", {})
        total = rows.count()
        request_digest = paging.digest(operation, *map(str, request))
        page = paging.page_window(operation, self.generation, request_digest, cursor, limit, total)
        shown = paging.page(rows, order, page["offset"], limit)
        return Result(operation, self.generation, shown, "complete" if status in ("complete", "not_applicable") else "qualified", {"capability": capability, "by_language": by, "population": total, **facts}, page)

    # ---- verbs

    def status(self, live: DataFrame | None = None) -> Result:
        """Counts by class, which are null for dead unless classification has authority, and the freshness of ``live`` (path, hash)."""
        state, by = self.authority("callable_liveness")
        summary = rollup.class_summary(self.nodes)
        if state != "complete":
            summary = summary.withColumn("dead", F.lit(None).cast("long"))
        fresh = changes.freshness(live, self.tables["files"]).head()["status"] if live is not None and "files" in self.tables else "unknown"
        return Result("status", self.generation, summary, "complete" if state == "complete" else "qualified", {"freshness": fresh, "by_language": by, "guidance": evidence.guidance("sufficient", state == "complete", state != "unavailable")})

    def overview(self, unit: str = "unit", limit: int = 50, cursor: str | None = None) -> Result:
        nodes = self.nodes if unit in self.nodes.columns else self.nodes.withColumn(unit, F.substring_index("file_path", "/", 1))
        return self._result("overview", rollup.unit_overview(nodes, unit), ["unit"], "callable_liveness", limit, 100, cursor, (unit,))

    def find(self, query: str, kind: str | None = None, limit: int = 20, cursor: str | None = None) -> Result:
        """By path or name; a name without rows brings suggestions."""
        if search.is_path_query(query):
            rows, order = search.search_by_path(self.nodes, query, None), ["file_path", "line", "symbol_name", "kind", "memory_id"]
        else:
            rows, order = search.search_by_name(self.nodes, query, kind, limit=None), ["rank", "symbol_name", "file_path", "line", "kind", "memory_id"]
        out = self._result("find", rows, order, None, limit, 100, cursor, (query, kind))
        if not out.evidence["population"] and not search.is_path_query(query):
            out.evidence["suggestions"] = [r["symbol_name"] for r in search.suggestions(self.nodes, query).collect()]
        return out

    def type(self, symbol: str, limit: int = 50, cursor: str | None = None) -> Result:
        node = self.resolve(symbol)
        if node["kind"] not in model.ROLES["type"]:
            raise InvalidRequest(f"{symbol!r} is no type")
        members = rollup.type_members(self.nodes, self.edges, self.spark.createDataFrame([(node["memory_id"],)], "type_id string"))
        named = members.join(self.nodes.select(F.col("memory_id").alias("member_id"), "symbol_name", "file_path"), "member_id").select("role", "symbol_name", "file_path", "member_id")
        return self._result("type", named, ["role", "file_path", "symbol_name", "member_id"], None, limit, 100, cursor, (symbol,))

    def read(self, symbol: str, offset: int = 0, limit: int = 8000) -> str:
        if not 1 <= limit <= 20_000 or offset < 0:
            raise InvalidRequest("limit must be 1 to 20000")
        node = self.resolve(symbol)
        return files.read_page(files.slice_source(self.nodes.where(F.col("memory_id") == node["memory_id"]), self.tables["contents"]), node["memory_id"], offset, limit)

    def _incoming(self) -> DataFrame:
        """(from, to): callee to caller, and target to binding."""
        calls = self.edges.where("kind = 'calls'").select(F.col("dst").alias("from"), F.col("src").alias("to"))
        if "bindings" in self.tables:
            calls = calls.union(self.tables["bindings"].select(F.col("target").alias("from"), F.col("binding").alias("to")))
        return calls.distinct()

    def calls(self, symbol: str, filter: str = "live", limit: int = 50, cursor: str | None = None) -> Result:
        """Direct callers that the filter admits; the evidence counts those it does not."""
        node = self.resolve(symbol, callables=True)
        sites = self.edges.where((F.col("kind") == "calls") & (F.col("dst") == node["memory_id"])).select(F.col("src").alias("memory_id"), "scope", "source", "confidence")
        named = sites.join(self.nodes.select("memory_id", "symbol_name", "file_path", "line_start", "reachability_class"), "memory_id")
        rows = named.where(P.filter_admits(filter, "reachability_class"))
        return self._result("calls", rows, ["file_path", "line_start", "symbol_name", "memory_id"], "calls", limit, 100, cursor, (symbol, filter), callers=named.select("memory_id").distinct().count())

    def _chains(self, node: str, depth: int) -> DataFrame:
        rank = self.nodes.select(F.col("memory_id").alias("node"), F.struct("file_path", "symbol_name", "memory_id").alias("rank"))
        return walk.chains(self._incoming(), self.spark.createDataFrame([(node,)], "root string"), rank, depth).where("depth > 0")

    def tests(self, symbol: str, limit: int = 50, cursor: str | None = None) -> Result:
        """Test roots that reach a symbol through calls, one shortest chain each."""
        node = self.resolve(symbol)
        roots = self.nodes.where("is_test_root").select(F.col("memory_id").alias("node"), "symbol_name", "file_path")
        rows = self._chains(node["memory_id"], 10).join(roots, "node").select("node", "symbol_name", "file_path", "depth", "chain")
        return self._result("tests", rows, ["node"], "calls", limit, 100, cursor, (symbol,))

    def assess(self, symbol: str, depth: int = 3, limit: int = 50, cursor: str | None = None) -> Result:
        """What a change may affect: callers and structural dependents up to a depth, with counts as risk signals."""
        if not 1 <= depth <= 10:
            raise InvalidRequest("depth must be 1 to 10")
        node = self.resolve(symbol)
        chains = self._chains(node["memory_id"], depth)
        structural, cutoff = walk.impact(self.edges, self.nodes, self.spark.createDataFrame([(node["memory_id"],)], "root string"), depth)
        union = changes.impact_union(chains.select("node", "depth"), structural.select("node", "depth"))
        named = union.join(self.nodes.select(F.col("memory_id").alias("node"), "symbol_name", "file_path"), "node")
        tests = self.nodes.where("is_test_root").select(F.col("memory_id").alias("node"))
        none = tests.limit(0) if "bindings" not in self.tables else self.tables["bindings"].select(F.col("binding").alias("node"))
        signals = evidence.risk_signals(union, self.nodes, tests, none).head().asDict()
        return self._result("assess", named, ["depth", "file_path", "symbol_name", "node"], "calls", limit, 100, cursor, (symbol, depth), signals=signals, depth_cutoff_nodes=cutoff.head()["depth_cutoff_nodes"])

    def inspect(self, symbol: str, preview: int = 20) -> dict:
        """Facets of a symbol: source, structure, callers, field usage and tests, each available, not_applicable or unavailable."""
        node = self.resolve(symbol)
        kind, out = node["kind"], {"symbol": node, "selector": self.selector(node["memory_id"])}
        text = "contents" in self.tables
        out["source"] = {"state": "available", "result": self.read(out["selector"])} if text else {"state": "unavailable"}
        is_type, is_code = kind in model.ROLES["type"], kind in model.ROLES["callable"]
        out["structure"] = {"state": "available", "result": self.type(out["selector"], preview)} if is_type else {"state": "not_applicable"}
        out["callers"] = {"state": "available", "result": self.calls(out["selector"], "all", preview)} if is_code else {"state": "not_applicable"}
        out["tests"] = {"state": "available", "result": self.tests(out["selector"], preview)} if is_code else {"state": "not_applicable"}
        out["field_usage"] = {"state": "not_applicable"} if not is_type else {"state": "available", "result": self._field_usage(node["memory_id"], preview)} if text else {"state": "unavailable"}
        return out

    def _field_usage(self, type_id: str, preview: int) -> Result:
        """Callables and properties whose lines use a field of the type."""
        inside = self.edges.where((F.col("kind") == "contains") & (F.col("src") == type_id)).select(F.col("dst").alias("memory_id"))
        fields = self.nodes.where("kind = 'field'").join(inside, "memory_id", "left_semi").select(P.short_name("symbol_name").alias("field")).distinct()
        sources = files.slice_source(self.nodes.where(P.has_role("kind", "callable") | (F.col("kind") == "property")), self.tables["contents"]).where("source is not null")
        lines = sources.select("memory_id", F.explode(F.split("source", "\n")).alias("line")).select("memory_id", source_text.blank_line_col("line").alias("line"))
        return self._result("field_usage", grep.field_usage(lines, fields), ["memory_id", "field"], None, preview, 100, None, (type_id,))

    def dead(self, limit: int = 50, cursor: str | None = None) -> Result:
        """Candidates; a callable counts as unreached only when call evidence is complete, else it is unknown."""
        status, _ = self.authority("calls")
        calls = self.edges.where("kind = 'calls'").select(F.col("src").alias("from"), F.col("dst").alias("to"))
        seeds = lambda cond: self.nodes.where(cond).select(F.col("memory_id").alias("node"))
        production = walk.reach(calls, seeds("coalesce(entry_retain, 0) & 7 <> 0 or (kind in ('function', 'method') and split(symbol_name, '::')[size(split(symbol_name, '::')) - 1] = 'main')"))
        tests = walk.reach(calls, seeds("is_test_root"))
        verdicts = classify.callable_verdicts(self.nodes, production, tests, status == "complete")
        summary = classify.dead_summary(verdicts).head().asDict()
        return self._result("dead", classify.dead_candidates(self.nodes, verdicts), ["file_path", "symbol_name", "kind", "memory_id"], "calls", limit, 100, cursor, (), summary=summary)

    def audit(self, scope: str = "production", fan_in: int = 20, percent: int = 10, limit: int = 50, cursor: str | None = None) -> Result:
        rows = rollup.hotspots(self.nodes, self.edges, scope, fan_in)
        units = rollup.dead_ratios(self.nodes.withColumn("unit", F.substring_index("file_path", "/", 1)), percent=percent)
        order = [F.desc("fan_in"), "file_path", "line_start", "symbol_name", "kind", "memory_id"]
        return self._result("audit", rows, order, "calls", limit, 100, cursor, (scope, fan_in, percent), dead_units=units, dead_files=rollup.dead_files(self.nodes))

    def deps(self, path: str, limit: int = 50, cursor: str | None = None) -> Result:
        inside = (F.col("file_path") == path) | F.col("file_path").startswith(path.rstrip("/") + "/")
        rows = rollup.dependencies(self.nodes, self.edges, self.nodes.where(inside).select("file_path"))
        return self._result("deps", rows, ["file", "direction", "relation"], "project_dependencies", limit, 100, cursor, (path,))

    def grep_context(self, pattern: str, context: int = 0, limit: int = 50) -> Result:
        """Matching lines with context, and the smallest symbol around each match where the file is as it was indexed."""
        text = self.tables["contents"].select("path", F.decode("content", "UTF-8").alias("text"))
        found = grep.grep(text, pattern, context, overall=limit)
        return Result("grep_context", self.generation, grep.containing(found, self.nodes), "complete", {"pattern": pattern})

    def diff(self, fresh: DataFrame, limit: int | None = 50) -> Result:
        """This generation's symbols against freshly extracted ones (memory_id, symbol_name, file_path, content_hash); without a limit all changes."""
        keys = ["memory_id", "symbol_name", "file_path"]
        found = changes.full_diff(self.nodes, fresh, keys, "content_hash")
        facts = changes.verdict(found, True).head().asDict()
        return Result("diff", self.generation, changes.bounded(found, limit), "complete", facts)

    # ---- library verbs

    def stats(self) -> DataFrame:
        return rollup.graph_stats(self.nodes, self.edges)

    def blast_radius(self, symbol: str, depth: int = 3, filter: str = "all") -> DataFrame:
        """Dependents with their class; the filter applies to the finished walk."""
        node = self.resolve(symbol)
        found = walk.dependents(self.nodes, self.edges, self.spark.createDataFrame([(node["memory_id"],)], "root string"), depth)
        named = found.join(self.nodes.select(F.col("memory_id").alias("node"), "symbol_name", "file_path", "reachability_class"), "node")
        return named.where(P.reverse_filter(filter, "reachability_class")).select("node", "symbol_name", "file_path", "depth", "reachability_class")

    def is_wired(self, symbol: str) -> str:
        return self.resolve(symbol)["reachability_class"]

    def signature(self, symbol: str) -> str:
        node = self.resolve(symbol)
        return node["signature"] or f"{node['kind']} {node['symbol_name'].rpartition('::')[2]}"

    def reachability(self, entries: DataFrame, baseline: DataFrame | None = None, threshold: int = 0) -> tuple[DataFrame, dict]:
        """The classification, and against a baseline its deltas with an exit code: 0 without regression, 1 with one, 2 beyond the threshold."""
        classes = classify.classify(self.nodes, self.edges, classify.roots(self.nodes, entries))
        named = self.nodes.drop("reachability_class").join(classes, "memory_id")
        if baseline is None:
            return named, {"exit_code": 0}
        facts = changes.regression(baseline, named, threshold).head().asDict()
        return named, facts | {"exit_code": 2 if facts["exceeds_threshold"] else 1 if facts["is_regression"] else 0}
