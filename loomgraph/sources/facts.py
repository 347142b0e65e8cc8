"""Facts that arrive as text or as other tools' files (O-11, O-14 to O-17, O-73)."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIAGNOSTIC = "reason string, manifest_path string, message struct<code:struct<code:string>,message:string,spans:array<struct<file_name:string,line_start:long,is_primary:boolean>>>"


def dead_diagnostics(lines: DataFrame, column: str = "value") -> DataFrame:
    """O-17: (file_name, line, code, subject, manifest_path) from JSON lines of a compiler: dead_code only, at the first primary span; other and broken lines are skipped. The subject is the first name in back-ticks."""
    own = lines.select(F.from_json(column, DIAGNOSTIC).alias("m"))
    span = F.get(F.filter("m.message.spans", lambda s: s["is_primary"]), F.lit(0))
    hits = own.where((F.col("m.message.code.code") == "dead_code") & span.isNotNull())
    return hits.select(
        span["file_name"].alias("file_name"), span["line_start"].alias("line"), F.col("m.message.code.code").alias("code"),
        F.nullif(F.regexp_extract("m.message.message", "`([^`]+)`", 1), F.lit("")).alias("subject"), F.col("m.manifest_path").alias("manifest_path"),
    )


def churn(log: DataFrame, days: int = 90) -> DataFrame:
    """O-16, O-73: per path churn_90d, unique_authors_90d, last_modified_days from a log's numbered lines (line_no, value).

    A header is ``commit|author``; below it stand numstat lines of added, deleted and path, parted by tabs. The author is
    carried down by a running last value within blocks of lines plus the last header of earlier blocks, so no task sees the
    whole log. The age is a proxy by position: floor(first line index * days / number of lines).
    """
    block = 1 << 16
    rows = log.withColumn("author", F.nullif(F.regexp_extract("value", r"^commit\|(.*)$", 1), F.lit(""))).withColumn("block", F.expr(f"line_no div {block}"))
    lasts = rows.where("author is not null").groupBy("block").agg(F.max_by("author", "line_no").alias("own"))
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(lasts, "block", "left")
    carried = blocks.select(F.col("block").alias("b"), F.last("own", ignorenulls=True).over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    here = F.last("author", ignorenulls=True).over(W.partitionBy("block").orderBy("line_no"))
    filled = rows.withColumn("here", here).join(carried, F.col("block") == F.col("b")).withColumn("who", F.coalesce("here", "before"))
    stat = F.split("value", "\t")
    stats = filled.where(F.size(stat) == 3).select(F.get(stat, 2).alias("path"), "who", "line_no", "total")
    return stats.groupBy("path").agg(
        F.count(F.lit(1)).alias("churn_90d"), F.countDistinct("who").alias("unique_authors_90d"), F.expr(f"min(line_no) * {days} div max(total)").alias("last_modified_days")
    )


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _manifest(path: str, text: str) -> list[tuple]:
    """Units (unit_id, language, ecosystem, kind, root, manifest, dependencies) that a manifest declares."""
    root, name = path.rpartition("/")[0], path.rpartition("/")[2]
    if name == "Cargo.toml":
        body = _toml(text)
        out = []
        if "workspace" in body:
            out.append((f"workspace:{root}", "rust", "cargo", "workspace", root, path, sorted(body["workspace"].get("members", []))))
        if "package" in body:
            local = sorted(k for k, v in body.get("dependencies", {}).items() if isinstance(v, dict) and "path" in v)
            out.append((f"cargo:{body['package'].get('name', root)}", "rust", "cargo", "package", root, path, local))
        return out
    if name == "pyproject.toml":
        project = _toml(text).get("project", {})
        return [(f"python:{project.get('name', root)}", "python", "pyproject", "package", root, path, sorted(project.get("dependencies", [])))]
    if name == "go.mod":
        words = [line.split() for line in text.splitlines()]
        module = next((w[1] for w in words if len(w) > 1 and w[0] == "module"), root)
        return [(f"go:{module}", "go", "gomod", "module", root, path, [])]
    if name == "package.json":
        try:
            body = json.loads(text)
        except ValueError:
            return []
        return [(f"npm:{body.get('name', root)}", "typescript", "npm", "package", root, path, sorted(body.get("dependencies", {})))]
    return []


UNITS = "project_unit_id string, language_id string, ecosystem_id string, kind string, root_path string, manifest_path string, dependencies array<string>"


def project_units(files: DataFrame) -> DataFrame:
    """O-14: units from manifests among files (path, content)."""

    def run(parts):
        for pdf in parts:
            rows = [u for p, c in zip(pdf["path"], pdf["content"]) for u in _manifest(p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in UNITS.split(", ")])

    names = F.substring_index("path", "/", -1).isin("Cargo.toml", "pyproject.toml", "go.mod", "package.json")
    return files.where(names).select("path", "content").mapInPandas(run, UNITS)


def memberships(documents: DataFrame, units: DataFrame) -> DataFrame:
    """O-24's input: (document_path, project_unit_id, kind): the innermost unit of a document's language owns it, outer ones are its path context.

    Documents meet units by an equi-join on each of their directories.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = documents.select("path", "language", F.explode(above).alias("root_path"))
    own = units.where("kind <> 'workspace'").select("project_unit_id", F.col("language_id").alias("language"), "root_path")
    hits = dirs.join(own, ["root_path", "language"])
    best = F.max(F.length("root_path")).over(W.partitionBy("path"))
    return hits.select(F.col("path").alias("document_path"), "project_unit_id", F.when(F.length("root_path") == best, F.lit("source_owner")).otherwise(F.lit("path_context")).alias("kind"))


def entry_points(files: DataFrame) -> DataFrame:
    """O-15: (name, kind, file_path, crate_name) by convention and manifest of files (path, content): Cargo targets, and Go packages by their package clause (main: bin file, else lib directory)."""

    def run(parts):
        for pdf in parts:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                root, _, name = p.rpartition("/")
                text = bytes(c).decode("utf-8", "replace")
                at = f"{root}/" if root else ""
                if name == "Cargo.toml":
                    body = _toml(text)
                    crate = body.get("package", {}).get("name")
                    if crate:
                        for kind, section in (("bin", "bin"), ("example", "example"), ("test", "test"), ("bench", "bench")):
                            rows += [(x.get("name", crate), kind, at + x["path"], crate) for x in body.get(section, []) if "path" in x]
                        rows.append((crate, "lib", at + body.get("lib", {}).get("path", "src/lib.rs").rpartition("/")[0], crate))
                        rows += [(crate, "bin", at + "src/main.rs", crate), (crate, "build", at + "build.rs", crate), (crate, "test", at + "tests", crate), (crate, "example", at + "examples", crate)]
                elif name.endswith(".go") and not name.endswith("_test.go"):
                    package = next((line.split()[1] for line in text.splitlines() if line.startswith("package ")), "")
                    rows.append((package, "bin", p, root) if package == "main" else (package, "lib", root, root))
            yield pd.DataFrame(rows, columns=["name", "kind", "file_path", "crate_name"])

    own = files.where(F.col("path").endswith("Cargo.toml") | F.col("path").endswith(".go"))
    return own.select("path", "content").mapInPandas(run, "name string, kind string, file_path string, crate_name string").distinct()


def reference_edges(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """O-11, O-107, J-6: compiler occurrences (path, line, symbol) as edges (src, dst, kind) from the innermost definition around each.

    ``definitions`` is (path, line_start, line_end, memory_id, symbol). Descriptors ending in ``#`` are types; nothing here is a call.
    """
    spans = definitions.select("path", F.col("line_start").alias("a"), F.col("line_end").alias("b"), F.col("memory_id").alias("src"))
    found = occurrences.join(spans, "path").where("line between a and b")
    owner = found.groupBy("path", "line", "symbol").agg(F.min_by("src", F.struct(F.col("b") - F.col("a"), -F.col("a"), F.col("src"))).alias("src"))
    target = definitions.select("symbol", F.col("memory_id").alias("dst"))
    kind = F.when(F.col("symbol").endswith("#"), F.lit("type_of")).otherwise(F.lit("references"))
    return owner.join(target, "symbol").where("src <> dst").select("src", "dst", kind.alias("kind")).distinct()
