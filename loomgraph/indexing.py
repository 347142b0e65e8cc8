"""From a source tree to a published generation: the index and reindex verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import source_text
from loomgraph.operators import build, changes, classify
from loomgraph.plans.checkpoint import cut, discard
from loomgraph.sources import facts, files, python_extractor
from loomgraph.sources.bundle import Bundle


def index(tree: DataFrame, bundle: Bundle, languages: list[str] | None = None, ignored: list[str] | None = None, **publish: object) -> str:
    """Extract, build, classify and publish the files (path, content) of a tree; the new generation's name.

    Tables: nodes, edges, files (path, hash, language, bytes), contents, units and memberships. Calls come from syntax
    alone here, so no receipts are written and verbs that need call evidence qualify their answers.
    """
    found = files.discover(tree, languages, ignored)
    symbols = cut(python_extractor.extract(found), "symbols")
    nodes, edges = (cut(df, "built") for df in build.build_graph(symbols))
    roots = classify.roots(nodes, facts.entry_points(tree).select("kind", "file_path"))
    classes = classify.classify(nodes, edges, roots)
    conditions = found.select(F.col("path").alias("file_path"), source_text.platform_col(F.decode("content", "UTF-8")).alias("has_platform_cfg"))
    whole = nodes.join(classes, "memory_id").join(conditions, "file_path", "left").withColumn("rustc_flagged_dead", F.lit(False))
    units = facts.project_units(tree)
    tables = {
        "nodes": whole, "edges": edges, "files": files.file_records(found), "contents": found.select("path", "content"), "units": units,
        "memberships": facts.memberships(found.select("path", "language"), units),
    }
    name = bundle.publish(tables, **publish)
    discard(symbols, nodes, edges)
    return name


def reindex(tree: DataFrame, bundle: Bundle, languages: list[str] | None = None, ignored: list[str] | None = None, **publish: object) -> str:
    """The present generation if its files are those of the tree, else a new one by :func:`index`."""
    if bundle.heads():
        head = bundle.resolve()["generation_id"]
        live = files.file_records(files.discover(tree, languages, ignored))
        if changes.freshness(live, bundle.open("files", head)).head()["status"] == "fresh":
            return head
    return index(tree, bundle, languages, ignored, **publish)
