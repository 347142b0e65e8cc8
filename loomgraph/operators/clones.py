"""Clone groups by normalised syntax (O-74)."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def python_fingerprints(source: str | None, least: int) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, fingerprint) of functions with at least ``least`` lines.

    The fingerprint is the tree's shape: names are numbered by first use and literals reduced to their type, so renamed
    copies agree. Sources that don't parse have none.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for fn in ast.walk(tree):
        if not isinstance(fn, ast.FunctionDef | ast.AsyncFunctionDef) or (fn.end_lineno or 0) - fn.lineno + 1 < least:
            continue
        seen: dict[str, int] = {}
        shape, todo = [], [fn]
        while todo:
            node = todo.pop()
            shape.append(type(node).__name__)
            if isinstance(node, ast.Constant):
                shape.append(type(node.value).__name__)
            for field in ("id", "arg", "name", "attr"):
                word = getattr(node, field, None)
                if isinstance(word, str) and node is not fn:
                    shape.append(str(seen.setdefault(word, len(seen))))
            children = list(ast.iter_child_nodes(node))
            shape.append(str(len(children)))
            todo += reversed(children)
        out.append((fn.name, fn.lineno, fn.end_lineno or fn.lineno, hashlib.sha256(" ".join(shape).encode()).hexdigest()))
    return out


def fingerprints(files: DataFrame, least: int = 5) -> DataFrame:
    """(path, name, line_start, line_end, fingerprint) of Python files (path, text)."""

    def run(parts):
        for pdf in parts:
            rows = [(p, *f) for p, t in zip(pdf["path"], pdf["text"]) for f in python_fingerprints(t, least)]
            yield pd.DataFrame(rows, columns=["path", "name", "line_start", "line_end", "fingerprint"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, line_start long, line_end long, fingerprint string")


def clone_groups(prints: DataFrame) -> DataFrame:
    """Groups of two or more: (fingerprint, size, lines, duplicated_lines), the largest first. Lines are those of the shortest member.

    Works on any rows with a fingerprint and line range; members are not gathered."""
    lines = F.col("line_end") - F.col("line_start") + 1
    groups = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"), F.min(lines).alias("lines")).where("size >= 2")
    return groups.withColumn("duplicated_lines", F.col("lines") * (F.col("size") - 1)).orderBy(F.desc("size"), F.desc("lines"), "fingerprint")
