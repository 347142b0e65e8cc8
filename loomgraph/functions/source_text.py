"""Functions on source text that need a scanner: generic types, comments, platform conditions (O-10, O-42, O-43).

Each is a plain function and a vectorised column over it; they run on columns of type names or lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import model


def split_top(text: str) -> list[str]:
    """Parts of a comma list, commas inside angle brackets aside; at most two."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            return [text[:i], text[i + 1 :]]
    return [text]


def leaf_types(text: str | None) -> list[str]:
    """O-42: type names inside references, trait objects, wrappers and maps, from left to right, without primitives."""
    found: list[str] = []
    todo = [text or ""]
    while todo:
        t = todo.pop().strip()
        if t.startswith("&"):
            todo.append(re.sub(r"^&\s*(?:'\S+\s+)?(?:mut\s+)?", "", t))
        elif t.startswith("dyn "):
            todo.append(t[4:])
        elif "<" in t:
            outer, inner = (x.strip() for x in t.split("<", 1))
            inner = inner[:-1] if inner.endswith(">") else inner
            name = outer.rpartition("::")[2]
            if name not in model.WRAPPERS and name not in model.PAIR_TYPES and outer:
                found.append(outer)
            todo += reversed(split_top(inner) if name in model.PAIR_TYPES else [inner])
        elif "::" in t:
            last = t.rpartition("::")[2].strip()
            if last[:1].isupper():
                found.append(last)
        elif t[:1].isalpha() or t[:1] == "_":
            found.append(t)
    return [t for t in found if t not in model.PRIMITIVES]


def blank_line(line: str | None) -> str | None:
    """O-43: string literals become blanks (an escape and its sign vanish), and the line ends at ``//`` outside of them."""
    if line is None:
        return None
    cut = lambda m: "" if m.group(1) else " " * len(re.sub(r"\\.", "", m.group(2), flags=re.S))
    return re.sub(r'(//.*)|("(?:[^"\\]|\\.)*"?)', cut, line, flags=re.S)


_TOKENS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\"(?:[^\"\\]|\\.)*\"|\S")
#: Predicate names in which a build may differ.
_PLATFORM = {"unix", "windows", "target_os", "target_arch", "target_family", "target_env", "target_pointer_width", "target_endian", "target_feature", "target_vendor", "feature", "debug_assertions"}


def has_platform_condition(source: str | None) -> bool:
    """O-10: some cfg(...), cfg!(...) or cfg_attr(...) names a predicate that a build can strip; names elsewhere don't count."""
    depth, open_at, pending = 0, None, False
    for token in _TOKENS.findall(source or ""):
        if open_at is None:
            if token in ("cfg", "cfg_attr"):
                pending = True
            elif token == "(" and pending:
                open_at, depth, pending = 0, 1, False
            elif token != "!":
                pending = False
            continue
        depth += (token == "(") - (token == ")")
        if depth == 0:
            open_at = None
        elif token in _PLATFORM:
            return True
    return False


def _column(fn: Callable, kind: T.DataType) -> Callable[[Column | str], Column]:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action=None)

    return run


leaf_types_col = _column(leaf_types, T.ArrayType(T.StringType()))
blank_line_col = _column(blank_line, T.StringType())
platform_col = _column(has_platform_condition, T.BooleanType())


def field_pattern(field: str) -> str:
    """A regex for uses of a field: member access or a literal's initialiser."""
    return rf"(?:\.\s*{re.escape(field)}\b(?!\s*\()|\b{re.escape(field)}\s*:(?!:))"
