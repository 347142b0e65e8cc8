"""Symbols and relations of sources by language (O-04), and of Python sources (O-07)."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.sources import brace_extractor

SYMBOLS = (
    "file_path string, name string, kind string, parent string, start_byte long, end_byte long, line_start int, line_end int, signature string, "
    "doc_comment string, content_hash string, visibility string, is_test_only boolean, is_test_root boolean, has_body boolean, entry_retain int, "
    "relations array<struct<tag:string,target:string>>"
)
_NAMES = [x.split(" ")[0] for x in SYMBOLS.split(", ")]


def is_test_path(path: str) -> bool:
    parts = path.split("/")
    stem = parts[-1].rpartition(".")[0]
    return "tests" in parts[:-1] or stem.startswith("test_") or stem.endswith("_test") or parts[-1] == "conftest.py"


def _dotted(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    return None


def _types(node: ast.AST | None) -> list[str]:
    """Names in an annotation, inside subscripts and unions too."""
    if node is None:
        return []
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _types(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return []
    found = {x.id for x in ast.walk(node) if isinstance(x, ast.Name)} | {x.attr for x in ast.walk(node) if isinstance(x, ast.Attribute)}
    return sorted(found - {"None", "int", "str", "float", "bool", "bytes", "list", "dict", "set", "tuple", "object", "Any", "Optional", "Union"})


class _Collector(ast.NodeVisitor):
    def __init__(self, path: str, source: str) -> None:
        self.path, self.lines = path, source.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode()))
        self.raw, self.scope, self.test, self.rows = source.encode(), [], is_test_path(path), []

    def add(self, node: ast.AST, name: str, kind: str, relations: list[tuple[str, str]], body: bool | None = None, root: bool = False) -> None:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        a = self.starts[first - 1] + (node.col_offset if first == node.lineno else 0)
        b = self.starts[node.end_lineno - 1] + node.end_col_offset
        doc = ast.get_docstring(node) if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else None
        private = name.rpartition(".")[2].startswith("_") and not name.endswith("__")
        self.rows.append(
            (self.path, name, kind, "::".join(n for n, _ in self.scope), a, b, first - 1, node.end_lineno - 1, self.lines[node.lineno - 1].strip(), doc,
             hashlib.sha256(self.raw[a:b]).hexdigest(), "private" if private else "pub", self.test, root, body, 0, [{"tag": t, "target": x} for t, x in relations])
        )

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, node.bases) if b]
        protocol = any(b.rpartition(".")[2] == "Protocol" for b in bases)
        links = [("extends", b.rpartition(".")[2]) for b in bases if b.rpartition(".")[2] not in ("Protocol", "object")]
        self.add(node, node.name, "interface" if protocol else "class", links)
        self.scope.append((node.name, "class"))
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                self.add(x, x.target.id, "field", [("type_of", t) for t in _types(x.annotation)])
            elif isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        self.add(x, t.id, "field", [])
        self.generic_visit(node)
        self.scope.pop()

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = bool(self.scope) and self.scope[-1][1] == "class"
        marks = {d.rpartition(".")[2] for d in map(_dotted, node.decorator_list) if d}
        kind = "property" if inside and marks & {"property", "cached_property"} else "constructor" if inside and node.name == "__init__" else "method" if inside else "function"
        stub = all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in node.body) and "abstractmethod" in marks
        links = {("calls", n.rpartition(".")[2]) for x in ast.walk(node) if isinstance(x, ast.Call) and (n := _dotted(x.func))}
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        links |= {("type_of", t) for a in [*[x.annotation for x in args], node.returns] for t in _types(a)}
        self.add(node, node.name, kind, sorted(links), not stub, self.test and node.name.startswith("test"))
        if kind == "constructor":
            for x in ast.walk(node):
                if isinstance(x, ast.Assign | ast.AnnAssign):
                    for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            self.add(x, t.attr, "field", [("type_of", n) for n in _types(getattr(x, "annotation", None))])
        self.scope.append((node.name, "function"))
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add(node, a.asname or a.name, "import", [("references", a.name.rpartition(".")[2])])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add(node, a.asname or a.name, "import", [("references", a.name)] if a.name != "*" else [])

    def module_level(self, tree: ast.Module) -> None:
        for x in tree.body:
            if isinstance(x, ast.Assign | ast.AnnAssign):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Name):
                        alias = isinstance(x, ast.AnnAssign) and (_dotted(x.annotation) or "").endswith("TypeAlias")
                        kind = "type_alias" if alias else "callable_value" if isinstance(x.value, ast.Lambda) else "const" if t.id.isupper() else "variable"
                        self.add(x, t.id, kind, [("type_of", n) for n in _types(x.annotation)] if isinstance(x, ast.AnnAssign) and not alias else [])


def extract_python(path: str, source: str) -> list[tuple]:
    """Rows of SYMBOLS for one document; a document that does not parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = _Collector(path, source)
    found.module_level(tree)
    found.visit(tree)
    return found.rows


#: O-04: extractors by language. A new language is one entry.
EXTRACTORS: dict[str, Callable[[str, str], list[tuple]]] = {"python": extract_python, **brace_extractor.EXTRACTORS}


def extract(files: DataFrame) -> DataFrame:
    """SYMBOLS of files (path, language, content); those without a registered extractor, or not in UTF-8, give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                try:
                    rows += EXTRACTORS[language](path, bytes(content).decode()) if language in EXTRACTORS else []
                except UnicodeDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=_NAMES)

    return files.select("path", "language", "content").mapInPandas(run, SYMBOLS)
