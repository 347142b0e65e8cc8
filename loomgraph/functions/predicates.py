"""Column expressions: roles, admission, paths, names, scopes and relations (O-23 to O-44, O-79, O-80)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import model


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_role(kind: Column | str, role: str) -> Column:
    """O-23. Unknown kinds are definitions and nothing else."""
    return ~col(kind).isin(model.NOT_DEFINITIONS) if role == "definition" else col(kind).isin(model.ROLES[role])


def executable(kind: Column | str, has_body: Column | str) -> Column:
    """A callable that owns code: a known body, and not a mere callable value."""
    return F.coalesce(col(has_body), F.lit(False)) & (col(kind) != "callable_value") & has_role(kind, "callable")


def filter_admits(name: str, label: Column | str) -> Column:
    """O-25. ``live`` is everything but dead and orphan: suspected, unclassified and excluded count as live."""
    gone = col(label).isin("dead", "orphan")
    return {"all": F.lit(True), "live": ~gone, "dead": gone, "test_only": col(label) == "test_only"}[name]


def reverse_filter(name: str, label: Column | str) -> Column:
    """O-26, applied to a finished reverse walk. Unclassified passes all but ``dead``."""
    kinds = {"wired": ["wired", "public_api", "structural"], "dead": ["dead", "orphan"], "test_only": ["test_only"], "all": model.CLASSES}[name]
    return col(label).isin(kinds if name == "dead" else [*kinds, "unclassified"])


def admits(admission: str, kind: Column | str) -> Column:
    """O-27."""
    return col(kind).isin(model.ADMISSION[admission])


def is_test_file(path: Column | str) -> Column:
    """O-29: a ``tests`` component, or a base name test_*, *_test.rs or *_tests.rs."""
    base = F.substring_index(col(path), "/", -1)
    return F.array_contains(F.split(col(path), "/"), "tests") | base.startswith("test_") | base.endswith("_test.rs") | base.endswith("_tests.rs")


def node_is_test(is_test_only: Column | str, path: Column | str) -> Column:
    """O-30: what the syntax says, else what the path says."""
    return F.coalesce(col(is_test_only), is_test_file(path))


def is_test_module(is_test_only: Column | str, kind: Column | str, name: Column | str) -> Column:
    """O-31: what the syntax says, else a module named tests or a name inside one."""
    n = col(name)
    return F.coalesce(col(is_test_only), ((col(kind) == "module") & (n == "tests")) | n.startswith("tests::") | n.contains("::tests::"))


def extension(path: Column | str) -> Column:
    """The text after the base name's last dot, or null."""
    return F.nullif(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1), F.lit(""))


def language(path: Column | str) -> Column:
    """O-03: the language registered for the extension, or null."""
    names = F.create_map(*[F.lit(x) for kv in model.LANGUAGES.items() for x in kv])
    return F.try_element_at(names, F.coalesce(extension(path), F.lit("")))


def source_path_is_test(path: Column | str) -> Column:
    """O-32: each language's own rule; unregistered extensions are never tests."""
    p, base = col(path), F.substring_index(col(path), "/", -1)
    inside = F.array_contains(F.split(p, "/"), "tests")
    lang = language(path)
    return F.coalesce(
        F.when(lang == "rust", is_test_file(path))
        .when(lang == "go", p.endswith("_test.go"))
        .when(lang == "python", inside | base.startswith("test_") | base.rlike(r"_test\.pyi?$") | (base == "conftest.py"))
        .when(lang == "typescript", base.rlike(r"\.(test|spec|e2e|stories)\.[cm]?[jt]sx?$") | p.rlike("(^|/)__tests__/")),
        F.lit(False),
    )


def deletable(visibility: Column | str) -> Column:
    """O-33: known not to be visible outside; the empty label proves nothing."""
    return col(visibility).isin("private", "pub(crate)", "pub(super)") | col(visibility).startswith("pub(in ")


def is_generated(path: Column | str) -> Column:
    """O-34: components target, build and out, in this order."""
    return col(path).rlike("(^|/)target/(.*/)?build/(.*/)?out(/|$)")


def under_test_dir(path: Column | str) -> Column:
    """O-35."""
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*[F.lit(x) for x in ("tests", "examples", "benches")]))


def crate_name(path: Column | str) -> Column:
    """O-36: the component after a leading ``crates``, or null."""
    return F.nullif(F.regexp_extract(col(path), "^crates/([^/]+)/", 1), F.lit(""))


def short_name(name: Column | str) -> Column:
    """O-37: the last segment of a qualified name."""
    return F.substring_index(col(name), "::", -1)


def relationship_scope(scope: Column | str, src_is_test: Column | str) -> Column:
    """O-38."""
    return (
        F.when((col(scope) == "Test") | F.coalesce(col(src_is_test), F.lit(False)), F.lit("tests"))
        .when(col(scope) == "CfgGated", F.lit("conditional"))
        .otherwise(F.lit("production"))
    )


def mapped(kind: Column | str, table: dict[str, str]) -> Column:
    """A label from a small closed table, or null: O-39 (dependencies) and O-40 (impact)."""
    out = None
    for k, v in table.items():
        out = F.when(col(kind) == k, F.lit(v)) if out is None else out.when(col(kind) == k, F.lit(v))
    return out


def visibility_label(visibility: Column | str, signature: Column | str) -> Column:
    """O-41: the node's own label in normal form, else what the signature starts with."""
    v, s = col(visibility), col(signature)
    return (
        F.when(v == "Public", F.lit("pub"))
        .when(v == "CrateVisible", F.lit("pub(crate)"))
        .when(v == "Private", F.lit("private"))
        .when(v != "", F.lower(v))
        .when(s.startswith("pub(crate) "), F.lit("pub(crate)"))
        .when(s.startswith("pub(super) "), F.lit("pub(super)"))
        .when(s.startswith("pub "), F.lit("pub"))
        .otherwise(F.lit("private"))
    )


def overview_bucket(label: Column | str) -> Column:
    """O-44."""
    c = col(label)
    return (
        F.when(c.isin("wired", "public_api", "structural"), F.lit("alive"))
        .when(c.isin("dead", "orphan"), F.lit("dead"))
        .when(c == "test_only", F.lit("test"))
        .otherwise(c)
    )


def action_tier(label: Column | str) -> Column:
    """What a class advises: alive code is preserved, dead and suspected code reviewed, the rest unknown."""
    c = col(label)
    return (
        F.when(c.isin("wired", "public_api", "structural", "test_only"), F.lit("PRESERVE"))
        .when(c.isin("dead", "orphan", "suspected"), F.lit("REVIEW"))
        .otherwise(F.lit("UNKNOWN"))
    )


def class_rank(label: Column | str) -> Column:
    return mapped(label, {c: str(i) for c, i in model.RANK.items()}).cast("int")


def class_label(rank: Column | str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in model.CLASSES]), col(rank))


def coverage_tier(callables: Column, nodes: Column, authority: Column) -> Column:
    """O-79."""
    return (
        F.when((callables == 0) & (nodes == 0), F.lit("degenerate"))
        .when(callables == 0, F.lit("not_applicable"))
        .when(~authority, F.lit("unavailable"))
        .otherwise(F.lit("sufficient"))
    )


def aggregate_status(status: Column | str) -> Column:
    """O-80, an aggregate over the statuses of a group."""
    s = col(status)
    every = lambda *x: F.coalesce(F.bool_and(s.isin(*x)), F.lit(True))
    return (
        F.when(F.count(s) == 0, F.lit("not_applicable"))
        .when(every("complete"), F.lit("complete"))
        .when(every("complete", "qualified"), F.lit("qualified"))
        .when(every("unavailable"), F.lit("unavailable"))
        .otherwise(F.lit("partial"))
    )


def is_excluded_path(path: Column | str) -> Column:
    """O-115: a component that the census leaves out."""
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*[F.lit(x) for x in model.EXCLUDED_DIRS]))


def glob_regex(pattern: str) -> str:
    """O-49a for patterns with ``*``: anchored, case-insensitive, other signs literal."""
    return "(?is)^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in pattern.split("*")) + "$"


def glob_match(name: Column | str, pattern: str) -> Column:
    """O-49a: without ``*`` case-sensitive equality, else a case-insensitive match of the whole name."""
    return col(name).rlike(glob_regex(pattern)) if "*" in pattern else col(name) == pattern
