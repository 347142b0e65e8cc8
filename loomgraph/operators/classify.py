"""Reachability classification and what follows from it (O-61, O-96, O-109 to O-123).

A class is held as its rank, 0 the most alive, so that "the most alive of" is a minimum. Passes are joins; the two
fixpoints write their state once per round and stop when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.plans import walk as W
from loomgraph.plans.checkpoint import cut, discard

R = model.RANK


def _plain(path: str) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def entry_files(paths: DataFrame, entries: DataFrame, key: int = 8) -> DataFrame:
    """J-12: (entry_file, file_path) where one of the paths, without a leading ``./``, ends with the other.

    Entry files may be absolute and graph paths relative, or the other way round. Pairs must agree in their last ``key``
    characters, so this is an equi-join; only paths shorter than that are joined by their last character.
    """
    own = paths.select("file_path", _plain("file_path").alias("p")).where("p <> ''").distinct()
    asked = entries.select("entry_file", _plain("entry_file").alias("e")).where("e <> ''").distinct()
    ends = F.col("p").endswith(F.col("e")) | F.col("e").endswith(F.col("p"))
    out = []
    for n, short in ((key, F.least(F.length("p"), F.length("e")) >= key), (1, F.least(F.length("p"), F.length("e")) < key)):
        both = own.withColumn("end", F.right("p", F.lit(n))).join(asked.withColumn("end", F.right("e", F.lit(n))), "end")
        out.append(both.where(short & ends).select("entry_file", "file_path"))
    return out[0].union(out[1])


def files_below(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_file, file_path) where the entry is the file or a directory above it, by joining each path's directories."""
    parts = F.split(_plain("file_path"), "/")
    above = paths.select("file_path").distinct().select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("e"))
    return above.join(entries.select("entry_file", _plain("entry_file").alias("e")).distinct(), "e").select("entry_file", "file_path")


def roots(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """O-109: (role, node) with role production, test or public_api.

    ``entries`` is (kind, file_path): bin, build and bench files, which are matched by suffix (:func:`entry_files`), and lib,
    test and example files or directories. A binary or build file contributes its callables named main, or all its
    symbols if it has none; a bench file all of them. Retain attributes and Go's ``init`` outside tests make production
    roots too.
    """
    at = entries.select(F.col("kind").alias("entry"), F.col("file_path").alias("entry_file")).distinct()
    listed = F.col("entry").isin("bin", "build", "bench")
    found = at.where(listed).join(entry_files(nodes, at.where(listed)), "entry_file").unionByName(at.where(~listed).join(files_below(nodes, at.where(~listed)), "entry_file"))
    here = nodes.join(found, "file_path")
    binary = here.where(F.col("entry").isin("bin", "build"))
    mains = binary.where(P.has_role("kind", "callable") & (P.short_name("symbol_name") == "main"))
    whole = binary.join(mains.select("entry_file").distinct(), "entry_file", "left_anti")
    label = lambda df, role: df.select(F.lit(role).alias("role"), F.col("memory_id").alias("node"))
    kept = nodes.where(F.col("entry_retain").bitwiseAND(7) != 0)
    inits = nodes.where(F.col("file_path").endswith(".go") & ~F.col("file_path").endswith("_test.go") & (P.short_name("symbol_name") == "init") & P.has_role("kind", "callable"))
    tests = nodes.where(F.col("is_test_root") & P.has_role("kind", "callable"))
    api_kind = F.col("kind").isin("function", "struct", "enum", "trait", "type_alias", "module") | (F.col("file_path").endswith(".go") & F.col("kind").isin("const", "static"))
    api = here.where((F.col("entry") == "lib") & (F.col("visibility") == "pub") & api_kind & ~F.coalesce("is_test_only", F.lit(False)))
    parts = [(mains, "production"), (whole.select(mains.columns), "production"), (here.where("entry = 'bench'"), "production"), (kept, "production"), (inits, "production"), (tests, "test"), (here.where("entry in ('test', 'example')"), "test"), (api, "public_api")]
    out = label(*parts[0])
    for part in parts[1:]:
        out = out.union(label(*part))
    return out.distinct()


def reach_sets(nodes: DataFrame, edges: DataFrame, root_rows: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """O-61, O-96: (node, rank) by set algebra: production reach is wired, what only the public API reaches is public_api, what only tests reach is test_only."""
    rank = F.when(F.col("role") == "production", R["wired"]).when(F.col("role") == "public_api", R["public_api"]).when(F.col("role") == "test", R["test_only"])
    return _closures(W.packed_steps(edges, W.CLASSIFIER_CALLS), _test_modules(nodes), root_rows.select(rank.alias("root"), "node").where("root is not null"), population)


def _test_modules(nodes: DataFrame) -> DataFrame:
    return cut(nodes.where(P.is_test_module("is_test_only", "kind", "symbol_name")).select("memory_id").distinct().select(F.col("memory_id").alias("t")), "tests")


def _closures(lists: DataFrame, tests: DataFrame, roots: DataFrame, population: DataFrame | None) -> DataFrame:
    """(node, rank): the least rank whose roots (root: a rank, node) reach a node over ``lists`` (:func:`W.packed_steps`); only tests step from or into test modules (``tests``: t).

    All ranks walk at once: a node's ranks are bits, ``new`` those that came in the last round. A round joins the nodes with
    new bits to their steps, sums the bits by far end and writes the state. Ranks but test_only have the same steps, so the
    least of them stands for all.
    """
    test = 1 << R["test_only"]
    least = lambda bits: bits.bitwiseAND(test).bitwiseOR(bits.bitwiseAND(test - 1).bitwiseAND(-bits.bitwiseAND(test - 1)))
    marked = lambda df: df.join(tests, F.col("node") == F.col("t"), "left").select("node", F.col("t").isNotNull().alias("test"), "got")
    own = roots.where("node is not null").groupBy("node").agg(F.bit_or(F.expr("shiftleft(1, root)")).alias("got"))
    if population is not None:
        own = own.join(population.select("node"), "node", "left_semi")
    now = cut(marked(own).select("node", "test", least(F.col("got")).alias("bits"), least(F.col("got")).alias("new")), "reach")
    ahead = F.when(F.col("test"), F.col("new").bitwiseAND(test)).otherwise(F.col("new"))
    while True:
        front = now.select(F.col("node").alias("from"), ahead.alias("ahead")).where("ahead <> 0")
        if not front.take(1):
            break
        found = front.join(lists, "from").select(F.explode("to").alias("node"), "ahead").groupBy("node").agg(F.bit_or("ahead").alias("got"))
        if population is not None:
            found = found.join(population.select("node"), "node", "left_semi")
        found = marked(found).select("node", F.col("test").alias("far"), F.when(F.col("test"), F.col("got").bitwiseAND(test)).otherwise(F.col("got")).alias("got")).where("got <> 0")
        both = now.select("node", "test", "bits").join(found, "node", "full").select("node", F.coalesce("test", "far").alias("test"), F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("got", F.lit(0)).alias("got"))
        after = least(F.col("bits").bitwiseOR(F.col("got")))
        last, now = now, cut(both.select("node", "test", after.alias("bits"), after.bitwiseAND(F.bitwise_not("bits")).alias("new")), "reach")
        discard(last)
    rank = F.coalesce(*[F.when(F.col("bits").bitwiseAND(1 << r) != 0, F.lit(r)) for r in range(R["test_only"] + 1)])
    return now.select("node", rank.alias("rank"))


def _ranked(state: DataFrame, id_name: str, rank_name: str) -> DataFrame:
    return state.select(F.col("node").alias(id_name), F.col("rank").alias(rank_name))


def structural_kinds(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Pass 5: dead declarations in a file with wired or public code are structural."""
    info = state.join(nodes.select(F.col("memory_id").alias("node"), "file_path", "kind"), "node")
    alive = info.where(F.col("rank") <= R["public_api"]).select(F.col("file_path").alias("alive_file")).distinct()
    hit = (F.col("rank") == R["dead"]) & F.col("kind").isin(model.STRUCTURAL_KINDS) & F.col("alive_file").isNotNull()
    return info.join(alive, F.col("file_path") == F.col("alive_file"), "left").select("node", F.when(hit, F.lit(R["structural"])).otherwise(F.col("rank")).alias("rank"))


def field_parents(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Pass 6, O-114: a dead data member is structural if some prefix of its name is an alive container's name."""
    info = state.join(nodes.select(F.col("memory_id").alias("node"), "symbol_name", "kind"), "node")
    alive = info.where((F.col("rank") <= R["structural"]) & P.has_role("kind", "field_container")).select(F.col("symbol_name").alias("prefix")).distinct()
    parts = F.split("symbol_name", "::")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))
    members = info.where((F.col("rank") == R["dead"]) & P.has_role("kind", "data_member") & (F.size(parts) > 1))
    saved = members.select("node", F.explode(prefixes).alias("prefix")).join(alive, "prefix", "left_semi").select(F.col("node").alias("saved")).distinct()
    return state.join(saved, F.col("node") == F.col("saved"), "left").select("node", F.when(F.col("saved").isNotNull(), F.lit(R["structural"])).otherwise(F.col("rank")).alias("rank"))


def real_callers(edges: DataFrame, reached: DataFrame, asked: DataFrame, population: DataFrame) -> DataFrame:
    """O-112: nodes of ``asked`` with a calls or references edge from the classified population, or a call-class edge from another reached node."""
    asked = cut(asked.select(F.col("node").alias("dst")), "asked")
    own = cut(edges.where(P.admits("call", "kind")).where("src <> dst").select("src", "dst", "kind").join(asked, "dst", "left_semi"), "callers")
    direct = own.where(F.col("kind").isin("calls", "references")).join(population.select(F.col("node").alias("src")), "src", "left_semi")
    near = own.join(reached.select(F.col("node").alias("src")), "src", "left_semi")
    return direct.select(F.col("dst").alias("node")).union(near.select(F.col("dst").alias("node"))).distinct()


def _tier(rank: Column) -> Column:
    """What a rescuer passes on: its own class if wired or test_only, public_api for public and structural ones, else nothing."""
    return F.when(rank.isin(R["wired"], R["test_only"]), rank).when(rank.isin(R["public_api"], R["structural"]), F.lit(R["public_api"]))


def guard_tiers(nodes: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """O-111: (node, tier) for dead callables that an alive abstraction, owner or implementation holds; the most alive rescuer counts.

    The order of edges decides between rescuers elsewhere; here the minimum does, so the result does not depend on it.
    """
    info = nodes.select(F.col("memory_id").alias("id"), "kind", P.is_test_module("is_test_only", "kind", "symbol_name").alias("test"))
    kind = lambda name: info.select(F.col("id").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("test").alias(f"{name}_test"))
    holds = edges.where("kind = 'contains'").select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    implements = edges.where("kind = 'implements'").select(F.col("src").alias("parent"), F.col("dst").alias("rescuer"))
    dead = state.where(F.col("rank") == R["dead"]).select(F.col("node").alias("child"))
    held = holds.join(dead, "child", "left_semi").join(kind("child"), "child").where(P.has_role("child_kind", "callable")).join(kind("parent"), "parent")
    base = held.select("child", "parent", "parent_kind", (F.col("child_test") | F.col("parent_test")).alias("test"))
    own = base.where(F.col("parent_kind").isin("trait", "struct", "enum")).select("child", "test", F.col("parent").alias("rescuer"))
    by_trait = base.where(F.col("parent_kind").isin("impl", "struct", "enum")).join(implements, "parent").select("child", "test", "rescuer")
    owners = holds.select(F.col("child").alias("parent"), F.col("parent").alias("rescuer")).join(kind("rescuer"), "rescuer").where(P.has_role("rescuer_kind", "concrete_type"))
    by_owner = base.where("parent_kind = 'impl'").join(owners, "parent").select("child", "test", "rescuer")
    all_ways = own.union(by_trait).union(by_owner).join(_ranked(state, "rescuer", "r"), "rescuer").withColumn("tier", _tier(F.col("r"))).where("tier is not null")
    capped = F.when(F.col("test"), F.greatest("tier", F.lit(R["test_only"]))).otherwise(F.col("tier"))
    return all_ways.groupBy(F.col("child").alias("node")).agg(F.min(capped).alias("tier"))


def guard_rescue(nodes: DataFrame, edges: DataFrame, state: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Pass 8: rescued callables seed their tier's closure again; dead and rescued nodes take better tiers until nothing changes."""
    lists = tests = None
    now = cut(state.select("node", "rank", F.lit(False).alias("folded")), "rescue")
    while True:
        found = cut(guard_tiers(nodes, edges, now), "rescue")
        if not found.take(1):
            return now.select("node", "rank")
        if lists is None:
            lists, tests = W.packed_steps(edges, W.CLASSIFIER_CALLS), _test_modules(nodes)
        spread = _closures(lists, tests, found.select(F.col("tier").alias("root"), "node"), population).select("node", F.col("rank").alias("tier"))
        best = found.select("node", "tier").union(spread).groupBy("node").agg(F.min("tier").alias("tier"))
        better = ((F.col("rank") == R["dead"]) | F.col("folded")) & (F.col("tier") < F.col("rank"))
        now = cut(now.join(best, "node", "left").select("node", F.when(better, F.col("tier")).otherwise(F.col("rank")).alias("rank"), (F.col("folded") | F.coalesce(better, F.lit(False))).alias("folded")), "rescue")


def abstract_rules(nodes: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """Pass 9, O-113: nodes that become structural: trait methods overridden by an alive one, abstract ones of a trait with an alive implementation, and impls of marker traits on alive types."""
    alive = state.where(F.col("rank") <= R["test_only"]).select("node")
    dead = state.where(F.col("rank") == R["dead"]).select("node")
    info = nodes.select("memory_id", "kind", P.short_name("symbol_name").alias("short"), "has_body")
    of = lambda name: info.select(F.col("memory_id").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("short").alias(f"{name}_short"), F.col("has_body").alias(f"{name}_body"))
    holds = edges.where("kind = 'contains'").select(F.col("src").alias("holder"), F.col("dst").alias("held"))
    implements = edges.where("kind = 'implements'").select(F.col("src").alias("impl"), F.col("dst").alias("trait"))
    alive_children = holds.select(F.col("holder").alias("impl"), F.col("held").alias("child")).join(of("child"), "child").where(P.has_role("child_kind", "callable")).join(alive.select(F.col("node").alias("child")), "child", "left_semi")
    by_trait = implements.join(alive_children, "impl").select("trait", "child_short").distinct()
    methods = holds.select(F.col("holder").alias("trait"), F.col("held").alias("method")).join(of("trait"), "trait").where("trait_kind = 'trait'").join(of("method"), "method").where("method_kind = 'function'")
    methods = methods.join(dead.select(F.col("node").alias("method")), "method", "left_semi").select("trait", "method", "method_short", "method_body")
    saved = methods.join(by_trait, "trait").where((F.col("method_short") == F.col("child_short")) | F.coalesce(~F.col("method_body"), F.lit(False))).select(F.col("method").alias("node"))
    callable_traits = holds.select(F.col("holder").alias("trait"), F.col("held").alias("child")).join(of("child"), "child").where(P.has_role("child_kind", "callable")).select("trait").distinct()
    outside = nodes.where("file_path = '<external>'").select(F.col("memory_id").alias("trait"), P.short_name("symbol_name").alias("s"))
    markers = implements.join(callable_traits, "trait", "left_anti").join(outside, "trait", "left").where(F.col("s").isNull() | F.col("s").isin(model.MARKER_TRAITS))
    owners = holds.select(F.col("held").alias("impl"), F.col("holder").alias("owner")).join(alive.select(F.col("node").alias("owner")), "owner", "left_semi")
    impls = markers.join(owners, "impl").join(of("impl"), "impl").where("impl_kind = 'impl'").join(dead.select(F.col("node").alias("impl")), "impl", "left_semi").select(F.col("impl").alias("node"))
    return saved.union(impls).distinct()


def container_rollup(nodes: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """Pass 11: a dead or suspected impl, trait or module takes the most alive class of what it contains, until nothing changes."""
    containers = nodes.where(F.col("kind").isin("impl", "trait", "module")).select(F.col("memory_id").alias("holder"))
    holds = cut(edges.where("kind = 'contains'").select(F.col("src").alias("holder"), F.col("dst").alias("held")).join(containers, "holder", "left_semi"), "holds")
    now = cut(state.select("node", "rank"), "rollup")
    while True:
        alive = _ranked(now.where(F.col("rank") <= R["test_only"]), "held", "r")
        tier = holds.join(alive, "held").groupBy(F.col("holder").alias("of")).agg(F.min("r").alias("tier"))
        hit = F.col("rank").isin(R["dead"], R["suspected"]) & F.col("tier").isNotNull()
        after = cut(now.join(tier, F.col("node") == F.col("of"), "left").select("node", F.when(hit, F.col("tier")).otherwise(F.col("rank")).alias("rank"), F.coalesce(hit, F.lit(False)).alias("hit")), "rollup")
        if not after.where("hit").take(1):
            return after.select("node", "rank")
        now = after.select("node", "rank")


def classify(nodes: DataFrame, edges: DataFrame, root_rows: DataFrame, population: DataFrame | None = None, excluded: Column | None = None) -> DataFrame:
    """O-110: (memory_id, reachability_class) by the passes in their fixed order.

    ``population`` (node) are the nodes that are classified at all; others are unclassified. ``excluded`` is a condition on
    nodes that the census leaves out (default: O-115).
    """
    # Read many times below; no pass reads edges of other kinds.
    edges = edges.where(F.col("kind").isin(*model.ADMISSION["call"], "contains", "implements")).select("src", "dst", "kind")
    nodes, edges, root_rows = cut(nodes, "nodes"), cut(edges, "edges"), cut(root_rows, "roots")
    everyone = nodes.select(F.col("memory_id").alias("node"))
    people = everyone if population is None else everyone.join(population, "node", "left_semi")
    reached = cut(reach_sets(nodes, edges, root_rows, None if population is None else people), "reached")
    state = people.join(reached, "node", "left").select("node", F.coalesce("rank", F.lit(R["dead"])).alias("rank"))
    state = cut(field_parents(nodes, cut(structural_kinds(nodes, cut(state, "state")), "state")), "state")
    api = root_rows.where("role = 'public_api'").select("node").join(state.where(F.col("rank") == R["public_api"]), "node", "left_semi")
    doubted = api.join(real_callers(edges, reached, api, people), "node", "left_anti").select(F.col("node").alias("doubt"))
    state = state.join(doubted, F.col("node") == F.col("doubt"), "left").select("node", F.when(F.col("doubt").isNotNull(), F.lit(R["suspected"])).otherwise(F.col("rank")).alias("rank"))
    state = guard_rescue(nodes, edges, cut(state, "state"), None if population is None else people)
    saved = abstract_rules(nodes, edges, state).select(F.col("node").alias("saved"))
    state = state.join(saved, F.col("node") == F.col("saved"), "left").select("node", F.when(F.col("saved").isNotNull(), F.lit(R["structural"])).otherwise(F.col("rank")).alias("rank"))
    seen = nodes.select(F.col("memory_id").alias("node"), P.deletable("visibility").alias("hidden"))
    state = state.join(seen, "node").select("node", F.when((F.col("rank") == R["dead"]) & ~F.col("hidden"), F.lit(R["suspected"])).otherwise(F.col("rank")).alias("rank"))
    state = container_rollup(nodes, edges, state)
    out = P.is_excluded_path("file_path") if excluded is None else excluded
    marked = nodes.select(F.col("memory_id"), out.alias("out")).join(state, F.col("memory_id") == F.col("node"), "left")
    rank = F.when(F.col("node").isNull(), F.lit(R["unclassified"])).when(F.col("out"), F.lit(R["excluded"])).otherwise(F.col("rank"))
    return marked.select("memory_id", P.class_label(rank).alias("reachability_class"))


def orphan_files(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """O-116: Rust files below a source root without any symbol."""
    own = files.where(F.col("path").endswith(".rs") & F.col("path").rlike("^(src|crates/[^/]+/src)/"))
    return own.join(nodes.select(F.col("file_path").alias("path")), "path", "left_anti").select("path")


def callable_verdicts(nodes: DataFrame, production: DataFrame, tests: DataFrame, complete: bool) -> DataFrame:
    """O-117: (memory_id, verdict): live_production, live_test, retained_test, unreached when the evidence is complete, else unknown; other kinds by their class."""
    code = P.has_role("kind", "callable")
    joined = nodes.join(production.select(F.col("node").alias("p")).distinct(), F.col("memory_id") == F.col("p"), "left").join(tests.select(F.col("node").alias("q")).distinct(), F.col("memory_id") == F.col("q"), "left")
    own = (
        F.when(F.col("p").isNotNull(), F.lit("live_production"))
        .when(F.col("q").isNotNull(), F.lit("live_test"))
        .when(F.coalesce("is_test_only", F.lit(False)), F.lit("retained_test"))
        .otherwise(F.lit("unreached" if complete else "unknown"))
    )
    kept = F.when(F.col("reachability_class").isin("dead", "orphan"), F.lit("structural_candidate")).when(F.col("reachability_class").isin("unclassified", "suspected"), F.lit("unknown")).otherwise(F.lit("live"))
    return joined.select("memory_id", F.when(code, own).otherwise(kept).alias("verdict"))


def dead_candidates(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """O-118: definitions with a verdict that calls for attention, in path order."""
    own = nodes.where(P.has_role("kind", "definition")).join(verdicts.where(F.col("verdict").isin("unreached", "structural_candidate", "unknown")), "memory_id")
    return own.select("file_path", "symbol_name", "kind", "memory_id", "verdict").orderBy("file_path", "symbol_name", "kind", "memory_id")


def dead_summary(verdicts: DataFrame) -> DataFrame:
    """O-82: observed, candidates, unreached, structural, unknown in one row."""
    is_ = lambda *x: F.count_if(F.col("verdict").isin(*x))
    return verdicts.agg(
        F.count(F.lit(1)).alias("observed"), is_("unreached", "structural_candidate", "unknown").alias("candidates"), is_("unreached").alias("unreached"), is_("structural_candidate").alias("structural"), is_("unknown").alias("unknown")
    )


def dead_actions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-119, O-120: (memory_id, action, cause) for dead and suspected nodes.

    An alive user means needs_review, a test user or test directory test_only. safe_delete needs a dead class, the compiler's
    word, a hidden symbol, a crate without platform conditions and no retain attribute; it is withdrawn, to the greatest
    fixpoint, from nodes that a node which is not safe implements or contains. ``cause`` is the first condition that fails.
    """
    info = nodes.withColumn("crate", F.coalesce(P.crate_name("file_path"), F.lit("")))
    conditional = info.groupBy("crate").agg(F.bool_or("has_platform_cfg").alias("crate_cfg"))
    uses = edges.where(F.col("kind").isin("calls", "references", "type_of", "field_of", "implements", "extends", "has_impl")).select("src", F.col("dst").alias("memory_id"))
    by = uses.join(nodes.select(F.col("memory_id").alias("src"), F.col("reachability_class").alias("user")), "src").groupBy("memory_id").agg(
        F.bool_or(~F.col("user").isin("dead", "orphan", "unclassified", "test_only")).alias("alive_user"), F.bool_or(F.col("user") == "test_only").alias("test_user")
    )
    own = info.where(F.col("reachability_class").isin("dead", "suspected")).join(conditional, "crate").join(by, "memory_id", "left")
    alive, test = F.coalesce("alive_user", F.lit(False)), F.coalesce("test_user", F.lit(False))
    cause = (
        F.when(alive, F.lit("alive_dependent"))
        .when(test, F.lit("test_dependent"))
        .when(P.under_test_dir("file_path"), F.lit("test_directory"))
        .when(F.col("reachability_class") != "dead", F.lit("not_dead"))
        .when(~F.col("rustc_flagged_dead"), F.lit("not_confirmed"))
        .when(~P.deletable("visibility"), F.lit("visible"))
        .when(F.col("crate_cfg"), F.lit("platform_condition"))
        .when(F.col("entry_retain").bitwiseAND(15) != 0, F.lit("retained"))
    )
    action = F.when(F.col("cause").isNull(), F.lit("safe_delete")).when(F.col("cause").isin("test_dependent", "test_directory"), F.lit("test_only")).otherwise(F.lit("needs_review"))
    now = cut(own.select("memory_id", cause.alias("cause")).withColumn("action", action), "actions")
    blocks = edges.where(F.col("kind").isin("implements", "has_impl", "contains")).select(F.col("src").alias("by"), F.col("dst").alias("memory_id")).where("by <> memory_id")
    blocks = cut(blocks.join(now.where("action = 'safe_delete'").select("memory_id"), "memory_id", "left_semi"), "blocks")
    while True:
        safe = now.where("action = 'safe_delete'").select(F.col("memory_id").alias("by"))
        struck = blocks.join(now.where("action = 'safe_delete'").select("memory_id"), "memory_id", "left_semi").join(safe, "by", "left_anti").select(F.col("memory_id").alias("struck")).distinct()
        if not struck.take(1):
            return now.select("memory_id", "action", "cause")
        hit = F.col("struck").isNotNull()
        now = cut(
            now.join(struck, F.col("memory_id") == F.col("struck"), "left").select(
                "memory_id", F.when(hit, F.lit("unsafe_container")).otherwise(F.col("cause")).alias("cause"), F.when(hit, F.lit("needs_review")).otherwise(F.col("action")).alias("action")
            ),
            "actions",
        )


def dead_reasons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O-121: (memory_id, reason, parent) for dead nodes: dead_parent, no_incoming, tests_only or no_path; of several dead parents the least name is given."""
    own = nodes.where("reachability_class = 'dead'").select("memory_id")
    users = edges.select("src", F.col("dst").alias("memory_id"), F.col("kind").alias("edge")).join(nodes.select(F.col("memory_id").alias("src"), F.col("reachability_class").alias("user"), P.short_name("symbol_name").alias("short")), "src")
    depends = P.admits("dependency", "edge") & ~F.col("edge").isin("contains")
    facts = users.groupBy("memory_id").agg(
        F.min(F.when((F.col("edge") == "contains") & F.col("user").isin("dead", "orphan"), F.col("short"))).alias("parent"),
        F.count_if(depends).alias("callers"),
        F.count_if(depends & (F.col("user") == "test_only")).alias("test_callers"),
    )
    reason = (
        F.when(F.col("parent").isNotNull(), F.lit("dead_parent"))
        .when(F.coalesce("callers", F.lit(0)) == 0, F.lit("no_incoming"))
        .when(F.col("callers") == F.col("test_callers"), F.lit("tests_only"))
        .otherwise(F.lit("no_path"))
    )
    return own.join(facts, "memory_id", "left").select("memory_id", reason.alias("reason"), "parent")


def suppress(actions: DataFrame, nodes: DataFrame, tier: str, suppressed: list[str]) -> DataFrame:
    """O-122: without classification or with an unusable tier every action is unknown; suppressed languages are left out."""
    unclassified = nodes.agg(F.bool_and(F.col("reachability_class") == "unclassified").alias("none"))
    kept = actions.join(nodes.select("memory_id", P.language("file_path").alias("lang")), "memory_id").where(~F.coalesce(F.col("lang").isin(suppressed), F.lit(False))).drop("lang")
    unusable = F.lit(tier in ("unavailable", "degenerate")) | F.col("none")
    return kept.join(F.broadcast(unclassified)).withColumn("action", F.when(unusable, F.lit("unknown")).otherwise(F.col("action"))).drop("none")


def apply_oracle(nodes: DataFrame, diagnostics: DataFrame, good: bool) -> DataFrame:
    """O-123, J-11: nodes with the compiler's flag set where a diagnostic (file_name, line from 1, subject) names exactly one symbol on its line.

    A good run replaces all flags; a degraded one keeps those that are set. Symbols are counted by line before they meet
    diagnostics, so a line with many of both costs no pairs.
    """
    sole = nodes.groupBy("file_path", "line_start").agg(F.count(F.lit(1)).alias("n"), F.first("memory_id").alias("flagged"), F.first("symbol_name").alias("name")).where("n = 1")
    at = diagnostics.select(F.col("file_name").alias("file_path"), (F.col("line") - 1).alias("line_start"), "subject").distinct()
    named = at.join(sole, ["file_path", "line_start"]).where(F.col("subject").isNull() | (F.col("subject") == P.short_name("name")))
    flagged = named.select("flagged").distinct()
    mark = F.col("flagged").isNotNull() | (F.lit(not good) & F.col("rustc_flagged_dead"))
    return nodes.join(flagged, F.col("memory_id") == F.col("flagged"), "left").withColumn("rustc_flagged_dead", mark).drop("flagged")
