"""Operators on hand-made graphs, against plain Python, and across verbs."""

from __future__ import annotations

import collections
import itertools
import random
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.errors import SymbolAmbiguous, SymbolNotFound
from loomgraph.functions import predicates as P
from loomgraph.functions import source_text as S
from loomgraph.operators import build, changes, classify, enrich, evidence, grep, rollup, search
from loomgraph.plans import blocks, checkpoint, walk
from loomgraph.queries import base
from loomgraph.verbs import RECEIPTS, Graph

from graphs import consistency, edge, frames, node


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def graph(spark):
    return consistency(spark)


def test_stats_closure_and_dependents_of_the_consistency_graph(spark, graph):
    nodes, edges = graph
    assert as_map(rollup.graph_stats(nodes, edges), "metric", "n") == {"nodes": 11, "edges": 8, "kind:calls": 6, "kind:contains": 2}
    out = walk.walk(walk.steps(edges, walk.REACHABLE_OUT), roots(spark, "main"))
    assert as_map(out, "node", "depth") == {"main": 0, "handler": 1, "helper": 2, "MyStruct::new": 2, "util": 3}
    assert as_map(walk.dependents(nodes, edges, roots(spark, "util"), 3), "node", "depth") == {"helper": 1, "handler": 2, "test_helper": 2, "main": 3, "test_handler": 3}
    assert set(as_map(walk.dependents(nodes, edges, roots(spark, "util"), 2), "node", "depth")) == {"helper", "handler", "test_helper"}


def test_fan_in_deps_members_and_suggestions(spark, graph):
    nodes, edges = graph
    assert as_map(rollup.fan_in_breakdown(nodes, edges), "memory_id", "all") == {"handler": 2, "helper": 2, "util": 1, "MyStruct::new": 1}
    scope = spark.createDataFrame([("crates/app/src/helper.rs",)], "file_path string")
    got = {(r.file, r.direction, r.relation, r.n) for r in rollup.dependencies(nodes, edges, scope).collect()}
    assert got == {("crates/app/src/util.rs", "dependency", "call", 1), ("crates/app/src/handler.rs", "dependent", "call", 1), ("crates/app/tests/test_helper.rs", "dependent", "call", 1)}
    members = rollup.type_members(nodes, edges, spark.createDataFrame([("MyStruct",)], "type_id string"))
    assert {(r.role, r.member_id) for r in members.collect()} == {("public_method", "MyStruct::new"), ("private_method", "MyStruct::process")}
    assert [tuple(r) for r in search.suggestions(nodes, "hlper").collect()][0] == ("helper", 1)


def test_verbs_agree_with_each_other(spark, graph):
    nodes, edges = graph
    receipts = spark.createDataFrame([("p", "1", "calls", "d", "rust", "repository", None, "complete")], RECEIPTS)
    g = Graph(spark, {"nodes": nodes, "edges": edges, "receipts": receipts, "inventory": spark.createDataFrame([("rust", "u")], "language string, unit string")})
    tests = g.tests("helper")
    assert {r.node: tuple(r.chain) for r in tests.rows.collect()} == {"test_helper": ("helper", "test_helper"), "test_handler": ("helper", "handler", "test_handler")}
    assert g.assess("helper").evidence["signals"]["tests"] == tests.evidence["population"] == 2
    assert g.inspect("MyStruct")["structure"]["result"].evidence["population"] == g.type("MyStruct").evidence["population"] == 2
    assert g.calls("handler", "all").evidence["population"] == 2 and {r.symbol_name for r in g.calls("handler", "test_only").rows.collect()} == {"test_handler"}
    assert g.find("hlper").evidence["suggestions"] == ["helper"] and g.is_wired("main") == "wired" and g.signature("util") == "function util"
    assert g.resolve(g.selector("util"))["memory_id"] == "util"
    with pytest.raises(SymbolNotFound):
        Graph(spark, g.tables, "other generation").resolve(g.selector("util"))
    dead = g.dead()
    assert dead.status == "complete" and {r.symbol_name for r in dead.rows.collect()} == {"dead_fn", "orphan_fn", "MyStruct::process"}


def test_without_evidence_unreached_is_unknown(spark, graph):
    nodes, edges = graph
    dead = Graph(spark, {"nodes": nodes, "edges": edges}).dead()
    assert dead.status == "qualified" and dead.evidence["summary"]["unreached"] == 0 and dead.evidence["summary"]["unknown"] == 3


def test_pages_concatenate_to_the_whole(spark, graph):
    g = Graph(spark, {"nodes": graph[0], "edges": graph[1]})
    whole, cursor, got = [r.symbol_name for r in g.find("*", limit=100).rows.collect()], None, []
    for _ in range(20):
        page = g.find("*", limit=3, cursor=cursor)
        got += [r.symbol_name for r in page.rows.collect()]
        if not (cursor := page.page["next_cursor"]):
            break
    assert got == whole and len(got) == 11


def test_empty_graph(spark):
    nodes, edges = frames(spark, [], [])
    g = Graph(spark, {"nodes": nodes, "edges": edges})
    assert g.find("x").evidence["population"] == 0 and g.audit().evidence["population"] == 0 and g.dead().evidence["population"] == 0
    assert rollup.class_summary(nodes).head().total == 0 and classify.classify(nodes, edges, spark.createDataFrame([], "role string, node string")).count() == 0


def bfs(pairs, root, depth=None):
    seen, todo = {root: 0}, collections.deque([root])
    while todo:
        x = todo.popleft()
        if depth is not None and seen[x] >= depth:
            continue
        for a, b in pairs:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16), st.integers(0, 3))
def test_walks_match_breadth_first_search(spark, links, depth):
    pairs = [(f"n{a}", f"n{b}") for a, b in links]
    frame = spark.createDataFrame(pairs, "from string, to string")
    got = {(r.root, r.node): r.depth for r in walk.walk(frame.repartition(3), roots(spark, "n0", "n1"), depth).collect()}
    assert got == {(r, n): d for r in ("n0", "n1") for n, d in bfs(pairs, r, depth).items()}


def test_walk_handles_cycles_terminals_targets_and_confinement(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), (None, "x"), ("d", None)], "from string, to string")
    one = lambda **k: as_map(walk.walk(frame, roots(spark, "a"), **k), "node", "depth")
    assert one() == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert one(stop_at=spark.createDataFrame([("b",)], "node string")) == {"a": 0, "b": 1}
    assert one(within=spark.createDataFrame([("b",), ("d",)], "node string")) == {"a": 0, "b": 1}
    assert one(target=spark.createDataFrame([("a", "b")], "root string, node string")) == {"a": 0, "b": 1}


def test_deep_walks_compact_what_they_saw(spark, monkeypatch):
    monkeypatch.setattr(walk, "_COMPACT", 2)
    pairs = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)] + [("6", "2"), (None, "1"), ("1", None)], "from string, to string")
    got = {(r.root, r.node): r.depth for r in walk.walk(pairs, roots(spark, "0", "4")).collect()}
    assert got == {("0", str(i)): i for i in range(7)} | {("4", n): d for n, d in (("4", 0), ("5", 1), ("6", 2), ("2", 3), ("3", 4))}


def test_only_tests_step_into_test_modules(spark):
    n, e = frames(spark, [node("a"), node("b"), node("m", "module", name="tests", is_test_only=True), node("c"), node("t")], [edge("a", "b"), edge("a", "m"), edge("m", "c"), edge("t", "m")])
    own = spark.createDataFrame([("production", "a"), ("test", "t"), ("other", "c")], "role string, node string")
    got = {r.node: r.rank for r in classify.reach_sets(n, e, own).collect()}
    production, test = (dict.fromkeys(walk.reach(walk.steps(e, spec, n), own.where(f"role = '{role}'")).toPandas()["node"]) for spec, role in ((walk.CLASSIFIER_CALLS, "production"), (walk.without_tests(walk.CLASSIFIER_CALLS), "test")))
    assert got == dict.fromkeys(test, 3) | dict.fromkeys(production, 0) and got["c"] == 3


def test_places_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000 // 3, i) for i in range(1000)] + [(None, 1000)], "v long, k long").repartition(7)
    got = {r.k: (r.place, r.v) for r in checkpoint.placed(rows, "v", "k").collect()}
    want = sorted(got, key=lambda k: (got[k][1] is not None, got[k][1] or 0, k))
    assert [got[k][0] for k in want] == list(range(1001)) and checkpoint.placed(rows.limit(0), "v", "k").count() == 0


def test_impact_paths_prefer_the_least_parent(spark):
    nodes, edges = frames(spark, [node(x, path=p) for x, p in (("t", "z"), ("p2", "b"), ("p1", "a"), ("d", "c"), ("far", "e"))], [edge("p1", "t", "references"), edge("p2", "t", "extends"), edge("d", "p1", "type_of"), edge("d", "p2", "references"), edge("d", "t", "calls"), edge("far", "d", "references")])
    found, beyond = walk.impact(edges, nodes, roots(spark, "t"), 2)
    got = {r.node: [(s.dependent, s.dependency, s.relation) for s in r.path] for r in found.collect()}
    assert got == {"p1": [("p1", "t", "references")], "p2": [("p2", "t", "inheritance")], "d": [("p1", "t", "references"), ("d", "p1", "type_use")]}
    assert beyond.head().depth_cutoff_nodes == 1


def classes(spark, nodes, edges, *root_rows, **more):
    n, e = frames(spark, nodes, edges)
    return as_map(classify.classify(n, e, spark.createDataFrame(list(root_rows), "role string, node string"), **more), "memory_id", "reachability_class")


def test_classification_order_and_doubt(spark):
    nodes = [node("main"), node("used"), node("api", visibility="pub"), node("by_api", visibility="pub"), node("lonely", visibility="pub"), node("t", is_test_only=True), node("by_test"), node("gone"), node("seen", visibility="pub"), node("skip", path="vendor/x.rs"), node("k", "const")]
    edges = [edge("main", "used"), edge("main", "api"), edge("lonely", "by_api"), edge("t", "by_test"), edge("t", "used")]
    got = classes(spark, nodes, edges, ("production", "main"), ("public_api", "lonely"), ("test", "t"))
    assert got == {"main": "wired", "used": "wired", "api": "wired", "by_api": "public_api", "lonely": "suspected", "t": "test_only", "by_test": "test_only", "gone": "dead", "seen": "suspected", "skip": "excluded", "k": "structural"}


def test_guard_rescue_reaches_a_fixpoint(spark):
    nodes = [node("main"), node("T", "trait"), node("impl", "impl"), node("impl::m", "method"), node("deep"), node("Own", "struct"), node("oi", "impl"), node("oi::n", "method", is_test_only=True), node("never")]
    edges = [edge("main", "T", "references"), edge("impl", "T", "implements"), edge("impl", "impl::m", "contains"), edge("impl::m", "deep"), edge("deep", "Own", "type_of"), edge("Own", "oi", "contains"), edge("oi", "oi::n", "contains")]
    got = classes(spark, nodes, edges, ("production", "main"))
    assert {k: got[k] for k in ("impl::m", "deep", "Own", "oi::n", "impl", "oi", "never")} == {"impl::m": "wired", "deep": "wired", "Own": "wired", "oi::n": "test_only", "impl": "wired", "oi": "test_only", "never": "dead"}


def test_abstract_methods_fields_and_markers(spark):
    nodes = [
        node("main"), node("T", "trait"), node("T::a", has_body=False), node("T::b", has_body=True), node("T::m"), node("I", "impl"), node("I::m", "method", name="I::m"), node("S", "struct"), node("S::f", "field", name="S::f"),
        node("M", "trait", name="Send", path="<external>"), node("mi", "impl"), node("Z", "trait"), node("Z::a", has_body=False),
    ]
    edges = [edge("main", "I::m"), edge("main", "S", "type_of"), edge("I", "T", "implements"), edge("I", "I::m", "contains"), edge("T", "T::a", "contains"), edge("T", "T::b", "contains"), edge("T", "T::m", "contains"), edge("S", "mi", "contains"), edge("mi", "M", "implements"), edge("Z", "Z::a", "contains")]
    got = classes(spark, nodes, edges, ("production", "main"))
    want = {"T::a": "structural", "T::m": "structural", "T::b": "dead", "S::f": "structural", "mi": "structural", "Z::a": "dead", "Z": "dead", "T": "structural", "I": "wired"}
    assert {k: got[k] for k in want} == want


def test_population_and_partitioning_do_not_change_classes(spark):
    rng = random.Random(2)
    nodes = [node(f"n{i}", rng.choice(["function", "struct", "trait", "impl", "module", "field"]), visibility=rng.choice(["pub", "private"]), path=f"src/f{i % 4}.rs") for i in range(40)]
    edges = list({(a, b, k): edge(f"n{a}", f"n{b}", k) for a, b, k in ((rng.randrange(40), rng.randrange(40), rng.choice(["calls", "contains", "implements", "references"])) for _ in range(80))}.values())
    n, e = frames(spark, nodes, edges)
    r = spark.createDataFrame([("production", "n1"), ("test", "n2"), ("public_api", "n3")], "role string, node string")
    a, b = (as_map(classify.classify(n.repartition(k), e.repartition(k), r), "memory_id", "reachability_class") for k in (1, 5))
    assert a == b
    part = as_map(classify.classify(n, e, r, population=spark.createDataFrame([("n1",), ("n4",)], "node string")), "memory_id", "reachability_class")
    assert sum(v == "unclassified" for v in part.values()) == 38


def test_dead_actions_reasons_and_fixpoint(spark):
    dead = {"rustc_flagged_dead": True}
    nodes = [node("safe", **dead), node("C", "impl", **dead), node("C::m", "method", **dead), node("bad", "impl"), node("bad::m", "method", **dead), node("bad::m::n", **dead), node("live", cls="wired"), node("called", **dead), node("t", cls="test_only"), node("tested", **dead), node("x", path="tests/x.rs", **dead), node("pubf", visibility="pub", **dead), node("kept", entry_retain=8, **dead)]
    edges = [edge("C", "C::m", "contains"), edge("bad", "bad::m", "contains"), edge("bad::m", "bad::m::n", "contains"), edge("live", "called"), edge("t", "tested")]
    n, e = frames(spark, nodes, edges)
    got = {r.memory_id: (r.action, r.cause) for r in classify.dead_actions(n, e).collect()}
    assert got == {
        "safe": ("safe_delete", None), "C": ("safe_delete", None), "C::m": ("safe_delete", None), "bad": ("needs_review", "not_confirmed"), "bad::m": ("needs_review", "unsafe_container"), "bad::m::n": ("needs_review", "unsafe_container"),
        "called": ("needs_review", "alive_dependent"), "tested": ("test_only", "test_dependent"), "x": ("test_only", "test_directory"), "pubf": ("needs_review", "visible"), "kept": ("needs_review", "retained"),
    }
    reasons = as_map(classify.dead_reasons(n, e), "memory_id", "reason")
    assert reasons["C::m"] == "dead_parent" and reasons["safe"] == "no_incoming" and reasons["tested"] == "tests_only" and reasons["called"] == "no_path"


def test_roots_from_entries(spark):
    n, _ = frames(spark, [node("main", path="src/main.rs"), node("other", path="src/main.rs"), node("w", path="build.rs"), node("b", path="benches/b.rs"), node("api", path="src/lib/x.rs", visibility="pub"), node("hid", path="src/lib/x.rs"), node("no_mangle", entry_retain=1), node("init", path="a/x.go"), node("init_t", name="init", path="a/x_test.go"), node("tr", is_test_root=True)], [])
    entries = spark.createDataFrame([("bin", "src/main.rs"), ("build", "build.rs"), ("bench", "benches/b.rs"), ("lib", "src/lib")], "kind string, file_path string")
    got = {(r.role, r.node) for r in classify.roots(n, entries).collect()}
    assert got == {("production", "main"), ("production", "w"), ("production", "b"), ("production", "no_mangle"), ("production", "init"), ("test", "tr"), ("public_api", "api")}


def test_names_with_homonyms(spark):
    n, _ = frames(spark, [node("1", name="a::run", path="crates/x/src/a.rs"), node("2", name="b::run", path="crates/x/src/b.rs"), node("3", name="run", path="crates/y/src/c.rs"), node("4", name="a::go", path="crates/x/src/a.rs"), node("5", name="b::go", path="crates/x/src/b.rs"), node("6", name="é::go", path="crates/z/src/q.rs")], [])
    asked = spark.createDataFrame([("run", "crates/x/src/a.rs"), ("go", "crates/x/src/a.rs"), ("go", "crates/z/src/other.rs"), ("go", "nowhere.rs"), ("nope", "f")], "query string, file string")
    got = {(r.query, r.file): (r.status, r.memory_id) for r in search.resolve_unique(n, asked).collect()}
    assert got == {("run", "crates/x/src/a.rs"): ("unique", "3"), ("go", "crates/x/src/a.rs"): ("unique", "4"), ("go", "crates/z/src/other.rs"): ("unique", "6"), ("go", "nowhere.rs"): ("ambiguous", None), ("nope", "f"): ("not_found", None)}
    assert {(r.query, r.file): (r.status, r.memory_id) for r in search.resolve_unique(n, asked.union(asked)).collect()} == got
    inside = {(r.query, r.file): (r.status, r.memory_id) for r in search.resolve_in_file(n, asked.union(asked)).collect()}
    assert inside == {("run", "crates/x/src/a.rs"): ("wrong_file", None), ("go", "crates/x/src/a.rs"): ("unique", "4"), ("go", "crates/z/src/other.rs"): ("wrong_file", None), ("go", "nowhere.rs"): ("wrong_file", None), ("nope", "f"): ("not_found_in_file", None)}
    g = Graph(spark, {"nodes": n, "edges": spark.createDataFrame([], "src string, dst string, kind string")})
    with pytest.raises(SymbolAmbiguous) as e:
        g.resolve("go")
    assert e.value.candidates == ["4", "5", "6"]
    rel = spark.createDataFrame([("r1", "run", "crates/x/src/a.rs"), ("r2", "go", "crates/x/src/zz.rs"), ("r3", "go", "q.rs")], "rel_id string, target string, file string")
    assert as_map(search.resolve_with_locality(n, rel), "rel_id", "memory_id") == {"r1": "3", "r2": "4"}


def test_glob_and_predicates(spark):
    names = spark.createDataFrame([("A::Run",), ("a::run",), ("x.y",), ("b\nrun",)], "n string")
    hit = lambda p: {r.n for r in names.where(P.glob_match("n", p)).collect()}
    assert hit("a::run") == {"a::run"} and hit("*RUN") == {"A::Run", "a::run", "b\nrun"} and hit("x.*") == {"x.y"} and hit("a*n") == {"A::Run", "a::run"} and hit("*") == {r.n for r in names.collect()}
    paths = {"tests/integration.rs": True, "pkg/service_test.go": True, "tests/test_service.py": True, "apps/web/service.spec.ts": True, "apps/web/service.e2e.ts": True, "apps/web/widget.stories.tsx": True, "src/contest.rs": False, "pkg/service.go": False, "src/service.py": False, "apps/web/service.ts": False, "apps/web/storybook.ts": False, "x.md": False}
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.t for r in frame.select("p", P.source_path_is_test("p").alias("t")).collect()} == paths


def test_source_text_functions():
    assert S.leaf_types("Arc<dyn Handler>") == ["Handler"] and S.leaf_types("Option<Vec<u8>>") == [] and S.leaf_types("HashMap<Key, Vec<a::Item>>") == ["Key", "Item"] and S.leaf_types("&'a mut Foo<Bar>") == ["Foo", "Bar"] and S.leaf_types(None) == []
    assert S.blank_line('a = "x//y" // c') == "a =        " and S.blank_line(r'"a\"b" c') == '     c' and S.blank_line('open "rest') == "open      "
    assert S.has_platform_condition("#[cfg(all(unix, test))]") and S.has_platform_condition("if cfg!( windows ) {}") and not S.has_platform_condition("#[cfg(test)] unix") and not S.has_platform_condition(None)


def test_grep_caps_context_and_skips(spark):
    files = spark.createDataFrame([("a", "x\nhit 1\ny\nz\nhit 2\nhit 3"), ("b", "hit\0"), ("c", "hit 4\n" + "w" * 300_000)], "path string, text string")
    got = [(r.path, r.line_no, r.is_match) for r in grep.grep(files, "^hit", context=1, per_file=2, overall=3).orderBy("path", "line_no").collect()]
    assert got == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("a", 5, False), ("c", 0, True)]


def test_diffs_and_freshness(spark):
    a = spark.createDataFrame([("k", "1"), ("gone", "1"), ("n", None)], "path string, hash string")
    b = spark.createDataFrame([("k", "2"), ("new", "1"), ("n", None)], "path string, hash string")
    assert as_map(changes.full_diff(a, b, ["path"], "hash"), "path", "change") == {"k": "modified", "gone": "removed", "new": "added", "n": "unchanged"}
    assert changes.freshness(a, a).head().status == "fresh" and changes.freshness(a, b).head().status == "stale" and changes.freshness(a.limit(0), a.limit(0)).head().status == "unknown"
    empty = changes.full_diff(a, a, ["path"], "hash")
    assert changes.verdict(empty, True).head().verdict == "none" and changes.verdict(empty, False).head().verdict == "unknown"


def test_receipts(spark):
    need = spark.createDataFrame([("go", "u1"), ("go", "u2")], "language string, unit string")
    rows = [("a", "1", "calls", "d", "go", "unit", "u1", "complete"), ("a", "1", "calls", "d", "go", "unit", "u2", "complete"), ("b", "1", "calls", "d", "go", "language", None, "complete"), ("c", "1", "calls", "d", "go", "unit", "u1", "partial")]
    of = lambda keep, **k: tuple(evidence.resolve_provider(spark.createDataFrame([r for r in rows if r[0] in keep], RECEIPTS), "calls", need, **k).head())
    assert of("a") == ("complete", "a") and of("ab") == ("ambiguous", None) and of("ab", preferred="b") == ("complete", "b") and of("c") == ("unavailable", None)
    tie = spark.createDataFrame([*rows[:1], ("a", "2", "calls", "d", "go", "unit", "u1", "partial"), ("a", "1", "calls", "d", "go", "repository", None, "complete")], RECEIPTS)
    assert as_map(evidence.most_specific(tie, "calls", need, "a"), "unit", "outcome") == {"u1": "conflict", "u2": "resolved"}
    state = spark.createDataFrame([(True, "x", "y", 1, 1, "stale"), (None, None, None, None, 1, None), (True, "x", "x", 1, 1, "fresh")], "authority boolean, stamp string, graph_identity string, prover int, expected_prover int, freshness string")
    assert [r.failures for r in evidence.classification_failures(state).collect()] == [["identity_mismatch", "index_stale"], ["authority_missing", "stamp_absent", "identity_unavailable", "configuration_mismatch", "index_stale"], []]


def brandes(ids, pairs, sources):
    score = dict.fromkeys(ids, 0.0)
    out = collections.defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    for s in sources:
        order, pred, sigma, dist = [], collections.defaultdict(list), collections.defaultdict(float), {s: 0}
        sigma[s], todo = 1.0, collections.deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = collections.defaultdict(float)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_betweenness_matches_brandes(spark):
    rng = random.Random(4)
    ids = sorted(f"n{i:02d}" for i in range(25))
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(70)})
    pairs = [(a, b) for a, b in pairs if a != b]
    n, e = frames(spark, [node(i) for i in ids], [edge(a, b) for a, b in pairs])
    got = as_map(enrich.betweenness(n, e, 10), "memory_id", "betweenness")
    want = brandes(ids, pairs, ids[:: 25 // 10][:10])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_expansion_caps_and_order(spark):
    n, e = frames(spark, [], [edge("s", "a"), edge("s", "b", "contains"), edge("a", "c"), edge("b", "s2"), edge("c", "d")])
    got = [(r.node, round(r.score, 6), r.depth) for r in enrich.expand(e, spark.createDataFrame([("s",), ("s2",)], "seed string"), max_depth=2).collect()]
    assert got == [("a", 0.35, 1), ("b", 0.35, 1), ("c", 0.175, 2)]
    assert enrich.expand(e, spark.createDataFrame([("s",)], "seed string"), max_total=1).count() == 1


def test_upper_percentile_is_not_the_discrete_one(spark):
    assert enrich.upper_percentile(spark.range(10).toDF("v"), "v", 0.9).head().value == 9
    assert enrich.rank_percentile(spark.range(1).toDF("v"), "v", "v").head().percentile == 0


def test_graph_construction(spark):
    rel = "array<struct<tag:string,target:string>>"
    schema = f"file_path string, name string, kind string, parent string, start_byte long, end_byte long, is_test_only boolean, relations {rel}"
    rows = [("a.rs", "S", "struct", "", 0, 5, False, [("implements", "T"), ("extends", "Send"), ("type_of", "Gone")]), ("a.rs", "f", "function", "S", 1, 2, True, []), ("a.rs", "f", "function", "S", 3, 4, False, [("references", "f")]), ("b.rs", "T", "trait", "", 0, 5, False, [("references", "S")])]
    nodes, edges = build.build_graph(spark.createDataFrame(rows, schema))
    name = {r.memory_id: f"{r.symbol_name}{r.ordinal}" for r in nodes.collect()}
    got = {(name[r.src], name[r.dst], r.kind, r.scope) for r in edges.collect()}
    assert got == {("S0", "T0", "implements", "Production"), ("T0", "S0", "has_impl", "Production"), ("S0", "S::f0", "contains", "Test"), ("S0", "S::f1", "contains", "Production"), ("T0", "S0", "references", "Production"), ("S::f1", "S::f0", "references", "Production")}
    assert len(name) == 4 == len(set(itertools.chain(name)))


def test_reverse_filter_applies_after_the_walk(spark, graph):
    g = Graph(spark, {"nodes": graph[0], "edges": graph[1]})
    assert {r.node for r in g.blast_radius("util", 3, "test_only").collect()} == {"test_helper", "test_handler"}
    assert g.nodes.where(F.col("memory_id") == "x").count() == 0


def test_whole_graph_queries_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    ids = sorted(f"{'opcs'[i % 4]}{i:02d}" for i in range(60))
    pairs = sorted({(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(90)) if a != b} | {("r0", "c02"), ("r0", "o00")})
    chain = [f"z{i}" for i in range(6)]
    pairs += list(itertools.pairwise(chain))
    ids = sorted([*ids, "r0", *chain])
    graph = frames(spark, [node(i, cls="wired" if i == "z0" else "dead") for i in ids], [edge(a, b) for a, b in pairs])
    monkeypatch.setattr(base, "Tables", lambda spark, _: SimpleNamespace(spark=spark, nodes=graph[0], edges=graph[1]))
    run = lambda name: catalog.queries()[name](spark, "")
    got, want = as_map(run("o75_betweenness"), "memory_id", "betweenness"), brandes(ids, pairs, ids)
    assert got.keys() == set(ids) and all(abs(got[k] - want[k]) < 1e-9 for k in ids) and max(want.values()) > 0
    assert as_map(run("o76_depth_from_entries_whole"), "memory_id", "depth") == {z: i for i, z in enumerate(chain)}
    near, seen, out = collections.defaultdict(set), {"r0"}, []
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    front = {"r0"}
    for depth in (1, 2, 3):
        front = {b for a in front for b in near[a]} - seen
        seen |= front
        out += [(b, round(0.7 * 0.5**depth, 6), depth) for b in sorted(front)]
    assert [(r.node, r.score, r.depth) for r in run("o62_seed_expansion_whole").collect()] == out[:20] and out[min(len(out), 20) - 1][2] > 1


def test_diff_query_gives_all_changes_in_total_order(spark, monkeypatch):
    rows = [(f"s{k}", "struct", f"n::{k % 7}", f"f{k % 3}", k, "x") for k in range(700)]
    nodes = spark.createDataFrame(rows, "memory_id string, kind string, symbol_name string, file_path string, k long, signature string")
    monkeypatch.setattr(base, "Tables", lambda spark, _: SimpleNamespace(spark=spark, nodes=nodes, edges=nodes))
    want = sorted((f, n, i) for i, _, n, f, k, _ in rows if k % 10 == 0)
    assert [(r.memory_id, r.row_no) for r in catalog.queries()["v_diff"](spark, "").orderBy("row_no").collect()] == [(i, at + 1) for at, (_, _, i) in enumerate(want)]
    found = changes.full_diff(nodes, nodes.where("k % 10 <> 0"), ["memory_id", "symbol_name", "file_path"], "k")
    assert [(r.memory_id, r.row_no) for r in changes.bounded(found, 5).orderBy("row_no").collect()] == [(i, at + 1) for at, (_, _, i) in enumerate(want[:5])]


def test_diagnostics_on_a_crowded_line_meet_no_pairs(spark):
    nodes, _ = frames(spark, [node(f"a{i}", name=f"m::a{i}") for i in range(300)] + [node("b", name="m::b", path="b.rs"), node("c", name="m::c", path="c.rs"), node("d", name="m::d", path="d.rs", rustc_flagged_dead=True)], [])
    said = [("crates/app/src/a.rs", 1, f"a{i}") for i in range(300)] + [("b.rs", 1, "b"), ("b.rs", 1, None), ("c.rs", 1, "other"), ("c.rs", 2, "c")]
    got = {good: classify.apply_oracle(nodes, spark.createDataFrame(said, "file_name string, line int, subject string"), good) for good in (True, False)}
    assert [{r.memory_id for r in got[g].where("rustc_flagged_dead").collect()} for g in (True, False)] == [{"b"}, {"b", "d"}]
    assert got[True].count() == 303
    # Symbols are counted by line before any join; a window over joined rows would hold 90,000 pairs here.
    assert "Window" not in got[True]._jdf.queryExecution().optimizedPlan().toString()


def test_reach_of_ranks_over_lists_of_steps(spark, monkeypatch):
    monkeypatch.setattr(walk, "_LIST", 3)
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    tests = set(ids[::5])
    pairs = {("n1", i) for i in ids[2:]} | {(rng.choice(ids), rng.choice(ids)) for _ in range(60)} | {("n7", "outside"), ("outside", "n9"), ("a1", "a2"), ("a2", "n1")}
    n, e = frames(spark, [node(i, is_test_only=i in tests) for i in [*ids, "a1", "a2"]], [edge(a, b, rng.choice(["calls", "type_of"])) for a, b in sorted(pairs)] + [edge("n3", "n8", "related_to")])
    starts = [("production", "n1"), ("production", "n5"), ("public_api", "n2"), ("public_api", "a1"), ("test", "n10"), ("test", "n11"), ("other", "n13")]
    best = {}
    for rank, role in ((3, "test"), (1, "public_api"), (0, "production")):
        seen = ahead = {i for r, i in starts if r == role}
        while ahead:
            ahead = {b for a, b in pairs if a in ahead and (rank == 3 or not {a, b} & tests)} - seen
            seen = seen | ahead
        best |= dict.fromkeys(seen, rank)
    got = classify.reach_sets(n, e, spark.createDataFrame(starts, "role string, node string"))
    assert as_map(got, "node", "rank") == best and set(best.values()) == {0, 1, 3}
    lists = walk.packed_steps(e, walk.CLASSIFIER_CALLS)
    assert lists.where("from = 'n1'").count() > 1 and sorted((r["from"], x) for r in lists.collect() for x in r.to) == sorted(pairs)


def test_classification_writes_no_edges_that_no_pass_reads(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(classify, "cut", lambda df, label: written.setdefault(label, checkpoint.cut(df, label)) if label == "edges" else checkpoint.cut(df, label))
    n, e = frames(spark, [node("a"), node("b")], [edge("a", "b"), *[edge("a", "b", "related_to") for _ in range(9)], edge("b", "a", "depends_on"), edge("a", "b", "contains"), edge("a", "b", "implements")])
    got = classify.classify(n, e, spark.createDataFrame([("production", "a")], "role string, node string"))
    assert as_map(got, "memory_id", "reachability_class") == {"a": "wired", "b": "wired"}
    assert sorted(r.kind for r in written["edges"].collect()) == ["calls", "contains", "implements"]


@pytest.mark.parametrize("few", [1_000, 0])
def test_expansion_takes_the_best_of_many_ways(spark, monkeypatch, few):
    monkeypatch.setattr(enrich, "_FEW", few)
    written = []
    monkeypatch.setattr(enrich, "cut", lambda df, label: written.append(checkpoint.cut(df, label)) or written[-1])
    rng = random.Random(3)
    ids = [f"e{i:02d}" for i in range(60)]
    links = [(a, b, rng.choice([0.25, 0.5, 1.0])) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(400))] + [("e00", i, 0.25) for i in ids[1:]]
    near = collections.defaultdict(dict)
    for a, b, x in links:
        if a != b:
            near[a][b] = near[b][a] = max(x, near[a].get(b, 0))
    seeds, want = ["e00", "e01", "e02"], {}
    for s in seeds:
        done, heap, n = set(seeds), [(-x * 0.5, b, 1) for b, x in near[s].items()], 0
        while heap and n < 6:
            score, b, depth = min(heap)
            heap.remove((score, b, depth))
            if b in done:
                continue
            done.add(b)
            n += 1
            want[b] = min(want.get(b, (0, "")), (score, s))
            heap += [(-x * 0.5 ** (depth + 1), c, depth + 1) for c, x in near[b].items()] if depth < 3 else []
    _, e = frames(spark, [], [edge(a, b, weight=x, confidence=1.0) for a, b, x in links])
    got = enrich.expand(e, spark.createDataFrame([(s,) for s in seeds], "seed string"), max_per_seed=6).collect()
    assert {r.node: (-r.score, r.seed) for r in got} == want
    ways = [t for t in written if t.columns == ["from", "to", "w"]]
    assert ways and all(r["count"] <= 6 for t in ways for r in t.groupBy("from").count().collect())


def test_betweenness_keeps_numbers_and_compacts_what_it_saw(spark, monkeypatch):
    monkeypatch.setattr(walk, "_LIST", 2)
    monkeypatch.setattr(enrich, "_COMPACT", 2)
    written = []
    monkeypatch.setattr(enrich, "cut", lambda df, label: written.append((label, df.columns, dict(df.dtypes))) or checkpoint.cut(df, label))
    ids = [f"b{i}" for i in range(12)]
    pairs = sorted({*itertools.pairwise(ids[:8]), *(("b0", i) for i in ids[8:]), *((i, "b5") for i in ids[8:]), ("b5", "outside"), ("outside", "b11"), ("b7", "b0")})
    n, e = frames(spark, [node(i) for i in ids], [edge(a, b, k) for a, b in pairs for k in ("calls", "references")])
    want = brandes([*ids, "outside"], pairs, ids)
    got = as_map(enrich.betweenness(n, e), "memory_id", "betweenness")
    assert got.keys() == set(ids) and all(abs(got[k] - want[k]) < 1e-9 for k in ids) and max(want.values()) > 0
    levels = [types for _, columns, types in written if "sigma" in columns]
    assert len(levels) > 4 and all((t["s"], t["v"]) == ("int", "bigint") for t in levels) and any(label == "seen" for label, _, _ in written)


def test_betweenness_of_deep_graphs_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(enrich, "cut", lambda df, label: written.append(df.columns) or checkpoint.cut(df, label))
    ids = [f"d{i:02d}" for i in range(50)]
    pairs = sorted({*itertools.pairwise(ids), ("d03", "d20"), ("d03", "e"), ("e", "d21"), ("d40", "d10"), ("d49", "d00")})
    n, e = frames(spark, [node(i) for i in ids], [edge(a, b) for a, b in pairs])
    got, want = as_map(enrich.betweenness(n, e), "memory_id", "betweenness"), brandes([*ids, "e"], pairs, ids)
    assert got.keys() == set(ids) and all(abs(got[k] - want[k]) < 1e-9 for k in ids) and max(want.values()) > 100
    assert len(written) < 20


@pytest.mark.parametrize("held", [0, 1 << 24])
def test_betweenness_in_many_parts_and_blocks(spark, monkeypatch, held):
    for name, small in (("_NODES", 7), ("_ARRIVING", 60), ("_SPREAD", 3), ("_NAMED", 12)):
        monkeypatch.setattr(blocks, name, small)
    monkeypatch.setattr(enrich, "_HELD", held)
    monkeypatch.setattr(enrich, "_DEEP", 2)
    rng = random.Random(11)
    ids = sorted(f"n{i:02d}" for i in range(40))
    pairs = {(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(60)) if a != b} | {("n05", i) for i in ids[6:38]} | {(i, "n07") for i in ids[8:30]} | {("n07", "out"), ("out", "n39")}
    n, e = frames(spark, [node(i) for i in ids], [edge(a, b) for a, b in sorted(pairs)])
    got, want = as_map(enrich.betweenness(n, e, 10), "memory_id", "betweenness"), brandes([*ids, "out"], sorted(pairs), ids[:: 40 // 10][:10])
    assert got.keys() == set(ids) and all(abs(got[k] - want[k]) < 1e-9 for k in ids) and max(want.values()) > 0
