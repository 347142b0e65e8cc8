"""Sources, generations, cursors, clones, the schedule and streams."""

from __future__ import annotations

import datetime as dt
import json
import subprocess
import sys
import time
from pathlib import Path

import pytest

from loomgraph import catalog, indexing
from loomgraph.errors import CapabilityDowngrade, CursorError, NoGeneration, ResultTooLarge
from loomgraph.operators import build, clones, paging
from loomgraph.sources import facts, files, python_extractor, scip
from loomgraph.sources.bundle import HEADS, Bundle
from loomgraph.streaming import watch
from loomgraph.verbs import Graph

ROOT = Path(__file__).resolve().parents[1]

APP = 'def greeting(name: str) -> str:\n    """Say."""\n    return f"hé {name}"\n\n\ndef greet() -> str:\n    return greeting("x")\n\n\nclass Box(Base):\n    size: Size = 1\n\n    def __init__(self):\n        self.lid = 2\n\n    @property\n    def area(self):\n        return self.size\n\n    def _hide(self):\n        pass\n'
TEST = "from app import greeting\n\n\ndef test_greeting():\n    assert greeting('a')\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in {"app.py": APP, "test_app.py": TEST, "bad.py": "def (", "pyproject.toml": '[project]\nname = "quick"\ndependencies = ["x"]\n', "vendor/v.py": "def v(): pass\n", "cmd/main.go": "package main\n", "lib/l.go": "package lib\n", "crates/c/Cargo.toml": '[package]\nname = "c"\n[dependencies]\nd = { path = "../d" }\n[[bench]]\nname = "b"\npath = "benches/b.rs"\n', "build/out.py": "x = 1\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_discovery_and_records(spark, tree):
    found = files.discover(files.read_tree(spark, tree), ignored=["build/", "/vendor"])
    assert [r.path for r in found.collect()] == ["app.py", "bad.py", "cmd/main.go", "lib/l.go", "test_app.py"]
    assert {r.directory for r in files.directories(found).collect()} == {"", "cmd", "lib"}
    assert {r.language for r in files.file_records(found).collect()} == {"python", "go"}


def test_python_sources_to_callers_tests_and_slices(spark, tree):
    found = files.discover(files.read_tree(spark, tree), ["python"], ["build/", "/vendor"])
    symbols = python_extractor.extract(found)
    rows = {(r.file_path, r.parent, r.name): r for r in symbols.collect()}
    assert rows["app.py", "Box", "area"].kind == "property" and rows["app.py", "Box", "_hide"].visibility == "private" and rows["app.py", "Box", "lid"].kind == "field"
    assert rows["test_app.py", "", "test_greeting"].is_test_root and rows["app.py", "", "greeting"].doc_comment == "Say." and not any(k[0] == "bad.py" for k in rows)
    nodes, edges = build.build_graph(symbols)
    nodes = nodes.selectExpr("*", "cast('unclassified' as string) as reachability_class", "false as rustc_flagged_dead")
    g = Graph(spark, {"nodes": nodes, "edges": edges, "contents": found.select("path", "content")})
    callers = {r.symbol_name for r in g.calls("greeting", "all").rows.collect()}
    assert {"greet", "test_greeting"} <= callers and [r.symbol_name for r in g.tests("greeting").rows.collect()] == ["test_greeting"]
    assert g.read("greeting") == APP[: APP.index("\n\n\ndef greet")] and g.read("greeting", 4, 8) == "greeting"
    assert g.dead().status == "qualified"


def test_slices_are_refused_for_a_reason(spark):
    contents = spark.createDataFrame([("a", bytearray("é!".encode()))], "path string, content binary")
    rows = [("1", "a", "x", 0, 2), ("2", "a", "x", 0, 9), ("3", "b", "x", 0, 1), ("4", "a", "x", 1, 2)]
    nodes = spark.createDataFrame(rows, "memory_id string, file_path string, content_hash string, start_byte long, end_byte long")
    assert {r.memory_id: r.refusal for r in files.slice_source(nodes, contents).collect()} == {"1": "hash_mismatch", "2": "bad_span", "3": "missing", "4": "not_utf8"}


def test_manifests_and_entry_points(spark, tree):
    tree = files.read_tree(spark, tree)
    units = facts.project_units(tree)
    assert {(r.project_unit_id, tuple(r.dependencies)) for r in units.collect()} == {("python:quick", ("x",)), ("cargo:c", ("d",))}
    owners = facts.memberships(files.discover(tree, ["python"]), units)
    assert {(r.document_path, r.kind) for r in owners.where("document_path = 'app.py'").collect()} == {("app.py", "source_owner")}
    got = {(r.kind, r.file_path) for r in facts.entry_points(tree).collect()}
    assert {("bin", "cmd/main.go"), ("lib", "lib"), ("bench", "crates/c/benches/b.rs"), ("lib", "crates/c/src"), ("build", "crates/c/build.rs")} <= got


def test_churn_carries_authors_over_blocks(spark):
    lines = ["commit|ann", "1\t0\ta.py", "2\t1\tb.py", "", "commit|bob", "1\t1\ta.py"]
    log = spark.createDataFrame([(i * 40_000, x) for i, x in enumerate(lines)], "line_no long, value string")
    got = {r.path: (r.churn_90d, r.unique_authors_90d) for r in facts.churn(log).collect()}
    assert got == {"a.py": (2, 2), "b.py": (1, 1)}


def test_clones_agree_up_to_names(spark):
    one = "def a(x, y):\n    z = x + y\n    if z:\n        return z\n    return 1\n"
    two = one.replace("a(", "b(").replace("x", "p").replace("z", "q").replace("1", "2")
    three = one.replace("+", "-")
    prints = clones.fingerprints(spark.createDataFrame([("1", one), ("2", two), ("3", three), ("4", "def ("), ("5", None)], "path string, text string"))
    assert [(r.size, r.lines, r.duplicated_lines) for r in clones.clone_groups(prints).collect()] == [(2, 5, 5)]


def test_cursor_refusals():
    args = ("find", "g1", "digest")
    cursor = paging.encode_cursor(*args, 20, now=1000)
    assert paging.decode_cursor(cursor, *args, 50, now=1500) == 20

    def code(text, *a, total=50, now=1500):
        with pytest.raises(CursorError) as e:
            paging.decode_cursor(text, *a, total, now=now)
        return e.value.code

    body = json.loads(bytes.fromhex(cursor)) | {"offset": 0}
    assert code(json.dumps(body).encode().hex(), *args) == code("zz", *args) == code("7b7d", *args) == "checksum"
    assert code(cursor, "calls", "g1", "digest") == code(cursor, "find", "g1", "other") == "other_request"
    assert code(cursor, "find", "g2", "digest") == "other_generation" and code(cursor, *args, now=2000) == "expired" and code(cursor, *args, total=10) == "out_of_range"


def test_size_bound(spark):
    rows = spark.createDataFrame([(i, "x" * 20) for i in range(10)], "i int, s string")
    assert paging.fit_rows(rows, ["i"], 100).count() == 2
    with pytest.raises(ResultTooLarge):
        paging.fit_rows(rows, ["i"], 10)


def test_generations(spark, tmp_path):
    bundle = Bundle(spark, f"file://{tmp_path}/b")
    with pytest.raises(NoGeneration):
        bundle.resolve()
    table = spark.createDataFrame([("f1", 1), ("f2", 2)], "file_path string, v int")
    first = bundle.publish({"symbols": table}, [["calls", "d", "rust"]])
    second = watch.merge_generation(bundle, spark.createDataFrame([("f1", 9)], "file_path string, v int"), spark.createDataFrame([("f2",)], "file_path string"), capabilities=[["calls", "d", "rust"]])
    assert bundle.resolve()["generation_id"] == second and bundle.resolve()["parent"] == first
    assert [tuple(r) for r in bundle.open("symbols").collect()] == [("f1", 9)] and bundle.open("symbols", first).count() == 2
    with pytest.raises(CapabilityDowngrade):
        bundle.publish({"symbols": table})
    head = tmp_path / "b" / HEADS[bundle.resolve()["sequence"] % 2]
    head.write_text(head.read_text()[:-5])
    (tmp_path / "b" / f".{head.name}.crc").unlink(missing_ok=True)
    assert bundle.resolve()["generation_id"] == first


def test_schedule():
    s = watch.Schedule()
    assert s.change() == [] and s.watch() == [("start", 1, "watch", 1)]
    assert s.change() == [("cancel", 1, "superseded")] and s.change() == []
    assert s.finish(1, "cancelled") == [("start", 2, "watch", 3)]
    assert s.change(supersede=False) == [] and s.request() == [("cancel", 2, "manual_priority")] and s.request() == [("busy",)]
    assert s.finish(2, "cancelled") == [("start", 3, "manual", 4)] and s.finish(3, "failed") == [] and s.failed == 4
    assert s.change() == [("start", 4, "watch", 5)] and s.finish(4, "published") == [] and (s.published, s.failed) == (5, 0) and s.finish(9, "failed") == [("not_active", 9)]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


EVENTS = [(0, "a.py", "filesystem"), (1, "b.py", "git_state"), (2, "a.py", "filesystem"), (60, "c.py", "filesystem"), (61, "d.py", "filesystem"), (62, "e.py", "filesystem")]


def test_debounce_in_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame([(at(t), p, r) for t, p, r in EVENTS], "ts timestamp, path string, reason string")
    shape = lambda df: sorted((r.first_ts, tuple(r.paths), r.reason, r.hints) for r in df.collect())
    batch = shape(watch.debounce(rows, "5 seconds", most=2))
    assert batch == [(at(0), ("a.py", "b.py"), "git_state", 3), (at(60), (), "queue_overflow", 3)]
    rows.union(spark.createDataFrame([(at(1000), "late", "filesystem")], rows.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = watch.debounce(stream, "5 seconds", most=2, late="10 seconds").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert shape(spark.table("debounced")) == batch


def test_stream_drives_the_schedule(spark, tmp_path):
    spark.createDataFrame([(at(t), p, r) for t, p, r in EVENTS], "ts timestamp, path string, reason string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, reason string").parquet(str(tmp_path / "in"))
    schedule, runs = watch.Schedule(watching=True), []

    def run(i, trigger, epoch):
        runs.append((trigger, epoch))
        return "published"

    q = watch.scheduled(watch.classify_events(stream).where("event_class = 'source'"), schedule, run, str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert runs == [("watch", 1)] and schedule.published == 1


def test_reconciliation_supersedes_nothing_and_runs_without_hints(spark, tmp_path):
    schedule, runs = watch.Schedule(watching=True), []
    q = watch.reconciled(spark, schedule, lambda *a: runs.append(a) or "published", str(tmp_path / "cp"), "1 second")
    until = time.time() + 30
    while len(runs) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert [r[1:] for r in runs[:2]] == [("watch", 1), ("watch", 2)] and schedule.published >= 2


def test_index_publishes_and_reindex_reuses(spark, tree, tmp_path):
    bundle = Bundle(spark, f"file://{tmp_path}/b")
    source = files.read_tree(spark, tree)
    first = indexing.reindex(source, bundle, ignored=["build/", "/vendor"])
    g = Graph.open(spark, bundle.root)
    assert g.generation == first and {"nodes", "edges", "files", "contents", "units", "memberships"} == set(g.tables)
    assert {r.symbol_name for r in g.calls("greeting", "all").rows.collect()} >= {"greet", "test_greeting"} and g.read("greet").startswith("def greet()")
    assert "unclassified" not in {r.reachability_class for r in g.nodes.collect()} and g.nodes.where("has_platform_cfg is null").count() == 0
    assert indexing.reindex(source, bundle, ignored=["build/", "/vendor"]) == first
    facets = g.inspect("Box")
    assert facets["source"]["result"].startswith("class Box") and {(r.field, r.uses) for r in facets["field_usage"]["result"].rows.collect()} >= {("size", 1), ("lid", 1)}
    second = indexing.reindex(source.where("path <> 'test_app.py'"), bundle, ignored=["build/", "/vendor"])
    assert second != first and Graph.open(spark, bundle.root).nodes.where("file_path = 'test_app.py'").count() == 0 and g.nodes.where("file_path = 'test_app.py'").count() > 0


def test_index_bytes(spark):
    message = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    four, other = message(2, message(1, b"\x01\x00\x05\x02") + message(2, b"s#")), message(2, b"\x08\x07\x08\x00\x08\x03" + message(2, b"u") + b"\x18\x09")
    short, unknown = message(2, message(1, b"\x01") + message(2, b"bad")), b"\x4d\x00\x00\x00\x00"
    body = message(2, message(1, b"a.rs") + four + other + short + unknown) + message(3, message(1, b"s#") + message(4, message(1, b"t#")))
    assert scip.parse("i", body) == ([("i", "a.rs", 1, 5, "s#", False), ("i", "a.rs", 7, 7, "u", True)], [("i", "s#", "t#", False)])
    assert scip.parse("i", body[:-1]) == ([], []) and scip.parse("i", b"") == ([], [])
    rows = spark.createDataFrame([("i", bytearray(body)), ("j", None)], "path string, content binary")
    assert scip.occurrences(rows).count() == 2 and scip.occurrences(rows.limit(0)).count() == 0


def test_index_bytes_hold_lines_and_lengths_of_any_size(spark, tmp_path):
    keys = [1, 127, 128, 16_083, 16_084, 16_183, 16_184, 2_097_151, 2_097_152, 268_435_455, 268_435_456, 2**31 - 301]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.queries()["o11_index_bytes"](spark, str(tmp_path))
    want = {(f"f{k}", line, f"p{k + i}#", i == 0) for k in keys if k % 9 for i, line in enumerate((3, k + 200, k + 300))}
    assert {tuple(r) for r in got.collect()} == want


def test_refresh_plans(spark):
    schema = "path string, before string, after string, surface_before string, surface_after string, inputs_changed boolean, identity_changed boolean"
    plan = lambda *rows: tuple(watch.refresh_plan(spark.createDataFrame(rows, schema)).head())
    same = ("a", "1", "1", "s", "s", False, False)
    assert plan(same) == ("exact_reuse", None, 0) and plan(same, ("b", "1", "2", "s", "s", False, False)) == ("refresh_affected", None, 1)
    assert plan(("b", None, "2", None, "s", False, False))[:2] == ("certify_full", "document_added") and plan(("b", "1", "2", "s", "t", False, False))[:2] == ("certify_full", "surface_changed") and plan(("b", "1", "1", "s", "s", True, False))[:2] == ("certify_full", "input_changed")


def test_entry_works_without_the_optional_parts(tmp_path):
    """The driver contract imports and lists queries after the optional subpackage and the pipeline are removed."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    import shutil

    shutil.copytree(ROOT / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'o67_audit_hotspots' in q and 'pipeline' not in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100
