"""Small graphs for tests."""

from __future__ import annotations

from loomgraph import model


def node(memory_id, kind="function", name=None, path="crates/app/src/a.rs", cls="dead", **more):
    base = {
        "memory_id": memory_id, "symbol_name": name or memory_id, "kind": kind, "file_path": path, "content_hash": memory_id, "signature": "", "reachability_class": cls, "line_start": 0, "line_end": 9, "has_body": True,
        "visibility": "private", "is_test_only": None, "is_test_root": False, "has_platform_cfg": False, "rustc_flagged_dead": False, "entry_retain": 0,
    }
    return tuple((base | more)[f.name] for f in model.NODES.fields)


def edge(src, dst, kind="calls", source="TreeSitter", scope="Production", weight=1.0, confidence=0.7):
    return (src, dst, kind, weight, confidence, source, scope)


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, model.NODES), spark.createDataFrame(edges, model.EDGES)


def consistency(spark):
    """Eleven nodes and eight edges: a main path, a struct with methods, two tests, two dead functions."""
    app = "crates/app/src/"
    nodes = [
        node("main", path=app + "main.rs", cls="wired"), node("handler", path=app + "handler.rs", cls="wired"), node("helper", path=app + "helper.rs", cls="wired"), node("util", path=app + "util.rs", cls="wired"),
        node("MyStruct", "struct", path=app + "s.rs", cls="wired"), node("MyStruct::new", "method", path=app + "s.rs", cls="wired", visibility="pub"), node("MyStruct::process", "method", path=app + "s.rs", cls="wired"),
        node("test_helper", path="crates/app/tests/test_helper.rs", cls="test_only", is_test_only=True, is_test_root=True), node("test_handler", path="crates/app/tests/test_handler.rs", cls="test_only", is_test_only=True, is_test_root=True),
        node("dead_fn", path=app + "dead.rs"), node("orphan_fn", path=app + "orphan.rs"),
    ]
    edges = [
        edge("main", "handler"), edge("handler", "helper"), edge("helper", "util"), edge("handler", "MyStruct::new"), edge("test_helper", "helper"), edge("test_handler", "handler"),
        edge("MyStruct", "MyStruct::new", "contains"), edge("MyStruct", "MyStruct::process", "contains"),
    ]
    return frames(spark, nodes, edges)
