"""Closed vocabularies and schemas of the graph.

The lists and numbers in this module are fixed values: results depend on their exact spelling and order.
"""

from __future__ import annotations

from pyspark.sql import types as T

EDGE_KINDS = ["calls", "implements", "contains", "references", "depends_on", "extends", "type_of", "field_of", "has_impl", "related_to"]
#: Weights of edge kinds in seed expansion.
EXPANSION_WEIGHTS = {
    "calls": 1.0, "implements": 0.9, "contains": 0.7, "references": 0.6, "depends_on": 0.5,
    "extends": 0.8, "type_of": 0.4, "field_of": 0.4, "has_impl": 0.9, "related_to": 0.3,
}
#: Weights that graph construction gives to edges.
BUILD_WEIGHTS = {"references": 0.5, "field_of": 0.8, "type_of": 0.7, "extends": 1.0, "implements": 1.0, "has_impl": 1.0, "contains": 1.0}
#: From most to least alive; the position is the rank that minima compare.
CLASSES = ["wired", "public_api", "structural", "test_only", "dead", "orphan", "unclassified", "suspected", "excluded"]
RANK = {c: i for i, c in enumerate(CLASSES)}

ROLES = {
    "callable": ["function", "callable_value", "method", "constructor", "call_signature", "construct_signature"],
    "independent": [
        "function", "callable_value", "method", "constructor", "struct", "class", "enum", "union", "impl", "trait", "interface",
        "const", "static", "variable", "module", "namespace", "use", "import", "type_alias", "macro", "export",
    ],
    "type": ["struct", "class", "enum", "union", "trait", "interface", "type_alias"],
    "concrete_type": ["struct", "class", "enum", "union"],
    "abstraction": ["trait", "interface"],
    "data_member": ["field", "property", "index_signature"],
    "field_container": ["struct", "class", "enum", "union", "interface", "type_alias"],
    "container": ["struct", "class", "enum", "union", "impl", "trait", "interface", "module", "namespace"],
}
#: A definition is every kind but these, unknown kinds included.
NOT_DEFINITIONS = ["use", "import", "export"]

LANGUAGES = {
    "rs": "rust", "go": "go", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript",
}
EXCLUDED_DIRS = ["testdata", "vendor", "third_party", "node_modules"]
STRUCTURAL_KINDS = ["use", "const", "static", "type_alias", "macro", "module"]
MARKER_TRAITS = ["Send", "Sync", "Sized", "Unpin"]
WRAPPERS = ["Arc", "Rc", "Box", "Option", "Vec", "Mutex", "RwLock", "RefCell", "Cell", "Pin", "Cow"]
PAIR_TYPES = ["HashMap", "BTreeMap"]
PRIMITIVES = [
    "bool", "char", "str", "String", "u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "Self", "self",
]
IMPACT_RELATIONS = {"references": "references", "field_of": "type_use", "type_of": "type_use", "implements": "implementation", "extends": "inheritance"}
DEPENDENCY_RELATIONS = {
    "calls": "call", "references": "reference", "type_of": "type_use", "field_of": "type_use", "implements": "implementation",
    "extends": "inheritance", "depends_on": "project_dependency",
}
#: Edge kinds that each admission class follows.
ADMISSION = {
    "structural": [k for k in EDGE_KINDS if k != "related_to"],
    "dependency": [k for k in EDGE_KINDS if k not in ("related_to", "depends_on", "extends")],
    "call": ["calls", "references", "type_of", "field_of", "extends"],
}

NODES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("memory_id", "symbol_name", "kind", "file_path", "content_hash", "signature", "reachability_class")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end")]
    + [
        T.StructField("has_body", T.BooleanType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("is_test_only", T.BooleanType()),
        T.StructField("is_test_root", T.BooleanType()),
        T.StructField("has_platform_cfg", T.BooleanType()),
        T.StructField("rustc_flagged_dead", T.BooleanType()),
        T.StructField("entry_retain", T.IntegerType()),
    ]
)
EDGES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("src", "dst", "kind")]
    + [T.StructField("weight", T.DoubleType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "scope")]
)
