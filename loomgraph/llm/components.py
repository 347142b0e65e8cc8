"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; edges, labels and components stay distributed. Before
the rounds every partition replaces its own edges by a spanning forest of stars, which turns the
cliques of large groups of copies into as many edges as they have members.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import discard, realign, stage


class UnionFind:
    """Disjoint sets of integers whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            sets.union(a, b)
    nodes = [x for x in sets.up if sets.find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_pydict({"src": pa.array(nodes, pa.int64()), "dst": pa.array([sets.find(x) for x in nodes], pa.int64())})


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges directed from larger to smaller nodes."""
    both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(realign(low, "u"), "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
    parent = realign(large.groupBy("src").agg(F.min("dst").alias("m")), "src")
    small = large.join(parent, "src")
    onward = small.where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return small.select("src", F.col("m").alias("dst")).union(onward).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is the smallest node reachable.

    ``edges`` has two long columns; self-loops, repeated and null edges are ignored. An empty edge table
    gives an empty result. Nodes without edges are absent: a left join gives them their own id.
    """
    src, dst = edges.columns
    pairs = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).where("src <> dst")
    now = stage(pairs.mapInArrow(_forest, "src long, dst long").distinct(), "stars")
    while True:
        #: Done when no node is both a leaf and a centre, and no leaf has two centres.
        mixed = now.select("src").join(now.select(F.col("dst").alias("src")), "src", "left_semi").limit(1)
        twice = now.groupBy("src").count().where("count > 1").select("src").limit(1)
        if not mixed.union(twice).take(1):
            break
        after = stage(_stars(now), "stars")
        discard(now)
        now = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
