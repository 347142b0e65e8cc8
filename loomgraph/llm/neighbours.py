"""Embedding near-duplicates by sorted passes over concatenated random-projection hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.grouped import map_groups
from loomgraph.llm.shared import realign, stage

BITS = 62


def prefix_bits(rows: int, block: int) -> int:
    """Leading hash bits whose runs are compared whole; evenly spread rows make runs of one to two blocks."""
    return min(BITS, max(0, math.floor(math.log2(max(rows, 1) / block))))


def passes_needed(rows: int, block: int, cosine: float, miss: float = 0.005) -> int:
    """Passes after which a pair at the threshold never shared a run with probability ``miss`` at most.

    A hash bit agrees with probability 1 - angle / pi; a pair meets if its :func:`prefix_bits` leading bits agree, however
    the other rows are spread.
    """
    if rows <= block:
        return 1
    meet = (1 - math.acos(cosine) / math.pi) ** math.log2(rows / block)
    return max(2, math.ceil(math.log(miss) / math.log(1 - meet)))


def _projections(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((passes, BITS, dim)).reshape(passes * BITS, dim)


def _usable(x: list | None) -> bool:
    return bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)


def _units(cosine: float):
    """(vec_id, dim, unit, alike) of usable vectors: the unit vector in doubles, and whether it links with its equal."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, lists = part.column(0).to_pylist(), part.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i in (i for i, x in enumerate(lists) if _usable(x)):
                by_dim.setdefault(len(lists[i]), []).append(i)
            for dim, rows in by_dim.items():
                x = np.array([lists[i] for i in rows], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                alike = np.einsum("ij,ij->i", x, x) >= cosine
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], pa.int64()), pa.array([dim] * len(rows), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(alike)],
                    ["vec_id", "dim", "unit", "alike"],
                )

    return run


def _codes(passes: int, seed: int):
    """(vec_id, n, dim, unit, codes): a hash of the unit vector for each pass."""
    top = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for part in parts:
            dims = np.array(part.column(2).to_pylist(), np.int64)
            for dim in np.unique(dims).tolist():
                rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                x = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.float64).reshape(-1, dim)
                if dim not in planes:
                    planes[dim] = _projections(dim, passes, seed)
                codes = (x @ planes[dim].T > 0).reshape(len(x), passes, BITS) @ top
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(codes), pa.list_(pa.int64()))], ["vec_id", "n", "dim", "unit", "codes"])

    return run


def _number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for rows in parts:
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), *rows.columns], ["part", "at", *rows.schema.names])
        at += n


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the rows of each pair one label, the least; ``i`` is sorted."""
    for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        here = np.append(label[j[at]], label[i[at[0]]])
        if (here != here[0]).any():
            label[np.isin(label, here)] = here.min()


def _compare(cosine: float):
    """(vec_id, links, root) for the members of a group that link: how many pairs met here first, and the least id they reach here.

    In a window (``other`` is the block itself) a block's own rows are compared with each other and with the following
    block's (``own`` false). In a tile, the rows of a run in one block are compared with those in a block further on. So a
    pair meets in a pass when its places lie in the same or neighbouring blocks or its prefixes agree; each vector brings
    its blocks and prefixes of all passes, and a pair that met in an earlier pass is told apart and counted there alone.
    A row stands for ``n`` equal vectors and counts as many. Pairs themselves never leave the group.
    """

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = np.array(table.column("vec_id").to_pylist(), np.int64)
        n = np.array(table.column("n").to_pylist(), np.int64)
        own = np.array(table.column("own").to_pylist(), bool)
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        blocks, prefixes = (np.array(table.column(c).to_pylist(), np.int64) for c in ("blocks", "prefixes"))
        now, tile = table.column("pass")[0].as_py(), table.column("block")[0].as_py() != table.column("other")[0].as_py()
        links, label, linked = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        first = np.flatnonzero(own)
        for a in range(0, len(first), 512):
            rows = first[a : a + 512]
            near = x[rows] @ x.T >= cosine - 1e-9
            near &= ~own[None, :] if tile else ~own[None, :] | (ids[rows][:, None] < ids[None, :])
            i, j = np.nonzero(near)
            i = rows[i]
            keep = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 50_000]], x[j[k : k + 50_000]]) >= cosine for k in range(0, len(i), 50_000)]) if len(i) else np.zeros(0, bool)
            i, j = i[keep], j[keep]
            fresh = np.ones(len(i), bool)
            for q in range(now):
                fresh &= (np.abs(blocks[i, q] - blocks[j, q]) > 1) & (prefixes[i, q] != prefixes[j, q])
            np.add.at(links, i[fresh], n[j[fresh]])
            np.add.at(links, j[fresh], n[i[fresh]])
            linked[i] = linked[j] = True
            _merge(label, i, j)
        at = np.flatnonzero(linked)
        if len(at):
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(least[label[at]])], ["vec_id", "links", "root"])

    return run


def block_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block: int = 1024, seed: int = 5) -> DataFrame:
    """(vec_id, links, root) by group and pass; the links of a vector add up to those found, the roots tie its component together.

    Equal unit vectors are one row of the passes, that of the least key, with their number; the others take over its links.
    Every pass orders the rows by the bits of its own random projections, concatenated, then by key. The order is cut
    into blocks of ``block`` rows; each row is compared with its block and the whole next one, so a window reaches between
    one and two blocks. A run of equal leading bits (:func:`prefix_bits`) that is longer than a window is compared whole,
    by pairs of its blocks, so that dense groups lose no pair that the number of passes (:func:`passes_needed`) counts on.
    Only hashes and keys are sorted: global places are places within a range partition plus the counts of the partitions
    before it.
    """
    base = vectors.selectExpr(f"cast(`{key}` as long) as vec_id", f"cast(`{vector}` as array<double>) as v").where("vec_id is not null and v is not null")
    coded = base.mapInArrow(_units(cosine), "vec_id long, dim int, unit binary, alike boolean")
    units = stage(coded.groupBy("vec_id").agg(F.min(F.struct("dim", "unit", "alike")).alias("s")).select("vec_id", "s.dim", "s.unit", F.when(~F.col("s.alike"), F.col("vec_id")).alias("apart")), "vectors")
    copies = stage(units.groupBy("dim", "unit", "apart").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")).select("vec_id", "n", "dim", "unit"), "copies")
    rows = copies.count()
    passes, bits = passes_needed(rows, block, cosine), prefix_bits(rows, block)
    whole = stage(copies.mapInArrow(_codes(passes, seed), "vec_id long, n long, dim int, unit binary, codes array<long>"), "coded")
    order = ["pass", "dim", "hash", "vec_id"]
    prefix = lambda c: F.shiftright(c, BITS - bits)
    thin = whole.select("vec_id", "dim", F.posexplode("codes").alias("pass", "hash"))
    sorted_rows = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "dim", "vec_id", prefix("hash").alias("prefix"))
    ranked = stage(sorted_rows.mapInArrow(_number, "part int, at long, pass int, dim int, vec_id long, prefix long"), "sorted")
    #: One row per partition, pass and dimension: as many as there are tasks, not as there are vectors.
    counts = ranked.groupBy("pass", "dim", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    before = W.partitionBy("pass", "dim").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).drop("n", "from"), "starts")
    placed = ranked.join(starts, ["pass", "dim", "part"]).select("vec_id", "pass", "dim", "prefix", F.floor((F.col("at") + F.col("start")) / block).cast("long").alias("block"))
    runs = stage(placed.groupBy("pass", "dim", "prefix").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("hi - lo > 1"), "runs")
    known = placed.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "block"))), lambda s: s["block"]).alias("blocks"))
    told = whole.withColumn("prefixes", F.transform("codes", prefix)).drop("codes").join(known, "vec_id")
    each = told.select("vec_id", "n", "dim", "unit", "blocks", "prefixes", F.posexplode(F.arrays_zip("blocks", "prefixes")).alias("pass", "z")).withColumn("prefix", F.col("z.prefixes")).withColumn("b", F.col("z.blocks"))
    b = F.col("b")
    pair = lambda low, high, own: F.struct(low.alias("block"), high.alias("other"), own.alias("own"))
    window = F.filter(F.array(pair(b, b, F.lit(True)), pair(b - 1, b - 1, F.lit(False))), lambda s: s["block"] >= 0)
    tiles = F.transform(F.filter(F.sequence("lo", "hi"), lambda o: F.abs(o - b) > 1), lambda o: pair(F.least(o, b), F.greatest(o, b), b < o))
    columns = ["pass", "dim", F.col("w.block").alias("block"), F.col("w.other").alias("other"), F.col("w.own").alias("own"), "vec_id", "n", "unit", "blocks", "prefixes"]
    dealt = each.withColumn("w", F.explode(window)).select(*columns).union(each.join(runs, ["pass", "dim", "prefix"]).withColumn("w", F.explode(tiles)).select(*columns))
    met = stage(map_groups(dealt, ["pass", "dim", "block", "other"], _compare(cosine), "vec_id long, links long, root long"), "met")
    total = met.groupBy(F.col("vec_id").alias("root")).agg(F.sum("links").alias("links"))
    many = copies.where("n > 1").withColumnRenamed("vec_id", "root").join(total, "root", "left")
    copied = units.where("apart is null").select("vec_id", "dim", "unit").join(realign(many, "dim", "unit"), ["dim", "unit"])
    return met.union(copied.select("vec_id", (F.col("n") - 1 + F.when(F.col("vec_id") != F.col("root"), F.coalesce("links", F.lit(0))).otherwise(0)).alias("links"), "root"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block: int = 1024, seed: int = 5) -> DataFrame:
    """Links and components of vectors: (vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    ``n_links`` counts the other vectors linked directly (cosine >= ``cosine`` in double precision, found by
    :func:`block_links`), ``component_id`` is the smallest vec_id reachable by links, and the vector with that id is
    ``kept``. Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths don't link. Rows that share a vec_id are one vector, of unlike ones the least. A null vec_id links
    with nothing, has a null component and is kept. Empty tables give an empty result; other columns are ignored.
    """
    found = stage(block_links(vectors, key, vector, cosine, block, seed), "links")
    degree = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("n_links"))
    labels = connected_components(found.select("vec_id", "root"))
    known = degree.join(labels, "node", "left").withColumnRenamed("node", "of")
    return vectors.select(F.col(key).cast("long").alias("vec_id")).join(realign(known, "of"), F.col("vec_id") == F.col("of"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
