"""Sums along the steps of a graph for many sources at once, in blocks of nodes and of steps.

Nodes are dense numbers, dealt by ranges into parts; the steps into a part are dealt by ranges of where they start into
blocks of bounded size. A hot node's steps so lie in many blocks, whichever way they point. In a round each part sends a
node's values once to each block that has steps from it, a block sums them by node and source, and the part adds up the
sums of its blocks. Values travel as arrays, so a step and source cost no row of Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.checkpoint import cut, discard

#: Nodes of a part, pairs of a node and a source of a part, and such pairs that may arrive at a block, about.
_NODES, _PAIRS, _ARRIVING = 1 << 15, 1 << 22, 1 << 24

#: Pairs of a step and a source that a block spreads at a time.
_SPREAD = 1 << 21

#: Up to so many parts, blocks or links between them are named in plans, so that scans leave the rest unread.
_NAMED = 1_000

_TYPES = {
    "task": pa.int32(), "part": pa.int32(), "block": pa.int64(), "s": pa.int32(), "v": pa.int64(), "round": pa.int32(), "sigma": pa.float64(), "share": pa.float64(), "delta": pa.float64(),
    "src": pa.binary(), "ptr": pa.binary(), "to": pa.binary(), "want": pa.binary(), "at": pa.binary(), "x": pa.binary(), "seen": pa.binary(),
}
_NAMES = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.binary(): "binary"}


def _schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` {_NAMES[_TYPES[c]]}" for c in columns)


def _table(columns: list[str], n: int, **given: object) -> pa.Table:
    """``n`` rows of the columns, null where not given; one value stands for all rows."""
    put = lambda c: pa.array(v if isinstance(v := given[c], (list, np.ndarray)) else [v] * n, _TYPES[c]) if c in given else pa.nulls(n, _TYPES[c])
    return pa.table({c: put(c) for c in columns})


def _rows(table: pa.Table, column: str) -> pa.Table:
    """The rows that have the column; rows of several kinds come in one table."""
    return table.filter(pc.is_valid(table[column]))


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The arrays of all rows, one after the other."""
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table[column]] or [np.empty(0, kind)])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _added(keys: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (all under ``most``) and the sum of each; values are positive."""
    if len(keys) * 8 < most:
        own, at = np.unique(keys, return_inverse=True)
        return own, np.bincount(at, x, len(own))
    total = np.bincount(keys, x, most)
    own = np.flatnonzero(np.bincount(keys, minlength=most) if not total[keys].all() else total)
    return own, total[own]


@dataclass(frozen=True)
class Blocks:
    """Steps in blocks. ``links`` has the blocks that a part sends to, or is None if these are too many to be named."""

    size: int
    sources: int
    steps: DataFrame
    wanted: DataFrame
    links: dict[int, set[int]] | None
    table: DataFrame

    def ahead(self, parts: Iterable[int]) -> set[int] | None:
        """Blocks that these parts send to; a block's number shifted by 32 is its part."""
        return None if self.links is None else {b for p in parts for b in self.links.get(p, ())}

    def summed(self, rows: DataFrame, value: str, parts: Iterable[int], blocks: set[int] | None) -> DataFrame:
        """(part, at, x): for rows (part, s, v, value) of ``parts``, sums over the steps into ``blocks``; the same pair may come from several blocks."""
        size, sources, spread = self.size, self.sources, _SPREAD

        def send(table: pa.Table) -> pa.Table:
            own, wanted = _rows(table, "v"), _rows(table, "want")
            if not own.num_rows or not wanted.num_rows:
                return _table(["block", "at", "x"], 0)
            part = own["part"][0].as_py()
            keys = (own["v"].to_numpy() - part * size) * sources + own["s"].to_numpy()
            order = np.argsort(keys)
            keys, x = keys[order], own[value].to_numpy()[order]
            count = np.bincount(keys // sources, minlength=size)
            first, out = np.cumsum(count) - count, []
            for block, want in zip(wanted["block"].to_pylist(), wanted["want"]):
                nodes = np.frombuffer(want.as_buffer(), np.int32)
                nodes = nodes[count[nodes] > 0]
                if len(nodes):
                    at = _ranges(first[nodes], count[nodes])
                    out.append((block, (keys[at] + part * size * sources).tobytes(), x[at].tobytes()))
            return _table(["block", "at", "x"], len(out), **dict(zip(("block", "at", "x"), map(list, zip(*out)))))

        def gather(table: pa.Table) -> pa.Table:
            got, steps = _rows(table, "at"), _rows(table, "to")
            if not got.num_rows or not steps.num_rows:
                return _table(["part", "at", "x"], 0)
            at, x = _joined(got, "at", np.int64), _joined(got, "x", np.float64)
            src, ptr, to = _joined(steps, "src", np.int64), _joined(steps, "ptr", np.int32).astype(np.int64), _joined(steps, "to", np.int32).astype(np.int64) * sources
            place = np.searchsorted(src, at // sources)
            s, first, count = at % sources, ptr[place], ptr[place + 1] - ptr[place]
            upto, sums = np.cumsum(count), []
            cuts = np.searchsorted(upto, np.arange(spread, upto[-1] + spread, spread)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if len(n := count[a:b]):
                    sums.append(_added(to[_ranges(first[a:b], n)] + np.repeat(s[a:b], n), np.repeat(x[a:b], n), size * sources))
                if len(sums) > 8:
                    sums = [_added(*map(np.concatenate, zip(*sums)), size * sources)]
            keys, x = sums[0] if len(sums) == 1 else _added(*map(np.concatenate, zip(*sums)), size * sources)
            return _table(["part", "at", "x"], 1, part=table["block"][0].as_py() >> 32, at=[keys.tobytes()], x=[x.tobytes()])

        asked = named(named(self.wanted, "part", parts), "block", blocks)
        sent = together(["part", "s", "v", value, "block", "want"], named(rows, "part", parts), asked).groupBy("part").applyInArrow(send, _schema(["block", "at", "x"]))
        return together(["block", "at", "x", "src", "ptr", "to"], sent, named(self.steps, "block", blocks)).groupBy("block").applyInArrow(gather, _schema(["part", "at", "x"]))


def named(rows: DataFrame, column: str, values: Iterable[int] | None) -> DataFrame:
    """The rows with these values, or all where they are too many to be named: the others then find no partner."""
    few = None if values is None else sorted(values)
    return rows if few is None or len(few) > _NAMED else rows.where(F.col(column).isin(few))


def together(columns: list[str], *frames: DataFrame) -> DataFrame:
    """Rows of several kinds in one table, with nulls for columns that a kind has not."""
    cast = lambda f, c: F.col(c) if c in f.columns else F.lit(None).cast(_NAMES[_TYPES[c]]).alias(c)
    out, *more = [f.select(*(cast(f, c) for c in columns)) for f in frames]
    for f in more:
        out = out.unionByName(f)
    return out


def part_size(sources: int) -> int:
    return max(1, min(_NODES, _PAIRS // max(1, sources)))


def blocked(pairs: DataFrame, sources: int) -> Blocks:
    """Steps (from, to) between dense numbers, as blocks by the far end; written."""
    size, most = part_size(sources), max(1, _ARRIVING // max(1, sources))
    dealt = pairs.select("from", "to", F.expr(f"cast(`from` div {size} as int)").alias("a"), F.expr(f"cast(`to` div {size} as int)").alias("b"))
    #: One row per pair of parts.
    cells = cut(dealt.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "cells")
    first = F.expr(f"({{}} - n) div {most}".format("sum(n) over (partition by b order by a)"))
    blocks = cells.select("a", "b", first.alias("first"), F.ceil(F.col("n") / most).alias("chunks"))
    block = F.shiftleft(F.col("b").cast("long"), 32) + F.col("first") + F.pmod(F.xxhash64("from"), F.col("chunks"))
    columns = ["block", "part", "src", "ptr", "to", "want"]

    def pack(table: pa.Table) -> pa.Table:
        number = table["block"][0].as_py()
        a, b = table["from"].to_numpy(), table["to"].to_numpy()
        order = np.argsort(a, kind="stable")
        src, first = np.unique(a[order], return_index=True)
        to = (b[order] - (number >> 32) * size).astype(np.int32)
        parts, starts = np.unique(src // size, return_index=True)
        wants = [(nodes - p * size).astype(np.int32).tobytes() for p, nodes in zip(parts, np.split(src, starts[1:]))]
        steps = _table(columns, 1, block=number, src=[src.astype(np.int64).tobytes()], ptr=[np.append(first, len(a)).astype(np.int32).tobytes()], to=[to.tobytes()])
        return pa.concat_tables([steps, _table(columns, len(parts), block=number, part=parts.astype(np.int32), want=wants)])

    packs = cut(dealt.join(blocks, ["a", "b"]).select(block.alias("block"), "from", "to").groupBy("block").applyInArrow(pack, _schema(columns)), "blocks")
    discard(cells)
    wanted = packs.where("want is not null").select("part", "block", "want")
    found = wanted.select("part", "block").limit(_NAMED * _NAMED // 10 + 1).collect()
    links: dict[int, set[int]] | None = None
    if len(found) <= _NAMED * _NAMED // 10:
        links = {}
        for r in found:
            links.setdefault(r["part"], set()).add(r["block"])
    return Blocks(size, sources, packs.where("to is not null").select("block", "src", "ptr", "to"), wanted, links, packs)


def _keyed(table: pa.Table, value: str, size: int, sources: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Part, keys and values of rows (part, s, v, value)."""
    part = table["part"][0].as_py()
    return part, (table["v"].to_numpy() - part * size) * sources + table["s"].to_numpy(), table[value].to_numpy()


def fresh(size: int, sources: int, round_: int) -> Callable[[pa.Table], pa.Table]:
    """Of sums (part, at, x), or of first rows (part, s, v, sigma), those that no row of ``seen`` has: (part, s, v, sigma), and what is seen now."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        got, own, past = _rows(table, "at"), _rows(table, "v"), _rows(table, "seen")
        keys, x = _joined(got, "at", np.int64), _joined(got, "x", np.float64)
        if own.num_rows:
            keys, x = _keyed(own, "sigma", size, sources)[1:]
        if got.num_rows > 1 or own.num_rows:
            keys, x = _added(keys, x, size * sources)
        bits = np.zeros(size * sources, np.uint8)
        if past.num_rows:
            last = int(np.argmax(past["round"].to_numpy()))
            bits = np.unpackbits(np.frombuffer(past["seen"][last].as_buffer(), np.uint8), count=size * sources)
        new = bits[keys] == 0
        keys, x = keys[new], x[new]
        if not len(keys):
            return _table(LEVEL, 0)
        bits[keys] = 1
        level = _table(LEVEL, len(keys), part=np.full(len(keys), part, np.int32), s=(keys % sources).astype(np.int32), v=keys // sources + part * size, sigma=x)
        return pa.concat_tables([level, _table(LEVEL, 1, part=part, round=round_, seen=[np.packbits(bits).tobytes()])])

    return run


def returned(size: int, sources: int) -> Callable[[pa.Table], pa.Table]:
    """Brandes' dependencies of a level's rows (part, s, v, sigma) from the sums (part, at, x) of shares: (part, s, v, share, delta)."""

    def run(table: pa.Table) -> pa.Table:
        own, got = _rows(table, "v"), _rows(table, "at")
        if not own.num_rows:
            return _table(SHARE, 0)
        part, keys, sigma = _keyed(own, "sigma", size, sources)
        sums = np.zeros(size * sources)
        for at, x in zip(got["at"], got["x"]):
            sums[np.frombuffer(at.as_buffer(), np.int64)] += np.frombuffer(x.as_buffer(), np.float64)
        delta = sigma * sums[keys]
        return _table(SHARE, len(keys), part=np.full(len(keys), part, np.int32), s=own["s"].to_numpy(), v=own["v"].to_numpy(), share=(1 + delta) / sigma, delta=delta)

    return run


def dependencies(steps: DataFrame, levels: list[DataFrame], size: int, nodes: int, sources: int) -> DataFrame:
    """(v, delta): Brandes' dependencies on all sources, summed by task, for a graph of few enough steps that a task may hold it.

    ``levels`` are the first levels, (s, v, sigma) each. A task has every so-manieth source and goes on from there with one after
    the other, both ways, without waiting for others.
    """
    spread = _SPREAD
    tasks = max(1, min(sources, steps.sparkSession.sparkContext.defaultParallelism))
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    rows = [level.select(F.expr(f"cast(s % {tasks} as int)").alias("task"), "s", "v", "sigma", F.lit(at).alias("round")) for at, level in enumerate(levels)]

    def held(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Where each node's steps begin, and to where they lead."""
        own = [(b >> 32, *(np.frombuffer(c.as_buffer(), k) for c, k in zip(row, (np.int64, np.int32, np.int32)))) for b, *row in zip(table["block"].to_pylist(), *(table[c] for c in ("src", "ptr", "to")))]
        ptr = np.zeros(nodes + 1, np.int64)
        for _, src, first, _ in own:
            ptr[src + 1] += np.diff(first)
        np.cumsum(ptr, out=ptr)
        to, free = np.empty(ptr[-1], np.int64 if nodes >> 31 else np.int32), ptr[:-1].copy()
        for part, src, first, ends in own:
            count = np.diff(first)
            to[_ranges(free[src], count)] = ends + part * size
            free[src] += count
        return ptr, to

    def run(table: pa.Table) -> pa.Table:
        first = _rows(table, "v")
        s, v, sigma, at = (first[c].to_numpy() for c in ("s", "v", "sigma", "round"))
        order = np.lexsort((at, s))
        s, v, sigma, at = s[order], v[order], sigma[order], at[order]
        ptr, to = held(_rows(table, "to"))
        del table, first, order
        dist, paths, share, score = np.empty(nodes, np.int32), np.empty(nodes), np.empty(nodes), np.zeros(nodes)

        def steps_of(level: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Nodes of the level, a slice at a time, with the place of each step's node among them and the step's end."""
            count = ptr[level + 1] - ptr[level]
            upto = np.cumsum(count)
            cuts = np.searchsorted(upto, np.arange(spread, upto[-1] + spread, spread)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(level)]):
                if len(n := count[a:b]):
                    yield level[a:b], np.repeat(np.arange(len(n)), n), to[_ranges(ptr[level[a:b]], n)]

        begin = np.flatnonzero(np.diff(s, prepend=-1))
        for a, b in zip(begin, [*begin[1:], len(s)]):
            dist.fill(-1)
            dist[v[a:b]], paths[v[a:b]] = at[a:b], sigma[a:b]
            found = np.split(v[a:b], np.flatnonzero(np.diff(at[a:b])) + 1)
            while len(found[-1]):
                new = []
                for nodes_, own, ends in steps_of(found[-1]):
                    unseen = ends[dist[ends] < 0]
                    dist[unseen], paths[unseen] = len(found), 0.0
                    new.append(np.unique(unseen))
                    on = dist[ends] == len(found)
                    np.add.at(paths, ends[on], paths[nodes_[own[on]]])
                found.append(np.concatenate(new))
            for depth in range(len(found) - 1, 0, -1):
                for nodes_, own, ends in steps_of(found[depth]) if len(found[depth]) else ():
                    on = dist[ends] == depth + 1
                    delta = paths[nodes_] * np.bincount(own[on], share[ends[on]], len(nodes_))
                    score[nodes_] += delta
                    share[nodes_] = (1 + delta) / paths[nodes_]
        some = np.flatnonzero(score)
        return _table(["v", "delta"], len(some), v=some, delta=score[some])

    dealt = together(["task", "s", "v", "sigma", "round", "block", "src", "ptr", "to"], *rows, steps.select(every, "block", "src", "ptr", "to")).repartitionById(tasks, "task")
    return dealt.groupBy("task").applyInArrow(run, _schema(["v", "delta"]))


LEVEL = ["part", "s", "v", "sigma", "round", "seen"]
SHARE = ["part", "s", "v", "share", "delta"]


def of_parts(columns: list[str], frames: list[DataFrame], run: Callable[[pa.Table], pa.Table], result: list[str]) -> DataFrame:
    """``run`` over the rows of each part."""
    return together(columns, *frames).groupBy("part").applyInArrow(run, _schema(result))
