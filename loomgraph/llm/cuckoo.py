"""Exact deduplication through an index of cuckoo filters over sharded digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.grouped import map_groups
from loomgraph.llm.shared import numbered, realign, stage

SPACES = r"[\x20\x09-\x0D]"


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over live digests, with their stored keys in buckets.

    A digest (32 bytes) has two buckets: one from its own bits, the other reached by the hash of its
    fingerprint. ``find`` asks the filter first; a hit is verified against the keys stored with the
    bucket, so that equal fingerprints never merge different digests. ``delete`` frees the slot.
    When an insertion finds no slot within ``kicks`` moves, the number of buckets doubles and the
    filter is rebuilt from the stored keys: nothing is lost and no false negative can occur.
    """

    slots = 4

    def __init__(self, buckets: int = 64, kicks: int = 200) -> None:
        self.size = 1 << max(2, (buckets - 1).bit_length())
        self.kicks = kicks
        self.table: list[list[int]] = [[] for _ in range(self.size)]
        self.stored: dict[int, dict[bytes, object]] = {}
        self.resizes = 0
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E9955BD1E995 >> 7)) & (self.size - 1)

    @staticmethod
    def _content(digest: bytes) -> int:
        """The content bucket of a key: by its own bits, so that resizing the filter does not move it."""
        return int.from_bytes(digest[10:13], "little")

    def maybe(self, digest: bytes) -> bool:
        """The filter's own answer: false positives are possible, false negatives are not."""
        mark, one, two = self._places(digest)
        return mark in self.table[one] or mark in self.table[two]

    def find(self, digest: bytes) -> object | None:
        if not self.maybe(digest):
            return None
        return self.stored.get(self._content(digest), {}).get(digest)

    def insert(self, digest: bytes, value: object) -> bool:
        """Add a digest or, when it is live, replace its value; true if it was new. The stored keys are asked on a hit only."""
        bucket = self.stored.setdefault(self._content(digest), {})
        fresh = not self.maybe(digest) or digest not in bucket
        bucket[digest] = value
        if fresh:
            self.live += 1
            if not self._place(digest):
                self._grow()
        return fresh

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; false, and nothing changes, if it is not live."""
        content = self._content(digest)
        bucket = self.stored.get(content, {})
        if digest not in bucket:
            return False
        del bucket[digest]
        if not bucket:
            del self.stored[content]
        mark, one, two = self._places(digest)
        self.table[one if mark in self.table[one] else two].remove(mark)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.stored.values():
            yield from bucket.items()

    def _place(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for at in (one, two):
            if len(self.table[at]) < self.slots:
                self.table[at].append(mark)
                return True
        at = two
        for k in range(self.kicks):
            row = self.table[at]
            mark, row[k % self.slots] = row[k % self.slots], mark
            at = self._other(at, mark)
            if len(self.table[at]) < self.slots:
                self.table[at].append(mark)
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.size *= 2
            self.resizes += 1
            self.table = [[] for _ in range(self.size)]
            if all(self._place(digest) for digest, _ in self.items()):
                return


#: An index entry: how many rows have the digest, and the row that stays (length, doc_id, row, rows equal in both).
ENTRY = "digest binary, n long, length long, doc_id long, row long, ties long"


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (n, length, doc_id, row, ties) of one digest: the longer text, then smaller doc_id (null last), then row."""
    rank = lambda x: (-x[1], x[2] is None, x[2] or 0)
    first = a if (rank(a), a[3]) <= (rank(b), b[3]) else b
    return (a[0] + b[0], *first[1:4], a[4] + b[4] if rank(a) == rank(b) else first[4])


def _fold(index: CuckooIndex, columns: list[list]) -> None:
    for digest, *entry in zip(*columns):
        old = index.find(digest)
        index.insert(digest, tuple(entry) if old is None else _better(old, tuple(entry)))


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = [(digest, *entry) for digest, entry in index.items()]
    types = (pa.binary(), *[pa.int64()] * 5)
    for at in range(0, len(rows), 10_000):
        cols = list(zip(*rows[at : at + 10_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "n", "length", "doc_id", "row", "ties"])


def _fold_part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold a partition's rows, so that a hot digest leaves it once; full indexes are passed on early."""
    index = CuckooIndex(1 << 12)
    for part in parts:
        _fold(index, [part.column(c).to_pylist() for c in ("digest", "n", "length", "doc_id", "row", "ties")])
        if index.live > 200_000:
            yield from _entries(index)
            index = CuckooIndex(1 << 12)
    yield from _entries(index)


def _fold_shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex(max(64, table.num_rows // 3))
    _fold(index, [table.column(c).to_pylist() for c in ("digest", "n", "length", "doc_id", "row", "ties")])
    yield from _entries(index)


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """Index entries (ENTRY) of rows in the form of entries: folded in each partition, then in each shard of digests."""
    folded = rows.select("digest", "n", "length", "doc_id", "row", "ties").mapInArrow(_fold_part, ENTRY)
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 14, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return map_groups(folded.withColumn("shard", shard), ["shard"], _fold_shard, ENTRY)


def update_index(entries: DataFrame, added: DataFrame, removed: DataFrame, live: DataFrame, shards: int) -> DataFrame:
    """The index after a batch: entries of ``added`` rows go in, ``removed`` rows come out; ``live`` are all rows that are left.

    All rows are in the form of :func:`digest_rows`. A digest is deleted when its last row goes. Entries, added and
    removed rows are dealt by shard; in each, deletions run on the live filter. Where the row that stays is among those
    removed, the best of the digest's live rows takes its place; only digests for which that is so are looked up among
    them. Removing more rows than are live deletes the digest; removing an unknown digest changes nothing.
    """
    tag = lambda df, k: df.withColumn("what", F.lit(k))
    columns = ["digest", "n", "length", "doc_id", "row", "ties"]
    gone = removed.groupBy("digest", "length", "doc_id").agg(F.sum("n").alias("n")).select("digest", "n", "length", "doc_id", *[F.lit(None).cast("long").alias(c) for c in ("row", "ties")])
    together = tag(entries, 0).unionByName(tag(added.select(columns).mapInArrow(_fold_part, ENTRY), 0)).unionByName(tag(gone, 1))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 14, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")

    def apply(table: pa.Table) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(max(64, table.num_rows // 3))
        what = table.column("what")
        _fold(index, [table.filter(pc.equal(what, 0)).column(c).to_pylist() for c in columns])
        out = table.filter(pc.equal(what, 1))
        for digest, n, length, doc_id in zip(*(out.column(c).to_pylist() for c in columns[:4])):
            old = index.find(digest)
            if old is None:
                continue
            if old[0] <= n:
                index.delete(digest)
            else:
                #: Without ties the entry has lost the row that stays.
                index.insert(digest, (old[0] - n, *old[1:4], 0 if old[1:3] == (length, doc_id) else old[4]))
        yield from _entries(index)

    after = stage(map_groups(together.withColumn("shard", shard), ["shard"], apply, ENTRY), "index")
    lost = after.where("ties = 0").select("digest")
    return after.where("ties > 0").unionByName(build_index(live.join(lost, "digest", "left_semi"), shards))


def digest_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Rows in the form of index entries: SHA-256 of the text without white space, code points, key, row number (of column ``row`` if given)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.unhex(F.sha2(F.regexp_replace(body, SPACES, ""), 256)).alias("digest"),
        F.lit(1).cast("long").alias("n"),
        F.length(body).cast("long").alias("length"),
        F.col(key).cast("long").alias("doc_id"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.lit(1).cast("long").alias("ties"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_rows: int = 50_000, row: str | None = None) -> DataFrame:
    """Classes of equal texts: one row per document with the document that stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256, ties, keep_length, row); ``row`` may name a column that numbers the rows. Texts are equal when their SHA-256
    without ASCII white space is (the stored key a filter hit is verified against); the text with most
    code points stays, then the smallest doc_id. Null text counts as empty, so null, empty and blank texts
    are one class. A null doc_id stays only if all of its class are null. Of repeated rows exactly one is
    ``kept``; ``ties`` counts the rows of the class that have the same length and doc_id as that one. An
    empty table gives an empty result; other columns are ignored.

    The number of shards follows the number of rows, so a shard's index stays bounded; a hot digest reaches
    its shard once per map task. The join back splits its rows by adaptive execution.
    """
    rows = stage(digest_rows(docs, text, key, row), "digests")
    shards = max(1, -(-rows.count() // shard_rows))
    best = build_index(rows, shards).select("digest", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("ties"), F.col("length").alias("keep_length"))
    return rows.select("digest", "doc_id", "row").join(realign(best, "digest"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "ties", "keep_length", "row"
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that exact deduplication keeps, with their own columns; of repeated rows one stays."""
    rows, row = numbered(docs)
    kept = exact_dedup(rows, text, key, row=row).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)
