"""Packing tokenised documents into sequences by the online sum-of-squares rule."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomgraph.llm.grouped import map_batches

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Fixed value of the byte-level vocabularies: the pattern that splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, the rest follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """An encoder with the ids of the ``tokenizers`` file at ``path`` (byte-level BPE, special strings included).

    The vocabulary is run by ``tiktoken``, which gives the same ids several times faster; tests hold the two
    against each other. A file whose merges don't follow its ids is run by ``tokenizers`` itself.
    """
    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x.get("special")}
    joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
    plain = all(set(t) <= set(letters) for t in vocab if t not in special)
    ids = [vocab.get(t, -1) for t in joined]
    if not plain or ids != sorted(ids) or -1 in ids or spec.get("normalizer"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    enc = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(enc.encode_to_numpy(text, allowed_special="all"), np.uint32)


class SumOfSquares:
    """Fill levels of open windows: ``count[h]`` windows are filled to h, and each remembers its pieces.

    A piece of s tokens goes to the level h, or to a new window, for which the sum of count[h]**2 over the
    partly filled levels 1..capacity-1 becomes smallest; among equals to the fullest level. One vector
    operation over the level array finds it.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def level(self, s: int) -> int:
        c, top = self.count, self.capacity - s
        #: Change by taking a window from level h (0: none) and adding one to h + s (capacity: closed).
        change = 2 * c[s : self.capacity + 1] + 1
        if top:
            change[1:] -= 2 * c[1 : top + 1] - 1
            change[1:][c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[top] = -2 * c[top] + 1 if top and c[top] else (0 if not top else np.iinfo(np.int64).max)
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def place(self, piece: list, s: int) -> list | None:
        """Put a piece into a window; the window if that fills it."""
        h = self.level(s)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append(piece)
        if h + s == self.capacity:
            return window
        self.count[h + s] += 1
        self.open[h + s].append(window)
        return None

    def rest(self) -> list[list]:
        """Open windows, the fullest first."""
        return [w for h in range(self.capacity - 1, 0, -1) for w in self.open[h]]


def settle(windows: list[list], capacity: int, least: int) -> list[list]:
    """Close the gaps of the windows left open at the end: the emptiest are taken apart to fill the fullest.

    ``windows`` are lists of (doc_id, start, ids, doc_tokens), the fullest first. Pieces are cut to fit, but a
    gap of fewer than ``least`` tokens stays.
    """
    sizes = [sum(len(p[2]) for p in w) for w in windows]
    i, j = 0, len(windows) - 1
    while i < j:
        gap = capacity - sizes[i]
        if gap < least:
            i += 1
            continue
        piece = windows[j].pop()
        n = len(piece[2])
        take = min(gap, n)
        windows[i].append([piece[0], piece[1], piece[2][:take], piece[3]])
        if take < n:
            windows[j].append([piece[0], piece[1] + take, piece[2][take:], piece[3]])
        sizes[i] += take
        sizes[j] -= take
        if not windows[j]:
            j -= 1
    return [w for w in windows if w]


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], capacity: int = 2048, least: int = 64) -> Iterator[list]:
    """Windows of pieces (doc_id, start, ids, doc_tokens) from a stream of documents' ids.

    Whole windows are cut off a long document; what remains of it is placed by the sum-of-squares rule. Only
    open windows are held: at most a few per level.
    """
    levels = SumOfSquares(capacity)
    for doc_id, ids in docs:
        n, at = len(ids), 0
        while n - at >= capacity:
            yield [[doc_id, at, ids[at : at + capacity], n]]
            at += capacity
        if n > at:
            full = levels.place([doc_id, at, ids[at:].copy(), n], n - at)
            if full:
                yield full
    yield from settle(levels.rest(), capacity, least)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end_id: int = 1, least: int = 64
) -> DataFrame:
    """Pieces (PIECE) of all documents in sequences of at most ``capacity`` tokens, with their ids.

    A document is its tokens and ``end_id``. Every task packs its own partition in one pass: no shuffle, and
    only its open windows in memory. Each id lies in exactly one piece; sequence ids hold the partition in
    their upper bits; offsets are gapless. ``ids`` are little-endian unsigned 32-bit. Null and empty texts are
    documents of one token; repeated rows are packed each; null keys stay null; other columns are ignored;
    an empty table gives no pieces.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [*[pa.int64()] * 6, pa.binary()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def stream() -> Iterator[tuple[int | None, np.ndarray]]:
            for part in parts:
                keys = part.column(0).to_pylist()
                for doc_id, body in zip(keys, part.column(1)):
                    body = body.as_py()
                    ids = encode(body) if body else np.zeros(0, np.uint32)
                    yield doc_id, np.append(ids, np.uint32(end_id)).astype("<u4")

        rows, held = [], 0
        for k, window in enumerate(pack_stream(stream(), capacity, least)):
            offset = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids), n, first + k, offset, ids.tobytes()))
                offset += len(ids)
            held += offset
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_batches(docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text"), run, PIECE)
