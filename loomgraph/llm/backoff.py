"""Language-model scoring with a weighted backoff automaton of order three.

States are the n-grams of up to two tokens that occur in the training texts, and the root. A state has an arc for
each token seen after it and one failure arc to the state of its last token (of one token: to the root). With N
occurrences of a state, n of them before a token, a prior of k pseudo-counts and the next shorter state's probability
p of the token, the arc weighs (n + k * p) / (N + k) and the failure arc k / (N + k), so that the probabilities of a
state sum to one. The root has an arc for every word, and one for unknown words: (n + 1) / (tokens + types + 1).
No n-gram is left out and no table is broadcast: counts are those of the whole training fold.

The automaton is never in one place. Texts are cut into chunks of whole texts; each chunk asks for the counts of the
distinct n-grams of its texts, sorted by hash and cut into buckets. A bucket adds up what all chunks hold of its
n-grams and answers each. So a chunk holds the part of the automaton that its texts can reach, and walks through each
of them once from left to right. N-grams are told by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import textkit
from loomgraph.llm.grouped import map_batches, map_groups
from loomgraph.llm.shared import stage

END = np.uint64(0x0E0D0E0D0E0D0E0D)  # stands for the end of a text; no word has this hash but by chance
START = np.uint64(0x57A2757A2757A275)  # stands for the start of a text before its first word

_ASKED = "kind int, bucket int, chunk long, prefixes binary, low binary, seen binary"
_TOLD = "chunk long, kind int, bucket int, body binary, tokens long, types long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each closed by END, and their counts."""
    words, counts = textkit.word_hashes(texts)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def _follow(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its head and its last token."""
    return textkit.mix(before * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(last))


def _shift(x: np.ndarray, firsts: np.ndarray, first: np.uint64 | int) -> np.ndarray:
    """What stands one token before each; ``first`` before the first token of a text."""
    out = np.roll(x, 1)
    out[firsts] = first
    return out


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(np.concatenate([c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]).tobytes(), 1)


def _unpack(body: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw]


def _cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The buckets (bucket, begin, end) of sorted hashes; a bucket has the hashes with equal leading ``bits``."""
    if not len(keys):
        return []
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]))


def _shorten(keys: np.ndarray, bucket: int, bits: int) -> tuple[bytes, bytes]:
    """Sorted hashes of a bucket in six bytes each: how many have each value of the two leading bytes, and the rest."""
    rest = max(0, 16 - bits)
    lead = (keys >> np.uint64(48)).astype(np.int64) - ((bucket << rest) if bits <= 16 else bucket >> (bits - 16))
    return _pack(np.bincount(lead, minlength=1 << rest)), keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _lengthen(prefixes: bytes, low: bytes, bucket: int, bits: int) -> np.ndarray:
    rest = max(0, 16 - bits)
    full = np.zeros((len(low) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    lead = np.repeat(np.arange(1 << rest), _unpack(prefixes, 1)[0]) + ((bucket << rest) if bits <= 16 else bucket >> (bits - 16))
    return full.view(np.uint64).ravel() | (lead.astype(np.uint64) << np.uint64(48))


def split_rows(docs: DataFrame, text: str, key: str, folds: int, held: int) -> DataFrame:
    """(doc_id, held_out, text); a null doc_id is never held out."""
    code = F.crc32(F.col(key).cast("string").cast("binary"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(code % folds == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))


def _chunks(limit: int):
    """Rows gathered to chunks of about ``limit`` characters, as compressed Arrow streams; a longer text is one of its own."""
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        size = sum(len(x) for x in table.column("text").to_pylist() if x)
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["size", "body"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            texts = part.column(2).to_pylist()
            for a, b in textkit.batches(texts, 1 << 20):
                more = sum(len(x) for x in texts[a:b] if x)
                if held and size + more > limit:
                    yield out(held)
                    held, size = [], 0
                held.append(part.slice(a, b - a))
                size += more
        if held:
            yield out(held)

    return run


@dataclass
class Grams:
    """The n-grams of one kind in a chunk: distinct hashes in order, which of them ends at each token (-1: none), and
    how often they occur in the chunk's training texts and in its held-out ones."""

    keys: np.ndarray
    at: np.ndarray
    train: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, train: np.ndarray, where: np.ndarray | None = None) -> Grams:
        keys, at = np.unique(hashes if where is None else hashes[where], return_inverse=True)
        learnt = train if where is None else train[where]
        both, own = np.bincount(at, minlength=len(keys)), np.bincount(at[learnt], minlength=len(keys))
        if where is not None:
            full = np.full(len(hashes), -1)
            full[where] = at
            at = full
        return cls(keys, at, own, both - own)

    def ask(self, kind: int, chunk: int, bits: int) -> Iterator[pa.RecordBatch]:
        cuts = _cut(self.keys, bits)
        for some in (cuts[i : i + 64] for i in range(0, len(cuts), 64)):
            bodies = [(*_shorten(self.keys[i:j], b, bits), _pack(self.train[i:j], self.held[i:j])) for b, i, j in some]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([b for b, _, _ in some], pa.int32()), pa.array([chunk] * n, pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*bodies)]],
                ["kind", "bucket", "chunk", "prefixes", "low", "seen"],
            )

    def hear(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By distinct n-gram, its occurrences in all training texts and in all held-out ones."""
        told = [_unpack(answers[b], 2) for b in sorted(answers)]
        if not told:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*told))  # type: ignore[return-value]


class Chunk:
    """Whole texts with the tokens and n-grams of up to two tokens in them."""

    def __init__(self, body: bytes) -> None:
        rows = pa.ipc.open_stream(body).read_all()
        self.doc_ids, self.held_out = rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks()
        texts = rows.column("text").to_pylist()
        parts = [_tokens(texts[a:b]) for a, b in textkit.batches(texts)]
        self.tokens, self.counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.firsts = np.cumsum(self.counts) - self.counts
        self.train = ~np.repeat(np.array(self.held_out.to_pylist(), bool), self.counts)
        self.pairs = _follow(_shift(self.tokens, self.firsts, START), self.tokens)
        self.words, self.twos = Grams.of(self.tokens, self.train), Grams.of(self.pairs, self.train)

    def triples(self, of_pair: np.ndarray, in_all: np.ndarray) -> tuple[Grams, np.ndarray, np.ndarray]:
        """N-grams of three tokens with what is known of them: which have to be asked for, and the training occurrences of the others.

        ``of_pair`` and ``in_all`` are, by token, the occurrences of the pair that ends there in training texts and in all
        texts. A triple occurs no more often than its two pairs: not in training where one of them does not, and in no
        other chunk where one of them has no other occurrence than this chunk's triples. The first token has no triple.
        """
        head = _shift(_shift(self.tokens, self.firsts, START), self.firsts, START)
        hashes = _follow(head, self.pairs)
        inner = np.ones(len(hashes), bool)
        inner[self.firsts] = False
        possible = inner & (np.minimum(_shift(of_pair, self.firsts, 0), of_pair) > 0)
        grams = Grams.of(hashes, self.train, possible)
        #: Of one triple all pairs are the same, so any of its places tells the bound.
        bound = np.zeros(len(grams.keys), np.int64)
        bound[grams.at[possible]] = np.minimum(_shift(in_all, self.firsts, 0), in_all)[possible]
        return grams, grams.train + grams.held < bound, grams.train


def _ask_short(bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for chunk, body in zip(part.column(0).to_pylist(), part.column(1)):
                texts = Chunk(body.as_py())
                yield from texts.words.ask(1, chunk, bits)
                yield from texts.twos.ask(2, chunk, bits)

    return run


def _answer(bits: int):
    """Occurrences of a bucket's n-grams over all chunks, to each chunk that asked; tokens and types of single words once."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        chunks = table.column("chunk")
        keys = [_lengthen(p.as_py(), w.as_py(), bucket, bits) for p, w in zip(table.column("prefixes"), table.column("low"))]
        seen = [_unpack(s.as_py(), 2) for s in table.column("seen")]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        #: Sums of doubles are exact below 2**53.
        train, held = (np.bincount(at, weights=np.concatenate(x), minlength=len(found)).astype(np.int64) for x in zip(*seen))
        begin = 0
        for k, chunk in enumerate(chunks):
            mine = at[begin : begin + len(keys[k])]
            begin += len(keys[k])
            first = k == 0 and kind == 1
            row = [chunk.as_py(), kind, bucket, _pack(train[mine], held[mine]), int(train.sum()) if first else 0, int((train > 0).sum()) if first else 0]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["chunk", "kind", "bucket", "body", "tokens", "types"])

    return run


def _open(table: pa.Table) -> tuple[int, Chunk, np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
    """Of the rows of a chunk: its number, its texts, by token the training occurrences of the word and of the pair that ends
    there and all occurrences of the pair, and the answers on triples."""
    answers: dict[int, dict[int, bytes]] = {0: {}, 1: {}, 2: {}, 3: {}}
    for kind, bucket, body in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("body")):
        answers[kind][bucket] = body.as_py()
    texts = Chunk(answers[0][0])
    word, _ = texts.words.hear(answers[1])
    pair, pair_held = texts.twos.hear(answers[2])
    return table.column("chunk")[0].as_py(), texts, word[texts.words.at], pair[texts.twos.at], (pair + pair_held)[texts.twos.at], answers[3]


def _ask_long(bits: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, texts, _, pair, pair_all, _ = _open(table)
        grams, unknown, _ = texts.triples(pair, pair_all)
        yield from Grams(grams.keys[unknown], grams.at, grams.train[unknown], grams.held[unknown]).ask(3, chunk, bits)

    return run


@dataclass
class Automaton:
    """Weights of arcs in log10: ``tokens`` and ``types`` of the training texts, and the ``priors`` of states of one and two tokens."""

    tokens: int
    types: int
    priors: tuple[float, float]

    def root(self, word: np.ndarray) -> np.ndarray:
        return np.log10(word + 1.0) - math.log10(self.tokens + self.types + 1.0)

    def arc(self, order: int, seen: np.ndarray, state: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of an arc taken ``seen`` times from a state that occurs ``state`` times; ``below`` is the shorter state's weight."""
        k = self.priors[order - 1]
        return np.log10((seen + k * 10.0**below) / (state + k))

    def failure(self, order: int, state: np.ndarray) -> np.ndarray:
        k = self.priors[order - 1]
        return math.log10(k) - np.log10(state + k)

    def walk(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The weight of the path over each token: the arc of the longest state that has one, after the failure arcs to it.

        ``word``, ``pair`` and ``triple`` are the occurrences of what ends at the token, ``one`` and ``two`` those of the
        states of one and two tokens before it. A state that does not occur is not entered: its failure arc weighs nothing.
        """
        weight = self.root(word)
        for order, seen, state in ((1, pair, one), (2, triple, two)):
            weight = np.where(seen > 0, self.arc(order, seen, state, weight), self.failure(order, state) + weight)
        return weight


def _walk(model: Automaton):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, texts, word, pair, pair_all, answers = _open(table)
        grams, unknown, known = texts.triples(pair, pair_all)
        total = known.copy()
        if unknown.any():
            total[unknown] = grams.hear(answers)[0]
        triple = np.where(grams.at >= 0, total[grams.at], 0) if len(total) else np.zeros(len(word), np.int64)
        #: Every text starts once and ends once, and END is in every chunk.
        one = _shift(word, texts.firsts, word[texts.firsts[0] + texts.counts[0] - 1])
        two = _shift(pair, texts.firsts, 0)
        add = lambda x: np.add.reduceat(x, texts.firsts)
        yield pa.RecordBatch.from_arrays(
            [texts.doc_ids, texts.held_out, pa.array(texts.counts), pa.array(add((word > 0).astype(np.int64))), pa.array(add(model.root(word))), pa.array(add(model.walk(word, pair, triple, one, two)))],
            [x.split()[0] for x in _SCORED.split(", ")],
        )

    return run


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2, priors: tuple[float, float] = (100.0, 10.0), chunk: int = 1 << 23) -> DataFrame:
    """Scores of all documents under a model learned from those outside the held fold, whole texts:
    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text. ``base_score`` is the add-one
    unigram log10 probability, ``score`` that of the automaton's path. Null and empty texts are one end token; a null
    doc_id is in the training fold; repeated rows count each. Without training rows all counts are zero. An empty table
    gives an empty result; other columns are ignored.

    ``priors`` are the pseudo-counts of states of one and of two tokens. ``chunk`` is the number of characters of the
    texts that are walked together: memory follows it and the longest text, not the corpus. The number of buckets
    follows the corpus, so that a bucket's n-grams stay bounded too; a frequent n-gram reaches it once per chunk.
    """
    rows = split_rows(docs, text, key, folds, held)
    gathered = map_batches(rows, _chunks(chunk), "size long, body binary")
    chunks = stage(gathered.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / chunk))))
    texts = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "body")
    asked = map_batches(chunks.select("chunk", "body"), _ask_short(bits), _ASKED)
    told = stage(map_groups(asked, ["kind", "bucket"], _answer(bits), _TOLD), "told")
    seen = told.agg(F.sum("tokens"), F.sum("types")).first()
    model = Automaton(seen[0] or 0, seen[1] or 0, priors)
    short = texts.unionByName(told.drop("tokens", "types"))
    more = map_groups(short, ["chunk"], _ask_long(bits), _ASKED)
    told_more = stage(map_groups(more, ["kind", "bucket"], _answer(bits), _TOLD), "told")
    scored = map_groups(short.unionByName(told_more.drop("tokens", "types")), ["chunk"], _walk(model), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
