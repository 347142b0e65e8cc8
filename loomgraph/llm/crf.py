"""Language identification with a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import textkit
from loomgraph.llm.grouped import map_batches
from loomgraph.llm.shared import free_name, stage

GRAM_BITS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def _fold(code: np.ndarray) -> np.ndarray:
    """A bucket of the table of n-gram weights."""
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


@dataclass
class Features:
    """Features of the words of a batch: n-gram buckets (one per byte of a word, cut at ``starts``), two affix buckets
    per word, and places in the lexicon (-1: absent)."""

    grams: np.ndarray
    starts: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray


def features(texts: list[str | None], lexicon: np.ndarray) -> tuple[Features, np.ndarray]:
    """Features of all words, and the number of words of each text.

    N-grams are the three-byte windows of a word between blanks, A-Z lower-cased; affixes are the first and last
    four bytes of the word with its blank; the lexicon is looked up by word hash.
    """
    hashes, counts = textkit.word_hashes(texts)
    buf = _LOWER[np.frombuffer(b"  " + b" ".join(x.encode("utf-8", "replace") if x else b"" for x in texts) + b"     ", np.uint8)]
    starts, ends = textkit.word_spans(buf)
    wide = buf.astype(np.uint32)
    inside = buf != 0x20
    at = np.flatnonzero(inside)
    grams = _fold(wide[at - 1] | wide[at] << np.uint32(8) | wide[at + 1] << np.uint32(16))
    cut = np.cumsum(ends - starts) - (ends - starts)

    def run_of(i: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
        code, alive = np.zeros(len(i), np.uint32), np.ones(len(i), bool)
        for k in range(4):
            j = i + step * k
            alive &= (j < limit) if step > 0 else (j >= limit)
            code = np.where(alive, code * np.uint32(257) + wide[np.maximum(j, 0)] + np.uint32(1), code)
        return code

    prefix = _fold(run_of(starts, 1, ends) * np.uint32(3) + np.uint32(1))
    suffix = _fold(run_of(ends - 1, -1, starts) * np.uint32(3) + np.uint32(2))
    place = np.full(len(hashes), -1, np.int32)
    if len(lexicon):
        near = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        place = np.where(lexicon[near] == hashes, near, -1).astype(np.int32)
    return Features(grams, cut, np.stack([prefix, suffix], 1), place), counts


@dataclass
class Model:
    """Weights: ``grams`` and ``affixes`` by bucket and label, ``words`` by lexicon entry and label, ``moves`` between
    labels, ``begin`` by label."""

    labels: list[str]
    lexicon: np.ndarray
    grams: np.ndarray = field(default=None)
    affixes: np.ndarray = field(default=None)
    words: np.ndarray = field(default=None)
    moves: np.ndarray = field(default=None)
    begin: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        k = len(self.labels)
        if self.grams is None:
            self.grams = np.zeros((1 << GRAM_BITS, k), np.float32)
            self.affixes = np.zeros((1 << GRAM_BITS, k), np.float32)
            self.words = np.zeros((len(self.lexicon) + 1, k), np.float32)  # the last row stays 0: no entry
            self.moves, self.begin = np.zeros((k, k)), np.zeros(k)

    def scores(self, f: Features) -> np.ndarray:
        """Log potentials of words and labels."""
        if not len(f.starts):
            return np.zeros((0, len(self.labels)))
        out = np.add.reduceat(self.grams[f.grams], f.starts, axis=0).astype(np.float64)
        out += self.affixes[f.affixes[:, 0]]
        out += self.affixes[f.affixes[:, 1]]
        out += self.words[f.lexicon]
        return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, begin: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every word, expected moves (K, K) and expected first labels (K) of chains laid end to end.

    Chains are sorted by length, so that step t works on all chains longer than t with one matrix product. ``scores`` is
    overwritten; without ``expect``, as in prediction, the expected moves stay zero.
    """
    k = scores.shape[1]
    full = counts[counts > 0]
    if not len(full):
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k)
    first = np.cumsum(full) - full
    order = np.argsort(-full, kind="stable")
    heads, sizes = first[order], full[order]
    scores -= scores.max(axis=1, keepdims=True)
    local = np.exp(scores, out=scores)
    step = np.exp(moves - moves.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains with more than t words
    now = np.exp(begin - begin.max()) * local[heads]
    now /= now.sum(axis=1, keepdims=True)
    ahead[heads] = now
    for t in range(1, int(sizes[0])):
        n = alive[t]
        at = heads[:n] + t
        now = (now[:n] @ step) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    expected = np.zeros((k, k))
    for t in range(int(sizes[0]) - 2, -1, -1):
        n = alive[t + 1]
        at = heads[:n] + t
        onward = local[at + 1] * back[at + 1]
        now = onward @ step.T
        now /= now.sum(axis=1, keepdims=True)
        back[at] = now
        if not expect:
            continue
        pair = ahead[at][:, :, None] * step[None] * onward[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    prob = np.multiply(ahead, back, out=ahead)
    prob /= prob.sum(axis=1, keepdims=True)
    return prob, expected, prob[heads].sum(axis=0)


def train(texts: list[str], langs: list[str], epochs: int = 8, span: int = 24, rate: float = 0.15, decay: float = 1e-4, lexicon_words: int = 1 << 15, seed: int = 3) -> Model:
    """A model from labelled texts, by AdaGrad on the conditional likelihood of label sequences.

    Each training chain joins up to three spans of words from different texts, so that the moves between labels
    are learned from switches as well as from staying.
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    pieces, gold = [], []
    for text, lang in zip(texts, langs):
        words = text.split()
        for a in range(0, len(words), span):
            pieces.append(" ".join(words[a : a + span]))
            gold.append(number[lang])
    hashes, _ = textkit.word_hashes(pieces)
    keys, n = np.unique(hashes, return_counts=True)
    often = n >= 3
    chosen = np.sort(keys[often][np.argsort(-n[often], kind="stable")[:lexicon_words]])
    model = Model(labels, chosen)
    k = len(labels)
    if k < 2 or not pieces:
        return model
    gold_array = np.array(gold)
    slots = {name: np.full_like(getattr(model, name), 1e-6, dtype=np.float64) for name in ("grams", "affixes", "words", "moves", "begin")}

    def update(name: str, grad: np.ndarray) -> None:
        weights, slot = getattr(model, name), slots[name]
        hit = np.flatnonzero(np.abs(grad).sum(axis=1)) if grad.ndim == 2 else np.arange(len(grad))
        g = grad[hit] - decay * weights[hit]
        slot[hit] += g * g
        weights[hit] += (rate * g / np.sqrt(slot[hit])).astype(weights.dtype)

    for _ in range(epochs):
        #: Chains of one to three pieces in a random order.
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), 1536):
            chosen_now = order[a : a + 1536]
            f, per_piece = features([pieces[i] for i in chosen_now], model.lexicon)
            sizes, at = [], 0
            while at < len(chosen_now):
                sizes.append(min(int(rng.integers(1, 4)), len(chosen_now) - at))
                at += sizes[-1]
            edges = np.cumsum([0, *sizes])
            chains = np.add.reduceat(per_piece, edges[:-1])
            truth = np.repeat(gold_array[chosen_now], per_piece)
            prob, moved, begun = forward_backward(model.scores(f), chains, model.moves, model.begin)
            grad = -prob
            grad[np.arange(len(truth)), truth] += 1
            per_byte = np.repeat(np.arange(len(truth)), np.diff(np.append(f.starts, len(f.grams))))
            by_label = lambda idx, rows, size: np.stack([np.bincount(idx, grad[rows, c], size) for c in range(k)], 1)
            own = np.arange(len(truth))
            update("grams", by_label(f.grams, per_byte, 1 << GRAM_BITS))
            update("affixes", by_label(f.affixes.ravel(), np.repeat(own, 2), 1 << GRAM_BITS))
            known = f.lexicon >= 0
            words = np.zeros(model.words.shape)
            words[:-1] = by_label(f.lexicon[known], own[known], len(model.lexicon)) if known.any() else 0
            update("words", words)
            ends = np.cumsum(chains)
            last = np.zeros(len(truth), bool)
            last[ends - 1] = True
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[:-1][~last[:-1]], truth[1:][~last[:-1]]), 1)
            update("moves", seen - moved)
            start = np.zeros(k)
            np.add.at(start, truth[ends - chains], 1)
            update("begin", start - begun)
    return model


def label_words(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    """Label probabilities (words, labels) of each text's words, by forward-backward over the whole text."""
    if not model.labels:
        return [np.zeros((0, 0)) for _ in texts]
    parts, sizes = [], []
    for a, b in textkit.batches(texts, 1 << 19):
        f, counts = features(texts[a:b], model.lexicon)
        parts.append(model.scores(f))
        sizes.append(counts)
    if not parts:
        return []
    counts, scores = np.concatenate(sizes), np.concatenate(parts)
    del parts
    prob, _, _ = forward_backward(scores, counts, model.moves, model.begin, expect=False)
    return np.split(prob, np.cumsum(counts)[:-1])


def sample(docs: DataFrame, text: str, lang: str, key: str, folds: int, held: int, per_label: int, most_rows: int) -> DataFrame:
    """At most ``per_label`` training rows of each language, chosen by a hash of the key; fewer where these would be more than
    ``most_rows`` together, but one of every language at least. Rates come from counts over all rows; only rows under twice their rate are ranked.
    """
    code = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where((code % folds != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "languages")
    most = max(1, min(per_label, most_rows // max(1, counts.count())))
    #: About 16 rows more than needed are drawn of a language, so that chance leaves none of it short.
    rates = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), (2.0 * most + 16) / F.col("n")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.withColumn("draw", draw).join(rates, (F.col("lang") == F.col("of")) & (F.col("draw") < F.col("rate"))).where(F.col("text").rlike(r"\p{L}"))
    order = W.partitionBy("lang").orderBy("draw", "doc_id", "text")
    return picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("text", "lang")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 3, held: int = 1, per_label: int = 160, most_rows: int = 6400) -> Model:
    """A model learned from a bounded sample of the rows outside the held fold: ``per_label`` whole texts a language, and
    ``most_rows`` of all languages together (but one of each). These bound what the driver gathers; every language is learned."""
    got = sorted((r["lang"], r["text"]) for r in sample(docs, text, lang, key, folds, held, per_label, most_rows).collect())
    return train([t for _, t in got], [x for x, _ in got])


def _predict(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            texts, lettered = part.column(2).to_pylist(), part.column(3).to_pylist()
            for a, b in textkit.batches(texts, 1 << 22):
                pred, score = [], []
                for prob, ok in zip(label_words(model, texts[a:b]), lettered[a:b]):
                    if not ok or not len(prob) or not model.labels:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    mean = prob.mean(axis=0)
                    best = int(mean.argmax())
                    pred.append(model.labels[best])
                    score.append(float(min(1.0, mean[best])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", folds: int = 3, held: int = 1) -> DataFrame:
    """Languages of all texts: (doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    Every word of the whole text gets label probabilities; the prediction is the label with the largest mean, the
    score that mean. Null texts and those without a letter are ``und`` with score 0, as is everything without a
    learned label. Only the text enters. A null doc_id is not held out; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    code = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(code % folds == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    return map_batches(rows, _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(shared, columns: int, text: int, least: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            texts, lettered, kept = part.column(text).to_pylist(), part.column(columns).to_pylist(), []
            for a, b in textkit.batches(texts, 1 << 22):
                for prob, ok in zip(label_words(model, texts[a:b]), lettered[a:b]):
                    kept.append(bool(ok and len(prob) and model.labels and float(prob.max(axis=1).mean()) >= least))
            yield part.select(list(range(columns))).filter(pa.array(kept, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.4) -> DataFrame:
    """The documents whose language can be told, with their own columns.

    A document stays when its words' most probable labels have ``least`` probability on average, so a text in several
    languages stays as well as one in a single language. Null texts and those without a letter go, as does everything
    without a learned label. Rows are judged where they stand: keys may repeat or be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.withColumn(free_name("lettered", docs), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return map_batches(lettered, _keep(shared, len(docs.columns), docs.columns.index(text), least), docs.schema)
