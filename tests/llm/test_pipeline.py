"""The pipeline's stages on a small corpus, each against what plain Python keeps of its input."""

from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
from loomgraph.llm.shared import stage


def test_stages_keep_what_plain_python_keeps(spark):
    rng = random.Random(8)
    vocab = {"aa": [f"ba{i}do" for i in range(300)], "bb": [f"sch{i}ung" for i in range(300)]}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(60)), x, f"s{i % 3}", 0) for i, x in enumerate(rng.choice(["aa", "bb"]) for _ in range(120))]
    rows += [(500 + i, rows[i][1].replace(" ", "  "), rows[i][2], "s0", 0) for i in range(10)]
    rows += [(600 + i, rows[i][1] + " tail", rows[i][2], "s0", 0) for i in range(10)] + [(700, None, "aa", "s1", 0), (701, "12 34", "aa", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, kept = docs.columns, []
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), "test")
        kept.append(docs)
    ids = [sorted(r.doc_id for r in d.collect()) for d in kept]
    assert all(d.columns == columns for d in kept[:-1])
    assert ids[0] == sorted(r[0] for r in rows if r[1] and re.search("[a-z]", r[1]))
    assert ids[1] == sorted([*range(10, 120), *range(500, 510), *range(600, 610)])  # the longer of two equal texts stays
    assert ids[2] == sorted([*range(10, 120), *range(500, 510)])  # of a class the smallest id
    copies = collections.Counter(ids[3])
    assert set(copies) <= set(ids[2]) and max(copies.values()) <= 3
    packed = collections.Counter()
    for r in kept[4].collect():
        packed[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in kept[4].collect()}
    assert packed == {i: n * tokens[i] for i, n in copies.items()}


def test_stages_go_by_rows_where_keys_repeat_or_are_null(spark):
    rng = random.Random(4)
    texts = [" ".join(f"do{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key int, row_0 int, prompt string"
    rows = [(i % 5 if i % 3 else None, t, "aa" if i % 2 else "bb", None if i < 6 else "s", 0, i, i, "p") for i, t in enumerate(texts)]
    rows += [(None, texts[3] + " tail", "aa", "s", 0, 103, 3, "p"), (4, texts[4] + " tail", "aa", "s", 0, 104, 3, "p"), rows[7], rows[7], (9, None, "aa", "s", 0, 105, 1, "p"), (9, "", "aa", "s", 0, 106, 1, "p")]
    frame = spark.createDataFrame(rows, schema)
    kept, docs = [], frame
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = stage(step(spark, docs, ""), "test")
        assert docs.columns == frame.columns
        kept.append(sorted(r["__key"] for r in docs.collect()))
    assert kept[0] == sorted([*range(30), 103, 104, 7, 7]) and kept[1] == sorted([*range(30), 103, 104])
    assert len(kept[2]) == 30 and {103, 104}.isdisjoint(set(kept[2]) & {103 if rows[3][0] is not None else 3}) and len({3, 103} & set(kept[2])) == 1 == len({4, 104} & set(kept[2]))
    copies = collections.Counter(kept[3])
    assert set(copies) <= set(kept[2]) and max(copies.values()) <= 3
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() >= len(kept[3])


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), "test")
        assert docs.count() == 0
