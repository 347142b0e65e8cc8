"""Exact dedup, n-gram Jaccard join and embedding near-dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from loomgraph.llm import components, cuckoo, jaccard, neighbours, textkit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def closure(nodes, links):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    return best


def test_word_hashes_agree_with_regex_and_do_not_depend_on_segments(monkeypatch):
    texts = ["", None, "A b\tC", "a  B c\x0b\x0c\r\n", "é x É", "x" * 5000 + " y", " lead", "trail "]
    hashes, counts = textkit.word_hashes(texts)
    want = [words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    by = {}
    for h, w in zip(hashes.tolist(), sum(want, [])):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(textkit, "_SEGMENT", 64)
    assert (textkit.word_hashes(texts)[0] == hashes).all()


def test_cuckoo_index_matches_a_dictionary_through_resizes_and_deletions():
    rng, index, live = random.Random(5), cuckoo.CuckooIndex(4, kicks=8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12_000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.insert(k, step) == (k not in live)
            live[k] = step
        else:
            assert index.delete(k) == (k in live)
            live.pop(k, None)
    assert index.resizes > 3 and index.live == len(live) and dict(index.items()) == live
    assert all(index.maybe(k) for k in live)
    assert all(index.find(k) == live.get(k) for k in keys)


def test_cuckoo_hit_is_verified_against_stored_keys():
    index = cuckoo.CuckooIndex(64)
    key = hashlib.sha256(b"x").digest()
    twin = key[:13] + bytes(19)  # the same buckets, fingerprint and content bucket
    index.insert(key, 1)
    assert index.maybe(twin) and index.find(twin) is None and not index.delete(twin)


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a b"), (2, "ab  "), (3, None), (4, ""), (5, " \t"), (6, "AB"), (7, "a b"), (7, "a b"), (None, "a b"), (None, "ab" + " " * 9), (8, "z" * 200_000)]
    got = {(r.doc_id, i): r for i, r in enumerate(cuckoo.exact_dedup(docs(spark, rows)).collect())}
    by = {}
    for r in got.values():
        by.setdefault(r.text_sha256, []).append(r)
    assert len(got) == len(rows)
    ab = by[hashlib.sha256(b"ab").hexdigest()]
    assert {r.group_size for r in ab} == {5} and {r.keep_id for r in ab} == {None} and sum(r.kept for r in ab) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {5} and [r.doc_id for r in empty if r.kept] == [5]
    kept = cuckoo.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(by)
    assert cuckoo.exact_dedup(docs(spark, [])).count() == 0 and cuckoo.keep_one(docs(spark, [])).count() == 0


def test_repeated_rows_keep_one(spark):
    got = cuckoo.exact_dedup(docs(spark, [(1, "x y")] * 5 + [(2, "xy")]).repartition(3)).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {1} and {r.group_size for r in got} == {6}
    assert cuckoo.keep_one(docs(spark, [(1, "x y")] * 5 + [(2, "xy")])).collect()[0].doc_id == 1


def test_index_updates(spark):
    rows = lambda x: cuckoo.digest_rows(docs(spark, x))
    first = cuckoo.build_index(rows([(1, "a"), (2, "a"), (3, "b"), (6, "k  "), (7, "k "), (8, "k"), (8, "k")]), 2)
    gone = rows([(2, "a"), (3, "b"), (9, "none"), (6, "k  "), (7, "k ")])
    live = rows([(1, "a"), (8, "k"), (8, "k"), (4, "c"), (5, "a a")])
    after = cuckoo.update_index(first, rows([(4, "c"), (5, "a a")]), gone, live, 2)
    got = {bytes(r.digest): (r.n, r.doc_id, r.length, r.ties) for r in after.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).digest()
    assert got == {sha("a"): (1, 1, 1, 1), sha("aa"): (1, 5, 3, 1), sha("c"): (1, 4, 1, 1), sha("k"): (2, 8, 1, 2)}


def test_filter_decides_whether_stored_keys_are_asked():
    index, asked = cuckoo.CuckooIndex(1 << 10), []

    class Bucket(dict):
        def __contains__(self, key):
            asked.append(key)
            return super().__contains__(key)

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(500)]
    for k in keys:
        index.stored.setdefault(index._content(k), Bucket())
        index.insert(k, 1)
    assert len(asked) < 25
    assert not index.insert(keys[0], 2) and asked[-1] == keys[0]


def brute_jaccard(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return {i: len(s) for i, s in sets}, closure([i for i, _ in sets], links), links


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 160))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += passage
        out.append((i * 7 % 1009, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "one two three")]
    sizes, best, _ = brute_jaccard(rows)
    got = jaccard.jaccard_components(docs(spark, rows).repartition(3), block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], best[i]) for i, _ in rows}


def test_jaccard_large_group_of_near_copies_and_a_bystander(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i + 10, " ".join(w)))
    rows += [(1, " ".join(base[:70] + [f"y{k}" for k in range(50)])), (2, " ".join(base))]
    _, best, _ = brute_jaccard(rows)
    got = jaccard.jaccard_components(docs(spark, rows).repartition(5), block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == best


def test_jaccard_nulls_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, None), (4, text), (4, text), (3, text + " end"), (9, "p q r s t u"), (9, text), (None, "lone words of one row here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 26, 3), (None, 0, None), (4, 26, 3), (4, 26, 3), (3, 27, 3), (9, 2, 3), (9, 26, 3), (None, 2, None)], key=str)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_signature_tree_bound_never_undercuts_the_overlap():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(24)]
    tree = jaccard.SignatureTree(sets, list(range(24)))

    def leaves(x):
        return [x] if not x.children else [y for c in x.children for y in leaves(c)]

    for a in [tree.root, *tree.root.children, *leaves(tree.root)]:
        for b in [*tree.root.children, *leaves(tree.root)]:
            most = max(len(np.intersect1d(sets[i], sets[j])) for i in a.members for j in b.members)
            assert tree.bound(a, b) >= most


def test_signature_tree_prunes_most_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(200)]
    tree = jaccard.SignatureTree(sets, list(range(200)))
    assert tree.run() == [] and tree.verified < 200


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (2000, 3000 + 0)] + [(5000, 5001 + i) for i in range(50)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    want = closure({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cosine(rows, cut=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    return [(a, b) for a in unit for b in unit if a < b and len(ok[a]) == len(ok[b]) and unit[a] @ unit[b] >= cut]


def vectors(seed=2, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((150, 32))
    out = []
    for i in range(n):
        c = centres[rng.integers(150)] if i % 2 else rng.standard_normal(32)
        out.append((i, (c + 0.25 * rng.standard_normal(32)).tolist()))
    return out


def test_embedding_links_match_brute_force_in_one_block(spark):
    rows = vectors() + [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [None] + [1.0] * 31), (9005, [float("nan")] + [1.0] * 31), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e300] * 32), (9009, [3e300] * 32), (None, [1.0, 2.0])]
    links = brute_cosine([r for r in rows if r[0] is not None and r[0] < 9008])
    best = closure([i for i, _ in rows if i is not None], [*links, (9008, 9009)])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.near_duplicates(frame, block=4096).collect()
    n = {i: sum(i in e for e in [*links, (9008, 9009)]) for i, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], best[r.vec_id], best[r.vec_id] == r.vec_id)


@pytest.mark.parametrize("block", [32, 64])
def test_embedding_recall_with_small_blocks(spark, block):
    rows = vectors(3, 1500)
    links = brute_cosine(rows)
    want = {i: sum(i in e for e in links) for i, _ in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(frame, block=block).collect()}
    assert all(got[i] <= n for i, n in want.items())  # no pair counts twice
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 100
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_group_of_near_copies_is_counted_without_its_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    frame = spark.createDataFrame([*rows, rows[0], rows[0]], "vec_id long, embedding array<double>").repartition(4)
    assert neighbours.block_links(frame, block=512).count() < 3000
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(frame, block=512).collect()}
    want = collections.Counter(i for e in brute_cosine(rows) for i in e)
    assert all(got[i] == (want[i], 0) for i in range(300)) and want[0] >= 299


def test_embedding_groups_of_many_blocks_match_brute_force(spark):
    rng = np.random.default_rng(6)
    copied, centre, loose = rng.standard_normal((3, 16))
    rows = [(i, copied.tolist()) for i in range(200)]
    rows += [(1000 + i, (centre + 0.01 * rng.standard_normal(16)).tolist()) for i in range(200)]
    rows += [(2000 + i, (loose + 0.2 * rng.standard_normal(16)).tolist()) for i in range(200)]
    rows += [(3000 + i, (copied + 0.05 * rng.standard_normal(16)).tolist()) for i in range(3)]
    rows += [(4000 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    links = brute_cosine(rows)
    want, best = collections.Counter(i for e in links for i in e), closure([i for i, _ in rows], links)
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), block=32).collect()}
    assert all(got[i].n_links == want[i] and got[i].component_id == best[i] for i in (*range(200), *range(1000, 1200)))
    assert all(got[i].n_links <= want[i] for i, _ in rows)
    assert sum(got[i].n_links for i in range(2000, 2200)) >= 0.99 * sum(want[i] for i in range(2000, 2200)) > 10_000
