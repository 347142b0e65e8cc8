"""Archives, formatting, mixing, packing, surrogates, language ID and scoring."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import backoff, crf, mixing, packing, preferences, surrogates, textkit, warc
from loomgraph.llm.shared import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ---- WARC


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a.example/x?q=1", "<p>é</p>"), (2, None, ""), (3, "not a url\r\nX: y", None), (4, "http://a.example", "<p>é</p>"), (5, "http://b.example/", evil), (6, "u", evil), (7, "u", "\r\n\r\n"), (7, "u", "\r\n\r\n"), (None, "n", "only"), (8, "http://big.example/", "x" * 300_000)]
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as type", "2 as file").repartition(3)
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    got = {r.page_id: r for r in warc.captures(records).collect()}
    html = {i: (h or "").encode() for i, _, h in rows}
    best = {}
    for i, h in html.items():
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    assert set(got) == set(html)
    for i, h in html.items():
        r = got[i]
        stored = i is None or best[h] == i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h), b32(h), "response" if stored else "revisit", None if stored else best[h])
    nested = {r.metadata[0].payload: r for r in warc.assemble(records).collect()}
    assert len(nested) == len(html)
    big = nested[b"page_id: 8\r\n"]
    assert bytes(big.main.payload) == b"x" * 300_000 and big.requests[0].head.startswith("GET / HTTP/1.1") and big.main.declared_digest == big.main.payload_digest
    raw = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect())
    assert raw.count(b"WARC-Concurrent-To") == 2 * len(rows) and not re.search(rb"\nX: y", raw)


def test_warc_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path, least=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.captures(warc.read_warc(spark, path, payloads=False)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_warc_empty_table(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.read_warc(spark, path)).count() == 0


def record(kind, rid, to=None, body=b"x", **more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode()]
    if to:
        head.append(b"WARC-Concurrent-To: " + to.encode())
    head.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_assembly_follows_links_both_ways_and_one_step_further(spark, tmp_path):
    data = [
        record("warcinfo", "<w>"), record("response", "<r1>"), record("request", "<q1>", "<r1>"), record("metadata", "<m1>", "<q1>"), record("metadata", "<m2>", "<r1>"),
        record("request", "<q2>"), record("response", "<r2>", "<q2>"), record("request", "<q3>", "<gone>"), record("metadata", "<m3>"), record("response", "<r2>"), record("resource", "<s>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()}
    ids = lambda xs: sorted(x.record_id for x in xs)
    assert set(got) == {"<r1>", "<r2>", "<gone>", "<m3>", "<s>"}
    assert ids(got["<r1>"].requests) == ["<q1>"] and ids(got["<r1>"].metadata) == ["<m1>", "<m2>"]
    assert ids(got["<r2>"].requests) == ["<q2>"] and got["<gone>"].main is None and ids(got["<gone>"].requests) == ["<q3>"] and got["<s>"].requests == []


def test_assembly_follows_long_chains_and_repeated_headers(spark, tmp_path):
    twice = record("metadata", "<m0>", "<q0>").replace(b"Content-Length", b"WARC-Concurrent-To: <far>\r\nContent-Length")
    both = record("response", "<r>", "<q0>").replace(b"Content-Length", b"WARC-Concurrent-To: <m9>\r\nContent-Length")
    chain = [record("metadata", f"<c{k}>", f"<c{k - 1}>" if k else "<q0>") for k in range(6)]
    data = [both, record("request", "<q0>"), record("metadata", "<m9>"), twice, *chain, record("metadata", "<x>", "<y>"), record("metadata", "<y>", "<x>")]
    (tmp_path / "a.warc").write_bytes(b"".join(data)[:-3])
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()}
    assert sorted(x.record_id for x in got["<r>"].metadata) == sorted(["<m0>", "<m9>", *[f"<c{k}>" for k in range(6)]]) and [x.record_id for x in got["<r>"].requests] == ["<q0>"]
    assert set(got) == {"<r>", "<x>", "<y>"} and got["<x>"].main is None


# ---- preferences


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_preferences_match_python(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(60):
        base = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a", "bb", "é", ""])) for _ in range(rng.randint(0, 6))]
        a = base[: rng.randint(0, 6)] + [(rng.choice(["user", "assistant"]), str(k)) for k in range(rng.randint(0, 3))]
        b = base[: rng.randint(0, 6)] + [(rng.choice(["user", "assistant"]), str(k)) for k in range(rng.randint(0, 3))]
        pairs.append((i, None if i == 3 else a, None if i in (3, 5) else b))
    got = preferences.format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}")).collect()
    assert len(got) == 60
    for r in got:
        a, b = pairs[r.pair_id][1] or [], pairs[r.pair_id][2] or []
        p = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert (r.prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion) == (p, render(a[:p]), render(a[p:]), render(b[p:]))
        for side, text, mask in ((a, r.chosen_completion, r.chosen_mask), (b, r.rejected_completion, r.rejected_mask)):
            assert [text[m.start : m.start + m.length] for m in mask] == [f"{t}<|end|>\n" for role, t in side[p:] if role == "assistant"]


def test_conversations_with_nulls_and_ties(spark):
    rows = [(0, 1, "user", "q"), (0, None, None, None), (0, 1, "user", "q"), (0, 1, "assistant", "z"), (1, 1, "user", "q"), (None, 1, "user", "q"), (7, 1, "user", "alone")]
    turns = preferences.conversations_to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in turns.collect()}
    assert got == {0: [("unknown", ""), ("assistant", "z"), ("user", "q")], 1: [("user", "q")], 7: [("user", "alone")], None: [("user", "q")]}
    out = {r.pair_id: r for r in preferences.format_preferences(preferences.adjacent_pairs(turns)).collect()}
    assert (out[0].chosen_id, out[0].rejected_id, out[3].chosen_id, out[3].rejected_id, out[3].rejected_completion) == (0, 1, 7, None, "")
    assert (out[None].chosen_id, out[None].rejected_id, out[None].chosen_completion) == (None, None, render([("user", "q")]))
    assert preferences.conversations_to_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_preferences_with_clashing_columns_and_a_long_text(spark):
    long = "x" * 3_000_000
    rows = [(1, [("user", "q"), ("assistant", long)], [("user", "q"), ("assistant", "n")], "mine", 5, "kept")]
    frame = spark.createDataFrame(rows, f"pair_id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}, prompt string, prompt_turns_0 int, chosen_turns_0 string")
    out = preferences.format_preferences(frame)
    assert sorted(out.columns) == sorted(["pair_id", "prompt_turns_0", "chosen_turns_0", "prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"])
    got = out.collect()[0]
    assert (got.prompt, got.prompt_turns, got.prompt_turns_0, got.chosen_turns_0) == (render([("user", "q")]), 1, 5, "kept") and got.chosen_completion == render([("assistant", long)])


# ---- mixing


def fill(sizes, weights, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "zz", "empty", "\U0001f600"]
    rows = [(i, rng.choice(names[:3] if rng.random() < 0.6 else names)) for i in range(3000)]
    rows = [(i, s, 0 if s == "empty" else int(rng.lognormvariate(4, 1.3))) for i, s in rows]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    got = mixing.mix_sizes(frame, block_rows=64).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    want, taken = fill(sizes, (5.0, 2.0, 1.0)), collections.Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = max(n for _, _, n in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in sizes)
    again = mixing.mix_sizes(frame.repartition(2), block_rows=64).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}


def test_systematic_prefix_sums_cross_boundaries_once(spark):
    frame = spark.createDataFrame([(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 10) for i in range(100)], "doc_id long, source string, size long")
    got = mixing.mix_sizes(frame, weights=(1.0, 3.0), block_rows=50).collect()
    n = collections.Counter()
    for r in got:
        n[r.source] += r.copies
    assert n["b"] == 300 and abs(n["a"] - 800) <= 1


def test_mixing_edge_cases(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (3, ""), (None, "x y z")]
    out = mixing.systematic_mix(docs(spark, rows)).collect()
    assert sorted(r.size for r in out) == [0, 0, 0, 2, 3] and {r.target for r in out} == {5.0}
    assert mixing.systematic_mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.systematic_mix(docs(spark, [(1, None)])).collect()] == [0]
    table = docs(spark, [(i, "w " * 10) for i in range(50)])
    mixed = mixing.emit(table)
    assert mixed.columns == table.columns and mixed.count() == 50


# ---- packing


def test_tokenizer_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    encode, other = packing.load_tokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    signs = ["a", "Zé", " ", "  ", "\n", "\t", "'ll", "12", "٣", "中", "<|endoftext|>", "‍", "😀", "!", "ß", "\x00"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert encode(text).tolist() == other.encode(text, add_special_tokens=False).ids, text


def test_packing_is_an_exact_partition(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "x1", "the"]) for _ in range(int(rng.lognormvariate(4.5, 1.4))))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "null key"), (902, "again"), (902, "again"), (903, "long " * 9000)]
    got = packing.pack(docs(spark, rows).repartition(3), TOKENIZER).collect()
    encode = packing.load_tokenizer(TOKENIZER)
    want = collections.Counter((i, tuple(encode(t or "").tolist() + [1])) for i, t in rows)
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for doc, parts in pieces.items():
        copies = sum(n for (i, _), n in want.items() if i == doc)
        total = sorted(parts)
        assert sum(len(p[1]) for p in total) == sum(len(t) * n for (i, t), n in want.items() if i == doc)
        if copies == 1:
            ids = [x for p in total for x in p[1]]
            assert [p[0] for p in total] == list(np.cumsum([0] + [len(p[1]) for p in total[:-1]])) and (doc, tuple(ids)) in want and total[0][2] == len(ids)
    fills = []
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 2048 and sum(fills) / (2048 * len(fills)) > 0.97
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def test_sum_of_squares_level_matches_brute_force():
    rng, levels = random.Random(7), packing.SumOfSquares(32)
    for k in range(3000):
        s = rng.randint(1, 31)
        options = []
        for h in range(32 - s + 1):
            if h == 0 or levels.count[h]:
                c = levels.count.copy()
                if h:
                    c[h] -= 1
                if h + s < 32:
                    c[h + s] += 1
                options.append((int((c[1:32] ** 2).sum()), -h))
        assert levels.level(s) == -min(options)[1]
        levels.place([k, 0, np.zeros(s), s], s)


# ---- surrogates


KEY = b"test key"


def test_surrogates_keep_type_and_format():
    text = "Mail Bob.x1@Corp.com or 10.20.30.40, card 4111 1111 1111 1111, call +1 (988) 555-2485. Mrs. Anna SMITH met Dr. Иван Петров; Smith left. 4111 1111 1111 1112"
    new, n = surrogates.replace(text, KEY, {})
    assert n == 9
    for gone in ("Bob.x1", "10.20.30.40", "4111 1111 1111 1111", "555-2485", "Anna", "SMITH", "Smith", "Иван", "Петров"):
        assert gone not in new, gone
    assert "4111 1111 1111 1112" in new  # no valid card
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", new).group(1).replace(" ", "")
    assert surrogates.luhn(card) and card[0] == "4"
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", new)
    given, family = re.search(r"Mrs\. (\p{L}+) (\p{L}+) met".replace(r"\p{L}", r"[^\W\d_]"), new).groups()
    assert given.endswith("a") and given.istitle() and family.isupper() and f"; {family.title()} left" in new
    assert re.search(r"Dr\. [А-Я][а-я]+ [А-Я][а-я]+;", new)
    assert re.search(r"Mail [a-z]+\.[a-z]\d@[a-z]{6}\.example\.com or \d+\.\d+\.\d+\.\d+,", new)
    assert surrogates.replace(text, KEY, {})[0] == new != surrogates.replace(text, b"other", {})[0]
    assert not {c for *_, c in surrogates.detect(new)} & {c for *_, c in surrogates.detect(text)}


def test_clean_texts_stay():
    for text in (None, "", "In 2024 we saw 1,234,567 items; version 1.2.3 of a.b", "x" * 100_000, "ratio 3.14159265358979 and 12345678"):
        assert surrogates.replace(text, KEY, {}) == (text, 0)


def test_iban_and_ssn():
    new, n = surrogates.replace("DE89 3704 0044 0532 0130 00 and 123-45-6789", KEY, {})
    iban = re.match(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and 9\d\d-\d\d-\d{4}$", new).group(1)
    assert n == 2 and surrogates._iban(iban) and iban != "DE89 3704 0044 0532 0130 00"


def test_surrogates_stay_distinct_in_a_narrow_format(spark):
    rows = [(i, f"call +1 (200) 555-{i:04d} or user{i}@a.com") for i in range(400)] + [(9000, None), (9000, None), (None, "call +1 (200) 555-0007")]
    out = surrogates.pseudonymise(docs(spark, rows).repartition(4), KEY).collect()
    assert len(out) == len(rows)
    real = {f"+1 (200) 555-{i:04d}" for i in range(400)}
    phones = {r.doc_id: re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text).group() for r in out if r.text}
    assert len(set(phones.values())) == 400 and not real & set(phones.values()) and phones[None] == phones[7]
    #: Formats without room: a hundred phone numbers of one to three digits.
    found = spark.createDataFrame([("phone", f"1{i:02d}", None) for i in range(90)] + [("phone", f"{i}", None) for i in range(10)] + [("ssn", f"{i:09d}", None) for i in range(300)], "kind string, entity string, gender string")
    got = surrogates.assign(found, KEY).collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 400 and not {r.surrogate for r in got} & {r.entity for r in got}
    assert surrogates.pseudonymise(docs(spark, []), KEY).count() == 0


# ---- language ID


def brute_marginals(scores, moves, begin):
    n, k = scores.shape
    total, out = 0.0, np.zeros((n, k))
    import itertools

    for path in itertools.product(range(k), repeat=n):
        s = begin[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        p = math.exp(s)
        total += p
        for i, y in enumerate(path):
            out[i, y] += p
    return out / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 5, 2])
    scores, moves, begin = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    prob, expected, first = crf.forward_backward(scores.copy(), counts, moves, begin)
    assert np.allclose(crf.forward_backward(scores.copy(), counts, moves, begin, expect=False)[0], prob)
    at = 0
    for c in counts:
        if c:
            assert np.allclose(prob[at : at + c], brute_marginals(scores[at : at + c], moves, begin))
        at += c
    assert math.isclose(expected.sum(), 7) and math.isclose(first.sum(), 4)


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id_held_out_accuracy_and_switches(spark):
    rng = random.Random(6)
    langs = {"aa": ["ba", "do", "ki", "lu", "é"], "bb": ["sch", "ung", "er", "tz", "ü"], "cc": ["tion", "eau", "la", "qu", "ki"]}
    rows = [(i, invented(rng, langs[x], rng.randint(5, 60)), x, f"s{i}", 0) for i, x in enumerate(rng.choice(list(langs)) for _ in range(500))]
    rows += [(900, None, "aa", "s", 0), (901, "123 !?", "bb", "s", 0), (902, "", "aa", "s", 0), (903, "do ki", None, "s", 0), (None, "ung er", "bb", "s", 0), (904, invented(rng, langs["bb"], 30_000), "bb", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    model = crf.fit(frame)
    assert model.labels == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in crf.identify(frame, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i], x) for i, t, x, *_ in rows if i is not None and i < 500 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.lang_pred == x for r, x in held) > 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 904)] == ["und", "und", "und", "bb"] and got[901].score == 0 and 0 <= got[904].score <= 1
    first, second = invented(rng, langs["aa"], 12), invented(rng, langs["bb"], 12)
    labels = crf.label_words(model, [f"{first} {second}"])[0].argmax(axis=1)
    assert (labels == [0] * 12 + [1] * 12).mean() > 0.9
    assert crf.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_language_id_learns_every_label_and_keeps_mixed_texts(spark):
    rng = random.Random(1)
    names = [f"l{i:02d}" for i in range(70)]
    syllables = {x: ["".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiouy") for _ in range(2)) for _ in range(6)] for x in names}
    rows = [(i, invented(rng, syllables[x], 20), x, "s", 0) for i, x in enumerate(names * 4)]
    model = crf.fit(spark.createDataFrame(rows, DOCS), per_label=3, most_rows=140)
    assert model.labels == names
    got = [r.lang for r in crf.sample(spark.createDataFrame(rows, DOCS), "text", "lang", "doc_id", 3, 1, 3, 140).collect()]
    assert set(got) == set(names) and len(got) <= 140
    model = crf.fit(spark.createDataFrame([r for r in rows if r[2] < "l03"] * 8, DOCS))
    mixed = " ".join(invented(rng, syllables[x], 15) for x in ("l00", "l01", "l02"))
    frame = spark.createDataFrame([(1, mixed, 5), (1, "12 ?", 6), (None, invented(rng, syllables["l01"], 9), 7), (2, None, 8), (2, "", 9)], "doc_id long, text string, lettered_0 int")
    kept = crf.keep_identified(frame, model)
    assert kept.columns == frame.columns and sorted(r.lettered_0 for r in kept.collect()) == [5, 7]
    assert crf.fit(spark.createDataFrame([], DOCS)).labels == [] and crf.keep_identified(frame, crf.fit(spark.createDataFrame([], DOCS))).count() == 0


def test_features_do_not_cross_words():
    one = crf.features(["ab cd"], np.zeros(0, np.uint64))[0]
    two = crf.features(["cd", "xx ab\n"], np.zeros(0, np.uint64))[0]
    sums = lambda f, i: sorted(f.grams[f.starts[i] : (f.starts[i + 1] if i + 1 < len(f.starts) else len(f.grams))].tolist())
    assert sums(one, 0) == sums(two, 2) and sums(one, 1) == sums(two, 0) and (one.affixes[0] == two.affixes[2]).all()


def test_names_agree_across_texts_and_stay_distinct(spark):
    """Brute force over a corpus whose entities are known: each has one surrogate, in all texts, and no two share one."""
    rng = random.Random(12)
    given, family = ["Xenia", "Torben", "Ida-Marie", "Mary", "John"], [f"Kal{a}{b}" for a in "abcdefgh" for b in "mnopr"]
    told = {"Xenia": "Mrs", "Torben": "Mr", "Ida-Marie": "Ms", "Mary": "Dr", "John": "Dr"}
    rows, where = [], []
    for i in range(300):
        g, f = rng.choice(given), rng.choice(family)
        shape = rng.choice(["{t} {g} {f} spoke; {f} left.", "{t}. {g} {f}, then {F} again", "My name is {g} {f}, 7 {f} Road", "{t} {f} came with {t} {g} {f}"])
        rows.append((i, "Report: " + shape.format(t=told[g], g=g, f=f, F=f.upper())))
        where.append((g, f, shape))
    out = {r.doc_id: r for r in surrogates.pseudonymise(docs(spark, rows).repartition(5), KEY).collect()}
    of = {}
    for (i, _), (g, f, shape) in zip(rows, where):
        new = out[i].text
        pattern = "Report: " + re.escape(shape).replace(r"\{t\}", told[g]).replace(r"7\ \{f\}\ Road", r"\d (?P<s>\w+) Road")
        for name in ("f", "F", "g"):
            pattern = pattern.replace(rf"\{{{name}\}}", rf"(?P<{name}>[\w-]+)", 1).replace(rf"\{{{name}\}}", rf"(?P={name})")
        m = re.fullmatch(pattern, new)
        assert m, (rows[i], new, pattern)
        for name, entity in (("f", f), ("g", g)):
            if m.groupdict().get(name):
                of.setdefault(entity, set()).add(m.group(name))
        assert m.groupdict().get("F", m.group("f").upper()) == m.group("f").upper()
        assert g not in new and f not in new and f.upper() not in new
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)).lower() for v in of.values()}) == len(of)
    ends = {g: next(iter(of[g]))[-1] for g in given}
    assert (ends["Xenia"], ends["Mary"], ends["Ida-Marie"], ends["Torben"], ends["John"]) == ("a", "a", "a", "n", "n")
    assert re.fullmatch(r"[A-Z][a-z]+-[A-Z][a-z]+", next(iter(of["Ida-Marie"])))


def test_addresses_and_capitals_keep_their_format():
    new, n = surrogates.replace("MAX@EXAMPLE.COM at 2001:db8::1 or 2001:0DB8:0:0:0:0:0:1, John Smith of 12 High Street", KEY, {})
    assert n == 6 and re.match(r"[A-Z]{3}@[A-Z]{6}\.EXAMPLE\.COM at 2001:db8:[0-9a-f:]+ or [0-9A-Fa-f:]+, [A-Z][a-z]+n [A-Z][a-z]+ of \d\d? [A-Z][a-z]+ Street$", new)
    assert surrogates.replace("at 12:30:45, a::b or std::x, Road 5 and 3 Roads, Johnny Be", KEY, {})[1] == 0


def test_surrogates_of_rows_without_ids_and_long_texts(spark):
    long = "word " * 300_000 + "Mrs Xenia Kalam wrote " + "more " * 100_000
    rows = [(None, long), (None, "Xenia"), (None, "plain"), (5, None), (5, "Dr Xenia Kalam")]
    frame = docs(spark, rows).selectExpr("*", "1 as at", "2 as changes", "3 as kind")
    out = surrogates.pseudonymise(frame, KEY).collect()
    texts = {r.text for r in out}
    assert len(out) == 5 and "plain" in texts and None in texts and "Xenia" in texts
    other = next(r.text for r in out if r.doc_id == 5 and r.text).split(" ")[1:]
    assert all(f" {x}" in next(t for t in texts if t and len(t) > 10**6) for x in other) and other[0].endswith("a")


# ---- scoring


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


@pytest.mark.parametrize(
    ("body", "kind"),
    [("a@b.c", "email"), ("8.8.8.8", "ip"), ("1.10.1.1", "ip"), ("1.1.255.1", "ip"), ("NO9386011117947", "iban"), ("4222222222222", "card"), ("4 2 2 2 2 2 2 2 2 2 2 2 2", "card"), ("123-45-6789", "ssn"),
     ("+1 (2) 34 56", "phone"), ("+1 2 34 56", "phone"), ("+12 34 56", "phone"), ("(123)456-7890", "phone"), ("123.456.7890", "phone"), ("sr X.", "person"), ("Dr. Xu", "person"), ("John X.", "person"), ("name: Xu Yi", "person"), ("MRſ Xu", "person"), ("1::", "ip6"), ("a::1", "ip6"), ("1 Ab St", "street")],
)
def test_hint_lets_every_shortest_match_pass(body, kind):
    for text in (body, f"is {body} up", f"é {body}"):
        assert surrogates.PATTERN.search(text).group(kind) and surrogates.hint(text)
    if kind != "person":
        assert [k for *_, k, _ in surrogates.detect(f"is {body} up")] == [k for *_, k, _ in surrogates.detect(f"q@r.st {body}")][1:]


class Explicit:
    """The automaton of the training texts as dictionaries: states are tuples of tokens, walked token by token."""

    def __init__(self, train, priors=(100.0, 10.0)):
        self.priors, self.seen, self.after = priors, collections.Counter(), collections.Counter()
        self.words = collections.Counter(w for t in train for w in t)
        for t in train:
            line = ["", *t]
            for k in range(1, len(line)):
                for n in range(1, min(k, 2) + 1):
                    self.after[tuple(line[k - n : k])] += 1
                    self.seen[tuple(line[k - n : k + 1])] += 1
        self.total, self.types = sum(self.words.values()), len(self.words)

    def prob(self, state, w):
        if not state:
            return (self.words[w] + 1) / (self.total + self.types + 1)
        k = self.priors[len(state) - 1]
        if self.seen[*state, w]:
            return (self.seen[*state, w] + k * self.prob(state[1:], w)) / (self.after[state] + k)
        return k / (self.after[state] + k) * self.prob(state[1:], w)

    def longest(self, tokens):
        return next(tuple(tokens[i:]) for i in range(max(0, len(tokens) - 2), len(tokens) + 1) if i == len(tokens) or self.after[tuple(tokens[i:])])

    def score(self, text):
        state, out = self.longest([""]), 0.0
        for w in text:
            out += math.log10(self.prob(state, w))
            state = self.longest([*state, w])
        return out


def training(rows):
    return [words(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]


@pytest.mark.parametrize(("chunk", "priors"), [(1 << 23, (100.0, 10.0)), (300, (100.0, 10.0)), (2000, (3.0, 0.5))])
def test_backoff_scores_match_an_explicit_automaton(spark, chunk, priors):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 30, 300])]).upper() for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + rng.choice(["", " more", " w1 w2 w3"])) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words"), (None, "w1 w2"), (1003, "w1 w2"), (1003, "w1 w2"), (1004, " ".join(rng.choice(vocab) for _ in range(5000)))]
    rows += [(2000 + i, f"held{i % 3} pair{i % 5} only{i % 2} here") for i in range(60)]
    model = Explicit(training(rows), priors)
    want = [(i, len(words(t)), sum(w in model.words for w in words(t)), model.total, sum(math.log10(model.prob((), w)) for w in words(t)), model.score(words(t))) for i, t in rows]
    got = backoff.score_documents(docs(spark, rows).repartition(3), chunk=chunk, priors=priors).collect()
    assert len(got) == len(want)
    key = lambda x: (str(x[0]), x[1], round(x[5], 5))
    for a, b in zip(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9), (a, b)


def test_automaton_states_sum_to_one():
    rng = random.Random(5)
    train = [[rng.choice("abcdefghij") for _ in range(40)] + [None] for _ in range(60)]
    explicit = Explicit(train)
    model = backoff.Automaton(explicit.total, explicit.types, explicit.priors)
    for state in [*explicit.after, ("z",), ("z", "z")]:
        arcs = lambda n, s: np.array([*(explicit.seen[*s, w] if s else explicit.words[w] for w in explicit.words), 0])[:, None] if n else None
        tail = state[-1:]
        seen = [arcs(1, s).ravel() for s in ((), tail, state if len(state) == 2 else ("none", "none"))]
        one, two = explicit.after[tail], explicit.after[state] if len(state) == 2 else 0
        weights = model.walk(*seen, np.full(len(seen[0]), one), np.full(len(seen[0]), two))
        assert math.isclose((10**weights).sum(), 1, rel_tol=1e-9)


def test_hashes_of_buckets_come_back():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    for bits in (0, 3, 16, 20):
        back = [backoff._lengthen(*backoff._shorten(keys[i:j], b, bits), b, bits) for b, i, j in backoff._cut(keys, bits)]
        assert (np.concatenate(back) == keys).all()


def test_scores_without_rows_or_training(spark):
    assert backoff.score_documents(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = backoff.score_documents(docs(spark, [(held, "a b")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]
