"""Surrogates for personal data: keyed replacements that keep type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.grouped import map_batches
from loomgraph.llm.shared import stage

#: Parameters: titles with the gender they state (m, f, or n for either), given names that state one, cues after which a name
#: stands without a title, and words that end a street.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f", "госпожа": "f",
    "dr": "n", "prof": "n", "professor": "n",
}
GIVEN = {
    "john": "m", "james": "m", "robert": "m", "michael": "m", "david": "m", "thomas": "m", "peter": "m", "hans": "m", "pierre": "m", "jean": "m", "carlos": "m", "jose": "m", "иван": "m",
    "mary": "f", "anna": "f", "maria": "f", "jane": "f", "linda": "f", "susan": "f", "sarah": "f", "emma": "f", "julia": "f", "claire": "f", "elena": "f", "мария": "f",
}

CUES = ("my name is", "name:", "signed,", "sincerely,", "regards,", "contact:")
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Square")

_any = lambda words: "|".join(regex.escape(w) for w in sorted(words, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
_MORE = rf"(?:[ ](?:{_NAME}|\p{{Lu}}\.))"
PATTERN = regex.compile(
    rf"""
    (?P<email>[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?(?:\.[\p{{L}}\p{{N}}-]+)+)
    | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
    | (?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![\w:]))
    | (?P<iban>(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))
    | (?P<card>(?<![\d.])\d(?:[ -]?\d){{12,18}}(?![\d]))
    | (?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    | (?P<phone>(?<![\d\p{{L}}])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?|\d{{1,4}}[ .-])\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|\(\d{{3}}\)\ ?\d{{3}}-\d{{4}}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}})(?!\d))
    | (?P<street>(?<![\d\p{{L}}])\d{{1,5}}\ (?:{_NAME}\ ){{1,3}}(?:{_any(STREETS)})(?!\p{{L}}))
    | (?P<person>(?<!\p{{L}})(?:(?i:(?P<title>{_any(TITLES)})\.?)[ ](?P<names>(?:{_NAME}|\p{{Lu}}\.){_MORE}{{0,2}})
      | (?i:{_any(CUES).replace(chr(92) + " ", "[ ]")})\s+(?P<cued>{_NAME}{_MORE}{{1,2}})
      | (?P<known>(?i:{_any(GIVEN)})(?<=\p{{Lu}}\p{{L}}*)(?!\p{{L}}){_MORE}{{1,2}})))
    """,
    regex.VERBOSE,
)
KINDS = ("email", "ip", "ip6", "iban", "card", "ssn", "phone", "street", "person")
#: What every match of the branches with digits but those of phone numbers with a country code, of IPv6 and of streets holds.
_DIGITS = re.compile(r"\d(?:\.\d{1,3}\.\d{1,3}\.\d|[\d .()-]{4,}\d|\d(?<=[A-Z]{2}\d\d))")
_PLUS, _COLONS, _STREET = re.compile(r"\+\d"), re.compile(r":[0-9A-Fa-f]{0,4}:"), re.compile(rf"\d [^\W\d_].* (?:{_any(STREETS)})")
#: What every match of the branches for persons holds, in lower case: a title or given name before a blank or stop, or a cue.
_SPOT = ahocorasick.Automaton()
for _word_before in (*(f"{w}{end}" for w in TITLES for end in (" ", ". ")), *(f"{w} " for w in GIVEN)):
    _SPOT.add_word(_word_before, len(_word_before))
for _cue in CUES:
    _SPOT.add_word(_cue, 0)
_SPOT.make_automaton()


def hint(text: str) -> bool:
    """Whether a text may hold an entity; false only where PATTERN has no match. Cheap, for most texts hold none."""
    if "@" in text or _DIGITS.search(text) or "+" in text and _PLUS.search(text) or ":" in text and _COLONS.search(text):
        return True
    if any(f" {w}" in text for w in STREETS) and _STREET.search(text):
        return True
    #: Letter by letter: the one capital that two small letters stand for, and the one letter that folds to another's.
    low = text.replace("\u0130", "i").replace("\u017f", "s").lower()
    for last, size in _SPOT.iter(low):
        at = last - size
        if size == 0 or not (at >= 0 and text[at].isalpha()) and text[last + 1 : last + 2].isupper():
            return True
    return False


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, kind, canonical form), in order and apart. Cards must pass the Luhn check and IBANs theirs.

    Persons are capitalised names after a title or a cue, or a known given name with more names. Each of the names is an
    entity of its own, of the one kind ``name`` wherever it stands, so that mentions agree within and across texts; later
    mentions of a name by itself are found too. Its gender is that of :func:`stated`, not part of the entity.
    """
    return [(a, b, kind, canon) for a, b, kind, canon, _ in _detect(text)]


def stated(name: str) -> str:
    """The gender that a given name states by itself, else n."""
    return GIVEN.get(name, "n")


def _detect(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """As :func:`detect`, with the gender that the text's titles say of a name where it is not the last one (else n)."""
    if not text or not hint(text):
        return []
    found, names = [], {}
    for m in PATTERN.finditer(text):
        body = m.group()
        kind = next(k for k in KINDS if m.group(k) is not None)
        digits = "".join(c for c in body if c.isdigit())
        if kind == "card" and (len(digits) > 19 or not luhn(digits)) or kind == "iban" and not _iban(body) or kind == "ip6" and not _ip6(body):
            continue
        if kind != "person":
            canon = body.lower() if kind in ("email", "street") else body if kind == "ip" else ipaddress.ip_address(body).exploded if kind == "ip6" else "".join(c for c in body if c.isalnum())
            found.append((m.start(), m.end(), kind, canon, "n"))
            continue
        group = next(g for g in ("names", "cued", "known") if m.group(g) is not None)
        said, at = TITLES[m.group("title").casefold()] if group == "names" else "n", m.start(group)
        parts = m.group(group).split(" ")
        for i, part in enumerate(parts):
            if len(part) > 2 or not part.endswith("."):
                gender = said if i < len(parts) - 1 else "n"
                names[part.lower()] = gender if gender != "n" else names.get(part.lower(), "n")
                found.append((at, at + len(part), "name", part.lower(), "n"))
            at += len(part) + 1
    if names:
        again = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{_any(names)})(?![\p{{L}}\p{{M}}])", regex.IGNORECASE)
        inside = {p for a, b, *_ in found for p in range(a, b)}
        for m in again.finditer(text):
            if m.start() not in inside and m.group()[0].isupper() and m.group().lower() in names:
                found.append((m.start(), m.end(), "name", m.group().lower(), "n"))
    return sorted((a, b, kind, canon, names[canon] if kind == "name" else said) for a, b, kind, canon, said in found)


def _ip6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def first_gender(name: str, said: str) -> str:
    """The gender of the first proposal in a text: what the name states, else what the text's titles say."""
    return stated(name) if name in GIVEN else said


class Keyed:
    """Numbers from a key, a kind, an entity and an attempt; the same for the same four."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        seed = "\x00".join((kind, entity, str(attempt))).encode()
        self.key, self.seed, self.block, self.pool = key, seed, 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            more = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
            self.pool, self.left = int.from_bytes(more, "big"), 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


#: Letters from which names are built, consonants and vowels by script, and feminine and masculine ends.
SOUNDS = {
    "LATIN": ("bcdfglmnprstv", "aeiou", "a", "n"),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", "а", "н"),
    "GREEK": ("βγδζκλμνπρστ", "αεηιου", "α", "ς"),
}


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


def _word(draw: Keyed, model: str, gender: str) -> str:
    """A made-up name in the script of ``model``, about as long, ended by gender. Its stem does not depend on gender."""
    script = _script(model[0])
    if script not in SOUNDS:
        #: Letters of the same script near the given one; other signs stay.
        out = []
        for ch in model:
            near = [c for c in map(chr, range(max(0, ord(ch) - 40), ord(ch) + 41)) if c.isalpha() and _script(c) == _script(ch) and c.isupper() == ch.isupper()] if ch.isalpha() else []
            out.append(near[draw.below(len(near))] if near else ch)
        return "".join(out)
    hard, soft, female, male = SOUNDS[script]
    n = max(6, len(model))
    out = "".join((hard if i % 2 == 0 else soft)[draw.below(len(hard if i % 2 == 0 else soft))] for i in range(n - n % 2))
    return out[:-1] + female if gender == "f" else out + male if gender == "m" else out


#: Attempts after which a number grows by a digit an attempt, an address becomes one of six groups, and a name grows by a
#: syllable: the space of a format may be full, and different entities stay different all the same.
ROOM = 24


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str | None = None) -> str:
    """The canonical form that stands in for an entity; ``gender`` is that of a name, by default the one it states itself."""
    draw, more = Keyed(key, kind, entity, attempt), max(attempt - ROOM, 0)
    extra = lambda: "".join(str(draw.below(10)) for _ in range(more))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        text = "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in local)
        host = Keyed(key, "domain", domain, 0)
        label = "".join(chr(97 + host.below(26)) for _ in range(6))
        return text + "".join(chr(97 + draw.below(26)) for _ in range(max(attempt - 8, 0))) + f"@{label}.example.{'com' if domain.endswith('.com') else 'org'}"
    if kind == "ip6" or kind == "ip" and more:
        return ipaddress.IPv6Address((0x20010DB8 << 96) + (draw.below(1 << 48) << 48) + draw.below(1 << 48)).exploded
    if kind == "ip":
        while True:
            a = 1 + draw.below(223)
            if a not in (10, 127):
                return f"{a}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}"
    if kind == "card":
        body = entity[0] + "".join(str(draw.below(10)) for _ in entity[1:-1]) + extra()
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in entity[4:]) + extra()
        rest = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{98 - rest:02d}{body}"
    if kind == "ssn":
        return f"9{draw.below(100):02d}{draw.below(100):02d}{draw.below(10000):04d}" + extra()
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        return entity[:keep] + "".join(str(1 + draw.below(9)) if i == 0 else str(draw.below(10)) for i in range(len(entity) - keep)) + extra()
    if kind == "street":
        number, *words, last = entity.split(" ")
        return " ".join([str(1 + draw.below(10 ** len(number) - 1)), *(_name(draw, w, "n", more) for w in words), last])
    return _name(draw, entity, gender or stated(entity), more)


def _name(draw: Keyed, model: str, gender: str, more: int) -> str:
    """A made-up name with the hyphens of ``model``; the last of its parts has the ending."""
    parts = [p for p in model.split("-") if p]
    made = [_word(draw, p, gender if i == len(parts) - 1 else "n") for i, p in enumerate(parts)]
    return "-".join(made) + "".join(_word(draw, parts[0], "n")[:2] for _ in range(more))


def render(kind: str, shown: str, new: str) -> str:
    """The surrogate in the format of the text: separators of numbers and capitals of names and addresses stay as they were."""
    if kind == "ip" and ":" not in new:
        return new
    if kind in ("ip", "ip6"):
        short = ipaddress.ip_address(new).compressed if "::" in shown or kind == "ip" else new
        return short.upper() if shown.isupper() else short
    if kind in ("email", "name", "street"):
        if shown.isupper() and len(shown) > 1:
            return new.upper()
        if kind == "email":
            return new
        capital = lambda w, like: w[:1].upper() + w[1:] if like[:1].isupper() else w
        word = lambda w, like: "-".join(capital(a, b) for a, b in zip(w.split("-"), [*like.split("-"), *[like[:1]] * w.count("-")]))
        return " ".join(word(a, b) for a, b in zip(new.split(" "), shown.split(" ")))
    signs, out = iter(new), []
    for c in shown:
        out.append(next(signs, "") if c.isalnum() else c)
    return "".join(out) + "".join(signs)


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = set()
        for row, text in zip(part.column(0).to_pylist(), part.column(1)):
            rows |= {(row, kind, canon, said) for _, _, kind, canon, said in _detect(text.as_py())}
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], ["at", "kind", "entity", "said"])


def _retry(key: bytes):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds, entities, tries, genders = (part.column(i).to_pylist() for i in range(4))
            new = [surrogate(key, k, e, t, g) for k, e, t, g in zip(kinds, entities, tries, genders)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(new, pa.string())], ["kind", "entity", "attempt", "gender", "surrogate"])

    return run


_PROPOSAL = "kind string, entity string, attempt int, gender string, surrogate string"


def genders(found: DataFrame) -> DataFrame:
    """Entities of the corpus once: (kind, entity, gender). A name has the gender that it states itself, else the one that most
    titles say (of as many, f), else none (null); ``found`` has a row per text and entity, with ``said`` (m, f or n)."""
    votes = found.groupBy("kind", "entity").agg(F.count_if(F.col("said") == "m").alias("m"), F.count_if(F.col("said") == "f").alias("f"))
    own = F.col("entity").isin(*GIVEN)
    said = F.when(~own & (F.col("m") > F.col("f")), "m").when(~own & (F.col("f") > 0), "f")
    return votes.select("kind", "entity", F.when(F.col("kind") == "name", said).alias("gender"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """Surrogates of all entities, all different: (kind, entity, attempt, gender, surrogate).

    ``found`` has (kind, entity, gender). Entities of a kind whose proposal another has too, or that some text holds as real
    data, propose again with the next attempt; of those that share one the smallest entity keeps it. All of this is
    grouped by proposal, so nothing gathers in one place. Rounds end when nothing collides, and they do end: after ROOM
    attempts proposals grow.
    """
    first = found.select("kind", "entity", F.lit(0).alias("attempt"), "gender").mapInArrow(_retry(key), _PROPOSAL)
    now = stage(first, "proposals")
    real = now.select(F.col("kind").alias("k"), F.col("entity").alias("e"))
    while True:
        rivals = W.partitionBy("kind", "surrogate").orderBy("attempt", "entity")
        judged = now.withColumn("place", F.row_number().over(rivals)).join(real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("e")), "left")
        bad = judged.where("place > 1 or e is not null")
        if not bad.take(1):
            return now
        again = bad.select("kind", "entity", (F.col("attempt") + 1).alias("attempt"), "gender").mapInArrow(_retry(key), _PROPOSAL)
        good = judged.where("place = 1 and e is null").select("kind", "entity", "attempt", "gender", "surrogate")
        now = stage(good.unionByName(again), "proposals")


def replace(text: str | None, key: bytes, changed: dict[tuple[str, str], str]) -> tuple[str | None, int]:
    """The text with its entities replaced, and their number; ``changed`` has the surrogates that are not the first proposal."""
    spans = _detect(text)
    out, at = [], 0
    for a, b, kind, canon, said in spans:
        new = changed.get((kind, canon)) or surrogate(key, kind, canon, 0, first_gender(canon, said))
        out += [text[at:a], render(kind, text[a:b], new)]
        at = b
    return ("".join([*out, text[at:]]) if spans else text), len(spans)


def _apply(key: bytes):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, counts = [], []
            changes = part.column(2).to_pylist()
            for i, text in enumerate(part.column(1)):
                changed = {(c["kind"], c["entity"]): c["surrogate"] for c in changes[i] or []}
                new, n = replace(text.as_py(), key, changed)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_entities"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Texts with surrogates for personal data: (doc_id, text, n_entities), one row per row of ``docs``.

    Entities are e-mail addresses, IPv4 and IPv6 addresses, IBANs, payment cards, US social security numbers, phone numbers,
    street addresses and names (:func:`detect`). A surrogate depends on ``key`` and the entity, and a name's on the gender
    that the corpus says of it, so mentions agree within and across texts; it has the entity's kind, script, capitals,
    hyphens and separators, names their gender, cards and IBANs valid check digits. No two entities of a kind share one, and
    none is an entity of the corpus (:func:`assign`). Texts without entities, null and empty ones included, stay as they are;
    repeated rows get the same replacements; a null doc_id is kept; an empty table gives an empty result; other columns are
    ignored. Only surrogates other than an entity's first proposal are joined to texts, by a hash of the text.
    """
    src = docs.selectExpr(f"cast(`{id}` as long) as doc_id", f"`{text}` as text", f"xxhash64(`{text}`) as at")
    found = stage(map_batches(src.select("at", "text"), _find, "at long, kind string, entity string, said string"), "entities")
    given = assign(genders(found), key).select("kind", "entity", "attempt", "gender", F.col("surrogate").alias("new"))
    #: The first proposal of a text for a name is by the gender that its own titles say.
    differs = (F.col("attempt") > 0) | ((F.col("kind") == "name") & ~F.col("entity").isin(*GIVEN) & (F.coalesce("gender", F.lit("n")) != F.col("said")))
    change = F.struct("kind", "entity", F.col("new").alias("surrogate"))
    by_text = stage(found.distinct().join(given, ["kind", "entity"]).where(differs).groupBy("at").agg(F.collect_list(change).alias("changes")), "changes")
    if not by_text.take(1):
        rows = src.withColumn("changes", F.lit(None).cast(by_text.schema["changes"].dataType))
    else:
        rows = src.join(by_text, "at", "left")
    return map_batches(rows.select("doc_id", "text", "changes"), _apply(key), "doc_id long, text string, n_entities long")
