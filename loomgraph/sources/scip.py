"""Compiler indexes in the public SCIP format, read from their bytes (O-11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OCCURRENCES = "index string, path string, line int, end_line int, symbol string, is_definition boolean"
RELATIONSHIPS = "index string, symbol string, target string, is_implementation boolean"

#: Field numbers of the format.
_DOCUMENTS, _EXTERNAL = 2, 3
_PATH, _OCCURRENCES, _SYMBOLS = 1, 2, 3
_RANGE, _SYMBOL, _ROLES = 1, 2, 3
_OWN_SYMBOL, _RELATIONSHIPS = 1, 4
_TARGET, _IS_IMPLEMENTATION = 1, 3

#: Small indexes are handed on together, so many rows or those of one index at a time.
_TOGETHER = 10_000


def _varint(body: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = body[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(body: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields; raises on a message cut short."""
    at = 0
    while at < len(body):
        key, at = _varint(body, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(body, at)
            yield key >> 3, value
            continue
        size, at = _varint(body, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
        if at + size > len(body):
            raise IndexError("message cut short")
        yield key >> 3, body[at : at + size]
        at += size


def _numbers(value: int | memoryview) -> list[int]:
    """A repeated number, packed or single."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def _text(value: int | memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")  # type: ignore[arg-type]


def _relations(index: str, info: memoryview) -> list[tuple]:
    symbol, out = "", []
    for number, value in _fields(info):
        if number == _OWN_SYMBOL:
            symbol = _text(value)
        elif number == _RELATIONSHIPS:
            said = dict(_fields(value))
            out.append((_text(said.get(_TARGET, memoryview(b""))), bool(said.get(_IS_IMPLEMENTATION, 0))))
    return [(index, symbol, *row) for row in out]


def parse(index: str, content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Rows of OCCURRENCES and RELATIONSHIPS of one index; none of a broken one. Lines count from 0."""
    seen, related = [], []
    try:
        for number, value in _fields(memoryview(content)):
            if number == _EXTERNAL:
                related += _relations(index, value)
            if number != _DOCUMENTS:
                continue
            document = list(_fields(value))
            path = next((_text(v) for n, v in document if n == _PATH), "")
            for n, v in document:
                if n == _SYMBOLS:
                    related += _relations(index, v)
                if n != _OCCURRENCES:
                    continue
                span, symbol, roles = [], "", 0
                for m, x in _fields(v):
                    if m == _RANGE:
                        span += _numbers(x)
                    elif m == _SYMBOL:
                        symbol = _text(x)
                    elif m == _ROLES:
                        roles = x
                if symbol and len(span) in (3, 4):
                    seen.append((index, path, span[0], span[2] if len(span) == 4 else span[0], symbol, bool(roles & 1)))
    except (IndexError, KeyError, TypeError):
        return [], []
    return seen, related


def _read(files: DataFrame, which: int, schema: str) -> DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows += parse(path, bytes(content or b""))[which]
                if len(rows) >= _TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def occurrences(files: DataFrame) -> DataFrame:
    """OCCURRENCES of index files (path, content). One index is one task's memory, as its messages can't be split."""
    return _read(files, 0, OCCURRENCES)


def relationships(files: DataFrame) -> DataFrame:
    """RELATIONSHIPS that index files (path, content) declare between symbols."""
    return _read(files, 1, RELATIONSHIPS)


def implements_edges(related: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, dst, kind) for relationships that implement, between defined symbols; ``definitions`` is (memory_id, symbol)."""
    a = definitions.selectExpr("memory_id as src", "symbol")
    b = definitions.selectExpr("memory_id as dst", "symbol as target")
    return related.where("is_implementation").join(a, "symbol").join(b, "target").where("src <> dst").selectExpr("src", "dst", "'implements' as kind").distinct()
