"""Cursors, pages and size bounds (O-22, O-87, O-88)."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.errors import CursorError, ResultTooLarge

CURSOR_VERSION = 1
TTL_SECONDS = 15 * 60
CEILING, RESERVE = 28_000, 768


def digest(*fields: str) -> str:
    """SHA-256 over length-prefixed fields, so that no two lists of fields collide by joining."""
    h = hashlib.sha256()
    for f in fields:
        raw = f.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()


def _sum(body: dict) -> str:
    return digest(*[f"{k}={body[k]}" for k in sorted(body)])


def encode_cursor(operation: str, generation: str, request: str, offset: int, now: float | None = None) -> str:
    body = {"version": CURSOR_VERSION, "operation": operation, "generation": generation, "request": request, "offset": offset, "expiry": int((now or time.time()) + TTL_SECONDS)}
    return json.dumps(body | {"checksum": _sum(body)}, sort_keys=True).encode().hex()


def decode_cursor(text: str, operation: str, generation: str, request: str, total: int, now: float | None = None) -> int:
    """The cursor's offset; raises with code checksum, other_request, other_generation, expired or out_of_range."""
    try:
        body = json.loads(bytes.fromhex(text))
        given = body.pop("checksum")
    except (ValueError, KeyError, AttributeError):
        raise CursorError("checksum") from None
    if given != _sum(body) or body.get("version") != CURSOR_VERSION:
        raise CursorError("checksum")
    if body["operation"] != operation or body["request"] != request:
        raise CursorError("other_request")
    if body["generation"] != generation:
        raise CursorError("other_generation")
    if body["expiry"] < (now or time.time()):
        raise CursorError("expired")
    if body["offset"] > total:
        raise CursorError("out_of_range")
    return body["offset"]


def page_window(operation: str, generation: str, request: str, cursor: str | None, limit: int, total: int, now: float | None = None) -> dict:
    """O-87: offset, returned, has_more and the next cursor of a page over a total order of ``total`` rows."""
    offset = decode_cursor(cursor, operation, generation, request, total, now) if cursor else 0
    returned = max(0, min(limit, total - offset))
    more = offset + returned < total
    return {"offset": offset, "limit": limit, "returned": returned, "total_items": total, "has_more": more, "next_cursor": encode_cursor(operation, generation, request, offset + returned, now) if more else None}


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """The rows of one page of a totally ordered result; sorted and cut by Spark, not collected."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def fit_rows(rows: DataFrame, order: list, ceiling: int = CEILING - RESERVE) -> DataFrame:
    """O-88: the longest prefix of a page, in its order, whose rows as JSON stay below a size; raises if not even one fits.

    ``rows`` is a page: a bounded number of rows, whose sizes are summed in one window.
    """
    sized = rows.withColumn("__json", F.length(F.to_json(F.struct(*rows.columns))) + 1)
    total = sized.withColumn("__sum", F.sum("__json").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    fit = total.where(F.col("__sum") <= ceiling)
    if rows.take(1) and not fit.take(1):
        raise ResultTooLarge(ceiling)
    return fit.drop("__json", "__sum")


def to_json(rows: DataFrame) -> DataFrame:
    """O-22: one JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
