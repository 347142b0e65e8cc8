"""WARC archives: writing, reading, and assembling request, response and metadata records into captures."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import realign, stage

#: Fixed values of the format (WARC 1.1, HTTP 1.1, RFC 4648 base 32).
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "file string, offset long, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, "
    "date string, declared_digest string, payload_bytes long, payload_digest string, head string, payload binary"
)


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(kind: str, key: Column) -> Column:
    code = F.md5(F.concat(F.lit(f"{kind}|"), key))
    dashed = F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without its closing blank lines, which the text writer adds as its line separator. A null header is left out."""
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), size, F.lit(END), block)


def _one_line(text: Column) -> Column:
    """A value that fits into a header line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20]+", "%20")


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Which pages are stored and which revisit: (page_id, uri, payload_bytes, payload_digest, keep_id).

    Of pages with equal payloads of at least ``least`` bytes the largest page_id is stored. The minimum is
    grouped with partial sums; the join back splits hot digests by adaptive execution.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = stage(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), sha1_base32(F.encode(body, "UTF-8")).alias("payload_digest")),
        "payloads",
    )
    best = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("best_id"))
    joined = rows.join(realign(best, "payload_digest", "payload_bytes"), ["payload_digest", "payload_bytes"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", F.coalesce("best_id", "page_id").alias("keep_id")).distinct()


def write_warc(pages: DataFrame, path: str, least: int = 0, most: int = 30_000) -> None:
    """Write gzipped archives under ``path``: for each page a request, a response or revisit, and a metadata record.

    ``pages`` has page_id, url and html; the payload is the html in UTF-8, null counts as empty. The response
    or revisit record names its capture; the others point to it by WARC-Concurrent-To. A revisit stores no
    payload and refers to the record that does. page_id is written into the metadata record. Rows that
    repeat page_id and payload are one capture; a null page_id is an identifier of its own that never outranks
    another. Empty tables give no records. An archive holds at most ``most`` records of one task.
    """
    plan = plan_records(pages, least).select(F.col("page_id").alias("p_id"), F.col("payload_digest").alias("p_digest"), "keep_id")
    html = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), sha1_base32(F.encode(html, "UTF-8")).alias("payload_digest"))
    full = src.join(plan, F.col("page_id").eqNullSafe(F.col("p_id")) & (F.col("payload_digest") == F.col("p_digest")))
    named = lambda c: F.concat(F.coalesce(c.cast("string"), F.lit("null")), F.lit("|"), F.col("payload_digest"))
    key, stays = named(F.col("page_id")), F.col("keep_id").eqNullSafe(F.col("page_id"))
    main = F.when(stays, _record_id("response", key)).otherwise(_record_id("revisit", key))
    uri = _one_line(F.col("url"))
    path_part = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(uri, r"^[a-zA-Z]+://([^/]*)", 1)
    common = lambda rid: [("WARC-Record-ID", rid), ("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    refers = [("WARC-Refers-To", _record_id("response", named(F.col("keep_id")))), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Truncated", F.lit("length"))]
    http = "application/http; msgtype="
    response = _record("response", [*common(main), digest], http + "response", F.concat(status, F.col("html")))
    revisit = _record("revisit", [*common(main), digest, *refers], http + "response", status)
    asked = F.concat(F.lit("GET "), path_part, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record("request", [*common(_record_id("request", key)), ("WARC-Concurrent-To", main)], http + "request", asked)
    facts = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", [*common(_record_id("metadata", key)), ("WARC-Concurrent-To", main)], "application/warc-fields", facts)
    stored = F.when(stays, response).otherwise(revisit)
    records = full.select(F.explode(F.array(request, stored, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _open(content: bytes) -> bytes:
    """An archive's bytes; gzip may have one member or one per record."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse(data: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Records of an archive: offset, type, ids, uri, date, digest and payload, led by their declared lengths.

    The header that names concurrent records may repeat. The payload of an HTTP block is what follows its header; of other blocks, the block. Records cut short
    by the archive's end are given with what there is.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        split = data.find(b"\r\n\r\n", at)
        if split < 0:
            return
        head, beside = {}, []
        for line in data[at:split].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip().decode("utf-8", "replace")
            if name == b"warc-concurrent-to":
                beside.append(value)
            head[name] = value
        length = head.get(b"content-length", "")
        length = int(length) if length.isdigit() else 0
        block = data[split + 4 : split + 4 + length]
        kind, front = head.get(b"warc-type"), b""
        if head.get(b"content-type", "").startswith("application/http"):
            front, _, body = block.partition(b"\r\n\r\n")
        else:
            body = block
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        given = head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        keep = payloads or kind == "metadata"
        yield (
            at, kind, head.get(b"warc-record-id"), beside or None, head.get(b"warc-refers-to"), head.get(b"warc-target-uri"),
            head.get(b"warc-date"), given, len(body), digest, front.decode("latin-1"), body if keep else None,
        )
        at = split + 4 + length


_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 2, pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (RECORD) of all archives under ``path``, plain or gzipped.

    Spark's own reader fetches the archives, so any store it reaches will do; one archive at a time is in a
    task's memory. ``payloads=False`` keeps digests and lengths, computed from the bytes read, without the bodies.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, content in zip(part.column(0).to_pylist(), part.column(1)):
                rows, size = [], 0
                for record in parse(_open(content.as_py()), payloads):
                    rows.append((file, *record))
                    size += len(record[-1] or b"") + 500
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """Transactions: one nested row per capture, its records joined through their concurrent-to identifiers.

    Returns (capture_id, uri, main STRUCT, requests ARRAY<STRUCT>, metadata ARRAY<STRUCT>, others ARRAY<STRUCT>).
    The main record is a response, revisit or resource. Another record belongs to the main record it names, or
    that names it; a record that names other side records follows them to their capture, over any number of steps,
    and goes to the nearest, of several the least.
    Records that reach no main record form captures of their own, with a null main, under the identifier they
    name or else their own; warcinfo records are left out. Records without identifier are captures of their own
    and lie under a digest of their place. Records whose identifier occurs twice are taken once, the first by file and
    offset. An empty table gives no captures.
    """
    kinds = ["response", "revisit", "resource"]
    named = records.where(F.coalesce(F.col("type"), F.lit("")) != "warcinfo").withColumn(
        "record_id", F.coalesce("record_id", F.concat(F.lit("<at:"), F.md5(F.concat_ws("|", "file", F.col("offset").cast("string"))), F.lit(">")))
    )
    body = F.struct(*[c for c in named.columns])
    main = named.where(F.col("type").isin(kinds))
    rest = named.where(~F.coalesce(F.col("type").isin(kinds), F.lit(False)))
    mains = main.groupBy("record_id").agg(F.min_by(body, F.struct("file", "offset")).alias("main"))
    #: Links of side records to captures: they name a main record, or it names them.
    points = rest.select(F.col("record_id").alias("side"), F.explode("concurrent_to").alias("to"))
    heads = main.select(F.col("record_id").alias("capture")).distinct()
    names = main.select(F.explode("concurrent_to").alias("side"), F.col("record_id").alias("capture"))
    direct = points.join(heads, points["to"] == heads["capture"]).select("side", "capture").union(names).groupBy("side").agg(F.min("capture").alias("capture"))
    known = near = stage(direct, "links")
    while True:
        #: What names a record placed in the last step and has no place yet; chains are short, so steps are few.
        step = points.join(near.select(F.col("side").alias("to"), "capture"), "to").join(known.select("side"), "side", "left_anti")
        near = stage(step.groupBy("side").agg(F.min("capture").alias("capture")), "links")
        if not near.take(1):
            break
        known = known.union(near)
    placed = (
        rest.select("record_id", "concurrent_to", "type", body.alias("record"))
        .join(known, F.col("record_id") == F.col("side"), "left")
        .select(F.coalesce("capture", F.array_min("concurrent_to"), "record_id").alias("capture"), "type", "record")
    )
    of = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("record"))))
    kind = F.coalesce(F.col("type"), F.lit(""))
    sides = placed.groupBy("capture").agg(
        of(kind == "request").alias("requests"), of(kind == "metadata").alias("metadata"), of(~kind.isin("request", "metadata")).alias("others")
    )
    both = mains.join(sides, F.col("record_id") == F.col("capture"), "full")
    return both.select(
        F.coalesce("record_id", "capture").alias("capture_id"),
        F.coalesce("main.uri", F.get("requests", 0)["uri"], F.get("metadata", 0)["uri"], F.get("others", 0)["uri"]).alias("uri"),
        "main",
        *[F.coalesce(F.col(c), F.array().cast(sides.schema[c].dataType)).alias(c) for c in ("requests", "metadata", "others")],
    )


def captures(records: DataFrame) -> DataFrame:
    """Captures of this module's own archives with revisits resolved: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A revisit takes its payload from the record it refers to; ``refers_to`` is that record's page_id. A revisit
    whose target is missing has a null length and its declared digest.
    """
    page = F.regexp_extract(F.get("metadata", 0)["payload"].cast("string"), r"page_id: (-?\d+)", 1)
    found = assemble(records).where("main is not null").select(
        "capture_id",
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        F.col("main.type").alias("record_type"),
        F.col("main.refers_to").alias("to"),
        F.col("main.declared_digest").alias("declared"),
        F.col("main.payload_bytes").alias("bytes"),
        F.col("main.payload_digest").alias("digest"),
    )
    found = stage(found, "captures")
    stored = found.where("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("target_page"), F.col("bytes").alias("target_bytes"), F.col("digest").alias("target_digest")
    )
    again = F.col("record_type") == "revisit"
    return found.join(stored, again & (F.col("to") == F.col("target")), "left").select(
        "page_id",
        F.when(again, F.col("target_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, F.coalesce("target_digest", "declared")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("target_page")).alias("refers_to"),
    )
