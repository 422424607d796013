"""WARC archives: written from captured pages, read back, and assembled to one row per capture.

A page becomes three records: its response (or a revisit of an equal payload), the request and
a metadata record; request and metadata name the response in WARC-Concurrent-To. Every record
is a gzip member of its own; between two members stands an empty member, which readers pass over.

Defined cases: null html is an empty payload; a null url writes no WARC-Target-URI; a page with a
null page_id is always a response; rows equal in page_id and payload are captures of their own,
numbered in their record ids; an empty table gives no rows; further columns are ignored. Control characters and blanks in a url
are percent-encoded, so no url can break a header."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom.llm.common import parts, read_raw, shared_path, stored, write_raw

FILE_BYTES = 48 << 20  # payload bytes per archive: an archive is read whole
PIECE = 16 << 10  # compressed bytes inflated at once
PAGE_KEY = "page_id"
CRLF = b"\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
WHEN = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_bytes long, payload_digest string, fields map<string,string>"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return zlib_member("\r\n".join(lines).encode() + block + CRLF + CRLF)


def zlib_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def capture_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, copy: int = 0) -> list[bytes]:
    """The three records of a page; ``first`` is the page whose response this one revisits, ``copy`` tells
    rows of equal page_id and payload apart."""
    sha = digest(payload)
    name = lambda page, kind, copy=copy: f"<urn:capture:{'null' if page is None else page}:{sha}:{copy}:{kind}>"
    own = name(page_id, "response")
    target = [] if url is None else [("WARC-Target-URI", _safe(url))]
    same = [("WARC-Date", WHEN), *target]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if first is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), *same, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(first, "response", 0))]
    rest = _safe(url or "").partition("://")[2]
    host, _, path = rest.partition("/")
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    linked = [("WARC-Concurrent-To", own)]
    fields = f"{PAGE_KEY}: {'' if page_id is None else page_id}\r\n".encode()
    return [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", name(page_id, "request")), *same, *linked, ("Content-Type", "application/http;msgtype=request")], ask),
        _record(head, http + (payload if first is None else b"")),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", name(page_id, "metadata")), *same, *linked, ("Content-Type", "application/warc-fields")], fields),
    ]


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, _first) of the pages whose payload, of ``min_bytes`` at least, a page with a
    larger page_id holds too. Only ids and digests are shuffled; groups are summed before the
    exchange, and the join back is a plain equi-join that adaptive execution can split."""
    ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    ids = ids.filter((F.col("_n") >= min_bytes) & F.col("page_id").isNotNull())
    last = ids.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.min("page_id").alias("_least")).filter("_least < _first").select("_sha", "_first")
    return ids.join(last, "_sha").filter("page_id < _first").select("page_id", "_sha", "_first").distinct()


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of all ``pages`` (page_id, url, html) in the folder ``path``. The payloads cross the network
    once: they are dealt by page_id and digest to files of about ``FILE_BYTES``, the revisits are dealt
    alike, and the join and the numbering of repeats keep that layout."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    files = parts(size, FILE_BYTES)
    seen = stored(revisits(pages, min_bytes), "revisits").repartition(files, "page_id", "_sha")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, first, copy in zip(*(batch.column(c) for c in ("page_id", "url", "html", "_first", "_copy"))):
                made = EMPTY_MEMBER.join(capture_records(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py(), copy.as_py()))
                out.append(made)
                held += len(made)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, held = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    dealt = pages.withColumn("_sha", F.sha1(F.coalesce("html", F.lit("")))).repartition(files, "page_id", "_sha")
    full = dealt.join(seen, ["page_id", "_sha"], "left")
    full = full.withColumn("_copy", F.row_number().over(W.partitionBy("page_id", "_sha").orderBy("url")) - 1)
    write_raw(full.select("page_id", "url", "html", "_first", "_copy").mapInArrow(records, "value binary"), path, EMPTY_MEMBER.decode("latin-1"))


# ---- reading ----------------------------------------------------------------------------


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of an archive, inflated one at a time; plain archives pass as one. A member is fed
    piece by piece, so that only the rest of a piece is ever copied behind its end."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = data[at : at + PIECE]
            if not len(piece):
                raise ValueError("the archive ends within a member")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if any(out):
            yield b"".join(out)


def parsed(member: bytes) -> Iterator[tuple[list[tuple[str, str]], memoryview]]:
    """(headers, block) of the records of a member; Content-Length alone ends a block."""
    at, whole = 0, memoryview(member)
    while at < len(member):
        while member.startswith(CRLF, at):
            at += 2
        if at >= len(member):
            return
        stop = member.index(b"\r\n\r\n", at)
        lines = member[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        n = int(next(v for k, v in headers if k == "content-length"))
        yield headers, whole[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def _row(headers: list[tuple[str, str]], block: memoryview, with_payload: bool) -> dict:
    one = dict(headers)
    row = {
        "record_id": one.get("warc-record-id"),
        "type": one.get("warc-type"),
        "target_uri": one.get("warc-target-uri"),
        "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
        "refers_to": one.get("warc-refers-to"),
    }
    fields, payload, size, sha = {}, None, None, one.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if row["type"] in ("response", "revisit"):
        raw = bytes(block)
        head, _, body = raw.partition(b"\r\n\r\n")
        if row["type"] == "response":
            payload, size, sha = body, len(body), digest(body)
        elif found := re.search(rb"(?im)^content-length:[ \t]*(\d+)", head):
            size = int(found[1])
    elif one.get("content-type") == "application/warc-fields":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in bytes(block).decode("utf-8", "replace").split("\r\n")) if k.strip()}
    row |= {"payload_bytes": size, "payload_digest": sha, "fields": list(fields.items())}
    if with_payload:
        row["payload"] = payload
    return row


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``. Size and digest of a response are
    taken from the payload itself, those of a revisit from its headers."""
    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")] + (["payload"] if with_payload else [])
    types = {"concurrent_to": pa.list_(pa.string()), "payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for member in members(memoryview(content.as_buffer())):
                    for headers, block in parsed(member):
                        rows.append(_row(headers, block, with_payload))
                        held += 500 + len(block) * with_payload
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read_raw(spark, path).select("content").mapInArrow(records, RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, response, request, metadata, n_requests, n_metadata): one nested row per
    response or revisit record. A companion belongs to the capture that it names in
    WARC-Concurrent-To, that names it, or that a request it names belongs to. Of several
    companions of a kind the one with the smallest record id is shown and all are counted, so a
    capture with very many companions stays one small row. A repeated record counts once;
    companions that lead to no capture are left out."""
    kept = [c for c in ("target_uri", "refers_to", "payload_bytes", "payload_digest", "fields", "payload") if c in records.columns]
    anchors = records.filter(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull())
    others = records.filter(F.col("type").isin("request", "metadata") & F.col("record_id").isNotNull())
    named = others.select("record_id", F.explode("concurrent_to").alias("_to"))
    held = anchors.select(F.col("record_id").alias("_to")).distinct()
    forward = named.join(held, "_to").select("record_id", F.col("_to").alias("capture_id"))
    backward = anchors.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id")).select("record_id", "capture_id")
    direct = forward.union(backward).distinct()
    through = named.join(direct.select(F.col("record_id").alias("_to"), "capture_id"), "_to").select("record_id", "capture_id")
    links = direct.union(through).distinct()
    brief = F.struct("record_id", *[c for c in kept if c != "fields"])
    mine = others.select("record_id", "type", brief.alias("_brief"), "fields").join(links, "record_id")
    # Maps cannot be compared, so the record with the smallest id is picked with min_by.
    pick = lambda kind, what: F.min_by(F.when(F.col("type") == kind, F.col(what)), F.when(F.col("type") == kind, F.col("record_id")))
    count = lambda kind: F.count_distinct(F.when(F.col("type") == kind, F.col("record_id")))
    side = mine.groupBy("capture_id").agg(
        pick("request", "_brief").alias("request"),
        pick("metadata", "_brief").alias("_meta"),
        pick("metadata", "fields").alias("_fields"),
        count("request").alias("n_requests"),
        count("metadata").alias("n_metadata"),
    )
    main = anchors.select(F.col("record_id").alias("capture_id"), F.struct("type", *[c for c in kept if c != "fields"]).alias("response"))
    main = main.groupBy("capture_id").agg(F.first("response").alias("response"))
    return main.join(side, "capture_id", "left").select(
        "capture_id",
        "response",
        "request",
        F.when(F.col("_meta").isNotNull(), F.struct("_meta.*", F.col("_fields").alias("fields"))).alias("metadata"),
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives, reads these back and assembles the captures."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return assemble(stored(read(pages.sparkSession, path), "warc-records"))
