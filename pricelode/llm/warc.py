"""WARC archives: written with duplicates as revisits and long records in segments, read back and put together.

Every page has a record of its own, with its url.  A record holds an HTTP response whose payload is framed in chunks.  Of
pages with equal payloads that with the largest page_id (of several, with the largest url) is written as ``response``,
the others as ``revisit`` without payload, repeated rows too.  A block of over ``SEGMENT`` bytes is cut: the first part is
the record, the others are ``continuation`` records that name its id and their number, the last one the whole length.
Records, parts included, go through Spark's text sink (raw bytes, CR LF CR LF is its row end, as WARC asks for),
compressed by gzip, so files appear by its commit protocol only and in any store; a file has ``PER_FILE`` of them at
most, none longer than its head and ``SEGMENT`` bytes, so no page makes a file large.

Reading parses each file by Content-Length, decodes whole records at once, and groups only the parts of segmented
ones by origin: they are ordered by number, checked for gaps and whole length, and their chunk framing is taken off.

A null html is an empty payload.  A null page_id or url is the smallest and stays null.  Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch, new_path, slices, staged

SEGMENT = 32 << 10
CHUNK = 4 << 10
PER_FILE = 512
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
ROW = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, origin string, number int, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload inside chunked framing; extensions of a size line and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(sha: str, row: int | None = None) -> str:
    """Id of the response with a payload, or of the revisit by a row."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{sha}' if row is None else f'revisit:{sha}:{row}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the CR LF CR LF at its end."""
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def page_records(page_id: int | None, url: str | None, sha: str, payload: bytes, segment: int = SEGMENT) -> list[bytes]:
    """The response record of a page, in as many parts as it takes."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    rid, parts = record_id(sha), [block[i : i + segment] for i in range(0, len(block), segment)]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}:{i}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", i)]
        out.append(_record([*more, ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part))
    return out


def revisit_record(page_id: int | None, url: str | None, row: int, sha: str, n: int, refers: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(sha, row)), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)), ("WARC-Page-ID", page_id), ("WARC-Refers-To", record_id(sha)), ("WARC-Refers-To-Page-ID", refers)]
    return _record([*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], block)


def uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files under ``path``."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(html).alias("sha"), html.cast("binary").alias("payload"))
    first = F.max(F.struct("page_id", "url")).alias("first")

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            out: list[bytes] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "payload")), strict=True):
                out += page_records(*row)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "row", "sha", "n", "refers")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([revisit_record(*r) for r in rows], pa.binary())], ["record"])

    with Scratch(pages.sparkSession) as scratch:
        # a narrow row for each page; which of a payload's is first is an aggregate, so many copies of one make no large task
        rows = own.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
        rows = scratch.staged(rows, "page-keys")
        best = rows.groupBy("sha").agg(F.max(F.struct("page_id", "url", "row")).alias("best"))
        again = rows.join(best, "sha").filter("row <> best.row").select("page_id", "url", "row", "sha", "n", F.col("best.page_id").alias("refers"))
        full = own.groupBy("sha").agg(first, F.first("payload").alias("payload")).select("first.page_id", "first.url", "sha", "payload")
        records = full.mapInArrow(responses, "record binary").union(again.mapInArrow(revisits, "record binary"))
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        yield fields, raw[begin:at]
        at += 4


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response, its framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of the archives: what its record, put together, says."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column("content"):
                out: list[tuple] = []
                for f, block in parse_records(gzip.decompress(content.as_buffer())):
                    rid, page, url, kind = f["warc-record-id"], number(f.get("warc-page-id")), f.get("warc-target-uri"), f["warc-type"]
                    part = number(f.get("warc-segment-number"))
                    if part is not None:
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        out.append((rid, page, url, kind, None, digest, None, f.get("warc-segment-origin-id", rid), part, number(f.get("warc-segment-total-length")), block))
                    elif kind == "revisit":
                        n = next(int(x[15:]) for x in block.decode().split("\r\n") if x.startswith("Content-Length:"))
                        out.append((rid, page, url, kind, n, f["warc-payload-digest"].removeprefix("sha1:"), number(f.get("warc-refers-to-page-id")), None, None, None, None))
                    else:
                        payload = payload_of(block)
                        digest = base32_sha1(payload)
                        if f["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{rid}: the payload has another digest")
                        out.append((rid, page, url, kind, len(payload), digest, None, None, None, None, None))
                names, kinds = zip(*(x.split() for x in ROW.split(", ")), strict=True)
                types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], list(names))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                parts = r["parts"]
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != r["total"]:
                    raise ValueError(f"{r['record_id']}: segments are missing")
                payload = payload_of(block)
                digest = base32_sha1(payload)
                if digest != r["payload_digest"]:
                    raise ValueError(f"{r['record_id']}: the payload has another digest")
                out.append((r["record_id"], r["page_id"], r["url"], "response", len(payload), digest, None))
            columns = zip(*out, strict=True) if out else [[]] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in ROW.split(", ")[:7]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = staged(files.mapInArrow(parse, ROW), "records")
    plain = rows.filter("origin is null").drop("origin", "number", "total", "block")
    parts = rows.filter("origin is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("payload_digest"), F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    put = parts.withColumnRenamed("origin", "record_id").mapInArrow(whole, ", ".join(ROW.split(", ")[:7]))
    return plain.union(put).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sql() -> str:
    """The same in DuckDB's SQL, without archives."""
    base32 = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, (j // 4 * 5 + 1)::int, 5))::bigint >> (15 - j % 4 * 5)::int) & 31) + 1)::int, 1)), '')"
    return f"""with p as (select page_id::bigint as page_id, url, sha1(coalesce(html, '')) as sha, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
k as (select *, row_number() over w as rn, first(page_id) over w as best from p window w as (partition by sha order by page_id desc nulls last, url desc nulls last))
select page_id, n as payload_bytes, {base32} as payload_digest, case when rn = 1 then 'response' else 'revisit' end as record_type, case when rn > 1 then best end as refers_to from k"""
