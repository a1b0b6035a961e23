"""Token ids in binary files: patched frame-of-reference blocks.

A file is a row of segments, each followed by a line feed.  A segment holds whole documents in ascending doc_id order:

    magic "PFR1" | u64 segment bytes | u32 documents, ids, blocks, block size
    documents x (i64 doc_id, u8 doc_id is null, u32 ids)
    blocks x u64 start of the block, counted from the first block (the index)
    blocks: u32 minimum | u8 width | u32 exceptions | words of 64 bits | u32 places of exceptions | u32 their high parts

All numbers are little-endian.  A block subtracts its minimum, packs the low ``width`` bits of each difference, where
``width`` holds the given percentile of the differences, and lists the high parts of the others as exceptions.
Segments are written through Spark's text sink (raw bytes, the line feed is its row end) with its commit protocol, so
a lost executor leaves no half-written file; ``SEGMENTS`` bounds a file, which is read back whole.  Files are dealt by
ranges of doc_id, of rows with one doc_id by text and then by place in the input, so no id makes a task large.

Null or empty text: the end id alone.  Null doc_id comes first and stays null; repeated rows are all written.  Other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import documents, new_path, partitions, slices, staged
from pricelode.llm.tokens import encoder, public_path

BLOCK = 1024
PERCENTILE = 95.0
SEGMENT_IDS = 1 << 17
SEGMENTS = 32
HEAD = struct.Struct("<4sQIIII")
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
BLOCK_HEAD = struct.Struct("<IBI")


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, size) values under 2**width to (blocks, words): 64 values take ``width`` words."""
    lanes = values.astype(np.uint64).reshape(-1, 64)
    out = np.zeros((len(lanes), width), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack_bits(words: np.ndarray, width: int, size: int) -> np.ndarray:
    blocks = len(words)
    if not width:
        return np.zeros((blocks, size), np.uint32)
    lanes = words.reshape(-1, width)
    out, mask = np.empty((len(lanes), 64), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = lanes[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= lanes[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(blocks, size).astype(np.uint32)


def encode_segment(docs: list[tuple[int | None, np.ndarray]], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment of whole documents; ``block`` is a multiple of 64."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    table = np.array([(d or 0, d is None, len(x)) for d, x in docs], DOC)
    blocks = -(-len(ids) // block)
    full = np.empty(blocks * block, np.uint32)
    full[: len(ids)] = ids
    if blocks:
        full[len(ids) :] = ids[-1]  # fills the last block; the count of ids says where to stop
    full = full.reshape(blocks, block)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    rank = min(block - 1, int(np.ceil(percentile / 100 * block)) - 1)
    edge = np.partition(diff, rank, axis=1)[:, rank] if blocks else low
    width = np.frexp(edge.astype(np.float64))[1].astype(np.int64)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        part = diff[which]
        packed = _pack_bits(part & np.uint32((1 << w) - 1), w)
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        for k, b in enumerate(which.tolist()):
            places = np.flatnonzero(high[k]).astype("<u4")
            bodies[b] = b"".join([BLOCK_HEAD.pack(int(low[b]), w, len(places)), packed[k].astype("<u8").tobytes(), places.tobytes(), high[k][places].astype("<u4").tobytes()])
    starts = np.cumsum([0, *map(len, bodies)])[:-1].astype("<u8") if blocks else np.zeros(0, "<u8")
    rest = [table.tobytes(), starts.tobytes(), *bodies]
    return b"".join([HEAD.pack(b"PFR1", HEAD.size + sum(map(len, rest)), len(docs), len(ids), blocks, block), *rest])


def decode_segment(data: memoryview) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents' table, all ids, and the bytes of one segment."""
    magic, size, docs, n, blocks, block = HEAD.unpack_from(data)
    if magic != b"PFR1" or size > len(data):
        raise ValueError("not a whole segment of ids")
    at = HEAD.size
    table = np.frombuffer(data, DOC, docs, at)
    at += docs * DOC.itemsize
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    first = at + 8 * blocks
    out, groups = np.empty((blocks, block), np.uint32), {}
    for b, s in enumerate(starts.tolist()):
        groups.setdefault(data[first + s + 4], []).append((b, *BLOCK_HEAD.unpack_from(data, first + s), first + s + BLOCK_HEAD.size))
    for w, rows in groups.items():
        words = block * w // 64
        which = [r[0] for r in rows]
        packed = np.stack([np.frombuffer(data, "<u8", words, r[4]) for r in rows])
        values = _unpack_bits(packed, w, block)
        for k, (_, _, _, exceptions, p) in enumerate(rows):
            if exceptions:
                q = p + 8 * words
                places = np.frombuffer(data, "<u4", exceptions, q)
                values[k, places] |= np.frombuffer(data, "<u4", exceptions, q + 4 * exceptions) << np.uint32(w)
        out[which] = values + np.array([r[1] for r in rows], np.uint32)[:, None]
    return table, out.reshape(-1)[:n], size


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode ``docs(doc_id, text)`` and write the id files under ``path``, in ascending doc_id order over all files."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, n = encoder(tokenizer), [], 0
        for batch in slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text").to_pylist()), strict=True):
                held.append((doc, ids))
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_segment(held)], pa.binary())], ["segment"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode_segment(held)], pa.binary())], ["segment"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("place").asc()]
    ordered = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    segments = ordered.select("doc_id", "text").mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    segments.write.option("maxRecordsPerFile", SEGMENTS).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read id files back: a row per document with its place, count and checksum of ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, content in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                at, before = 0, 0
                while at < len(data):
                    table, ids, size = decode_segment(data[at:])
                    at += size + 1  # and the line feed
                    counts = table["n"].astype(np.int64)
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(counts), pa.int64()), pa.array([name] * len(counts), pa.int64()), pa.array(table["id"], mask=table["null"].astype(bool)), pa.array(before + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                        ["part", "file", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    before += int(counts.sum())

    number = lambda p: F.regexp_extract(F.col("path"), p, 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(number(r"part-(\d+)-").alias("part"), number(r"-c(\d+)[^/]*$").alias("file"), "content")
    rows = staged(files.mapInArrow(decode, "part long, file long, doc_id long, local long, n_tokens long, ids_crc32 long"), "ids")
    sizes = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    sizes = staged(sizes, "id-files")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each task that wrote
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("parts_before"))
    within = sizes.select("part", "file", earlier(Window.partitionBy("part").orderBy("file")).alias("files_before"))
    firsts = within.join(parts, "part").select("part", "file", (F.col("parts_before") + F.col("files_before")).alias("before"))
    joined = rows.join(firsts, ["part", "file"])
    return joined.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "idfiles")
    write_ids(documents(spark, sf_dir), public_path("byte_bpe_50k.json"), path)
    return read_ids(spark, path)
