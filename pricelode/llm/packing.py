"""Packing documents into fixed windows: best-fit decreasing with a segment tree over remaining capacity.

A document's ids are cut into full windows first; what is left over is placed, longest first, into the open window
whose remaining capacity is the tightest that still holds it.  Left-overs are dealt by hash (of the row and its number
in its task, so that repeated rows part) into shards of about
``SHARD_PIECES`` pieces, so each shard's packing is bounded and the padding a shard wastes (a window or two) is small
against the thousands it fills.  Windows count from 0 within a shard; ``sequence_id`` is shard * 2**32 + window.

Null or empty text: a document of the end id alone.  Repeated rows are packed as often as they come; a null doc_id
stays null.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import documents, partitions, slices, staged
from pricelode.llm.tokens import encoder, public_path

WINDOW = 4096
SHARD_PIECES = 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class CapacityTree:
    """Segment tree over capacities 0..top; finds the smallest capacity, at least ``need``, with an open window."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window of the tightest capacity that holds ``need``."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                i += not count[i]
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece; ``lengths`` come longest first, none over ``window``."""
    tree, windows = CapacityTree(window), 0
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        if found := tree.pop_tightest(n):
            left, w = found
        else:
            left, w = window, windows
            windows += 1
        number[i], offset[i] = w, window - left
        if left > n:
            tree.push(left - n, w)
    return number, offset


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Every document's ids cut into full windows and one left-over: a row of figures for each piece, with its number
    among those of its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, made = encoder(tokenizer), 0
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text").to_pylist()), strict=True):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                for s in range(0, n, window):
                    m = min(window, n - s)
                    for column, value in zip(rows, (doc, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n), strict=True):
                        column.append(value)
            numbers = np.arange(made, made + len(rows[0]))
            made += len(rows[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows), pa.array(numbers)], [*NAMES, "number"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, f"{PIECES}, number long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack ``docs(doc_id, text)``; returns a row per piece with its window and offset, and the window's used length."""
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, tokenizer, window), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    mix = F.xxhash64(F.lit("shard"), "doc_id", "start", "ids_crc32", "doc_tokens", "number")
    dealt = pieces.withColumn("_shard", F.pmod(mix, F.lit(shards))).repartition(partitions(spark), "_shard")
    order = ["_shard", F.col("length").desc(), "doc_id", "start", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard_rows() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
            used = np.bincount(number, rows.column("length").to_numpy()).astype(np.int64)[number]
            ids = (rows.column("_shard").to_numpy() << 32) + number
            columns = [rows.column(c) for c in NAMES]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offset), pa.array(used)], [*NAMES, "sequence_id", "offset", "used"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("_shard")[0].as_py() != shard[a]:
                    yield shard_rows()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield shard_rows()

    out = f"{PIECES}, sequence_id long, offset long, used long"
    packed = dealt.sortWithinPartitions(*order).mapInArrow(place, out)
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return packed.withColumn("sequence_length", F.when(power, F.col("used")).otherwise(F.lit(window))).drop("used")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_path("word_bpe_49k.json"))
