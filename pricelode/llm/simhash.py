"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint.  Two fingerprints link if they differ in ``BITS`` (2) bits or fewer; the classes
are the connected components.

Search: the anchors are the words of a covering code, the product of repetition codes of odd length over the 64 bits
(blocks of equal bits).  The nearest anchor of a fingerprint takes each block's majority bit.  A fingerprint goes to
its nearest anchor as resident, and as visitor to every anchor that is the nearest one of a fingerprint within
``BITS`` of it: these are the anchors within covering radius plus threshold at which it can meet a partner.  So each
linked pair meets at the anchor of either one.  Longer blocks mean fewer anchors and fewer visits, and the code is
chosen so that an anchor has about ``PER_ANCHOR`` residents; any code of the family finds every pair.

At an anchor the residents are held and compared with themselves and with the visitors, who stream past.  An anchor with
over ``RESIDENTS`` of them is dealt again, residents and visitors, to the anchors of a code with more blocks, in which
each pair still meets; the finest code has an anchor for every fingerprint, so this ends.  Only the links that join
classes at the anchor are kept, so no group of near copies is expanded into all its pairs; exact copies share one
fingerprint from the start.  Components of what remains come from min-label rounds with pointer jumping over
written tables.

Null text is as empty: fingerprint zero, as for a text without words, and links like any other.  Repeated rows and
equal or null doc_id are kept; a component of null doc_ids only has a null id.  Other columns are ignored by
``fingerprints``/``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch, documents, only_rows, partitions, slices, text_key

BITS = 2
SHINGLE = 3
SEED = 42
PER_ANCHOR = 48
#: An anchor with more residents is dealt again, by a code with ``FINER`` more blocks.
RESIDENTS = 4096
FINER = 6


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of every ``n``-word shingle, A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest, m = xxhash.xxh64_intdigest, min(n, len(words))
    begins = [0, *(e + 1 for e in ends)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[m - 1 :], strict=False)), np.uint64, len(words) - m + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the text's two keys, and the fingerprint as a signed long."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    k1, k2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInArrow(sketch, "doc_id long, k1 long, k2 long, fp long")


def code_blocks(residents: int, per_anchor: int = PER_ANCHOR, finer: int = 0) -> list[tuple[int, int]]:
    """(first bit, odd length) of the blocks: the code has 2**blocks anchors, at the finest one for each fingerprint."""
    want = min(64, max(4, (max(1, residents) // per_anchor).bit_length()) + finer)
    short = max(1, 64 // want - 1 + 64 // want % 2)
    longer = min(want, (64 - short * want) // 2)
    lengths = [short + 2] * longer + [short] * (want - longer)
    starts = np.cumsum([0, *lengths])[:-1].tolist()
    return list(zip(starts, lengths, strict=True))


def anchors(fps: np.ndarray, blocks: list[tuple[int, int]], visits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``fps`` and anchors: the nearest one of each fingerprint first, then (with ``visits``) the others.

    A block's bit can turn with one flip where its majority is by one, with two where it is by three.
    """
    home = np.zeros(len(fps), np.uint64)
    one, two = [], []
    for j, (first, length) in enumerate(blocks):
        part = (fps >> np.uint64(first)) & np.uint64((1 << length) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        home |= (2 * ones > length).astype(np.uint64) << np.uint64(j)
        margin = np.abs(2 * ones - length)
        one.append(margin == 1)
        two.append(margin == 3)
    rows, at = [np.arange(len(fps))], [home]

    def visit(mask: np.ndarray, turn: int) -> None:
        which = np.flatnonzero(mask)
        rows.append(which)
        at.append(home[which] ^ np.uint64(turn))

    for j in range(len(blocks) if visits else 0):
        visit(one[j] | two[j], 1 << j)
        for k in range(j):
            visit(one[j] & one[k], 1 << j | 1 << k)
    return np.concatenate(rows), np.concatenate(at)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-label components of 0..n-1 after joining the pairs (a, b)."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _roots(parent)
    return parent


class Anchor:
    """An anchor at work: its residents' classes, which visitors join as well.  Fingerprints are distinct."""

    def __init__(self, residents: np.ndarray, step: int = 1 << 20):
        self.fps, self.step = residents, step
        self.parent = np.arange(len(residents))
        self.meet(residents)

    def meet(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of those of ``fps`` that are near a resident, one for each; residents near the same one are joined."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        rows = max(1, self.step // max(1, len(self.fps)))
        for i in range(0, len(fps), rows):
            part = fps[i : i + rows]
            who, near = np.nonzero(np.bitwise_count(part[:, None] ^ self.fps[None, :]) <= BITS)
            linked, first = np.unique(who, return_index=True)
            self.parent = _join(self.parent, np.repeat(near[first], np.diff(np.append(first, len(who)))), near)
            out.append((self.fps[near[first]], part[linked]))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the residents with the first of their class."""
        which = np.flatnonzero(self.parent != np.arange(len(self.fps)))
        return self.fps[self.parent[which]], self.fps[which]


def _dealt(rows: DataFrame, blocks: list[tuple[int, int]], visits: bool = True) -> DataFrame:
    """``rows(anchor, fp)`` at the anchors of a code within their own anchor; ``home``: as resident."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column("anchor").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            every = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(every), 2000):
                fps = every[i : i + 2000]
                which, at = anchors(fps, blocks, visits)
                home = np.zeros(len(which), bool)
                home[: len(fps)] = True
                at = (at * np.uint64(0xC2B2AE3D27D4EB4F)) ^ outer[i : i + 2000][which]
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fps[which].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return rows.select("anchor", "fp").mapInArrow(deal, "anchor long, fp long, home boolean")


def _met(dealt: DataFrame) -> DataFrame:
    """Links found at the anchors of ``dealt(anchor, fp, home)``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at = None, [], None

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            pairs = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in pairs], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, fp, home = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            cuts = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at != anchor[a]:
                    if held or now:
                        found.append((now or Anchor(np.concatenate(held))).own())
                    now, held, at = None, [], anchor[a]
                k = a + int(home[a:b].sum())  # residents come first
                if k > a:
                    held.append(fp[a:k])
                if b > k and held and not now:
                    now = Anchor(np.concatenate(held))
                if b > k and now:
                    found.append(now.meet(fp[k:b]))
            yield batch_of(found)
        if held or now:
            yield batch_of([(now or Anchor(np.concatenate(held))).own()])

    met = dealt.repartition(partitions(dealt.sparkSession), "anchor").sortWithinPartitions("anchor", F.col("home").desc())
    return met.mapInArrow(meet, "a long, b long")


def links(distinct: DataFrame, count: int, scratch: Scratch, most: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``; their components are those of all links of 2 bits or fewer."""
    rows, finer, found = distinct.select(F.lit(0).cast("long").alias("anchor"), "fp"), 0, []
    while True:
        blocks = code_blocks(count, finer=finer)
        dealt = _dealt(rows, blocks)
        crowded = _dealt(rows, blocks, visits=False).groupBy("anchor").count().filter(F.col("count") > (most or RESIDENTS)).select("anchor")
        crowded = scratch.staged(crowded, "crowded-anchors")
        if crowded.isEmpty():
            found.append(_met(dealt))
            return functools.reduce(DataFrame.union, found).distinct()
        found.append(_met(dealt.join(crowded, "anchor", "left_anti")))
        rows = scratch.staged(dealt.join(crowded, "anchor", "left_semi").select("anchor", "fp"), "crowded")
        finer += FINER


def components(edges: DataFrame, scratch: Scratch, tag: str = "components") -> DataFrame:
    """(node, root) of every node with a link; ``edges(a, b)``.  Each round takes the least label of a node and its
    neighbours, then follows the label's own label; a round's table is written before the next."""
    both = scratch.staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{tag}-edges")
    labels = scratch.staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), tag)
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(least, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("top", "root")).alias("root"))
        new = scratch.staged(jumped, tag)
        if new.filter("root < was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text keys, fingerprint ``fp`` (signed), and its class: least doc_id and ``class_fp``."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.staged(fingerprints(docs), "fingerprints")
        distinct = scratch.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(links(distinct, distinct.count(), scratch), scratch)
        classed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("class_fp"))
        classed = scratch.staged(classed, "classed")
        least = classed.groupBy("class_fp").agg(F.min("least").alias("component_id"))
        named = scratch.staged(classed.join(least, "class_fp").select("fp", "class_fp", "component_id"), "classes")
        return scratch.kept(rows.join(named, "fp"), "near-duplicates")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of each class: that with the least doc_id (null last), and of equal ones that with the least key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("f")
    keep = near_duplicates(docs).groupBy("class_fp").agg(first)
    return only_rows(docs, keep.select("f.doc_id", "f.k1", "f.k2"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
