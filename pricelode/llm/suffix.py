"""Removal of repeated byte strings with suffix arrays built per shard.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus is removed, in all its
places, the first one too; strings never cross documents and are judged on the input.  ``LENGTH`` (400) is for whole
passages of a page, ``PASSAGE`` (240) is short enough for any passage of over 50 words.

1. Distinct texts, with the number of their copies, are written bucketed by content, so later joins leave text alone.
2. A text's strings are told apart by an anchor: the least of the hashes of the 32-byte substrings inside (sliding
   minimum, leftmost of equals).  It depends on the string's content only, so equal strings have equal anchors at the
   same place.  Consecutive strings with the same anchor make a segment, known by the anchor's hash and a 128-bit
   digest.  Anchors met once cannot have repeats and end here.
3. Equal segments repeat as a whole.  Segments of one anchor that differ are cut by content: a string's distance to its
   anchor falls in one of a few bands, and all strings of a band have the same bytes in common, so equal strings have an
   equal core.  Pieces whose core nothing else has end here, pieces that are equal repeat as a whole.  A core with over
   ``KINDS`` differing pieces is cut again by a quarter of the band; at a band of one distance the core is the string,
   so this ends.  At each step a piece has four parts at most, of which only that on the edge of a common passage goes on.
4. What is left goes to shards, all pieces of a core to one.  A shard's suffix array comes from Larsson-Sadakane
   refinement in numpy (only unsorted groups are sorted again, by the rank a known distance on), and common prefixes
   from Kasai's: an entry whose preceding byte continues the previous pair takes that value less one, only the others
   compare bytes.  Neighbours that share ``length`` bytes are repeats.  As equal strings meet in one shard, shards are
   merged by the sorted digests of their cores alone; strings are never looked up one by one.
5. The segments' repeats come back as byte ranges of each text.

A null text is as an empty one.  Texts of under ``length`` bytes keep all.  Repeated rows are copies, so all of their
bytes go if they have ``length`` or more.  doc_id may be null or repeated; other columns are kept by ``strip_repeats``
and ignored by ``stripped``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import Scratch, documents, partitions, slices, text_key

LENGTH = 400
PASSAGE = 240
GRAM = 32
SHARD_BYTES = 1 << 20
#: A core with more differing pieces is cut by content again before it goes to a shard.
KINDS = 1000
#: A long text is looked at in pieces of so many bytes, which overlap by the length of a string less one.
PIECE = 1 << 20
#: Segments of a text are fetched from it in rows of those that start within so many bytes.
CUT_BYTES = 1 << 20


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``gram``-byte substring (a power of two), by doubling."""
    h = b.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < gram:
        m = len(h) - size
        with np.errstate(over="ignore"):
            h = (h[:m] * np.uint64(0x9FB21C651E98DF25 + 2 * size)) ^ (h[size:] >> np.uint64(29)) ^ (h[size:] * np.uint64(0xC2B2AE3D27D4EB4F))
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def segments(data: bytes, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end (text i is bounds[i]:bounds[i+1]): (text, first start, last start, anchor hash,
    anchor place).

    Starts count from the beginning of ``data``; every start of a whole string is in exactly one segment.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    hashes = _gram_hashes(b, gram)
    place = np.uint64((1 << 24) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = span - size
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & place).astype(np.int64)  # of the anchor, for every start
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    whole = np.flatnonzero(np.arange(len(at)) + length <= bounds[text + 1])
    if not len(whole):
        return segments(b"", bounds, length, gram)
    key_at, key_text = at[whole], text[whole]
    cut = np.flatnonzero((np.diff(key_at) != 0) | (np.diff(key_text) != 0) | (np.diff(whole) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(whole) - 1]])
    return key_text[first], whole[first], whole[last], hashes[key_at[first]], key_at[first]


def pack_symbols(codes: np.ndarray) -> np.ndarray:
    """The seven symbols (under 512) from every place on, as one number that sorts like them."""
    n, packed = len(codes), np.zeros(len(codes), np.uint64)
    for j in range(7):
        packed <<= np.uint64(9)
        packed[: max(0, n - j)] |= codes[j:].astype(np.uint64)
    return packed


def suffix_array(packed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, and the rank (of the group) of every suffix.

    Larsson-Sadakane: start from packed groups of symbols, then sort each group not yet settled by the rank that
    follows at the distance already sorted.
    """
    n = len(packed)
    sa = np.argsort(packed)
    key = packed[sa]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = 7
    while done < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        rows = sa[open_at]
        after = rows + done
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[rows]
        key = group * (n + 1) + follow + 1
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        sa[open_at] = rows
        fresh = np.ones(len(rows), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        new[open_at] = fresh
        rank[rows] = open_at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        done *= 2
    return sa, rank


def common_prefixes(packed: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of every suffix (by position) with the one before it in ``sa``, up to ``most`` symbols.

    Kasai's relation in text order: where the pair of position p - 1 stands one symbol to the left of p's pair and
    starts with equal symbols, p has one less.  Only pairs not so continued compare symbols, seven at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    first = packed >> np.uint64(54)
    begins = np.ones(n, bool)
    begins[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (before[1:] < 0) | (first[:-1] != first[before[:-1]])
    at = np.flatnonzero(begins & (before >= 0))
    value = np.zeros(n, np.int64)
    # a continued run of r positions needs a prefix of most + r at its head
    heads = np.flatnonzero(begins)
    limits = most + np.diff(np.append(heads, n))[np.searchsorted(heads, at)]
    padded = np.concatenate([packed, np.zeros(8, np.uint64)])
    got, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    p, q = at, before[at]
    while len(todo):
        unlike = padded[np.minimum(p[todo] + got[todo], n)] ^ padded[np.minimum(q[todo] + got[todo], n)]
        same = unlike == 0
        ended = todo[~same]
        for shift in range(54, -1, -9):
            got[ended] += unlike[~same] >> np.uint64(shift) == 0
        got[todo[same]] += 7
        todo = todo[same]
        todo = todo[(got[todo] < limits[todo]) & (np.maximum(p[todo], q[todo]) + got[todo] < n)]
    got = np.minimum(got, n - np.maximum(p, q))
    value[at] = got
    pos = np.arange(n)
    head = np.maximum.accumulate(np.where(begins, pos, 0))
    return np.clip(np.where(before >= 0, value[head] + head - pos, 0), 0, most)


def shard_repeats(parts: list[bytes], starts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings among the segments of a shard: a mask over all starts, laid end to end, with each start's
    segment, and its class (equal strings have equal classes).  Segment i has ``starts[i]`` starts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    codes = np.zeros(int(ends[-1]), np.int16)  # 0 ends a segment
    mask = np.ones(len(codes), bool)
    mask[ends - 1] = False
    codes[mask] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    packed = pack_symbols(codes)
    sa, _ = suffix_array(packed, length)
    # suffixes within a group of equal first symbols may stand in any order; those shorter than a string can't be starts
    prefix = common_prefixes(packed, sa, length)[sa]
    joined = prefix >= length
    repeated = joined.copy()
    repeated[:-1] |= joined[1:]
    group = np.cumsum(~joined)
    n = np.array(starts)
    segment = np.repeat(np.arange(len(parts)), n)
    at = np.repeat(ends - sizes - 1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    by_place, class_at = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    by_place[sa], class_at[sa] = repeated, group
    return by_place[at], segment, class_at[at]


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


PLACED = "k1 long, k2 long, first array<int>, n array<int>, rel array<int>, anchor array<long>, d1 array<long>, d2 array<long>"


def _text_segments(texts: DataFrame, length: int) -> DataFrame:
    """Segments of every distinct text of ``texts(k1, k2, text)``, a row of lists for each piece of a text: byte place
    of the first start, starts, place of the anchor from the first start, anchor hash and digest."""

    def rows(now: list[tuple[int, int, bytes]], k1: list[int], k2: list[int]) -> Iterator[pa.RecordBatch]:
        data = b"".join(p[2] for p in now)
        bounds = np.cumsum([0, *(len(p[2]) for p in now)])
        text, first, last, anchor, place = segments(data, bounds, length)
        if not len(text):
            return
        view = memoryview(data)
        digest = b"".join([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        digests = np.frombuffer(digest, "<i8").reshape(-1, 2)
        shift = np.array([p[1] for p in now])[text] - bounds[text]
        which, at = np.unique(text, return_index=True)
        offsets = pa.array(np.append(at, len(text)), pa.int32())
        lists = [(first + shift, pa.int32()), (last - first + 1, pa.int32()), (place - first, pa.int32()), (anchor.view(np.int64), pa.int64()), (digests[:, 0], pa.int64()), (digests[:, 1], pa.int64())]
        keys = [pa.array([k[now[t][0]] for t in which.tolist()], pa.int64()) for k in (k1, k2)]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in lists)], ["k1", "k2", "first", "n", "rel", "anchor", "d1", "d2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            k1, k2 = (batch.column(k).to_pylist() for k in ("k1", "k2"))
            now: list[tuple[int, int, bytes]] = []
            held = 0
            for i, t in enumerate(batch.column("text")):
                raw = t.as_buffer()
                for a in range(0, max(1, len(raw) - length + 1), PIECE):
                    piece = bytes(raw[a : a + PIECE + length - 1])
                    if now and held + len(piece) > PIECE + length:
                        yield from rows(now, k1, k2)
                        now, held = [], 0
                    now.append((i, a, piece))
                    held += len(piece)
            yield from rows(now, k1, k2)

    return texts.select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(cut, PLACED)


def bands(length: int, gram: int = GRAM) -> list[int]:
    """Widths of the bands of distances between a string and its anchor: each a quarter of the one before, the last 1."""
    out = [1 << max(0, ((length - gram + 1) // 2).bit_length() - 1)]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 4))
    return out


def _cores(rows: DataFrame, length: int, band: int) -> DataFrame:
    """Of ``rows(anchor, d1, d2, rel, lo, hi, bytes)``, starts lo to hi of a segment, the parts in each band of ``band``
    distances: number of the band, starts, hash of the core and digest of the part's bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, exact = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            digests: list[bytes] = []
            for i, (rel, lo, hi, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rel", "lo", "hi", "bytes")), strict=True)):
                for b in range((rel - hi + 1) // band, (rel - lo) // band + 1):
                    far = b * band  # distances far to far + band - 1: starts rel - far back to ...
                    x, y = max(lo, rel - far - band + 1), min(hi, rel - far + 1)
                    core = raw[rel - far : rel - far + length - band + 1]
                    for column, value in zip(out, (i, b, x, y, wide(core)), strict=True):
                        column.append(value)
                    digests.append(exact(raw[x : y + length - 1]))
            at = pa.array(out[0], pa.int32())
            exacts = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [batch.column(c).take(at) for c in ("anchor", "d1", "d2")]
            columns += [pa.array(c, pa.int32()) for c in out[1:4]]
            columns += [pa.array(np.array(out[4], np.uint64).view(np.int64)), pa.array(exacts[:, 0]), pa.array(exacts[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "d1", "d2", "band", "lo", "hi", "core", "c1", "c2"])

    return rows.select("anchor", "d1", "d2", "rel", "lo", "hi", "bytes").mapInArrow(cut, "anchor long, d1 long, d2 long, band int, lo int, hi int, core long, c1 long, c2 long")


def _shards(rows: DataFrame, length: int) -> DataFrame:
    """Of ``rows(anchor, band, core, d1, d2, lo, hi, bytes)``: ranges (lo, hi) of starts repeated within a shard; all rows
    of a core are in one shard, in any number of shards for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            parts = [x.as_buffer().to_pybytes() for x in table.column("bytes").combine_chunks()]
            lo = table.column("lo").to_numpy()
            starts = table.column("hi").to_numpy() - lo
            mask, _, _ = shard_repeats(parts, starts.tolist(), length)
            upto = np.cumsum([0, *starts.tolist()])
            found = [(i, x + int(lo[i]), y + int(lo[i])) for i in range(len(parts)) for x, y in _ranges(mask[upto[i] : upto[i + 1]])]
            at, x, y = zip(*found, strict=True) if found else ([], [], [])
            columns = [table.column(c).combine_chunks().take(pa.array(at, pa.int32())) for c in ("anchor", "d1", "d2")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["anchor", "d1", "d2", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "band", "core")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            sizes = np.append(0, np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy()))
            begin = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                if size >= SHARD_BYTES and last != keys[a].tolist():
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield shard()
                    held, size, begin = [], 0, a
                size += int(sizes[b] - sizes[a])
                last = keys[a].tolist()
            held.append(batch.slice(begin))
        if held:
            yield shard()

    dealt = rows.repartition(partitions(rows.sparkSession), "anchor", "band", "core").sortWithinPartitions("anchor", "band", "core")
    return dealt.select("anchor", "band", "core", "d1", "d2", "lo", "hi", "bytes").mapInArrow(run, "anchor long, d1 long, d2 long, lo int, hi int")


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct texts, a table bucketed by content: k1, k2, text, copies."""
    text = F.coalesce("text", F.lit(""))
    k1, k2 = text_key(text)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).groupBy("k1", "k2")
    return scratch.bucketed(texts.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "k1", "k2")


def repeats(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated strings of ``length`` bytes among ``distinct_texts``: per text that has some (k1, k2, ranges), where
    ranges array<struct<a, b>> tell the starts from a up to b, not merged."""
    kind = ["anchor", "d1", "d2"]
    placed = scratch.staged(_text_segments(texts.filter(F.octet_length("text") >= length), length), "segments")
    met = placed.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).filter("all > 1")
    spans = placed.select("k1", "k2", F.inline(F.arrays_zip("first", "n", "rel", "anchor", "d1", "d2")))
    spans = scratch.staged(spans.join(met.select("anchor"), "anchor", "left_semi"), "met")
    one = F.min(F.struct("k1", "k2", "first", "n", "rel")).alias("one")
    kinds = scratch.staged(spans.groupBy(*kind).agg(F.count(F.lit(1)).alias("times"), one), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor")

    # bytes of the segments to compare, from one text of each
    sent = kinds.join(several, "anchor", "left_semi").select("one.*", *kind)
    sent = sent.groupBy("k1", "k2", F.expr(f"first div {CUT_BYTES}").alias("part")).agg(F.collect_list(F.struct(*kind, "first", "n", "rel")).alias("s"))
    sent = texts.select("k1", "k2", "text").join(sent, ["k1", "k2"]).select(F.explode("s").alias("s"), F.col("text").cast("binary").alias("b"))
    raw = F.expr(f"substring(b, s.first + 1, s.n + {length - 1})").alias("bytes")
    cut = scratch.staged(sent.select(*(f"s.{c}" for c in (*kind, "n", "rel")), raw), "cut")

    rows, found, ready = cut.select(*kind, "rel", F.lit(0).alias("lo"), F.col("n").alias("hi"), "bytes"), [], []
    core = ["anchor", "band", "core"]
    for band in bands(length):
        parts = scratch.staged(_cores(rows, length, band), "cores")
        least = F.min(F.struct("d1", "d2", "lo", "hi")).alias("one")
        contents = parts.groupBy(*core, "c1", "c2").agg(F.count(F.lit(1)).alias("times"), least)
        cores = contents.groupBy(*core).agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")).filter("all > 1")
        alive = scratch.staged(contents.join(cores, core).drop("all"), "shared-cores")
        found.append(parts.join(alive.filter("times > 1").select(*core, "c1", "c2"), [*core, "c1", "c2"]).select(*kind, "lo", "hi"))
        apart = alive.filter("kinds > 1").select(*core, "kinds", "one.*")
        ready.append(apart.filter(F.col("kinds") <= KINDS).drop("kinds"))
        hot = apart.filter(F.col("kinds") > KINDS)
        if hot.isEmpty():
            break
        rows = hot.drop("band", "core").join(cut.select(*kind, "rel", "bytes"), kind)
    dealt = functools.reduce(DataFrame.unionByName, ready).join(cut.select(*kind, "bytes"), kind)
    piece = F.expr(f"substring(bytes, lo + 1, hi - lo + {length - 1})").alias("bytes")
    found.append(_shards(dealt.select(*core, "d1", "d2", "lo", "hi", piece), length))
    found.append(kinds.filter("times > 1").select(*kind, F.lit(0).alias("lo"), F.col("one.n").alias("hi")))
    starts = functools.reduce(DataFrame.unionByName, found).groupBy(*kind).agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    starts = scratch.staged(starts, "found")
    back = spans.join(starts, kind).select("k1", "k2", "first", F.inline("starts"))
    place = F.struct((F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi")).alias("b"))
    return scratch.staged(back.groupBy("k1", "k2").agg(F.collect_list(place).alias("ranges")), "ranges")


def starts_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """For each text the repeated starts, an array of (first, end); empty where there are none."""
    both = np.stack([c.to_numpy() for c in column.values.flatten()], axis=1)
    edges = column.offsets.to_numpy()
    for a, b in zip(edges, edges[1:], strict=False):
        yield both[a:b].astype(np.int64)


def removed(starts: np.ndarray, size: int, copies: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text."""
    if size >= length and copies > 1:
        return [(0, size)]
    if not len(starts):
        return []
    starts = starts[np.argsort(starts[:, 0], kind="stable")]
    begin, end = starts[:, 0], np.maximum.accumulate(starts[:, 1] - 1 + length)
    head = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return list(zip(begin[head].tolist(), end[np.append(head[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _left(raw: memoryview, gone: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in gone:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]])


def _within(texts: DataFrame, short: int, length: int, scratch: Scratch) -> DataFrame:
    """As ``repeats``, from ``texts(k1, k2, text, passages)`` with the repeats of a shorter length: a longer string that
    repeats lies in a run of shorter ones that do, so only runs that are long enough are looked at, each as a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            out: list[tuple] = []
            for k1, k2, t, p in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("b"), starts_of(batch.column("passages")), strict=True):
                raw = t.as_buffer()
                out += [(k1, k2, a, bytes(raw[a:b])) for a, b in removed(p, len(raw), 1, short) if b - a >= length]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k1", "k2", "at", "text"])

    runs = texts.select("k1", "k2", F.col("text").cast("binary").alias("b"), "passages").mapInArrow(cut, "k1 long, k2 long, at long, text binary")
    key = [F.xxhash64("k1", "k2", "at").alias("k1"), F.xxhash64(F.lit("run"), "k1", "k2", "at").alias("k2")]
    runs = scratch.bucketed(runs.select(*key, F.struct("k1", "k2", "at").alias("of"), "text"), "runs", "k1", "k2")
    found = runs.select("k1", "k2", "of").join(repeats(runs, length, scratch), ["k1", "k2"])
    at = F.col("of.at").cast("int")
    moved = found.select("of.k1", "of.k2", F.transform("ranges", lambda r: F.struct((r["a"] + at).alias("a"), (r["b"] + at).alias("b"))).alias("r"))
    return scratch.staged(moved.groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("ranges")), "long-ranges")


def stripped(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """Per distinct text (k1, k2): n_bytes, n_removed, n_spans, kept_sha256, and ``n_passage``: bytes covered by repeated
    strings of ``passage`` bytes, fewer than ``length`` (null if none is asked for)."""
    spark = docs.sparkSession

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            out: list[tuple] = []
            for t, r, p, c in zip(batch.column("b"), starts_of(batch.column("ranges")), starts_of(batch.column("passages")), batch.column("copies").to_pylist(), strict=True):
                raw = memoryview(t.as_buffer())
                gone = removed(r, len(raw), c, length)
                kept = _left(raw, gone)
                covered = None if passage is None else sum(b - a for a, b in removed(p, len(raw), c, passage))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), covered))
            n, less, spans, sha, covered = zip(*out, strict=True)
            columns = [batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    with Scratch(spark) as scratch:
        texts = distinct_texts(docs, scratch)
        if passage is None:
            joined = texts.join(repeats(texts, length, scratch), ["k1", "k2"], "left")
            joined = joined.withColumn("passages", F.lit(None).cast(joined.schema["ranges"].dataType))
        else:
            passages = repeats(texts, passage, scratch).withColumnRenamed("ranges", "passages")
            joined = texts.join(_within(texts.join(passages, ["k1", "k2"]), passage, length, scratch), ["k1", "k2"], "left").join(passages, ["k1", "k2"], "left")
        rows = joined.select("k1", "k2", F.col("text").cast("binary").alias("b"), "copies", "ranges", "passages")
        return scratch.kept(rows.mapInArrow(apply, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"), "stripped")


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of text and n_chars (where there is one) counted again; a document
    of which nothing is left is dropped, one that was empty before stays.  Where a range cuts a character of several
    bytes, what is left of it goes too."""
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    k1, k2 = text_key(text)
    own = docs.select(k1.alias("__k1"), k2.alias("__k2"), F.col("text").isNull().alias("__null"), *keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__b"):
            kept: list[str | None] = []
            for t, r, none in zip(batch.column("__b"), starts_of(batch.column("__ranges")), batch.column("__null").to_pylist(), strict=True):
                raw = memoryview(t.as_buffer())
                left = _left(raw, removed(r, len(raw), 1, length))
                kept.append(None if none else left.decode("utf-8", "ignore"))
            columns = [batch.column(c) for c in keep] + [pa.array(kept, pa.string()), batch.column("__size"), batch.column("__changed")]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "__text", "__size", "__changed"])

    with Scratch(docs.sparkSession) as scratch:
        texts = distinct_texts(docs, scratch)
        ranges = repeats(texts, length, scratch).withColumnRenamed("ranges", "__ranges")
        size = F.octet_length("text")
        left = texts.filter((F.col("copies") == 1) | (size < length)).join(ranges, ["k1", "k2"], "left")
        left = left.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("text").cast("binary").alias("__b"), size.alias("__size"), "__ranges", F.col("__ranges").isNotNull().alias("__changed"))
        schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("__text string, __size int, __changed boolean")])
        done = left.join(own, ["__k1", "__k2"]).mapInArrow(apply, schema)
        done = done.filter((F.col("__size") == 0) | F.coalesce(F.col("__text") != "", F.lit(True)))
        new = {"text": F.col("__text")}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(F.col("__changed"), F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return scratch.kept(done.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)), "no-repeats")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = stripped(docs, LENGTH, PASSAGE)
    k1, k2 = text_key(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    return rows.join(done, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_passage").alias("n_repeated_passages"))


def op2_sql(length: int = LENGTH, passage: int = PASSAGE) -> str:
    """The same in DuckDB's SQL: every string of the length by its hash, no suffix arrays."""

    def covered(n: int) -> str:
        return f"""w{n} as (select r, unnest(range(1, n_bytes - {n} + 2)) as i from t where n_bytes >= {n}),
d{n} as materialized (select r, i, md5(b[i:i + {n - 1}]) as d from w{n} join t using (r)),
s{n} as materialized (select r, i from d{n} where d in (select d from d{n} group by d having count(*) > 1)),
c{n} as (select r, sum(least(coalesce(next - i, {n}), {n}))::bigint as gone, count(*) filter (prev is null or i - prev > {n}) as spans
  from (select *, lead(i) over (partition by r order by i) as next, lag(i) over (partition by r order by i) as prev from s{n}) group by r)"""

    return f"""with t as materialized (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
{covered(length)},
{covered(passage)},
heads as (select r, i, lag(last) over (partition by r order by i) as before, row_number() over (partition by r order by i desc) = 1 as tail, last from
  (select r, min(i) as i, max(i) + {length} as last from (select r, i, sum(new) over (partition by r order by i) as run from
    (select r, i, case when i - lag(i) over (partition by r order by i) <= {length} then 0 else 1 end as new from s{length})) group by r, run)),
rest as (select r, string_agg(hex(b[coalesce(before, 1):i - 1]) || case when tail then hex(b[last:n_bytes]) else '' end, '' order by i) as h from heads join t using (r) group by r)
select doc_id, n_bytes::bigint as n_bytes, coalesce(c{length}.gone, 0) as n_removed, coalesce(c{length}.spans, 0) as n_spans,
  sha256(case when h is null then b else unhex(h) end) as kept_sha256, coalesce(c{passage}.gone, 0) as n_repeated_passages
from t left join c{length} using (r) left join c{passage} using (r) left join rest using (r)"""
