"""Hard negatives: for each anchor and positive, the best-scored rows of other labels inside a window of scores.

Scores are integer inner products.  All rows are scored against the anchors in blocks: anchors by ``ANCHORS`` and rows by
shards of about ``SHARD`` meet in groups of bounded size, each a matrix product, and only what a group has found goes on.
An anchor's positives are the best of each group, merged.  Negatives are found by radix selection: for each window (an
anchor and one of its positives) the groups count the scores of rows in it by the highest digit; Spark adds the counts
up, the digit in which the k-th score lies is the window's new interval, and the next round counts the next digit in it.  Windows
with k rows or fewer, or with an interval of one score, are settled.  Then the rows at or above the k-th score are
gathered, from each group k at most (ties by the smaller vec_id), and ranked.  Work that grows with a label, a hot vector
or many equal scores is only in counts, so no group's rows meet in one task.

Rows with a null vec_id, a null label, a null vector, or a null or non-finite component take no part.  Of rows with
the same vec_id the one with the least label and vector takes part.  Vectors shorter than another count as filled up with
zeros.  Components from 2**20 on are cut to it, which keeps scores of up to 64 components within 64 bits.  A positive score below zero
has an empty window.  Empty tables and anchors without positives or negatives give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch
from pricelode.llm.veccodes import finite, integers

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A window is from this share (in hundredths) of the positive score up to it.
LEAST = 80
BOUND = 1 << 28
ANCHORS, SHARD, CHUNK, DIGIT = 512, 32768, 8192, 8
Scored = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table], list[tuple]]


def usable(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v (integers): a row for each vec_id that takes part."""
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    own = F.col("label") if label is None else label
    pair = F.struct(own.cast("long").alias("label"), integers(F.col("embedding"), SCALE, BOUND).alias("v"))
    one = fine.select(F.col("vec_id").cast("long").alias("vec_id"), pair.alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(values) else []] = values
    return out


def longest(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers; in doubles where those are exact."""
    if np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * max(1, a.shape[1]) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def blocks(rows: DataFrame, anchors: DataFrame, shards: int, groups: int, each: Scored, schema: str) -> DataFrame:
    """``each`` for every group of a shard of ``rows(vec_id, label, v)`` and a block of ``anchors(anchor_id, label, v, ...)``,
    of which every row meets every anchor once: called for chunks of rows by ascending vec_id with scores (anchors x rows), ids, whether labels agree."""
    own = rows.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("b"))
    asked = anchors.select("*", F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(groups)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            width = max(longest(left["v"]), longest(right["v"]))
            asked_v, asked_label, asked_id = dense(right["v"], width), right["label"].to_numpy(), right["anchor_id"].to_numpy()
            for at in range(0, left.num_rows, CHUNK):
                part = left.slice(at, CHUNK)
                ids = part["vec_id"].to_numpy()
                scores = products(asked_v, dense(part["v"], width))
                same = asked_label[:, None] == part["label"].to_numpy()[None, :]
                same_id = asked_id[:, None] == ids[None, :]
                out += each(scores, ids, np.where(same_id, 2, same), right)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(np.concatenate(c) if out else c, pa.int64()) for c in columns], names)

    return own.groupBy("b", "s").cogroup(asked.groupBy("b", "s")).applyInArrow(run, schema)


def best(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the first ``k`` of each row where ``mask`` holds, by falling score and then column."""
    low = np.iinfo(np.int64).min
    held = np.where(mask, scores, low)
    if held.shape[1] > k:
        level = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        mask = mask & (scores >= level[:, None])
    row, column = np.nonzero(mask)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(begins, np.diff(begins, append=len(row)))
    return row[place < k], column[place < k]


def positives(rows: DataFrame, anchors: DataFrame, shards: int, groups: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: the best ``k`` other rows of an anchor's label."""

    def each(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, asked: pa.Table) -> list[tuple]:
        a, r = best(scores, same == 1, k)
        return [(asked["anchor_id"].to_numpy()[a], ids[r], scores[a, r])] if len(a) else []

    found = blocks(rows, anchors, shards, groups, each, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors that have windows, with these in an array (as many as an anchor has positives)."""
    packed = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "low", "high")).alias("w"))
    return anchors.join(packed, "anchor_id")


def each_window(asked: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The j-th windows of all anchors that have so many: anchor's place, positive_id, low, high."""
    held = asked["w"].to_pylist()
    out = []
    for j in range(max(map(len, held), default=0)):
        at = [i for i, w in enumerate(held) if len(w) > j]
        out.append((np.array(at), *(np.array([held[i][j][c] for i in at], np.int64) for c in ("positive_id", "low", "high"))))
    return out


def counted(rows: DataFrame, asked: DataFrame, shards: int, groups: int, shift: int) -> DataFrame:
    """anchor_id, positive_id, bucket, n: rows of other labels in each window by the digit above ``shift``, from its top."""

    def each(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, asked: pa.Table) -> list[tuple]:
        out = []
        for at, positive, low, high in each_window(asked):
            s = scores[at]
            w, r = np.nonzero((same[at] == 0) & (s >= low[:, None]) & (s <= high[:, None]))
            if len(w):
                bucket = (high[w] - s[w, r]) >> shift
                key, n = np.unique(w << 32 | bucket, return_counts=True)
                out.append((asked["anchor_id"].to_numpy()[at[key >> 32]], positive[key >> 32], key & 0xFFFFFFFF, n))
        return out

    found = blocks(rows, asked, shards, groups, each, "anchor_id long, positive_id long, bucket long, n long")
    return found.groupBy("anchor_id", "positive_id", "bucket").agg(F.sum("n").alias("n"))


def narrowed(windows: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Windows with the interval of the bucket that holds the k-th row; settled ones are those that need no more digits."""
    order = Window.partitionBy("anchor_id", "positive_id").orderBy("bucket")  # a digit's buckets at most
    upto = counts.withColumn("upto", F.sum("n").over(order)).join(windows.select("anchor_id", "positive_id", "need"), ["anchor_id", "positive_id"])
    hit = upto.filter("upto >= need").groupBy("anchor_id", "positive_id").agg(F.min(F.struct("bucket", "upto", "n")).alias("hit"))
    joined = windows.join(hit, ["anchor_id", "positive_id"], "left")
    high = F.col("high") - F.shiftleft(F.col("hit.bucket"), shift)
    low = F.greatest("low", high - ((1 << shift) - 1))
    found = F.col("hit").isNotNull()
    need = F.col("need") - (F.col("hit.upto") - F.col("hit.n"))
    settled = ~found | (high == low) | (F.col("hit.n") == need)
    return joined.select(
        "anchor_id", "positive_id", "top", F.when(found, low).otherwise(F.col("low")).alias("low"), F.when(found, high).otherwise(F.col("high")).alias("high"),
        F.when(found, need).otherwise(F.col("need")).alias("need"), settled.alias("settled"),
    )


def gathered(rows: DataFrame, asked: DataFrame, shards: int, groups: int, k: int) -> DataFrame:
    """anchor_id, positive_id, negative_id, negative_score of the first ``k`` of each group in each window."""

    def each(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, asked: pa.Table) -> list[tuple]:
        out = []
        for at, positive, low, high in each_window(asked):
            s = scores[at]
            w, r = best(s, (same[at] == 0) & (s >= low[:, None]) & (s <= high[:, None]), k)
            if len(w):
                out.append((asked["anchor_id"].to_numpy()[at[w]], positive[w], ids[r], s[w, r]))
        return out

    return blocks(rows, asked, shards, groups, each, "anchor_id long, positive_id long, negative_id long, negative_score long")


def hard_negatives(rows: DataFrame, scratch: Scratch, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores over ``rows(vec_id, label, v)``; anchors are the rows whose
    vec_id is divisible by ``every``."""
    rows = scratch.staged(rows, "rows")
    anchors = scratch.staged(rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    size, asked = rows.count(), anchors.count()
    shards, groups = max(1, -(-size // SHARD)), max(1, -(-asked // ANCHORS))
    pairs = scratch.staged(positives(rows, anchors, shards, groups, n_positives), "positives")
    score = F.col("positive_score")
    lowest = F.ceil(score * F.lit(least).cast("decimal(20,0)") / 100).cast("long")
    windows = pairs.filter(score >= 0).select("anchor_id", "positive_id", score.alias("top"), lowest.alias("low"), score.alias("high"), F.lit(n_negatives).cast("long").alias("need"), F.lit(False).alias("settled"))
    windows = scratch.staged(windows, "windows")
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    shift = max(0, -(-widest.bit_length() // DIGIT) - 1) * DIGIT
    done = []
    while shift >= 0:
        counts = counted(rows, with_windows(anchors, windows), shards, groups, shift)
        windows = scratch.staged(narrowed(windows, counts, shift), "windows")
        done.append(windows.filter("settled"))
        windows = windows.filter("not settled")
        shift -= DIGIT
    done.append(windows)
    every_window = done[0]
    for more in done[1:]:
        every_window = every_window.unionByName(more)
    every_window = every_window.select("anchor_id", "positive_id", "low", F.col("top").alias("high"))  # all at or above the k-th score
    found = gathered(rows, with_windows(anchors, every_window), shards, groups, n_negatives)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    with Scratch(spark) as scratch:
        return scratch.kept(hard_negatives(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved), scratch), "hard-negatives")


def op12_sql() -> str:
    return """with e as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as a, r.vec_id as r, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select a, r, score, row_number() over (partition by a order by score desc, r) as k from s where same qualify k <= 5),
n as (select p.a, p.r, p.score as ps, s.r as nr, s.score as ns, row_number() over (partition by p.a, p.r order by s.score desc, s.r) as rank from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score qualify rank <= 5)
select a as anchor_id, r as positive_id, rank::int as rank, nr as negative_id, ps as positive_score, ns as negative_score from n"""
