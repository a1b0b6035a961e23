"""Vector codes: product quantisation by Lloyd rounds that move only what changed.

A vector's components become integers (floor of ``scale`` times the component), are cut into ``parts`` equal consecutive
parts, and each part is coded by the nearest of ``entries`` codebook entries of its position (squared Euclidean distance,
ties to the lower index).  A position's codebook starts as that part of the first vectors by id.

Each round reads the vectors with the codes of the round before, written in the cluster's shared folder, assigns again,
and writes the new codes.  Running sums and counts of each entry are kept as integers; a task adds up what a part whose
code changed takes from its old entry and brings to its new one, and only these sums of changes are shuffled: at most
``parts * entries`` rows a task, however the vectors lie, so a hot vector or label is no hot key.  The codebooks are the
only thing on the driver, ``entries`` times a vector's length.  An entry is the floor of sum / count of each component;
an entry that is not used stays.  As all sums are of integers, the result does not depend on how rows are dealt.

Rows whose vector is null, or has null or non-finite components, are dropped.  Vectors shorter than the longest count as
filled up with zeros, also to a multiple of ``parts``.  Components beyond a bound at which squared distances would leave
64 bits are cut to it (32,768 for 64 components at scale 4,096).  A null vec_id comes last in the order of ids (ties by
the vector); repeated rows each count and each are returned.  With fewer vectors than ``entries`` the codebooks are shorter; without any the
result is empty.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Squares and their sums are exact in doubles below this component.
EXACT = 1 << 21


def finite(vec: Column) -> Column:
    """A vector that is not null, with no null or non-finite component."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vec: Column, scale: int, bound: int) -> Column:
    """floor(scale * x) of each component, cut to the bound."""
    limit = float(bound)
    return F.transform(vec, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and squared distances (n, parts) of ``v`` (n, parts, width) by ``books`` (parts, entries, width)."""
    n, parts, _ = v.shape
    codes, off = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64)
    small = max(np.abs(v).max(initial=0), np.abs(books).max(initial=0)) < EXACT and v.shape[2] < 512
    for p in range(parts):
        if small:
            x, c = v[:, p].astype(np.float64), books[p].astype(np.float64)
            d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        else:
            d = np.stack([((v[:, p].astype(np.int64) - c) ** 2).sum(1) for c in books[p]], axis=1)
        codes[:, p] = d.argmin(1)  # the first of equals
        off[:, p] = d[np.arange(n), codes[:, p]].astype(np.int64)
    return codes, off


def changes(v: np.ndarray, old: np.ndarray | None, new: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
    """Add to counts (parts, entries) and sums (parts, entries, width) what changed codes take and bring."""
    for p in range(v.shape[1]):
        at = np.flatnonzero(new[:, p] != old[:, p]) if old is not None else np.arange(len(v))
        for codes, sign in ((new, 1), (old, -1)):
            if codes is not None and len(at):
                np.add.at(count[p], codes[at, p], sign)
                np.add.at(sums[p], codes[at, p], sign * v[at, p].astype(np.int64))


def assigned(state: DataFrame, books: np.ndarray, first: bool) -> DataFrame:
    """``state(vec_id, label, v, codes)`` with new codes; and from each task the sums of changes, as rows with ``part``."""
    parts, entries, width = books.shape
    kind = state.schema["label"].dataType.simpleString()
    sent = state.sparkSession.sparkContext.broadcast(books)  # entries x components
    names = ["vec_id", "label", "v", "codes", "part", "entry", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label = sent.value, pa.null()
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            n, label = batch.num_rows, batch.schema.field("label").type
            if not n:
                continue
            v = matrix(batch.column("v"), parts * width).reshape(n, parts, width)
            new, _ = nearest(v, own)
            old = None if first else np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
            changes(v, old, new, count, sums)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array([r.tobytes() for r in new], pa.binary()), *none], names)
        p, e = np.nonzero((count != 0) | (sums != 0).any(axis=2))
        if len(p):
            none = [pa.nulls(len(p), t) for t in (pa.int64(), label, pa.list_(pa.int32()), pa.binary())]
            found = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *found], names)

    return state.mapInArrow(run, f"vec_id long, label {kind}, v array<int>, codes binary, part int, entry int, n long, sums array<long>")


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code as text and error of each vector."""
    parts, _, width = books.shape
    sent = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, off = nearest(matrix(batch.column("v"), parts * width).reshape(-1, parts, width), sent.value)
                columns = [pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(off.sum(1), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"vec_id long, label {state.schema['label'].dataType.simpleString()}, code string, error long")


def moved(count: list, sums: list, delta: DataFrame) -> None:
    """Add a round's changes, summed by Spark to a row for each entry and component, to the running sums."""
    rows = delta.filter("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("i", "x"))
    for part, entry, i, n, x in rows.groupBy("part", "entry", "i").agg(F.sum("n"), F.sum("x")).collect():  # entries x components
        sums[part][entry][i] += x
        if i == 0:
            count[part][entry] += n


def quantised(rows: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``rows(vec_id, label, embedding)``: vec_id, label, code, error; and the codebooks (parts, entries, width)."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(finite(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    whole = parts * width
    bound = min(math.isqrt((1 << 62) // whole) // 2, (1 << 31) - 1)
    v = F.concat(integers(F.col("embedding"), scale, bound), F.array_repeat(F.lit(0), F.lit(whole) - F.size("embedding")))
    state = scratch.staged(kept.select("vec_id", "label", v.alias("v"), F.lit(None).cast("binary").alias("codes")), "vectors")
    heads = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r[0] for r in heads], np.int64).reshape(len(heads), parts, width).transpose(1, 0, 2).copy()
    if not heads:
        return state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    count = [[0] * len(heads) for _ in range(parts)]
    sums = [[[0] * width for _ in heads] for _ in range(parts)]
    for number in range(rounds):
        table = scratch.staged(assigned(state, books, number == 0), "codes")
        moved(count, sums, table.select("part", "entry", "n", "sums"))
        state = table.filter("part is null").select("vec_id", "label", "v", "codes")
        for p in range(parts):
            for e in range(len(heads)):
                if count[p][e]:
                    books[p, e] = [s // count[p][e] for s in sums[p][e]]
    return coded(state, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        codes, books = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scratch)
        rows = scratch.kept(codes, "vector-codes")
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op11_sql() -> str:
    """The same by the plain form of Lloyd's rounds: every round sums all parts again."""
    dot = "list_inner_product({0}::double[], {1}::double[])".format
    text = """with k as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v, row_number() over (order by vec_id) as rid from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select rid, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] as x from k, range(8) t(p)),
c0 as materialized (select p, rid - 1 as e, x as c from parts where rid <= 16)"""
    for r in range(7):
        text += f""",
a{r} as materialized (select rid, p, min(({dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')}) * 16 + e)::bigint as m from parts join c{r} using (p) group by rid, p)"""
        if r < 6:
            text += f""",
s{r} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from (select p, m % 16 as e, i, sum(x[i]) as s, count(*) as n from (select p, m, x, unnest(generate_series(1, len(x))) as i from a{r} join parts using (rid, p)) group by all) group by p, e),
c{r + 1} as materialized (select p, e, coalesce(s{r}.c, c{r}.c) as c from c{r} left join s{r} using (p, e))"""
    return text + """,
coded as (select rid, string_agg(printf('%02x', m % 16), '' order by p) as code, sum(m // 16)::bigint as error from a6 group by rid)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from c6) as codebooks_sha256 from coded join k using (rid)"""
