"""Document fingerprints: a homomorphic multiset hash over paragraphs, with DataFrame functions only.

A paragraph (a line with a word) is hashed to a wide vector of two parts.  Four dense lanes of 32 bits come from two
hashes of the paragraph itself, white space included; they tell multisets of paragraphs apart.  64 narrow lanes are the
sum, over the paragraph's five-word shingles (fewer words: all of them at once), of +1 or -1 for each bit of a shingle's
64-bit hash; they tell how much alike two documents are.  A document's fingerprint is the sum over its paragraphs, narrow
lanes modulo 2**16 and dense lanes modulo 2**32.  So the order of paragraphs does not matter, other multisets of
paragraphs have other fingerprints (but for a collision of 128 bits), and a paragraph is put in or taken out by adding or
subtracting its vector (``combine``), without the rest of the text.

Likeness of two fingerprints is the cosine of their narrow lanes read as signed numbers, from 0 to 1: it estimates
the cosine of the two shingle multisets (standard error about 1/8), and is 1 for equal fingerprints.

Null text is as empty; texts without a word have the zero fingerprint.  The next document is by descending doc_id
(null last; of equal doc_ids by the text's hash).  Documents are dealt into cells that follow each other in that order:
ranges of doc_id between approximate quantiles, and for null or a doc_id that is several quantiles, as many ranges of the
text's hash.  Their number follows the bytes of the texts (``TASK`` for each ``CELLS`` cells), so what a task reads does not grow with
the table.  A cell also gets a copy of the row that follows its last, so no window spans cells.  Repeated rows stay
(those equal in doc_id and text in one cell); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import documents, partitions, text_key

LANES = 64
DENSE_LANES = 4
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"
NARROW, DENSE = 1 << 16, 1 << 32
#: Bytes of text that a task takes, and cells for each task.
TASK, CELLS = 32 << 20, 4


def shingles(paragraph: Column, n: int = SHINGLE) -> tuple[Column, Column]:
    """The words of a paragraph, and from a column ``words`` its shingles' hashes."""
    words = F.filter(F.split(paragraph, SPACE), lambda w: w != "")
    own = F.col("words")
    rolling = F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(n))))
    return words, F.when(F.size(own) >= n, rolling).when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " "))))


def lane_sums(h: Column, first: Column, own: list[Column]) -> list[Column]:
    """Aggregates that sum the lanes of shingle hashes ``h``: bits set in each narrow lane and shingles; and of the hashes
    ``own`` of their paragraphs, counted where ``first`` holds: two dense lanes of each."""
    bits = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{j}") for j in range(LANES)]
    low = F.lit(DENSE - 1).cast("long")
    halves = [x for p in own for x in (p.bitwiseAND(low), F.shiftrightunsigned(p, 32))]
    return [*bits, F.count(h).alias("n"), *(F.sum(F.when(first, x)).alias(f"d{i}") for i, x in enumerate(halves))]


def vector() -> Column:
    """The wide vector from the columns of ``lane_sums``: 64 signed narrow lanes, then the dense lanes."""
    n = F.col("n")
    narrow = [(2 * F.coalesce(F.col(f"b{j}"), F.lit(0)) - n).cast("long") for j in range(LANES)]
    return F.array(*narrow, *(F.coalesce(F.col(f"d{i}"), F.lit(0)).cast("long") for i in range(DENSE_LANES)))


def digest(v: Column) -> Column:
    """Fingerprint text: lanes modulo their powers, in hexadecimal."""
    narrow = F.transform(F.slice(v, 1, LANES), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(NARROW))), 4, "0"))
    dense = F.transform(F.slice(v, LANES + 1, DENSE_LANES), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(DENSE))), 8, "0"))
    return F.lower(F.concat(F.array_join(narrow, ""), F.array_join(dense, "")))


def lanes(fingerprint: Column) -> Column:
    """A fingerprint text's lanes, the narrow ones signed."""
    hexed = lambda i, w: F.conv(F.substring(fingerprint, i, F.lit(w)), 16, 10).cast("long")
    narrow = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.pmod(hexed(i * 4 + 1, 4) + NARROW // 2, F.lit(NARROW)) - NARROW // 2)
    dense = F.transform(F.sequence(F.lit(0), F.lit(DENSE_LANES - 1)), lambda i: hexed(i * 8 + 1 + 4 * LANES, 8))
    return F.concat(narrow, dense)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of two multisets of paragraphs taken together, or (sign -1) of the first without the second."""
    return digest(F.zip_with(lanes(a), lanes(b), lambda x, y: x + sign * y))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two wide vectors."""
    narrow = lambda v: F.slice(v, 1, LANES)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(narrow(a), narrow(b), lambda x, y: x.cast("double") * y))
    square = lambda v: total(F.transform(narrow(v), lambda x: x.cast("double") * x))
    norm = F.sqrt(square(a) * square(b))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the wide vector ``v`` of each row of ``docs(keys, text)``; rows with equal keys are one multiset."""
    paragraphs = docs.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph"))
    words, hashes = shingles(F.col("paragraph"))
    own = [F.xxhash64("paragraph").alias("p0"), F.xxhash64(F.lit("paragraph"), "paragraph").alias("p1")]
    hashed = paragraphs.select(*keys, words.alias("words"), *own).select(*keys, "p0", "p1", F.posexplode_outer(hashes).alias("i", "h"))
    sums = lane_sums(F.col("h"), F.col("i") == 0, [F.col("p0"), F.col("p1")])
    return hashed.groupBy(*keys).agg(*sums).select(*keys, vector().alias("v"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), cell ``g``, place ``rn`` in it, ``copy`` (true: only there for the one before
    it), and ``next_text``."""
    spark = docs.sparkSession
    ident = F.col("doc_id").cast("long")
    tasks = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK))
    groups = CELLS * tasks
    found, nulls, count = docs.agg(F.percentile_approx(ident, [(i + 1) / groups for i in range(groups)], 100_000), F.count_if(ident.isNull()), F.count(F.lit(1))).first()
    bounds = sorted(set(found or []))  # ids of the table, at most ``groups`` of them, the largest among them
    shares = [max(1, (found or []).count(b)) for b in bounds]
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    held, own = F.lit(bounds).cast("array<bigint>"), F.col("doc_id")
    at = F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when(F.get(held, lo + s - 1) < own, lo + s).otherwise(lo))
    k1, k2 = text_key(F.coalesce("text", F.lit("")))
    rows = docs.select(ident.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2")).withColumn("at", at)
    # ids from the largest down; an id that is a bound with several shares has cells of its own in front of the range below
    part = lambda n: F.floor((F.col("k1").cast("double") / F.lit(2.0**64) + 0.5) * n).cast("long")
    share = F.get(F.lit(shares).cast("array<bigint>"), F.col("at"))
    hot = (F.get(held, F.col("at")) == own) & (share > 1)
    place = (F.lit(len(bounds)) - F.col("at")).cast("long") * (groups + 1)
    last = F.lit((len(bounds) + 2) * (groups + 1)).cast("long") + part(max(1, -(-groups * nulls // max(1, count))))
    rows = rows.withColumn("g", F.when(own.isNull(), last).when(hot, place + part(share)).otherwise(place + groups)).drop("at")
    key = F.struct(own.isNull().alias("none"), F.bitwise_not(own).alias("down"), "k1", "k2")
    heads = rows.groupBy("g").agg(F.min(key).alias("head"))  # a row for each cell, at most twice ``groups``
    order = Window.orderBy("g")
    before = F.coalesce(F.lag("g").over(order), F.last("g").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(before.alias("to"), F.col("head.down").alias("h_down"), F.col("head.k1").alias("h_k1"), F.col("head.k2").alias("h_k2"))
    same = F.bitwise_not(own).eqNullSafe(F.col("h_down")) & (F.col("k1") == F.col("h_k1")) & (F.col("k2") == F.col("h_k2"))
    copies = rows.join(F.broadcast(heads), same).groupBy("to").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "k1", "k2")))
    rows = rows.select("doc_id", "text", "k1", "k2", "g", F.lit(False).alias("copy"))
    rows = rows.union(copies.select("doc_id", "text", "k1", "k2", F.col("to").alias("g"), F.lit(True))).repartition(tasks, "g")
    order = Window.partitionBy("g").orderBy("copy", F.col("doc_id").desc_nulls_last(), "k1", "k2")
    return rows.select("doc_id", "text", "g", "copy", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["g", "rn", "side", "doc_id", "copy", "n_chars", "edited_sha256"]
    both = rows.select(*(k for k in keys if k != "side"), F.posexplode(F.array("text", "edited")).alias("side", "text"))
    prints = fingerprints(both.filter("side = 0 or not copy"), keys)
    side = lambda k: F.first(F.when(F.col("side") == k, F.col("v")), ignorenulls=True)
    one = prints.groupBy(*(k for k in keys if k != "side")).agg(side(0).alias("v"), side(1).alias("e"))
    follows = F.lead("v").over(Window.partitionBy("g").orderBy("rn"))
    out = one.withColumn("f", follows).filter("not copy")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("v")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("f")).alias("near_next"),
    )
