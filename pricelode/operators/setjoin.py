"""Exact set-similarity joins by prefix filtering: pairs of word sets with enough in common, without forming all pairs.

Words are ranked by rarity over both sides.  Two sets of which at least ``need`` words must agree share one of their ``size - need + 1``
rarest words, or two of their ``size - need + 2`` rarest: only these words, or pairs of words, are keys of the candidate
join, so a word that is everywhere is a key of hardly any set.  Candidates also pass a bound on sizes, for single
words one on what the words after the shared one can still add, and one on the bits in which digests of the sets differ: a word turns
one bit of its set's digest, so digests differ in no more bits than sets in words.  What passes is then counted exactly.

``Jaccard(t)``: shared / all words of both >= t.  ``Overlap(c)``: at least c shared words.  Empty sets (and null ones)
match nothing; repeated words count once.  Ids of a side are taken to be distinct; equal sets are paired like others, so
callers with many of them pair distinct sets and come back by the set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.shared import written

TINY = 1e-9


def _ceil(x: Column) -> Column:
    return F.ceil(x - TINY).cast("int")


@dataclass(frozen=True)
class Jaccard:
    t: float

    def need(self, size: Column) -> Column:
        """Words of a set of this size that any partner must share."""
        return _ceil(size * self.t)

    def smallest(self, size: Column) -> Column:
        """Size of the smallest partner."""
        return _ceil(size * self.t)

    def required(self, a: Column, b: Column) -> Column:
        return _ceil((a + b) * (self.t / (1 + self.t)))

    def fits(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) >= _ceil(F.greatest(a, b) * self.t))


@dataclass(frozen=True)
class Overlap:
    c: int

    def need(self, size: Column) -> Column:
        return F.lit(self.c)

    def smallest(self, size: Column) -> Column:
        return F.lit(self.c)

    def required(self, a: Column, b: Column) -> Column:
        return F.lit(self.c)

    def fits(self, a: Column, b: Column) -> Column:
        return F.least(a, b) >= self.c


Measure = Jaccard | Overlap


#: The digest of a set: 64 bits a column.
BITS = [f"bits_{i}" for i in range(8)]


def _digest() -> list[Column]:
    h = "xxhash64(word)"
    turned = f"shiftleft(1L, cast(shiftrightunsigned({h}, 8) & 63 as int))"
    return [F.expr(f"bit_xor(if(({h} & {len(BITS) - 1}) = {i}, {turned}, 0L))").alias(b) for i, b in enumerate(BITS)]


def ranked(sides: dict[str, DataFrame]) -> DataFrame:
    """side, id, words (as numbers, rarest first), size and digest of each set that has a word; ``sides`` are frames of id and words."""
    each = None
    for name, df in sides.items():
        one = df.select(F.lit(name).alias("side"), "id", F.explode(F.array_distinct("words")).alias("word"))
        each = one if each is None else each.unionByName(one)
    each = written(each.filter("word is not null"), "words")
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # numbers that grow with the place in the order, so words are numbers from here on: sets go with each candidate
    places = counts.repartitionByRange("n", "word").sortWithinPartitions("n", "word").select("word", F.monotonically_increasing_id().alias("place"))
    placed = each.join(written(places, "places"), "word").select("side", "id", F.col("place").alias("word"))
    sets = placed.groupBy("side", "id").agg(F.sort_array(F.collect_list("word")).alias("words"), *_digest())
    return written(sets.select("side", "id", "words", F.size("words").alias("size"), *BITS), "sets")


def keyed(sets: DataFrame, measure: Measure, width: int = 1) -> DataFrame:
    """side, id, size, digest, width, key, place of each key of the sets: rare words, or with ``width`` 2 pairs of them where two words
    are needed.  Pairs are for short sets over few words, such as names; a set has as many as the square of its rare words."""
    size = F.col("size")
    need, least = measure.need(size), measure.need(measure.smallest(size))

    def single(words: Column) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(size - need + 1, F.lit(0))), lambda w, i: F.struct(F.lit(1).alias("width"), F.xxhash64(w).alias("key"), (i + 1).alias("place")))

    def double(words: Column) -> Column:
        head = F.slice(words, 1, F.greatest(size - need + 2, F.lit(0)))
        met = F.transform(head, lambda w, i: F.transform(F.slice(words, i + 2, F.greatest(F.size(head) - i - 1, F.lit(0))), lambda v: F.struct(F.lit(2).alias("width"), F.xxhash64(w, v).alias("key"), (i + 1).alias("place"))))
        return F.flatten(met)

    none = F.array().cast("array<struct<width:int,key:bigint,place:int>>")
    words = F.col("words")
    if width == 1:
        keys = F.when(need <= size, single(words)).otherwise(none)
    else:
        # a pair meets by two words if its smaller set needs two, else by one
        keys = F.concat(F.when((least < 2) & (need <= size), single(words)).otherwise(none), F.when((need >= 2) & (need <= size), double(words)).otherwise(none))
    return sets.select("side", "id", "size", *BITS, F.explode(F.transform(keys, lambda k: F.struct(k["width"].cast("int").alias("width"), k["key"].alias("key"), k["place"].cast("int").alias("place")))).alias("k")).select("side", "id", "size", *BITS, "k.*")


def candidates(sets: DataFrame, left: str, right: str, measure: Measure, width: int = 1) -> DataFrame:
    """left_id, right_id of the pairs that must be counted; of one side with itself, left_id < right_id."""
    keys = keyed(sets, measure, width)
    side = lambda name, p: keys.filter(F.col("side") == name).select(F.col("id").alias(f"{p}_id"), F.col("size").alias(f"{p}_size"), F.col("place").alias(f"{p}_place"), "width", "key", *(F.col(c).alias(f"{p}_{c}") for c in BITS))
    a, b = F.col("left_size"), F.col("right_size")
    more = 1 + F.least(a - F.col("left_place"), b - F.col("right_place"))
    by_one = measure.need(F.least(a, b)) < 2 if width > 1 else F.lit(True)
    met = side(left, "left").join(side(right, "right"), ["width", "key"]).filter(measure.fits(a, b) & (((F.col("width") == 1) & by_one & (more >= measure.required(a, b))) | (F.col("width") == 2)))
    apart = reduce(add, (F.bit_count(F.col(f"left_{c}").bitwiseXOR(F.col(f"right_{c}"))) for c in BITS))
    met = met.filter(apart <= a + b - 2 * measure.required(a, b))
    if left == right:
        met = met.filter("left_id < right_id")
    return met.select("left_id", "right_id").distinct()


def similar_pairs(left: DataFrame, right: DataFrame | None, measure: Measure, width: int = 1) -> DataFrame:
    """left_id, right_id, shared (words), jaccard of all pairs of sets that reach the measure; without ``right`` the pairs
    within ``left``.  Frames have columns id and words."""
    sets = ranked({"left": left} if right is None else {"left": left, "right": right})
    other = "left" if right is None else "right"
    return counted(candidates(sets, "left", other, measure, width), sets, other, measure)


def counted(pairs: DataFrame, sets: DataFrame, other: str, measure: Measure) -> DataFrame:
    """Candidates that reach the measure, with what they share."""
    of = lambda name, p: sets.filter(F.col("side") == name).select(F.col("id").alias(f"{p}_id"), F.col("words").alias(f"_{p}"))
    both = pairs.join(of("left", "left"), "left_id").join(of(other, "right"), "right_id")
    n = both.select("left_id", "right_id", F.size(F.array_intersect("_left", "_right")).alias("shared"), F.size("_left").alias("a"), F.size("_right").alias("b"))
    found = n.filter((F.col("shared") > 0) & (F.col("shared") >= measure.required(F.col("a"), F.col("b"))))
    return found.select("left_id", "right_id", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))


def containing(sets: DataFrame, items: DataFrame, least: int, depth: int = 4) -> DataFrame:
    """left_id, right_id, shared, jaccard of sets and items with ``least`` or more words in common, where the sets may be
    whole texts: an item is found by ``depth`` words among its rarest, of which it has ``least - depth`` more than it can do without;
    the sets' words are looked up among those alone.  Words are told apart by 64-bit hashes, as texts have many: that two of the
    few hundred words of a pair have one hash has a chance of under 1e-13."""
    depth = min(depth, least)
    hashed = F.array_distinct(F.transform(F.array_compact("words"), lambda w: F.xxhash64(w))).alias("words")
    own = written(sets.select("id", hashed), "sets")
    few = written(items.select("id", hashed).filter(F.size("words") >= least), "items")
    item_words = few.select(F.col("id").alias("right_id"), F.size("words").alias("size"), F.explode("words").alias("word"))
    each = own.select(F.col("id").alias("left_id"), F.explode("words").alias("word"))
    there = each.join(item_words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    heads = item_words.join(there, "word", "left").groupBy("right_id", "size").agg(order.alias("o"))
    heads = written(heads.select("right_id", F.explode(F.slice("o", 1, F.col("size") - least + depth)).alias("x")).select("right_id", "x.word", "x.n"), "heads")
    met = each.join(heads.filter("n > 0").select("right_id", "word"), "word").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= depth).drop("m")
    both = met.join(own.select(F.col("id").alias("left_id"), F.col("words").alias("_left")), "left_id").join(few.select(F.col("id").alias("right_id"), F.col("words").alias("_right")), "right_id")
    n = both.select("left_id", "right_id", F.size(F.array_intersect("_right", "_left")).alias("shared"), F.size("_left").alias("a"), F.size("_right").alias("b")).filter(F.col("shared") >= least)
    return n.select("left_id", "right_id", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))
