"""Cross-source entity matches: candidates by product code, by name, by brand and name, or by a set-similarity join of
their words; no conflict of package or code; then a cascade of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions import text as x
from pricelode.operators.setjoin import Jaccard, similar_pairs
from pricelode.shared import written

# Thresholds of the two fuzzy methods, and the scores of the exact ones.
DUAL = (0.60, 0.78)
WEIGHTED = (0.82, 0.50, 0.75)
EXACT_CODE, EXACT_NAME = 1.0, 0.88
BRAND_EXACT, BRAND_INCOMPLETE = 0.99, 0.93


def products(part: DataFrame, code: Column | None = None) -> DataFrame:
    """(chain, name, brand, package, code, words) of a product table, distinct by the code as it is written; package 0 is
    unknown, code null is none.  Codes and names are read after the distinct: copies cost no more than being told apart."""
    raw = F.lit(None).cast("string") if code is None else code.cast("string")
    rows = part.select(F.col("p_type").alias("chain"), F.col("p_name").alias("name"), F.lower("p_brand").alias("brand"), (F.col("p_size") % 3).alias("package"), raw.alias("raw")).distinct()
    rows = written(rows, "products")  # else a filter on codes is pushed below the distinct
    return _worded(rows.select("chain", "name", "brand", "package", (raw if code is None else x.gtin14(F.col("raw"))).alias("code")))


def _worded(rows: DataFrame) -> DataFrame:
    """With the normalised name and its words."""
    return rows.withColumn("normal", x.normalized(F.col("name"))).withColumn("words", x.tokens(F.col("name")))


def free(left: str = "left", right: str = "right") -> Column:
    """No conflict of packages, nor of codes where both have one."""
    package = (F.col(f"{left}_package") == 0) | (F.col(f"{right}_package") == 0) | (F.col(f"{left}_package") == F.col(f"{right}_package"))
    return package & F.coalesce(F.col(f"{left}_code") == F.col(f"{right}_code"), F.lit(True))


def word_pairs(rows: DataFrame, least: float = WEIGHTED[1]) -> DataFrame:
    """left_normal, right_normal of distinct names that share so many of their words, in both orders."""
    names = rows.select(F.col("normal").alias("id"), "words").dropDuplicates(["id"])
    found = similar_pairs(names, None, Jaccard(least), width=2).select(F.col("left_id").alias("left_normal"), F.col("right_id").alias("right_normal"))
    return found.union(found.select("right_normal", "left_normal"))


def _sides(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = written(p.groupBy("chain", "name", "normal", "words", "package", "code").agg(F.min("brand").alias("brand")), "products")
    side = lambda s: own.select(*(F.col(c).alias(f"{s}_{c}") for c in own.columns))
    return side("left"), side("right")


def _related(arms: list[DataFrame]) -> DataFrame:
    pairs = arms[0].filter("left_chain < right_chain")
    for arm in arms[1:]:
        pairs = pairs.unionByName(arm.filter("left_chain < right_chain"))
    relation = F.when((F.col("left_package") == 0) | (F.col("right_package") == 0), "incomplete").otherwise("exact")
    return pairs.filter(free()).distinct().withColumn("relation", relation).withColumn("same_name", F.col("left_normal") == F.col("right_normal"))


def same_names(p: DataFrame) -> DataFrame:
    """Pairs of products of different chains with one name, without conflict of package or code."""
    left, right = _sides(p)
    return _related([left.join(right, F.col("left_normal") == F.col("right_normal"))])


RELATIONS = ("exact", "incomplete")


def _names(p: DataFrame) -> DataFrame:
    """chain, name, normal, words of each name of a chain, with ``kinds``: its distinct (package, coded, brand).  Which code it
    is matters to pairs of one code alone; to all others only whether there is one."""
    own = p.groupBy("chain", "name", "package", "code").agg(F.min("brand").alias("brand"))
    kind = F.struct("package", F.col("code").isNotNull().alias("coded"), "brand")
    return written(_worded(own.groupBy("chain", "name").agg(F.collect_set(kind).alias("kinds"))).select("chain", "name", "normal", "words", "kinds"), "names")


def _bare(kinds: Column) -> Column:
    """Kinds without their brand."""
    return F.array_distinct(F.transform(kinds, lambda k: F.struct(k["package"].alias("package"), k["coded"].alias("coded"))))


def _full(brand: Column, normal: Column) -> Column:
    """The normalised name with its brand in front, null without one."""
    return F.when(brand != "", F.concat_ws(" ", brand, normal))


def _relations(left: Column, right: Column) -> Column:
    """The relations in which two lists of kinds have a pair without conflict of package that has not two codes."""

    def some(relation: str) -> Column:
        def meets(a: Column, b: Column) -> Column:
            unknown = F.coalesce((a["package"] == 0) | (b["package"] == 0), F.lit(False))
            fits = unknown if relation == "incomplete" else ~unknown & F.coalesce(a["package"] == b["package"], F.lit(False))
            return fits & ~(a["coded"] & b["coded"])

        return F.exists(left, lambda a: F.exists(right, lambda b: meets(a, b)))

    return F.array_compact(F.array(*(F.when(some(r), F.lit(r)) for r in RELATIONS)))


NAMED = ["left_chain", "right_chain", "left_name", "right_name", "left_normal", "right_normal", "left_words", "right_words"]


def same_codes(p: DataFrame) -> DataFrame:
    """left_chain, right_chain, left_name, right_name, relation of names of different chains with one code, without conflict of
    package.  A name is in the join once for each of its codes, with its packages."""
    packages = F.collect_set("package")
    own = written(p.filter("code is not null").groupBy("code", "chain", "name").agg(F.array_remove(packages, 0).alias("known"), F.array_contains(packages, 0).alias("open")), "codes")
    # few rows make many pairs, so codes are spread whatever the size of the rows
    own = own.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "code")
    left, right = (own.select("code", *(F.col(c).alias(f"{s}_{c}") for c in ("chain", "name", "known", "open"))) for s in ("left", "right"))
    exact, incomplete = F.arrays_overlap("left_known", "right_known").alias("exact"), (F.col("left_open") | F.col("right_open")).alias("incomplete")
    pairs = left.join(right, "code").filter("left_chain < right_chain")
    held = pairs.select("left_chain", "right_chain", "left_name", "right_name", exact, incomplete).distinct()
    relations = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in RELATIONS)))
    return held.select("left_chain", "right_chain", "left_name", "right_name", F.explode(relations).alias("relation")).distinct()


def blocked_pairs(p: DataFrame) -> DataFrame:
    """Pairs of names of different chains with the same code or name, names that differ by the brand in front, or names with
    enough words in common, by ``arm`` and relation; each arm is a join on its own key.  No conflict of package or code.
    Products of one name are one row of a join, so pairs grow with names, not with products."""
    own = _names(p)
    side = lambda s, *more: own.select(*(F.col(c).alias(f"{s}_{c}") for c in own.columns), *more)
    left, right = side("left"), side("right")
    branded = lambda s: own.select(*(F.col(c).alias(f"{s}_{c}") for c in own.columns if c != "kinds"), F.explode("kinds").alias("k")).select("*", _full(F.col("k.brand"), F.col(f"{s}_normal")).alias("full")).filter("full is not null").groupBy(*(f"{s}_{c}" for c in own.columns if c != "kinds"), "full").agg(F.collect_set("k").alias(f"{s}_kinds"))

    def arm(name: str, pairs: DataFrame, a: Column, b: Column) -> DataFrame:
        found = pairs.filter("left_chain < right_chain").select(*NAMED, a.alias("_a"), b.alias("_b"))
        found = found.select(*NAMED, F.explode(_relations(F.col("_a"), F.col("_b"))).alias("relation"))
        return found.distinct().withColumn("arm", F.lit(name))

    a, b = _bare(F.col("left_kinds")), _bare(F.col("right_kinds"))
    same = arm("same_name", left.join(right, F.col("left_normal") == F.col("right_normal")), a, b)
    before = branded("left").join(right, F.col("full") == F.col("right_normal")).drop("full")
    behind = left.join(branded("right"), F.col("left_normal") == F.col("full")).drop("full")
    prefixed = arm("prefixed", before.unionByName(behind), a, b)
    names = word_pairs(own.select("normal", "words")).filter("left_normal <> right_normal")
    # a pair of products whose names differ by the brand in front has that evidence; others of the two names have not
    plain = lambda s, other: _bare(F.filter(f"{s}_kinds", lambda k: ~F.coalesce(_full(k["brand"], F.col(f"{s}_normal")) == F.col(f"{other}_normal"), F.lit(False))))
    alike = arm("alike", left.join(names, "left_normal").join(right, "right_normal"), plain("left", "right"), plain("right", "left"))
    coded = same_codes(p).select("left_chain", "right_chain", "left_name", "right_name", *(F.lit(None).cast(left.schema[c.replace("right", "left")].dataType).alias(c) for c in NAMED[4:]), "relation", F.lit("coded").alias("arm"))
    return coded.unionByName(same).unionByName(prefixed).unionByName(alike)


def fuzzy_names(pairs: DataFrame) -> DataFrame:
    """left_normal, right_normal, jaccard, sequence of distinct name pairs that can still reach a fuzzy method: the ratio
    itself runs only where the letters in common allow it."""
    names = pairs.filter("arm = 'alike'").select("left_normal", "right_normal", "left_words", "right_words").distinct().withColumn("jaccard", x.jaccard(F.col("left_words"), F.col("right_words"))).filter(F.col("jaccard") >= WEIGHTED[1])
    most = x.with_letter_bound(names, "left_normal", "right_normal", "most")
    hope = ((F.col("jaccard") >= DUAL[0]) & (F.col("most") >= DUAL[1])) | ((F.col("most") >= WEIGHTED[2]) & (0.6 * F.col("jaccard") + 0.4 * F.col("most") >= WEIGHTED[0] - 1e-4))
    return most.filter(hope).select("left_normal", "right_normal", "jaccard", x.sequence_ratio("left_normal", "right_normal").alias("sequence"))


def evidence(pairs: DataFrame) -> DataFrame:
    """Method and score of each pair with evidence."""
    pairs = written(pairs, "pairs")
    rows = pairs.join(fuzzy_names(pairs), ["left_normal", "right_normal"], "left")
    score = F.round(0.6 * F.col("jaccard") + 0.4 * F.col("sequence"), 4)
    is_ = lambda arm: F.col("arm") == arm
    dual = is_("alike") & (F.col("jaccard") >= DUAL[0]) & (F.col("sequence") >= DUAL[1])
    weighted = is_("alike") & (score >= WEIGHTED[0]) & (F.col("jaccard") >= WEIGHTED[1]) & (F.col("sequence") >= WEIGHTED[2])
    cascade = [
        (is_("coded"), "code_exact", F.lit(EXACT_CODE)), (is_("prefixed"), "brand_prefix", F.when(F.col("relation") == "exact", BRAND_EXACT).otherwise(BRAND_INCOMPLETE)),
        (is_("same_name"), "exact_name", F.lit(EXACT_NAME)), (dual, "dual_threshold", score), (weighted, "weighted_fuzzy", score),
    ]
    method, own = F.lit(None).cast("string"), F.lit(None).cast("double")
    for holds, name, value in reversed(cascade):
        method, own = F.when(holds, name).otherwise(method), F.when(holds, value).otherwise(own)
    return rows.select("left_chain", "right_chain", "left_name", "right_name", "relation", method.alias("method"), own.alias("score")).filter("method is not null").distinct()
