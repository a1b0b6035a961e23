"""Set-similarity joins against all pairs, the number of candidates they form, and the match cascade against a plain version."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pricelode.functions import text
from pricelode.operators import matching, setjoin
from pricelode.operators.setjoin import Jaccard, Overlap


def sets(n, seed, vocabulary=60, most=9):
    """Sets over words of very unlike frequency, some equal, some empty, some null."""
    pick = random.Random(seed)
    word = lambda: f"w{min(int(pick.paretovariate(0.7)), vocabulary)}"
    out = [sorted({word() for _ in range(pick.randrange(1, most))}) for _ in range(n - 6)]
    return list(enumerate([*out, [], None, ["w1"], ["w1"], out[0], ["w1", "w1", "w2"]]))


def brute(left, right, measure, itself):
    out = []
    for (i, a), (j, b) in itertools.product(left, right):
        a, b = set(a or []), set(b or [])
        shared = len(a & b)
        if not shared or (itself and i >= j):
            continue
        ok = shared >= measure.c if isinstance(measure, Overlap) else shared >= measure.t * len(a | b) - 1e-9
        if ok:
            out.append((i, j, shared, round(shared / len(a | b), 9)))
    return sorted(out)


def rows(found):
    return sorted((r["left_id"], r["right_id"], r["shared"], round(r["jaccard"], 9)) for r in found.collect())


@pytest.mark.parametrize("width", [1, 2])
@pytest.mark.parametrize("measure", [Jaccard(0.3), Jaccard(0.5), Jaccard(0.8), Jaccard(1.0), Overlap(1), Overlap(2), Overlap(4)])
def test_pairs_are_all_pairs(spark, measure, width):
    left, right = sets(70, 1), sets(50, 2)
    frame = lambda x: spark.createDataFrame(x, "id int, words array<string>")
    width = 1 if measure == Overlap(1) else width
    assert rows(setjoin.similar_pairs(frame(left), None, measure, width)) == brute(left, left, measure, True)
    assert rows(setjoin.similar_pairs(frame(left), frame(right), measure, width)) == brute(left, right, measure, False)


@pytest.mark.parametrize("least", [1, 2, 5, 7])
def test_items_in_texts(spark, least):
    left, right = sets(80, 3, most=40), sets(40, 4, most=12)
    frame = lambda x: spark.createDataFrame(x, "id int, words array<string>")
    assert rows(setjoin.containing(frame(left), frame(right), least)) == brute(left, right, Overlap(least), False)
    assert setjoin.containing(frame(left).limit(0), frame(right), least).count() == setjoin.similar_pairs(frame(left).limit(0), None, Jaccard(0.5)).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_candidates_grow_with_input_and_output(spark, width):
    """A word in every set, and three that are in two thirds: all pairs share it, hardly any is a candidate."""
    made = {}
    for n in (300, 1200):
        pick = random.Random(n)
        data = [(i, ["the", *pick.sample(["of", "and", "to"], 2), *(f"r{pick.randrange(n * 3)}" for _ in range(5))]) for i in range(n)]
        data += [(n + i, [*data[i][1][:-1], f"x{i}"]) for i in range(n // 10)]  # near copies
        frame = spark.createDataFrame(data, "id int, words array<string>")
        ranked = setjoin.ranked({"left": frame})
        found = setjoin.candidates(ranked, "left", "left", Jaccard(0.7), width)
        made[n] = found.count()
        assert setjoin.counted(found, ranked, "left", Jaccard(0.7)).count() >= n // 10
    assert made[1200] <= 2 * 1320 and made[1200] <= 6 * max(made[300], 1)


def test_letter_bound_is_a_bound(spark):
    pick = random.Random(5)
    names = ["".join(pick.choice("abcä é") for _ in range(pick.randrange(0, 14))) for _ in range(120)]
    pairs = spark.createDataFrame([(a, pick.choice(names)) for a in names], "a string, b string")
    got = text.with_letter_bound(pairs, "a", "b", "most").collect()
    assert len(got) == 120 and all(round(SequenceMatcher(None, r["a"], r["b"]).ratio(), 4) <= r["most"] <= 1 for r in got)
    assert any(r["most"] < 0.5 for r in got)


def test_cascade_against_a_plain_version(spark):
    pick = random.Random(11)
    words = "milk fresh whole berg alp cheese old mild soft bread dark rye".split()
    parts = [(pick.choice("xyz"), " ".join(pick.sample(words, pick.randrange(1, 5))), pick.choice(["berg", "alp", "", "q"]), pick.randrange(3), pick.choice([None, None, "96385074", "4006381333931"])) for _ in range(160)]
    frame = spark.createDataFrame(parts, "p_type string, p_name string, p_brand string, p_size int, code string")
    got = {tuple(r) for r in matching.evidence(matching.blocked_pairs(matching.products(frame, F.col("code")))).collect()}
    own = {}
    for chain, name, brand, size, code in parts:
        key = (chain, name, size % 3, code)
        own[key] = min(own.get(key, brand), brand)
    want = set()
    for (a, ab), (b, bb) in itertools.product(own.items(), own.items()):
        if a[0] >= b[0] or (a[2] and b[2] and a[2] != b[2]) or (a[3] and b[3] and a[3] != b[3]):
            continue
        relation = "incomplete" if not a[2] or not b[2] else "exact"
        wa, wb = {w for w in a[1].split() if len(w) > 2}, {w for w in b[1].split() if len(w) > 2}
        j = round(len(wa & wb) / len(wa | wb), 4) if wa | wb else 0
        s = round(SequenceMatcher(None, a[1], b[1]).ratio(), 4)
        score = round(0.6 * j + 0.4 * s, 4)
        if a[3] and a[3] == b[3]:
            found = ("code_exact", 1.0)
        elif (ab and f"{ab} {a[1]}" == b[1]) or (bb and f"{bb} {b[1]}" == a[1]):
            found = ("brand_prefix", 0.99 if relation == "exact" else 0.93)
        elif a[1] == b[1]:
            found = ("exact_name", 0.88)
        elif j >= 0.6 and s >= 0.78:
            found = ("dual_threshold", score)
        elif score >= 0.82 and j >= 0.5 and s >= 0.75:
            found = ("weighted_fuzzy", score)
        else:
            continue
        want.add((a[0], b[0], a[1], b[1], relation, *found))
    assert got == want and {m for *_, m, _ in got} >= {"code_exact", "brand_prefix", "exact_name", "dual_threshold"}


def test_short_names_still_match(spark):
    """Names without a word of three letters have no words, and still match by name or code."""
    rows = [("x", "a b", "q", 0, None), ("y", "a b", "q", 0, None), ("x", "ö", "q", 0, "96385074"), ("y", "zz", "q", 1, "9638-5074")]
    frame = spark.createDataFrame(rows, "p_type string, p_name string, p_brand string, p_size int, code string")
    got = {(r["left_name"], r["right_name"], r["method"]) for r in matching.evidence(matching.blocked_pairs(matching.products(frame, F.col("code")))).collect()}
    assert got == {("a b", "a b", "exact_name"), ("ö", "zz", "code_exact")}


def test_products_of_one_name_are_one_row(spark):
    """Two names with many products and codes are as many pairs as they have kinds of evidence, not as their products."""
    def code(i):
        body = f"{400000000000 + i}"
        return body + str((10 - sum(int(d) * (3 if k % 2 == 0 else 1) for k, d in enumerate(reversed(body))) % 10) % 10)

    rows = [(c, "red ring", f"b{i % 5}", i % 3, code(i) if i % 7 else None) for c in "xy" for i in range(120)]
    frame = spark.createDataFrame(rows, "p_type string, p_name string, p_brand string, p_size int, code string")
    p = matching.products(frame, F.col("code"))
    pairs = matching.blocked_pairs(p)
    assert pairs.count() == 4
    want = {("x", "y", "red ring", "red ring", r, m, v) for r in ("exact", "incomplete") for m, v in (("code_exact", 1.0), ("exact_name", 0.88))}
    assert {tuple(r) for r in matching.evidence(pairs).collect()} == want
    assert {r["relation"] for r in matching.same_codes(p).collect()} == {"exact", "incomplete"}


def test_unlike_sets_with_rare_words_in_common_are_no_candidates(spark):
    """Sets that share their rarest words and little else differ in more bits of their digests than similar sets may."""
    rare = [f"r{k}" for k in range(6)]
    data = [(i, [*rare, *(f"c{(i * 37 + k * (2 * i + 1)) % 400}" for k in range(44))]) for i in range(80)]
    data += [(100 + i, [*data[i][1][:-1], f"x{i}"]) for i in range(5)]
    frame = spark.createDataFrame(data, "id int, words array<string>")
    measure = Jaccard(0.8)
    own = setjoin.ranked({"left": frame})
    assert own.schema["words"].dataType.simpleString() == "array<bigint>"
    want = brute(data, data, measure, True)
    assert rows(setjoin.similar_pairs(frame, None, measure)) == want and len(want) >= 5
    assert setjoin.candidates(own, "left", "left", measure).count() <= 2 * len(want) + 5
