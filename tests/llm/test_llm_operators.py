"""Each operator against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelode.llm import cotrain, idfiles, langid, mixing, multiset, packing, rules, simhash, suffix, warc
from pricelode.llm.tokens import END_ID, ChunkEncoder, public_path

WORDS = {
    "en": "the house and a river with many old stones under green trees near our quiet village road".split(),
    "de": "das haus und ein fluss mit vielen alten steinen unter grünen bäumen über der straße möchte".split(),
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, k1 string, fp string, share int, score string, kept string, tokens string, g int"


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = np.random.default_rng(seed)
    words = [str(WORDS[lang][i]) + (str(rng.integers(0, 40)) if rng.random() < 0.5 else "") for i in rng.integers(0, len(WORDS[lang]), n)]
    return "".join(w + (".\n" if i % 17 == 16 else " ") for i, w in enumerate(words))


def table() -> list[tuple]:
    passage = prose(999, 90)
    rows = [(i, prose(i, 30 + 11 * i % 170, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, rows[i][1], "en", "s0") for i in range(3)]  # exact copies
    rows += [(50 + i, prose(50 + i, 60) + passage + prose(70 + i, 40), "en", "s1") for i in range(4)]  # a shared passage
    rows += [(60, prose(5, 400), "en", "s0"), (61, prose(5, 400).replace("river", "lake", 1), "en", "s0")]  # near copies
    rows += [(70, None, "en", "s0"), (71, "", None, None), (72, " \t\n", "en", None), (73, "12 34 !?", "en", "s2"), (74, "é" * 500, "de", "s2"), (75, prose(7, 30000), "en", "s0")]
    rows += [(80, prose(80, 100), "en", "s0")] * 2 + [(None, prose(81, 100), "en", "s0")] * 2  # repeated rows, null ids
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", "y", 2, "z", "no", "t", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


TEXTS = [(r[0], r[1] or "") for r in table()]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_mixing(docs, none):
    out = mixing.weights(docs, {"source": {"s0": 0.5, "s1": 0.25, "s2": 0.25}, "lang": 1.0, "topic": 1.0}).toPandas()
    assert len(out) == len(TEXTS) and out.probability.max() == 1 and (out.probability >= 0).all()
    raked = out[out.tokens > 0].assign(t=lambda d: d.tokens * d.weight).groupby("source").t.sum()
    assert abs(raked["s0"] / raked.sum() - 0.5) < 1e-3 and abs(raked["s1"] / raked.sum() - 0.25) < 1e-3
    assert out[out.tokens == 0].kept.all()
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(TEXTS)
    assert mixing.weights(none).count() == 0 and mixing.mix(none).count() == 0


def brute_repeats(length):
    raw = [t.encode() for _, t in TEXTS]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for (d, _), b in zip(TEXTS, raw, strict=True):
        m = np.zeros(len(b) + 2, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i + 1 : i + length + 1] = 1
        kept = bytes(x for x, y in zip(b, m[1:], strict=False) if not y)
        yield d, len(b), int(m.sum()), int((np.diff(m) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(docs, none):
    same(suffix_rows(docs, 400).collect(), list(brute_repeats(400)))
    kept = suffix.strip_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 70").count() == 1
    assert suffix.strip_repeats(none).count() == 0


def suffix_rows(docs, length, passage=None):
    k1, k2 = suffix.text_key(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(suffix.stripped(docs, length, passage), ["k1", "k2"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage"] if passage else []))


@pytest.mark.parametrize("kinds", [1, 3, 1000])
def test_suffix_dedup_cuts_hot_cores(docs, monkeypatch, kinds):
    """Cores with more pieces than the limit are cut by content until equal strings meet."""
    monkeypatch.setattr(suffix, "KINDS", kinds)
    same(suffix_rows(docs, 64).collect(), list(brute_repeats(64)))


def test_passages(docs):
    """The longer strings and the shorter ones of one run."""
    got = suffix_rows(docs, 400, 240).collect()
    same([r[:5] for r in got], list(brute_repeats(400)))
    same([(r["doc_id"], r["n_bytes"], r["n_passage"]) for r in got], [r[:3] for r in brute_repeats(240)])


@pytest.mark.parametrize("size", [235, 300, 400, 500])
def test_planted_passages(spark, size):
    """A passage in texts that have nothing else in common goes if it has the length, in all of its places."""
    passage = prose(4321, 200)[:size]
    rows = [(i, f"{i} " + "".join(chr(97 + x) for x in np.random.default_rng(i).integers(0, 26, 700)) + passage + f" {i} end" * 40) for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in suffix.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffix.PASSAGE).collect()}
    for i, t in rows:
        assert (passage in out[i]) == (size < suffix.PASSAGE) and out[i].startswith(t[:300])


@pytest.mark.parametrize("kinds", [19, 20, 200])
def test_rows_stay_linear_at_a_hot_anchor(spark, monkeypatch, kinds):
    """A passage that many texts share, each in its own surroundings: rows of cores grow with the segments, on both
    sides of the limit."""
    monkeypatch.setattr(suffix, "KINDS", 20)
    made = []
    real = suffix._cores

    def counted(rows, length, band):
        out = real(rows, length, band)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(suffix, "_cores", counted)
    passage = prose(77, 80)[:330]
    rows = [(i, "".join(chr(97 + x) for x in np.random.default_rng(i).integers(0, 26, 500)) + passage + "".join(chr(97 + x) for x in np.random.default_rng(1000 + i).integers(0, 26, 9)) + str(i)) for i in range(kinds)]
    out = suffix.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 240)
    assert out.filter(F.contains("text", F.lit(passage[20:-20]))).count() == 0
    assert sum(b for _, b in made) <= 5 * sum(a for a, _ in made) and all(a <= 2 * made[0][0] for a, _ in made)  # a segment may lie on both edges


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n, k, depth in ((1, 1, 5), (40, 1, 9), (300, 2, 20), (500, 3, 60)):
        codes = rng.integers(1, k + 1, n).astype(np.int16)
        packed = suffix.pack_symbols(codes)
        sa, _ = suffix.suffix_array(packed, depth)
        got = suffix.common_prefixes(packed, sa, depth)
        for i in range(1, n):
            a, b = codes[sa[i - 1] :].tolist(), codes[sa[i] :].tolist()
            m = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[sa[i]] == min(m, depth) and (m >= depth or m == min(len(a), len(b)) or a[m] < b[m])


def test_language_id(spark, docs, none):
    many = spark.createDataFrame([(i, prose(i, 40, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    model = langid.fit(many)
    held = many.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    out = langid.predictions(held, model, ["doc_id", "lang"]).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()
    edge = {r["doc_id"]: r for r in langid.predictions(docs, model, ["doc_id"]).collect()}
    assert {edge[i]["lang_pred"] for i in (70, 71, 72, 73)} == {"und"} and all(edge[i]["rejected"] for i in (70, 71, 72, 73))
    assert edge[75]["lang_pred"] == "en"
    kept = langid.known_languages(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (70, 71, 72, 73)").count() == 0
    assert langid.known_languages(none).count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return [least[find(i)] for i in range(len(ids))]


def test_simhash(docs, none):
    prints = [brute_print(t) for _, t in TEXTS]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(TEXTS, prints, classes(prints, [d for d, _ in TEXTS]), strict=True)]
    rows = simhash.near_duplicates(docs)
    same(rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect(), want)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in want})
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("residents", [1, 5_000, 10**6, 10**9, 10**13])
def test_anchor_covering(residents):
    """Every code of the family gives the classes of all pairs."""
    rng = np.random.default_rng(residents % 97)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    blocks = simhash.code_blocks(residents)
    assert sum(n for _, n in blocks) <= 64 and all(n % 2 for _, n in blocks)
    rows, at = simhash.anchors(fps, blocks)
    joined = set()
    for a in np.unique(at):
        own = np.flatnonzero(at == a)
        here = simhash.Anchor(fps[rows[own[own < len(fps)]]])
        for x, y in (here.meet(fps[rows[own[own >= len(fps)]]]), here.own()):
            joined |= set(zip(x.tolist(), y.tolist(), strict=True))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in joined:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    want = classes([int(f) for f in fps], [int(f) for f in fps])
    assert [find(int(f)) for f in fps] == want


@pytest.mark.parametrize("most", [4, 40, 4096])
def test_crowded_anchors_are_dealt_again(spark, most):
    """Fingerprints that crowd a few anchors: the same links at any limit."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 4, 6) for _ in range(12)}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    with simhash.Scratch(spark) as scratch:
        roots = {r[0]: r[1] for r in simhash.components(simhash.links(rows, 200, scratch, most), scratch).collect()}
    ordered = sorted(fps)
    want = classes(ordered, ordered)
    got = [roots.get(f - (1 << 64) if f >> 63 else f, f) for f in ordered]
    assert len({*zip(got, want, strict=True)}) == len({*got}) == len({*want}) < len(ordered)


def test_quality_classifier(spark, docs, none):
    rows = [(i, prose(i, 60) if i % 4 else prose(i, 60).upper().replace(" ", "!! "), "en", f"s{i % 5}", 60 * (1 + i % 4)) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = cotrain.train(many, labels, rounds=2, added=20)
    out = cotrain.scored(many, model).toPandas()
    assert ((out.doc_id % 4 > 0) == out.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert cotrain.scored(docs, model).count() == len(TEXTS)
    assert cotrain.scored(none, cotrain.train(none, labels)).count() == 0
    assert cotrain.fit([]).scores(["a"], ([None], [None], [None]))[0][0] == 0.5
    for r in rows[:12]:  # by hand, from the weights
        words = r[1].split()
        c = sum(model.content_w[xxhash.xxh32_intdigest(w) % cotrain.WORD_BUCKETS] for w in words) / len(words) + model.content_w[-1]
        m = sum(model.metadata_w[k * cotrain.LEVELS + xxhash.xxh32_intdigest(x) % cotrain.LEVELS] for k, x in enumerate((repr(r[2]), repr(r[3]), repr((r[2], r[3])))))
        m += model.metadata_w[3 * cotrain.LEVELS + r[4].bit_length()] + model.metadata_w[-2] * np.log1p(r[4]) / 10 + model.metadata_w[-1]
        c, m = (a * z + b for (a, b), z in zip(model.curves, (c, m), strict=False))
        want = [1 / (1 + np.exp(-z)) for z in (model.curves[2][0] * (c + m) + model.curves[2][1], c, m)]
        got = out[out.doc_id == r[0]].iloc[0]
        assert np.allclose([got.score, got.content_score, got.metadata_score], want, atol=1e-5)


def test_metadata_view_never_sees_the_text():
    assert (cotrain.metadata(["en", None], ["s", None], [5, None])[0] == cotrain.metadata(["en"], ["s"], [5])[0]).all()


def test_repeated_rows_are_one_for_fitting(spark):
    rows = [(i, "a b c d e" if i else "f g h", "en", "s") for i in range(61) for _ in range(5)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    votes = spark.createDataFrame([(i, int(i > 0)) for i in range(61)], "doc_id long, label int")
    assert cotrain.labelled(many, votes).count() == 2
    own = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5)
    langs = spark.createDataFrame([(i, f"text number {i % 40} in words", "en") for i in range(200)] + [(own, "one text", "en")] * 500, "doc_id long, text string, lang string").repartition(4)
    assert langid.training_rows(langs, 10).count() <= 10 * (1 + len(langid.SHORT))
    assert langid.training_rows(langs.filter(F.col("doc_id") == own), 10).count() == 1


def test_calibration_is_the_best_curve():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * z + b)))
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()

    a, b = cotrain.calibrate(z, y)
    assert loss(a, b) <= min(loss(x, v) for x in np.linspace(0.3, 1.2, 46) for v in np.linspace(-1, 0.5, 46)) + 0.05


def test_language_scores_by_hand(spark):
    many = spark.createDataFrame([(i, prose(i, 40, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(100)], "doc_id long, text string, lang string")
    model = langid.fit(many)
    texts = ["Der Fluss über die Straße", "old stones, under green!", "a", "½ ² 12", None, ""]
    lang, score, rejected = model.predict(texts)
    assert lang[3:] == ["und"] * 3 and score[3:].tolist() == [0, 0, 0] and rejected[3:].all()
    for t, got, p in zip(texts[:3], lang, score, strict=False):
        raw = b" " + bytes(x if x >= 128 or 97 <= x < 123 else 32 for x in t.lower().encode()) + b"   "
        grams = [raw[i : i + n] for i in range(len(raw) - 3) for n in (2, 3, 4)]
        grams = [g for g in grams if not (g[0] == 32 == g[1]) and 32 not in g[1:-1]]

        def bucket(g):
            h = ((int.from_bytes(g, "little") + (len(g) - 2) * 0x51ED270B) * 0x9E3779B1) % 2**32
            h = ((h ^ h >> 15) * 0x85EBCA77) % 2**32
            return h >> 17

        z = (sum(model.table[bucket(g)].astype(float) for g in grams) / len(grams) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert got == model.langs[int(e.argmax())] and abs(p - (e / e.sum()).max()) < 1e-4


def test_posterior_by_brute_force():
    """The posterior of each pattern from the tables that EM ends with, and that one more step changes nothing."""
    rng = np.random.default_rng(6)
    patterns = np.array(sorted({tuple(r) for r in rng.integers(0, 3, (60, 3)).tolist()}))
    counts = rng.integers(1, 200, len(patterns)).astype(float)
    good, tables, share = rules.em(patterns, counts, rounds=4000)
    for p, g in zip(patterns.tolist(), good, strict=True):
        a, b = share, 1 - share
        for j, v in enumerate(p):
            if v < 2:
                a, b = a * tables[0, j, v], b * tables[1, j, v]
        assert abs(g - a / (a + b)) < 1e-6
    for j in range(3):
        for c, post in enumerate((good, 1 - good)):
            seen = [(post * counts)[patterns[:, j] == v].sum() + rules.WEIGHT * rules.START[c][v] for v in (0, 1)]
            assert np.allclose(tables[c, j], np.array(seen) / sum(seen), atol=1e-4)


def brute_lanes(text):
    v = [0] * 68
    for paragraph in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", paragraph)
        hashes = []
        for g in [w[i : i + 5] for i in range(len(w) - 4)]:
            h = 42
            for x in g:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            hashes.append(h)
        if w and not hashes:
            hashes.append(xxhash.xxh64_intdigest(" ".join(w).encode(), seed=42))
        for h in hashes:
            for j in range(64):
                v[j] += 2 * (h >> j & 1) - 1
        if w:
            p = [xxhash.xxh64_intdigest(paragraph.encode(), seed=s) for s in (42, xxhash.xxh64_intdigest(b"paragraph", seed=42))]
            for j in range(2):
                v[64 + 2 * j] += p[j] & 0xFFFFFFFF
                v[65 + 2 * j] += p[j] >> 32
    return v


def brute_vector(text):
    v = brute_lanes(text)
    return "".join(f"{x % 65536:04x}" for x in v[:64]) + "".join(f"{x % 2**32:08x}" for x in v[64:])


def brute_likeness(a, b):
    x, y = brute_lanes(a), brute_lanes(b)
    if x == y:
        return 1.0
    x, y = np.array(x[:64], float), np.array(y[:64], float)
    norm = np.sqrt((x @ x) * (y @ y))
    return max(0.0, min(1.0, x @ y / norm)) if norm else 0.0


def test_fingerprints(spark, docs):
    rows = multiset.fingerprints(docs.filter("doc_id < 80").select("doc_id", "text"), ["doc_id"])
    got = dict(map(tuple, rows.select("doc_id", multiset.digest(F.col("v"))).collect()))
    assert got == {d: brute_vector(t) for d, t in TEXTS if d is not None and d < 80}
    parts = spark.createDataFrame([(1, "a b c d e f g\nh i j"), (2, "h i j\na b c d e f g"), (3, "h i j"), (4, "a b c d e f g")], "doc_id int, text string")
    d = multiset.fingerprints(parts, ["doc_id"]).select("doc_id", multiset.digest(F.col("v")).alias("f"))
    f = dict(map(tuple, d.collect()))
    assert f[1] == f[2]
    other = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e\nb c d e f")], "doc_id int, text string")
    assert multiset.fingerprints(other, ["doc_id"]).select(multiset.digest(F.col("v"))).distinct().count() == 2
    one = spark.createDataFrame([(f[3], f[4], f[1])], "a string, b string, c string")
    assert one.select(multiset.combine(F.col("a"), F.col("b")), multiset.combine(F.col("c"), F.col("b"), -1)).first() == (f[1], f[3])


def test_fingerprints_of_next(spark, docs, none, tmp_path):
    """Against brute force, with ids of which all or many are null or equal; of equal ids and texts any order will do."""
    one_id = docs.withColumn("doc_id", F.when(F.col("doc_id") > 20, F.lit(7)).otherwise(F.col("doc_id")).cast("long"))
    for name, rows in (("some", docs), ("none", none), ("nulls", docs.withColumn("doc_id", F.lit(None).cast("long"))), ("one", one_id)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = multiset.op6_fingerprints(spark, f"{tmp_path}/{name}").toPandas()
        k1, k2 = multiset.text_key(F.coalesce("text", F.lit("")))
        texts = [tuple(r) for r in rows.select("doc_id", k1, k2, F.coalesce("text", F.lit(""))).collect()]
        texts.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
        want = []
        for i, (d, _, _, t) in enumerate(texts):
            follow, cut = texts[(i + 1) % len(texts)][3], len(t) // 3
            edited = t[: len(t) - cut] + follow[:cut]
            near = (round(brute_likeness(t, edited), 9), round(brute_likeness(t, follow), 9))
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_vector(t), brute_vector(edited), *near))
        got = [(None if np.isnan(r[0]) else int(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in out.itertuples(index=False)]
        same(got, want)


def test_quality_rules(docs, none):
    out = {(r["doc_id"], r["n_words"]): r for r in rules.judged(docs).collect()}
    for d, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins, mark = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [0] * len(w)
        for i in range(len(w) - 7):
            if wins[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        r = out[(d, len(w))]
        want = (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mark), len(w) < 20 or 100 * sum(mark) > 30 * len(w))
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])
    assert rules.judged(none).count() == 0


def test_repeated_words_by_brute_force():
    texts = ["a b c d e f g h x a b c d e f g h", "q " * 30, "", None, "one two", "a b c d e f g h i j k l"]
    assert rules.figures(texts)["n_repeat_words"].tolist() == [16, 30, 0, 0, 0, 0]


def test_em_tells_rules_apart():
    patterns = np.array([[1, 1], [0, 2], [2, 0], [1, 2]])
    good, tables, share = rules.em(patterns, np.array([900.0, 50, 40, 10]))
    assert good[0] > 0.9 > 0.5 > good[1] and good[2] < 0.5 and 0 < share < 1 and tables.shape == (2, 2, 2)


PAGES = "page_id long, url string, html string, sha string, copies int"


def test_warc(spark, tmp_path):
    big = "ü<p>" * 40000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", big), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", big), (7, "http://g", "y"), (7, "http://g", "y"), (7, "http://h", "y"), (None, None, "<p>x</p>"), (None, None, "alone")]
    pages = spark.createDataFrame([(*r, "s", 9) for r in rows], PAGES).repartition(3)
    warc.write_archives(pages, f"{tmp_path}/w")
    want, done = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True):
        raw = (h or "").encode()
        first = next(x for x in sorted((r[0] for r in rows if (r[2] or "") == (h or "")), key=lambda x: (x is None, -(x or 0))))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if h or "" in done else "response", None, warc.uri(u)))
        again = (h or "") in done
        want[-1] = (*want[-1][:3], "revisit" if again else "response", first if again else None, want[-1][5])
        done.add(h or "")
    back = warc.read_archives(spark, f"{tmp_path}/w")
    same(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect(), want)
    assert back.select("record_id").distinct().count() == len(rows)
    warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
    assert warc.unchunked(warc.chunked(b"ab\r\n" * 5000)) == b"ab\r\n" * 5000
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcdX0\r\n\r\n")


def test_long_pages_make_no_long_files(spark, tmp_path):
    """A file's bytes are bounded by those of its records, parts of long pages included."""
    import glob
    import gzip

    pages = spark.createDataFrame([(i, "http://a", f"{i}" + "xy z" * 1_500_000) for i in range(4)], "page_id long, url string, html string").repartition(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{tmp_path}/w/part-*")]
    assert sum(sizes) > 24_000_000 and max(sizes) <= warc.PER_FILE * (warc.SEGMENT + 1000)
    assert warc.read_archives(spark, f"{tmp_path}/w").agg(F.sum("payload_bytes")).first()[0] == sum(len(f"{i}") + 6_000_000 for i in range(4))


def test_tokens_are_the_tokenizers():
    texts = ["", None, "  a   b\n\n c ", "x  y  z", "it's <|endoftext|> ok 3's don't-'ll !'s 's", "a\t\n b", "l'été–! naïve×3 ñ!!", "–!a é–b", "'llama's 'S", "a b ", "ﬁne ① été", *(t for _, t in TEXTS[:45])]
    texts += ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, own = ChunkEncoder(public_path(name), keep=300), Tokenizer.from_file(public_path(name))
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == [*own.encode(t or "", add_special_tokens=False).ids, END_ID]


def test_packing(docs, none):
    encoder = ChunkEncoder(public_path("word_bpe_49k.json"))
    ids = encoder.encode([t for _, t in TEXTS])
    out = packing.pack(docs, public_path("word_bpe_49k.json"), shard_pieces=20).toPandas()
    assert out.length.sum() == sum(map(len, ids)) and out.length.max() <= 4096
    for _, window in out.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == [0, *window.length.cumsum()[:-1]] and window.length.sum() <= 4096
    for (d, _), x in zip(TEXTS, ids, strict=True):
        if d is not None and d != 80:
            own = out[out.doc_id == d].sort_values("start")
            assert own.length.sum() == len(x) == own.doc_tokens.iloc[0]
            for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
                assert zlib.crc32(x[s : s + n].astype("<u4").tobytes()) == c
    assert packing.pack(none, public_path("word_bpe_49k.json")).count() == 0
    equal = docs.sparkSession.createDataFrame([(1, "same text")] * 900, "doc_id long, text string").repartition(2)
    shards = packing.pack(equal, public_path("word_bpe_49k.json"), window=64, shard_pieces=100).groupBy(F.shiftright("sequence_id", 32)).count().toPandas()
    assert len(shards) == 9 and shards["count"].max() < 200


def test_best_fit_decreasing_takes_the_tightest():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 101, 300).tolist(), reverse=True))
    number, offset = packing.best_fit_decreasing(lengths, 100)
    left: list[int] = []
    for n, w, o in zip(lengths.tolist(), number.tolist(), offset.tolist(), strict=True):
        fits = [x for x in left if x >= n]
        if w == len(left):
            assert not fits
            left.append(100)
        else:
            assert left[w] == min(fits)
        assert o == 100 - left[w]
        left[w] -= n


def test_id_files(spark, docs, none, tmp_path):
    path = public_path("byte_bpe_50k.json")
    idfiles.write_ids(docs, path, f"{tmp_path}/ids")
    rows = idfiles.read_ids(spark, f"{tmp_path}/ids").toPandas().sort_values("start")
    encoder = ChunkEncoder(path)
    want = sorted(((d is not None, d or 0, len(x), zlib.crc32(x.astype("<u4").tobytes())) for (d, _), x in zip(TEXTS, encoder.encode([t for _, t in TEXTS]), strict=True)))
    got = [(not np.isnan(d), 0 if np.isnan(d) else int(d), n, c) for d, n, c in zip(rows.doc_id, rows.n_tokens, rows.ids_crc32, strict=True)]
    assert sorted(got) == want and [g[:2] for g in got] == [w[:2] for w in want]
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum()[:-1]]
    idfiles.write_ids(none, path, f"{tmp_path}/none")
    assert idfiles.read_ids(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("kind", ["small", "wide", "outliers", "same"])
def test_segments_round_trip(kind):
    rng = np.random.default_rng(5)
    ids = {"small": rng.integers(0, 50000, 5000), "wide": rng.integers(0, 2**32, 3000), "outliers": np.where(rng.random(9000) < 0.03, 2**32 - 1, rng.integers(7, 9, 9000)), "same": np.full(2048, 11)}[kind].astype(np.uint32)
    docs = [(None, ids[:10]), (-5, ids[10:10]), (9, ids[10:])]
    data = idfiles.encode_segment(docs)
    got, back, size = idfiles.decode_segment(memoryview(data + b"\nrest"))
    assert size == len(data) and (back == ids).all() and got["n"].tolist() == [10, 0, len(ids) - 10] and got["null"].tolist() == [1, 0, 0]
    assert kind != "outliers" or len(data) < len(ids)


@pytest.mark.parametrize(
    "rows",
    [
        [(0, "123 456", "en"), (2, "", "de"), (3, "!!!", "en"), (4, "some text", None)],  # labelled rows, none with a letter
        [(i, None, "en") for i in range(9)], [(i, "", "en") for i in range(9)], [(7, "only one row", "en")] * 8,
        [(1, "words and words " * 40000, "en"), (2, "wörter und mehr", "de")], [(None, "no id", "en"), (1, "x", "en")],
    ],
)
def test_language_of_odd_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predictions(frame, langid.fit(frame), ["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] in ("und", "en", "de") for r in out)
    if not any(r[2] and r[1] and re.search("[a-z]", r[1]) for r in rows):
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out)
    assert langid.known_languages(frame).count() <= len(rows)


def test_most_certain_by_brute_force(spark):
    """The surest of all unlabelled documents of each view that may teach; none by a view that may not."""
    rows = [(i, prose(i, 40) if i % 4 else prose(i, 40).upper(), "en", f"s{i % 3}", 40 * (1 + i % 4)) for i in range(300)]
    many = cotrain._described(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).repartition(5)
    labels = cotrain.labelled(many.drop("h").withColumnRenamed("size", "n_chars"), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 300, 2)], "doc_id long, label int"))
    model = cotrain.fit([tuple(r) for r in labels.select("h", "label", "teaches", "at", "x", "meta").collect()])
    pool = many.filter("doc_id % 2 = 1")
    held = pool.toPandas()
    views = model.views(held.text.tolist(), (held.lang.tolist(), held.source.tolist(), held["size"].tolist()))
    taken = set(held.h.tolist()[:5])
    for may_teach in ((True, True), (True, False), (False, True)):
        model.may_teach = may_teach
        with cotrain.Scratch(spark) as scratch:
            got = sorted((r["teaches"], r["label"], r["h"]) for r in cotrain.most_certain(pool, model, taken, scratch, 12).collect())
        bad = min(11, max(1, round(12 * (1 - model.share))))
        want = []
        for k in (cotrain.CONTENT, cotrain.METADATA):
            if may_teach[1 - k]:
                for label, n in ((0, bad), (1, 12 - bad)):
                    sure = sorted(((-z if label else z), h) for z, h in zip(views[1 - k].tolist(), held.h.tolist(), strict=True) if h not in taken)
                    want += [(k, label, h) for _, h in sure[:n]]
        assert got == sorted(want)


def test_a_view_like_the_base_rate_does_not_teach(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.8).astype(float)
    half = np.arange(400) % 2
    base = cotrain.held_losses(np.zeros(400), y, half)
    p = [(y[half != k].sum() / (half != k).sum()) for k in (0, 1)]
    assert np.allclose(base, [-np.log(p[h] if t else 1 - p[h]) for t, h in zip(y, half, strict=True)], atol=0.02)
    assert not cotrain.better(cotrain.held_losses(rng.normal(0, 1, 400), y, half), base)
    assert cotrain.better(cotrain.held_losses(y * 2 - 1 + rng.normal(0, 1, 400), y, half), base)
    rows = [(i, prose(i, 40) if i % 4 else prose(i, 40).upper(), "en", "s", 40) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    model = cotrain.train(many, spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int"), 2, added=20)
    assert model.may_teach == (True, False)


def test_cells_of_fingerprints_follow_the_bytes(spark, docs, monkeypatch):
    """Many small cells: the same next texts, more tasks."""
    few = sorted(map(str, multiset.with_next(docs.dropDuplicates(["doc_id"])).filter("not copy").select("doc_id", "text", "next_text").collect()))
    monkeypatch.setattr(multiset, "TASK", 2000)
    rows = multiset.with_next(docs.dropDuplicates(["doc_id"]))
    assert sorted(map(str, rows.filter("not copy").select("doc_id", "text", "next_text").collect())) == few
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert rows.select("g").distinct().count() > total // 4000 and rows.select(F.spark_partition_id()).distinct().count() > 8


def test_suffix_dedup_of_texts_of_several_megabytes(spark):
    """Texts longer than the pieces in which they are read and sent: strings across those cuts, within one text and between two."""
    rng = np.random.default_rng(11)
    letters = lambda n: bytearray(rng.integers(97, 123, n, dtype=np.uint8).tobytes())
    long, twin = letters(3_300_000), letters(1_500_000)
    assert len(long) > 3 * max(suffix.PIECE, suffix.CUT_BYTES)
    long[2_500_000 - 1 : 2_500_501] = b"#" + long[300_000:300_500] + b"#"  # 500 bytes again in the same text
    edges = [(suffix.PIECE - 300, 600), (2 * suffix.CUT_BYTES - 450, 500)]
    short = b"#" + b"#".join(bytes(long[a : a + n]) for a, n in edges) + b"#"
    near = b"#" + bytes(long[700_000:700_399]) + b"#"  # one byte too short
    texts = {1: bytes(long), 2: short, 3: bytes(twin), 4: bytes(twin), 5: near}
    docs = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string")
    gone = {1: [(300_000, 500), *edges, (2_500_000, 500)], 2: [(1, 600), (602, 500)], 3: [(0, len(twin))], 4: [(0, len(twin))], 5: []}
    want = []
    for d, t in texts.items():
        mask = np.ones(len(t), bool)
        for a, n in gone[d]:
            mask[a : a + n] = False
        kept = np.frombuffer(t, np.uint8)[mask].tobytes()
        want.append((d, len(t), len(t) - len(kept), len(gone[d]), hashlib.sha256(kept).hexdigest()))
    for passage in (None, 240):
        assert sorted(tuple(r)[:5] for r in suffix_rows(docs, 400, passage).collect()) == want
