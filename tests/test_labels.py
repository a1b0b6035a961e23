"""Packages, price contexts and references: the forms their rules turn on, as tables of examples."""

import hashlib
import json
import random
import unicodedata

import pytest
import regex as re
from pyspark.sql import functions as F

from pricelode.functions import labels, text
from pricelode.operators import pointers

IMAGES = [
    ("https://i.example/951983c2-735b-40a2-9499-9a516a4c44db_Almette_Kraeuter_70Prz_150g_146503009.png", (150.0, "g", 1)),
    ("https://i.example/61327a63-5975-41f2-86b1-7cbebf321edf_Bio_Joghurt_Himbeer_3_7_4x100g_1348762003.png", (100.0, "g", 4)),
    ("https://i.example/cfac7600-696c-4a88-8e69-39bade0040a7_Astra_Urtyp_27x0_33l.png", (330.0, "ml", 27)),
    ("https://i.example/a/Item%20200-ML.jpg?size=500g#9kg", (200.0, "ml", 1)), ("https://i.example/a/Item_200-ML.jpg?size=500g#9kg", (200.0, "ml", 1)), ("x_6X1,5L.png", (1500.0, "ml", 6)),
    ("Item_100g_75cl.v2.png", (750.0, "ml", 1)), ("250g/item.png", (None, None, None)), ("item_150gr.png", (None, None, None)), ("x150g.png", (None, None, None)), ("1348762003.png", (None, None, None)), (None, (None, None, None)), ("", (None, None, None)),
]
SAID = [
    ("250 g, auch als <b>250–g</b> (1 kg = 9,96)", (250.0, "g", 1)), ("250 g oder 500 g", (None, None, None)), ("6 x 0,33 l, 1 l = 1,11", (330.0, "ml", 6)), ("2x100g und 4x100g", (None, None, None)),
    ("4x100g, einzeln 100 g", (100.0, "g", 4)), ("lose (Grundpreis 250 g)", (None, None, None)), ("0,25 kg / 250 g", (250.0, "g", 1)), (None, (None, None, None)), ("", (None, None, None)),
]
TEXTS = [
    ("250–g", (250.0, "g", 1, "metric_single")), ("250 — g", (250.0, "g", 1, "metric_single")), ("150-g-Becher", (150.0, "g", 1, "metric_single")), ("0,75-L-Flasche", (750.0, "ml", 1, "metric_single")), ("5x180-g-Packung", (180.0, "g", 5, "metric_multipack")),
    ("12x95-ml-Packung", (95.0, "ml", 12, "metric_multipack")), ("30er-Packung", (None, "piece", 30, "count_pack")), ("35er–Rolle", (None, "piece", 35, "count_pack")), ("30 er Packung", (None, "piece", 30, "count_pack")), ("kg – Preis", (None, None, None, "variable_weight_kg_price")), ("Packung", (None, None, None, None)), ("250 -- g", (None, None, None, None)),
]
CONTEXTS = [
    ("Karate-Anzug 12,99", "12,99", "sale"), ("Apparate 9,99", "9,99", "sale"), ("Monatsangebot 9,99", "9,99", "sale"), ("pro Monat 9,99", "9,99", "installment"), ("Ratenzahlung", None, "installment"), ("zzgl. Liefer 4,99", "4,99", "shipping"), ("Versandkostenpauschale 4,99", "4,99", "shipping"),
    ("Transportversandtasche 4,99", "4,99", "sale"), ("1 kg = 3,99", "3,99", "unit"), ("100ml 0,99", "0,99", "unit"), ("11 kg 3,99", "3,99", "sale"), ("UVP 3,99", "3,99", "reference"), ("regulär 3,99", "3,99", "reference"), ("zzgl. 0,25 € Pfand", "0,25", "deposit"), ("1,99 zzgl. 0,25 Pfand", "1,99", "sale"),
    ("je 500 g 1,99", "500", "package"), ("je 500 g 1,99", "1,99", "sale"), ("6 x 1,5", "1,5", "package"), ("6 x 1,5 nur 3 €", "1,5", "sale"), ("Packung: 12", "12", "package"), ("12,00 EUR Packung 12", "12", "sale"), ("2,50", "2,5", "sale"), (None, "1", "sale"), ("", None, "sale"),
]


def one(spark, values, *columns):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {', '.join(f'c{k} string' for k in range(len(values[0]) if isinstance(values[0], tuple) else 1))}")
    return [r[1] for r in sorted(rows.select("i", *columns).collect())]


@pytest.mark.parametrize(("cases", "parse"), [(IMAGES, text.image_package), (SAID, text.described_package)])
def test_packages_of_images_and_descriptions(spark, cases, parse):
    got = one(spark, [c for c, _ in cases], parse(F.col("c0")))
    assert [tuple(r)[:3] for r in got] == [want for _, want in cases]


def test_dashes_in_packages(spark):
    assert [tuple(r) for r in one(spark, [c for c, _ in TEXTS], text.package(F.col("c0")))] == [want for _, want in TEXTS]


def test_price_contexts(spark):
    assert one(spark, [c[:2] for c in CONTEXTS], labels.price_context(F.col("c0"), F.col("c1"))) == [c[2] for c in CONTEXTS]
    assert one(spark, [("9,99", "nur 24 Monate Laufzeit"), ("9,99", None)], labels.price_context(F.col("c0"), F.col("c0"), F.col("c1"))) == ["installment", "sale"]


def test_references_are_followed(spark):
    pick = random.Random(1)
    docs = {d: [pick.choice([pick.randrange(0, 40), pick.randrange(0, 40), "x", None, {"a": 1}, True, 1.5, "3", -1]) for _ in range(pick.choice([1, 17, 40]))] for d in range(12)}
    docs[20] = list(range(1, 30)) + ["end"]
    docs[21] = [0]
    frame = spark.createDataFrame([(d, json.dumps(p)) for d, p in docs.items()] + [(90, None), (91, "{}"), (92, "no"), (93, "[]")], "d int, p string")
    got = {(r["doc"], r["node"]): (r["last"], r["steps"], r["outcome"]) for r in pointers.chased(pointers.payload_nodes(frame, "d", "p")).collect()}
    want = {}
    for d, p in docs.items():
        for i in range(len(p)):
            at, seen = i, []
            while type(p[at]) is int and 0 <= p[at] < len(p) and at not in seen:
                seen.append(at)
                at = p[at]
            cycle = at in seen
            want[(d, i)] = (None, None, "cycle") if cycle else (at, len(seen), "too_deep" if len(seen) > 10 else "resolved")
    assert got == want
    assert pointers.chased(spark.createDataFrame([], "doc int, node int, target int")).count() == 0


def test_names_that_hold_each_other(spark):
    cases = [("Bio Milch", "biomilch", "0.2", 1.0), ("Bio Milch", "Die Bio-Milch 3,5 %", "0.2", 1.0), ("Milch", "Mehl", "0.2", 0.2), ("", "Mehl", "0.2", 0.2), (None, None, "0.2", 0.2), ("%", "100 % Saft", "0.2", 0.2), ("Straße", "STRASSE 5", "0.5", 1.0)]
    got = one(spark, [c[:3] for c in cases], labels.contained(F.col("c0"), F.col("c1"), F.col("c2").cast("double")))
    assert got == [c[3] for c in cases]
    said = [("frische Bio Milch heute", "Bio Milch", True), ("Milch aus Bio Anbau", "Bio Milch", True), ("Bio Mehl", "Bio Milch Natur", False), ("Bio und Milch", "Bio Milch Natur", True), ("x", None, False), (None, "x", False)]
    assert one(spark, [c[:2] for c in said], labels.echoes(F.col("c0"), F.col("c1"))) == [c[2] for c in said]


def test_brands_and_labels(spark):
    brands = [("Dr. Oetker Pizza", "Dr. Oetker", "pizza"), ("Dr. Oetker", "Dr. Oetker", "dr oetker"), ("Oetkers Pizza", "Oetker", "oetkers pizza"), ("Pizza", None, "pizza"), ("Pizza", "!", "pizza"), (None, "Oetker", "")]
    assert one(spark, [c[:2] for c in brands], labels.without_brand(F.col("c0"), F.col("c1"))) == [c[2] for c in brands]
    loud = [("MILKA", True), ("MILka", False), ("MILKa", True), ("ÄÖÜß", True), ("12 %", False), ("", False)]
    assert one(spark, [c[0] for c in loud], labels.brandlike(F.col("c0"))) == [c[1] for c in loud]
    ends = [("Milka® ", "Milka"), ("Käse  und", "Käse"), ("Käse FÜR", "Käse"), ("Hund", "Hund"), ("und", "und"), ("Brot mit je", "Brot mit"), (None, "")]
    assert one(spark, [c[0] for c in ends], labels.clean_label(F.col("c0"))) == [c[1] for c in ends]


def test_composed_text_by_brute_force(spark, sf):
    """Every document against Python's own tables; forms that the data may lack by hand."""
    from pricelode.plans.registry import queries

    plain = lambda t: re.sub(r"[^\p{L}\p{N}%]+", " ", unicodedata.normalize("NFKC", t).casefold()).strip() if t is not None else ""
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["composed_md5"], r["composed_chars"]) for r in queries()["composed_text"](spark, sf).collect()}
    assert got == {d: (hashlib.md5(plain(t).encode()).hexdigest(), len(plain(t))) for d, t in texts.items()}
    forms = ["Müsli", "ﬁsch", "１００％", "STRAẞE", "①", None, ""]
    assert one(spark, forms, text.normalized(text.composed(F.col("c0")))) == ["müsli", "fisch", "100%", "strasse", "1", "", ""]
