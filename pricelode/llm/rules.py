"""Quality rules by weak supervision.

Each rule looks at one figure of a text and votes keep, drop or abstains.  Expectation-maximisation over all documents
estimates how often each rule is right when it votes (and the share of good documents); the posterior probability
that a document is good, given its votes, replaces "must pass all".  The documents enter as counts of vote patterns, at
most 3 ** rules of them, so the estimate takes all documents at any size.

The model: a document is good with some probability; given that, each rule votes by itself, with its own
probabilities to drop and to keep, where it votes, for good and for bad documents (its accuracy on either).  ``START`` holds where
these begin, and weighs ``WEIGHT`` documents throughout (a rule that never votes keeps it); all else is estimated.

Base checks come first: a text of under 20 words, or with over 30 words in 100 in repeated eight-word windows, fails.

Null text: no words, fails the base checks.  Repeated rows count as often as they come; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import documents, slices, staged
from pricelode.llm.words import words_of

WINDOW = 8
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim", "n_signs")
#: Probabilities to drop and to keep, where a rule votes, for good and for bad documents, before any document is seen.
START = ((0.01, 0.99), (0.40, 0.60))
WEIGHT = 2.0
ROUNDS = 50
KEEP_AT = 0.5
#: (name, figure, per, keep below or at, drop above): votes keep, drop, or abstains between; least figure first.
RULES = (
    ("symbols", "n_symbols", "n_words", 0.10, 0.30),
    ("repeated words", "n_repeat_words", "n_words", 0.10, 0.25),
    ("repeated lines", "n_dup_lines", "n_lines", 0.20, 0.40),
    ("capitals", "n_upper", "n_letters", 0.20, 0.50),
    ("exclamations", "n_exclaim", "n_words", 0.05, 0.30),
    ("other than letters", "n_other", "word_chars", 0.20, 0.30),
    ("words without letters", "n_signs", "n_words", 0.10, 0.30),
    ("long words", "word_chars", "n_words", 10.0, 15.0),
)


def _byte_set(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


SYMBOL = _byte_set("#*$%&|<>")
UPPER = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LETTER[0xC0:] = True  # lead bytes of other characters
EXCLAIM = _byte_set("!")


def repeated_words(ids: np.ndarray, upto: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the words in ``window``-word windows that are found twice or more in their text."""
    covered = np.zeros(len(ids), bool)
    n = len(ids) - window + 1
    if n <= 0:
        return covered
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    mixed = text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        mixed = (mixed ^ ids[at + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    near = np.flatnonzero(mixed[order[:-1]] == mixed[order[1:]])
    a, b = a[near], b[near]
    same = text[a] == text[b]
    for k in range(window):
        same &= ids[a + k] == ids[b + k]
    hit = np.unique(np.concatenate([a[same], b[same]]))
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[hit] += 1
    np.subtract.at(edge, hit + window, 1)
    return np.cumsum(edge[:-1]) > 0


def figures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The figures of every text."""
    w = words_of(texts)
    b = w.data
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    lines, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t and "\n" in t:
            own = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            lines[i], again[i] = len(own), len(own) - len(set(own))
        else:
            lines[i] = bool(t and t.strip(" \t\n\r\x0b\x0c"))
    return {
        "n_words": np.diff(w.upto),
        "word_chars": w.per_text(inside & ((b & 0xC0) != 0x80)),
        "n_symbols": w.per_text(SYMBOL[b]),
        "n_dup_lines": again,
        "n_repeat_words": w.per_words(repeated_words(w.ids, w.upto)),
        "n_lines": lines,
        "n_upper": w.per_text(UPPER[b]),
        "n_letters": w.per_text(LETTER[b]),
        "n_exclaim": w.per_text(EXCLAIM[b]),
        "n_signs": w.per_words(np.fromiter((not any(LETTER[c] for c in x) for x in w.names), bool, len(w.names))[w.ids]) if len(w.ids) else np.zeros(len(texts), np.int64),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = figures(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k].astype(np.int64)) for k in FIGURES)], ["doc_id", *FIGURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in FIGURES))


def votes() -> list[Column]:
    """1 keep, 0 drop, 2 abstain, for each rule."""
    out = []
    for _, figure, per, low, high in RULES:
        value = F.col("word_chars") - F.col("n_letters") if figure == "n_other" else F.col(figure)
        ratio = F.when(F.col(per) > 0, value / F.col(per))
        out.append(F.when(ratio <= low, 1).when(ratio > high, 0).otherwise(2))
    return out


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern (rows of 0 drop, 1 keep, 2 abstain), the rules' vote probabilities
    (good or bad, rule, vote), the share of good documents."""
    table, prior = np.repeat(np.array(START)[:, None, :], patterns.shape[1], axis=1), 0.8
    onehot = (patterns[:, :, None] == np.arange(2)).astype(float)  # abstaining says nothing
    for _ in range(rounds):
        like = np.einsum("prv,crv->cp", onehot, np.log(table)) + np.log([prior, 1 - prior])[:, None]
        post = np.exp(like - like.max(axis=0))
        post /= post.sum(axis=0)
        seen = np.einsum("cp,prv->crv", post * counts, onehot) + WEIGHT * np.array(START)[:, None, :]
        table = seen / seen.sum(axis=2, keepdims=True)
        prior = float(np.clip((post[0] * counts).sum() / max(1.0, counts.sum()), 0.05, 0.95))
    return post[0], table, prior


def judged(docs: DataFrame) -> DataFrame:
    """Figures, votes, base_failed, posterior and verdict of every row."""
    spark = docs.sparkSession
    pattern = sum((v * 3**j for j, v in enumerate(votes())), F.lit(0))
    rows = staged(measured(docs).withColumn("pattern", pattern.cast("int")), "figures")
    seen = rows.groupBy("pattern").count().collect()  # 3 ** rules rows at most
    codes, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.float64)
    digits = codes[:, None] // 3 ** np.arange(len(RULES)) % 3 if seen else np.zeros((0, len(RULES)), np.int64)
    good = em(digits, counts)[0] if seen else counts
    table = spark.createDataFrame(list(zip(codes.tolist(), good.tolist(), strict=True)), "pattern int, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
