"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is lower-cased, everything but letters becomes a word boundary, and every substring of 2, 3 or 4 bytes inside a
word (boundaries included at its ends) is hashed to a bucket.  The text's vector is the mean of its buckets'
embeddings, a linear layer and softmax give the languages.  Both layers are trained in numpy by stochastic gradient
descent with a falling rate, on a bounded sample of labelled rows: ``PER_LANG`` documents of each language, those with the
least hash of their id and text (repeated rows are one), and short pieces cut from them so that short texts are known too.  What a task sends for a training
document is its bucket counts, not its text, and one task trains on them.

Applied to whole texts the two layers are one table (bucket -> score per language), summed over all substrings.

Calibration: a temperature and the rejection level are fitted on a fifth of the sample that training never sees; a
text is rejected if it has no letter, or if its calibrated probability is below the level under which ``LOSE`` of the
rightly predicted calibration texts fall, at most ``HIGHEST``.

Rows whose crc32(doc_id as text) mod 5 is 0, or whose doc_id or lang is null, are never learned from.  Null or
letterless texts get ``und`` with score 0.  Without any labelled row that has a letter every text gets ``und``.  Repeated rows and other
columns do no harm; lang, source and doc_id are never part of a prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import documents, slices, staged, text_key

BUCKETS = 1 << 15
DIM = 16
PER_LANG = 1200
SHORT = (12, 40, 120)
EPOCHS = 6
LOSE = 0.001
HIGHEST = 0.5
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
FOLDS = 5


def _table() -> np.ndarray:
    """Lower-cased bytes, with 32 for what cannot be part of a word."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


TABLE = _table()


def buckets(b: np.ndarray, positions: int) -> np.ndarray:
    """(3, positions) buckets of the 2-, 3- and 4-byte substrings at each place of normalised bytes, which go on for
    three bytes more; -1 where there is none."""
    w = [b[i : i + positions].astype(np.uint32) for i in range(4)]
    gap = [x == 32 for x in w]
    two = w[0] | w[1] << np.uint32(8)
    three = two | w[2] << np.uint32(16)
    four = three | w[3] << np.uint32(24)
    mask = [~(gap[0] & gap[1]), ~gap[1] & ~(gap[0] & gap[2]), ~gap[1] & ~gap[2]]
    out = np.empty((3, positions), np.int32)
    for k, (code, use) in enumerate(zip((two, three, four), mask, strict=True)):
        h = (code + np.uint32(k * 0x51ED270B)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out[k] = np.where(use, (h >> np.uint32(17)).astype(np.int32), -1)
    return out


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, each between boundaries, and where each begins (and the last ends)."""
    parts = [b" " + (t.lower().encode("utf-8", "surrogatepass") if t else b"") + b"   " for t in texts]
    return TABLE[np.frombuffer(b"".join(parts), np.uint8)], np.cumsum([0, *map(len, parts)])


def text_scores(texts: list[str | None], table: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``table`` over each text's substrings, and their number."""
    b, bounds = normalised(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    padded = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    for a in range(0, len(b) - 3, step):
        m = min(step, len(b) - 3 - a)
        found = buckets(b[a : a + m + 3], m)
        doc = np.searchsorted(bounds, [a, a + m - 1], side="right") - 1
        inner = bounds[doc[0] + 1 : doc[1] + 1] - a
        cuts = np.concatenate([[0], inner])
        sums = padded[found[0]]
        sums += padded[found[1]]
        sums += padded[found[2]]
        which = np.arange(doc[0], doc[1] + 1)
        total[which] += np.add.reduceat(sums, cuts, axis=0, dtype=np.float64)
        count[which] += np.add.reduceat((found >= 0).sum(axis=0), cuts)
    return total, count


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each comes."""
    b, _ = normalised([text])
    found = buckets(b, len(b) - 3)
    return np.unique(found[found >= 0], return_counts=True)


class Model:
    """Languages, the bucket table (both layers in one), bias, temperature and rejection level."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, level: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.level = langs, table, bias, temperature, level

    def probabilities(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether it is rejected."""
        lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts])
        if not self.langs or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = self.probabilities(*text_scores(texts, self.table))
        best, score = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)], score, ~lettered | (score < self.level)


def train(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], dim: int = DIM, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on rows of (language, for calibration, buckets, counts)."""
    rows = [r for r in rows if len(r[2])]  # others have nothing to learn from
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    number = {x: i for i, x in enumerate(langs)}
    fit = [r for r in rows if not r[1]] or rows
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    size, done, steps = 32, 0, epochs * -(-len(fit) // 32)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for a in range(0, len(order), size):
            batch = [fit[i] for i in order[a : a + size]]
            lens = [len(r[2]) for r in batch]
            at, row = np.concatenate([r[2] for r in batch]), np.repeat(np.arange(len(batch)), lens)
            weight = np.concatenate([r[3] / r[3].sum() for r in batch]).astype(np.float32)
            used, place = np.unique(at, return_inverse=True)
            x = np.zeros((len(batch), len(used)), np.float32)
            x[row, place] = weight
            own = embed[used]
            mean = x @ own
            z = mean @ layer + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = z / z.sum(axis=1, keepdims=True)
            grad[np.arange(len(batch)), [number[r[0]] for r in batch]] -= 1
            rate = 1.0 * (1 - done / steps) + 0.02
            done += 1
            back = grad @ layer.T
            layer -= rate / len(batch) * (mean.T @ grad)
            bias -= rate / len(batch) * grad.sum(axis=0)
            embed[used] = own - rate * 20 / len(batch) * (x.T @ back)
    model = Model(langs, (embed @ layer).astype(np.float32), bias.astype(np.float64))
    held = [r for r in rows if r[1]] or fit
    total = np.stack([(model.table[r[2]] * r[3][:, None]).sum(axis=0, dtype=np.float64) for r in held])
    count, truth = np.array([r[3].sum() for r in held]), np.array([number[r[0]] for r in held])
    loss = {}
    for t in np.geomspace(0.05, 5, 40):
        model.temperature = float(t)
        p = model.probabilities(total, count)
        loss[float(t)] = -np.log(np.maximum(p[np.arange(len(held)), truth], 1e-12)).mean()
    model.temperature = min(loss, key=loss.get)
    p = model.probabilities(total, count)
    right = p.argmax(axis=1) == truth
    model.level = float(min(HIGHEST, np.quantile(p.max(axis=1)[right], LOSE))) if right.any() else 0.0
    return model


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most ``per_lang`` documents of each language, the least by hash, as bucket counts of the whole text and of a
    few short pieces: lang, held, at, times."""
    k1, k2 = text_key(F.col("text"))
    learned = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null").filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    # the least hashes of each language: a threshold that about 3 * per_lang distinct rows are under keeps the ranked rows few
    hashed = F.xxhash64(k1, k2, "doc_id")
    share = F.least(F.lit(1.0), F.lit(3.0 * per_lang) / F.approx_count_distinct("h", 0.02))
    per = staged(learned.select("lang", hashed.alias("h")).groupBy("lang").agg(share.alias("share")), "lang-shares")
    picked = learned.withColumn("h", hashed).join(per, "lang")
    picked = picked.filter(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranks = picked.select("lang", "h", "doc_id").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_lang)
    ranks = staged(ranks.select(F.col("lang").alias("of"), F.col("h").alias("own"), F.col("doc_id").alias("id")), "lang-ranks")
    picked = picked.join(ranks, (F.col("lang") == F.col("of")) & (F.col("h") == F.col("own")) & (F.col("doc_id") == F.col("id")), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, str]] = set()  # at most ``per_lang`` of each language
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for lang, h, doc, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "doc", "text")), strict=True):
                if (lang, h, doc) in seen:
                    continue  # a repeated row
                seen.add((lang, h, doc))
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                pieces = [text]
                for size in SHORT:
                    if len(text) > 2 * size:
                        a = int(rng.integers(0, len(text) - size))
                        pieces.append(text[a : a + size])
                for number, piece in enumerate(pieces):
                    at, times = text_counts(piece)
                    out.append((lang, h, doc, number, h % 5 == 0, at.astype("<u2").tobytes(), np.minimum(times, 65535).astype("<u2").tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "h", "doc", "piece", "held", "at", "times"])

    rows = picked.select("lang", "h", F.col("doc_id").cast("string").alias("doc"), "text")
    rows = rows.mapInArrow(count, "lang string, h long, doc string, piece int, held boolean, at binary, times binary")
    return rows.dropDuplicates(["lang", "h", "doc", "piece"]).select("lang", "held", "at", "times")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Train in one task on the bounded sample; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "held", "at", "times")), strict=True))
        model = train([(lang, held, np.frombuffer(at, "<u2"), np.frombuffer(times, "<u2")) for lang, held, at, times in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = training_rows(docs, per_lang).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else train([])


def predictions(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with language, score and whether it is rejected, under ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "__text"):
            lang, score, rejected = own.predict(batch.column("__text").to_pylist())
            columns = [batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double, {names[2]} boolean")


def known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the model, fitted on their own labelled rows, rejects."""
    kept = predictions(docs, fit(docs), docs.columns, ("__lang", "__score", "__rejected"))
    return kept.filter("not __rejected").select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return predictions(docs, fit(docs), ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
