"""Quality classifier by co-training of two views.

Content: a linear model over the hashed words of the text (shares of words in buckets; long runs count alike).
Metadata: a linear model over what the other columns say: language and source (hashed levels, and the pair of them) and
the size ``n_chars`` (its logarithm and its power of two); it never sees the text.

Both are logistic regressions trained in numpy by stochastic gradient descent.  They start from the labelled rows;
in each of ``ROUNDS`` rounds each view scores all documents without a label and gives the ``ADDED`` that it is most sure of,
in the labels' proportion, to the other view, which is trained again.  A view teaches only if it is better than the share of good labels
on a fold of the labels that training never sees: its log-loss there must be lower by two standard errors.  Rounds end when no view may
teach, or when a round does not lower the log-loss of both views together on that fold; then the model before it stays.  A task keeps
its own most certain ones only, with their features, so a round sends a bounded number of rows to the next step whatever the input.  Each view's score
is then calibrated by a logistic curve on that fold; so is the sum of the two
calibrated log-odds.

Fitting takes ``LABELLED`` labelled documents at most, those with the least hash of text and metadata, as features; it runs
in one task, and only the weights come to the driver.  Scoring takes every document, whole.

A label row of null counts as none; of several labels of a document the larger share wins, a tie is good.  Rows with equal
text and metadata are one for fitting (good, if any of them is).  Null text is as empty; null lang, source and n_chars are
levels of their own, a missing n_chars column is as null.  Without both classes among the labels every score is the share of
good labels (0.5 without any); without both classes in the fold nothing is exchanged.  Other columns do no harm.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch, documents, slices, text_key
from pricelode.llm.words import words_of

WORD_BUCKETS = 1 << 16
LEVELS = 64
SIZES = 32
LABELLED = 4000
ADDED = 200
ROUNDS = 3
EPOCHS = 8


def content(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text's words and their shares."""
    w = words_of(texts)
    bucket = np.fromiter((xxhash.xxh32_intdigest(x) % WORD_BUCKETS for x in w.names), np.int64, len(w.names))
    out = []
    for a, b in zip(w.upto, w.upto[1:], strict=False):
        at, n = np.unique(bucket[w.ids[a:b]], return_counts=True)
        out.append((at.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
    return out


def content_scores(texts: list[str | None], weight: np.ndarray) -> np.ndarray:
    """Sum of each text's word weights by their shares, as from ``content`` but without listing the buckets."""
    w = words_of(texts)
    bucket = np.fromiter((xxhash.xxh32_intdigest(x) % WORD_BUCKETS for x in w.names), np.int64, len(w.names))
    return w.per_words_sum(weight[bucket][w.ids] if len(w.ids) else np.zeros(0)) / np.maximum(1, np.diff(w.upto))


def metadata(langs: list[str | None], sources: list[str | None], sizes: list[int | None]) -> np.ndarray:
    """Rows of: hashed levels of language, source and both, the size's power of two and logarithm, and one."""
    out = np.zeros((len(langs), 3 * LEVELS + SIZES + 2), np.float32)
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        for k, level in enumerate((repr(lang), repr(source), repr((lang, source)))):
            out[i, k * LEVELS + xxhash.xxh32_intdigest(level) % LEVELS] = 1
        out[i, 3 * LEVELS + (SIZES - 1 if size is None else min(SIZES - 2, max(0, int(size)).bit_length()))] = 1
        out[i, -2] = np.log1p(max(0, size or 0)) / 10
    out[:, -1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_content(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the word buckets, the last one the bias."""
    w, rng = np.zeros(WORD_BUCKETS + 1), np.random.default_rng(seed)
    total, step = epochs * len(rows), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 16):
            batch = order[a : a + 16]
            at = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = np.bincount(doc, w[at] * x, len(batch)) + w[-1]
            rate = 60.0 * (1 - step / total) + 1
            step += len(batch)
            g = (_sigmoid(z) - y[batch]) / len(batch)
            np.subtract.at(w, at, rate * g[doc] * x)
            w[-1] -= 0.02 * rate * g.sum()
    return w


def fit_metadata(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 4 * EPOCHS) -> np.ndarray:
    w, rng = np.zeros(x.shape[1]), np.random.default_rng(seed)
    total, step = epochs * len(x), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 16):
            batch = order[a : a + 16]
            g = (_sigmoid(x[batch] @ w) - y[batch]) / len(batch)
            w -= (2.0 * (1 - step / total) + 0.05) * (x[batch].T @ g)
            step += len(batch)
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve from scores to labels, by Newton's steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hessian, [(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def held_losses(z: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Log-loss of each held label, by the curve that is fitted to the other half of them."""
    out = np.zeros(len(z))
    for k in (0, 1):
        a, b = calibrate(z[half != k], y[half != k])
        p = _sigmoid(a * z[half == k] + b)
        out[half == k] = -np.log(np.where(y[half == k] > 0, p, 1 - p))
    return out


def better(losses: np.ndarray, base: np.ndarray) -> bool:
    """Whether losses are lower than those of the base rate by two standard errors of the mean difference."""
    gain = base - losses
    return len(gain) > 1 and bool(gain.mean() > 2 * gain.std(ddof=1) / np.sqrt(len(gain)))


class Model:
    """Weights and calibration of both views, and of their sum; the mean log-loss of both together on the held fold, and whether
    each view (content, metadata) may teach the other."""

    def __init__(self, share: float, content_w: np.ndarray | None = None, metadata_w: np.ndarray | None = None, curves: list[tuple[float, float]] | None = None, loss: float = np.inf, may_teach: tuple[bool, bool] = (False, False)):
        self.share, self.content_w, self.metadata_w, self.curves = share, content_w, metadata_w, curves or []
        self.loss, self.may_teach = loss, may_teach

    def views(self, texts: list[str | None], meta: tuple[list, list, list]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good by content and by metadata, calibrated."""
        c = self.curves[0][0] * (content_scores(texts, self.content_w[:-1]) + self.content_w[-1]) + self.curves[0][1]
        return c, self.curves[1][0] * (metadata(*meta) @ self.metadata_w) + self.curves[1][1]

    def scores(self, texts: list[str | None], meta: tuple[list, list, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good: by content, by metadata, and combined."""
        if self.content_w is None:
            same = np.full(len(texts), self.share)
            return same, same, same
        c, m = self.views(texts, meta)
        return _sigmoid(c), _sigmoid(m), _sigmoid(self.curves[2][0] * (c + m) + self.curves[2][1])


ROW = "h long, label int, teaches int, at binary, x binary, meta binary"
#: Of ``teaches``: a label for both views, or a pseudo-label for the content or for the metadata view.
BOTH, CONTENT, METADATA = -1, 0, 1


def fit(rows: list[tuple[int, int, int, bytes, bytes, bytes]]) -> Model:
    """Both views and their calibration from rows as in ``ROW``; a quarter of the labels (by h) is for calibration."""
    labels = {r[0]: r for r in sorted(rows, key=lambda r: r[:2]) if r[2] == BOTH}  # of one h the good label
    y = np.array([r[1] for r in labels.values()], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    held = [r for r in labels.values() if r[0] % 4 == 0]
    train = [r for r in labels.values() if r[0] % 4 != 0]
    apart = len({r[1] for r in train}) == 2 and len({r[1] for r in held}) == 2
    if not apart:
        train = held = list(labels.values())
    words = lambda of: [(np.frombuffer(r[3], np.int32), np.frombuffer(r[4], np.float32)) for r in of]
    meta = lambda of: np.stack([np.frombuffer(r[5], np.float32) for r in of])
    sets = [[*train, *(r for r in sorted(rows) if r[2] == k)] for k in (CONTENT, METADATA)]
    target = [np.array([float(r[1]) for r in s]) for s in sets]
    w = [fit_content(words(sets[0]), target[0], 1), fit_metadata(meta(sets[1]), target[1], 2)]
    z = [np.array([w[0][at] @ x + w[0][-1] for at, x in words(held)]), meta(held) @ w[1]]
    truth = np.array([float(r[1]) for r in held])
    curves = [calibrate(v, truth) for v in z]
    both = sum(a * v + b for (a, b), v in zip(curves, z, strict=True))
    curves.append(calibrate(both, truth))
    half = np.array([r[0] >> 2 & 1 for r in held])
    base = held_losses(np.zeros(len(held)), truth, half)
    may_teach = tuple(apart and better(held_losses(v, truth, half), base) for v in z)
    return Model(float(y.mean()), w[0], w[1], curves, float(held_losses(both, truth, half).mean()), may_teach)


def _described(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    k1, k2 = text_key(F.col("text"))
    rows = docs.select("doc_id", "text", "lang", "source", size.alias("size"))
    return rows.withColumn("h", F.xxhash64(k1, k2, "lang", "source", "size"))


def _meta(batch: pa.RecordBatch) -> tuple[list, list, list]:
    return tuple(batch.column(c).to_pylist() for c in ("lang", "source", "size"))


def _features(texts: list[str | None], meta: tuple[list, list, list]) -> list[tuple[bytes, bytes, bytes]]:
    return [(at.tobytes(), x.tobytes(), m.tobytes()) for (at, x), m in zip(content(texts), metadata(*meta), strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["h", "label", "teaches", "at", "x", "meta", "sure"][: len(columns)])


def labelled(docs: DataFrame, votes: DataFrame, most: int = LABELLED) -> DataFrame:
    """Features of at most ``most`` different labelled documents, of one h once for each label."""
    rows = _described(docs).join(votes, "doc_id")
    least = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # at most ``most`` texts
        for batch in slices(batches, "text"):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("h", "label")), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if new:
                part = batch.take(pa.array(new))
                yield _batch([(*keys[i], BOTH, *f) for i, f in zip(new, _features(part.column("text").to_pylist(), _meta(part)), strict=True)])

    rows = rows.filter(F.col("h") <= F.lit(least)).select("h", "label", "text", "lang", "source", "size")
    return rows.mapInArrow(features, ROW).dropDuplicates(["h", "label"])


def most_certain(pool: DataFrame, model: Model, taken: set[int], scratch: Scratch, added: int = ADDED) -> DataFrame:
    """The documents of ``pool`` of which a view that may teach is most sure, as rows that teach the other view; without those of
    ``taken``.  At most ``added`` for each view, bad and good in the labels' proportion."""
    sent = pool.sparkSession.sparkContext.broadcast((model, taken))  # weights, and at most 2 * added hashes a round
    bad = min(added - 1, max(1, round(added * (1 - model.share))))
    quota = {(k, label): added - bad if label else bad for k in (CONTENT, METADATA) if model.may_teach[1 - k] for label in (0, 1)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gone = sent.value
        best: dict[tuple[int, int], dict[int, tuple]] = {q: {} for q in quota}
        for batch in slices(batches, "text"):
            h, texts, meta = batch.column("h").to_pylist(), batch.column("text").to_pylist(), _meta(batch)
            views = own.views(texts, meta)
            wanted: dict[int, list[tuple[tuple[int, int], float]]] = {}
            for (k, label), n in quota.items():
                sure = views[1 - k] if label else -views[1 - k]  # the other view teaches k
                held = best[k, label]
                edge = min(v[-1] for v in held.values()) if len(held) >= n else -np.inf
                for i in np.argsort(-sure, kind="stable")[: 4 * n].tolist():
                    if sure[i] > edge and h[i] not in gone and h[i] not in held:
                        wanted.setdefault(i, []).append(((k, label), float(sure[i])))
            if not wanted:
                continue
            at = list(wanted)
            part = [[column[i] for i in at] for column in meta]
            for i, f in zip(at, _features([texts[i] for i in at], part), strict=True):
                for (k, label), sure in wanted[i]:
                    best[k, label][h[i]] = (h[i], label, k, *f, sure)
            for q, n in quota.items():
                best[q] = {r[0]: r for r in sorted(best[q].values(), key=lambda r: (-r[-1], r[0]))[:n]}
        yield _batch([r for rows in best.values() for r in rows.values()])

    rows = pool.select("h", "text", "lang", "source", "size").mapInArrow(keep, f"{ROW}, sure double")
    rows = scratch.staged(rows, "certain")  # at most 2 * added rows of each task
    each = [rows.filter((F.col("teaches") == k) & (F.col("label") == label)).dropDuplicates(["h"]).orderBy(F.col("sure").desc(), "h").limit(n) for (k, label), n in quota.items()]
    return functools.reduce(DataFrame.unionByName, each).drop("sure")


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = LABELLED, added: int = ADDED) -> Model:
    """The model from documents and their labels."""
    votes = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("h", "label", "teaches", "at", "x", "meta")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    with Scratch(docs.sparkSession) as scratch:
        votes = scratch.staged(votes, "votes")
        rows = [scratch.staged(labelled(docs, votes, most), "labelled")]
        pool = _described(docs).join(votes, "doc_id", "left_anti")
        taken: set[int] = set()
        best = fit([])
        for i in range(rounds + 1):
            teaching = functools.reduce(DataFrame.unionByName, rows)  # bounded: labels, and 2 * added rows a round
            found = teaching.repartition(1).mapInArrow(run, "model binary").first()
            model = pickle.loads(found[0]) if found else fit([])
            if i > 0 and not model.loss < best.loss:
                return best
            best = model
            if i == rounds or not any(best.may_teach):
                return best
            chosen = scratch.staged(most_certain(pool, best, taken, scratch, added), "pseudo-labels")
            taken |= {r[0] for r in chosen.select("h").collect()}
            rows.append(chosen)
    return best


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with the combined score, each view's, and the verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            c, m, both = sent.value.scores(batch.column("text").to_pylist(), _meta(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(both), pa.array(c), pa.array(m), pa.array(both >= 0.5)], ["doc_id", "score", "content_score", "metadata_score", "quality"])

    rows = _described(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "size")
    return rows.mapInArrow(run, "doc_id long, score double, content_score double, metadata_score double, quality boolean")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
