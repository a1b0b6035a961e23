"""The pipeline's stages take effect one after the other, and hold against brute force."""

from collections import Counter

import corpus_pipeline
from test_llm_operators import DOCS, TEXTS, table
from test_nearcopies import brute_classes, brute_set

from pricelode.llm import mixing


def test_pipeline(spark):
    from pricelode.llm.common import staged

    docs = staged(spark.createDataFrame(table(), DOCS), "raw")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, ""), name)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        if name == "language":
            assert not {70, 71, 72, 73} & {r[0] for r in out.select("doc_id").collect()}
            left = [(d, t) for d, t in TEXTS if d not in (70, 71, 72, 73)]
        if name == "near_duplicates":
            ids = {r[0] for r in out.select("doc_id").collect()}
            label, best = brute_classes([brute_set(t) for _, t in left]), {}
            for (d, _), c in zip(left, label, strict=True):
                best[c] = d if best.get(c) is None else (best[c] if d is None else min(d, best[c]))
            assert ids == set(best.values()) and out.count() == len(best)
        if name == "repeats":
            before = [(r[0], (r[1] or "").encode()) for r in docs.select("doc_id", "text").collect()]
            seen = Counter(b[i : i + 240] for _, b in before for i in range(len(b) - 239))
            want = {}
            for d, b in before:
                gone = {k for i in range(len(b) - 239) if seen[b[i : i + 240]] > 1 for k in range(i, i + 240)}
                want[d] = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
            assert {r[0]: r[1] for r in out.select("doc_id", "text").collect()} == {d: t for d, t in want.items() if t}
        if name == "mixing":
            weights = {r["doc_id"]: r["kept"] for r in mixing.weights(docs).collect()}
            assert {r[0] for r in out.select("doc_id").collect()} == {d for d, k in weights.items() if k}
        if name == "packing":
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
        docs = out
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
