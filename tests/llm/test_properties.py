"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricelode.llm import idfiles, packing, suffix, warc
from pricelode.llm.rules import figures
from pricelode.llm.tokens import END_ID, ChunkEncoder, public_path

ENCODERS = [ChunkEncoder(public_path(n), keep=500) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
PLAIN = [Tokenizer.from_file(public_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
MIXED = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'aAsStzéÉß×÷12!?.-– ́ﬁ中"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, max_size=6))
def test_chunks_give_the_tokenizers_ids(texts):
    for encoder, own in zip(ENCODERS, PLAIN, strict=True):
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == [*own.encode(t, add_special_tokens=False).ids, END_ID]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=300), max_size=5), st.sampled_from([64, 128, 1024]), st.sampled_from([50.0, 95.0, 100.0]))
def test_segments_round_trip(docs, block, percentile):
    arrays = [(i if i % 2 else None, np.array(d, np.uint32)) for i, d in enumerate(docs)]
    data = idfiles.encode_segment(arrays, block, percentile)
    table, ids, size = idfiles.decode_segment(memoryview(data))
    assert size == len(data) and table["n"].tolist() == [len(d) for d in docs] and ids.tolist() == [x for d in docs for x in d]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_fits_and_loses_nothing(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    for w in set(number.tolist()):
        own = number == w
        assert lengths[own].sum() <= 64 and sorted(offset[own].tolist()) == [0, *np.cumsum(lengths[own][np.argsort(offset[own])])[:-1].tolist()]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700), st.integers(300, 900))
def test_records_come_back(payload, chunk, segment):
    assert warc.unchunked(warc.chunked(payload, chunk)) == payload
    parts = [block for record in warc.page_records(1, "http://x/ü", "ab", payload, segment) for _, block in warc.parse_records(record + b"\r\n\r\n")]
    assert warc.payload_of(b"".join(parts)) == payload


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.sampled_from([4, 9]))
def test_segments_cover_every_start_once(texts, length):
    """Segments tell every start of a whole string once, and equal strings have equal anchors."""
    data, bounds = b"".join(texts), np.cumsum([0, *map(len, texts)])
    text, first, last, anchor, place = suffix.segments(data, bounds, length, gram=4)
    assert ((first <= place + length) & (place >= last) & (place <= first + length - 4)).all()
    starts = [(int(t), int(s)) for t, a, b in zip(text, first, last, strict=True) for s in range(a, b + 1)]
    assert sorted(starts) == [(t, s) for t in range(len(texts)) for s in range(bounds[t], bounds[t + 1] - length + 1)]
    of: dict[bytes, set] = {}
    for h, a, b in zip(anchor.tolist(), first, last, strict=True):
        for s in range(a, b + 1):
            of.setdefault(data[s : s + length], set()).add(h)
    assert all(len(x) == 1 for x in of.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), MIXED), max_size=5))
def test_figures_add_up(texts):
    f = figures(texts)
    for i, t in enumerate(texts):
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        assert (f["n_words"][i], f["word_chars"][i]) == (len(w), sum(map(len, w)))
