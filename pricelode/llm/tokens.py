"""Token ids of whole texts, with repeated words encoded once.

Both public BPE files first split a text into words by a pattern no match of which ends inside a run of letters, or
joins letters to what is written after them.  So the ids of a text are the ids of its chunks put in a row, if it is
cut only in front of white space, after letters, and between letters and a digit or sign (not an apostrophe) in front
of them.  A batch is cut so, distinct chunks are found by Arrow's dictionary encoding, and only chunks not seen before
go through the tokenizer.  Only ASCII's and the Latin letters of two bytes count as letters here, other characters
stay with their neighbours.  A text with white space outside ASCII, or with the string of an added token (which the file
turns into that token's id), goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

END_ID = 2
#: White space outside ASCII.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Lead bytes of U+00C0 to U+017F, which are letters but for the signs of multiplication and division.
LATIN_LEAD = np.zeros(256, bool)
LATIN_LEAD[[0xC3, 0xC4, 0xC5]] = True
SIGN = np.zeros(256, bool)
SIGN[33:128] = True
SIGN &= ~LETTER
APOSTROPHE = 39


def chunk_starts(b: np.ndarray, alone: bool) -> np.ndarray:
    """Where chunks begin (a mask without the first byte's); ``alone``: white space is a chunk of its own."""
    space, letter = SPACE[b], LETTER[b]
    lead = LATIN_LEAD[b[:-1]] & ~((b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)))
    letter[:-1] |= lead
    letter[1:] |= lead
    sign = SIGN[b]
    first = space[1:] & ~space[:-1]
    first |= letter[:-1] & sign[1:]
    first |= sign[:-1] & (b[:-1] != APOSTROPHE) & letter[1:]
    if alone:
        first |= space[:-1] & ~space[1:]
    return first


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encode texts with a tokenizers file; ``keep`` bounds the chunks held in memory.

    A file that lower-cases and drops white space gets smaller tables: its chunks are lower-cased here already (A-Z)
    and white space is a chunk of its own.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.lower = not self.tokenizer.encode(" \n", add_special_tokens=False).ids and self.tokenizer.encode("A").ids == self.tokenizer.encode("a").ids
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """The place of each distinct chunk in the tables."""
        seen = self.seen
        place = np.fromiter((seen.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(seen) + len(new) > self.keep and seen:
                self._clear()
                return self._learn(chunks)
            words = [chunks[i] for i in new]
            got = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(lens.sum()))
            place[new] = np.arange(len(self.len), len(self.len) + len(new))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.flat = np.concatenate([self.flat, flat])
            seen.update(zip(words, place[new].tolist(), strict=True))
        return place

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of every text, each followed by ``END_ID``; null is as empty."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and (any(x in t for x in self.added) or not t.isascii() and WIDE_SPACE.search(t)):
                out[i] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END_ID], np.uint32)
            else:
                plain.append(i)
        parts = [texts[i].encode("utf-8") if texts[i] else b"" for i in plain]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        data = b"".join(parts)
        if self.lower:
            data = data.lower()
        ends = np.cumsum(sizes)
        counts, ids = np.zeros(len(parts), np.int64), np.zeros(0, np.uint32)
        if data:
            b = np.frombuffer(data, np.uint8)
            first = np.ones(len(b), bool)
            first[1:] = chunk_starts(b, self.lower)
            begins = ends - sizes
            first[begins[sizes > 0]] = True
            cuts = np.flatnonzero(first)
            offsets = np.append(cuts, len(b)).astype(np.int32)
            chunks = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            place = self._learn(chunks.dictionary.to_pylist())[chunks.indices.to_numpy(zero_copy_only=False)]
            lens = self.len[place]
            upto = np.concatenate([[0], np.cumsum(lens)])
            ids = self.flat[np.repeat(self.at[place] - upto[:-1], lens) + np.arange(upto[-1])]
            counts = upto[np.searchsorted(cuts, ends)] - upto[np.searchsorted(cuts, begins)]
        full = np.full(len(ids) + len(parts), END_ID, np.uint32)
        full[np.arange(len(ids)) + np.repeat(np.arange(len(parts)), counts)] = ids
        stops = np.cumsum(counts + 1)
        for i, e, n in zip(plain, stops.tolist(), counts.tolist(), strict=True):
            out[i] = full[e - n - 1 : e]
        return out  # type: ignore[return-value]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker: tasks that follow find the chunks already seen."""
    return ChunkEncoder(path)
