"""Words of a batch of texts as numbers: bytes laid end to end, words cut at ASCII white space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pricelode.llm.common import text_bytes
from pricelode.llm.tokens import SPACE


@dataclass
class Words:
    data: np.ndarray  #: all bytes, a blank after each text
    bounds: np.ndarray  #: text i is data[bounds[i] : bounds[i + 1]]
    starts: np.ndarray  #: of each word in ``data``
    ids: np.ndarray  #: number of each word in ``names``
    names: list[bytes]
    upto: np.ndarray  #: words before each text, and at the end of all

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask over bytes in each text."""
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[self.bounds])

    def per_words(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask over words in each text."""
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[self.upto])

    def per_words_sum(self, values: np.ndarray) -> np.ndarray:
        """Sum of values over words in each text."""
        text = np.repeat(np.arange(len(self.upto) - 1), np.diff(self.upto))
        return np.bincount(text, values, len(self.upto) - 1)


def words_of(texts: list[str | None]) -> Words:
    parts = [text_bytes(t) for t in texts]
    data = np.frombuffer(b"".join(x for p in parts for x in (p, b" ")), np.uint8)
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    inside = ~space
    offsets = np.append((np.cumsum(inside) - 1)[starts], inside.sum()).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    return Words(data, bounds, starts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), np.searchsorted(starts, bounds))
