"""Sets of word shingles as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

from .text import LOWER, UPPER, WORD

_FIND = re.compile(WORD).findall
_LOW = str.maketrans(UPPER, LOWER)
#: Words whose hash a worker remembers.
_CACHE = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _CACHE and len(word) < 40:
            self[word] = h
        return h


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles of k words, given the words' hashes; all words as one shingle where there are fewer."""
    n = len(words)
    if not n:
        return words
    span = min(n, k)
    h = np.full(n - span + 1, 0x243F6A8885A308D3 + span, dtype=np.uint64)
    for i in range(span):
        h = (h ^ words[i : n - span + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def shingle_sets(batches: Iterator[pd.DataFrame], k: int, rows: int = 512) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, sets) for ``rows`` documents at a time; a null text has an empty set."""
    hashes = _Hashes()
    for b in batches:
        ids = b["doc_id"].to_numpy()
        texts = b["text"]
        for i in range(0, len(b), rows):
            sets = []
            for x in texts.iloc[i : i + rows]:
                ws = _FIND(x.translate(_LOW)) if x else []
                sets.append(shingle_set(np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws)), k))
            yield ids[i : i + rows], sets
