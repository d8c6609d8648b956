"""Word and shingle hashes for set similarity.

A word's bytes are absorbed eight at a time, each time through a bijective
mixer, so no family of words collides by structure as it does under a
polynomial hash; words of more than ``LONG`` bytes go through xxh3. Equal words
(A-Z folded) have equal hashes on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

LONG = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123, dtype=np.uint8)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_ROUND = common.keys(61, LONG // 8 + 1)


class SetWords:
    """Words (runs of bytes other than the six ASCII spaces) of a run of documents: ``hash`` of each, and word i of document d lies in first[d] <= i < first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        word = ~common.SPACE[data]
        begins, ends = word.copy(), word.copy()
        if n:
            inner = offsets[(offsets > 0) & (offsets < n)]
            apart = np.zeros(n, bool)
            apart[inner] = True  # a document begins here
            begins[1:] &= ~word[:-1] | apart[1:]
            ends[:-1] &= ~word[1:] | apart[1:]
        starts = np.flatnonzero(begins)
        self.first = np.searchsorted(starts, offsets)
        self.hash = word_hashes(data, starts, np.flatnonzero(ends) + 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of bytes with A-Z folded; other seeds give independent ones."""
    folded = np.zeros(len(data) + 8, np.uint8)
    folded[: len(data)] = _FOLD[data]
    eight = np.ndarray(len(data) + 1, "<u8", folded, 0, (1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        out = common.mix(length.astype(np.uint64) * _ROUND[-1] + np.uint64(1 + seed))
        live = np.flatnonzero(length <= LONG)
        at, left = starts[live], length[live]
        for key in _ROUND[:-1]:
            if not len(live):
                break
            block = eight[at] & _KEEP[np.minimum(left, 8)]
            out[live] = common.mix(common.mix(out[live] ^ block) + key)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > LONG):
            out[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : ends[i]].tobytes(), seed=61 + seed)
    return out


def doc_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 5-word shingle hashes of a run of documents, and where each document's begin."""
    return common.shingles(SetWords(data, offsets))


def distinct_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, ascending, and where each document's begin."""
    h, begin = doc_sets(data, offsets)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(begin)))
