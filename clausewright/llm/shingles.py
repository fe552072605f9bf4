"""Hashed word shingles of whole texts, on UTF-8 bytes with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Marks all ASCII but letters and digits; other characters count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word that are mixed 8 at a time with those of other words; a longer one is hashed by itself.
_SHORT = 512
_PARTS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, cut at bytes that `between` marks) of texts that lie one after the other; and the first word of each text, with the total at the end.

    A word's bytes are taken 8 at a time, and each 8 are mixed into what came before, so no pattern in words makes hashes meet.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    first = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    size = np.flatnonzero(word & (~after | edge[1:])) + 1 - first
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[data]
    eights = np.lib.stride_tricks.sliding_window_view(low, 8)
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, done = np.flatnonzero(size <= _SHORT), 0
    while len(todo):
        left = size[todo] - done
        part = np.ascontiguousarray(eights[first[todo] + done]).view("<u8").ravel() & _PARTS[np.minimum(left, 8)]
        out[todo] = mix64((out[todo] ^ part) + np.uint64(1))
        todo, done = todo[left > 8], done + 8
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(first, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text, one text after the other, and where each text's begin (with the total at the end). A text of 1 to k-1 words has its whole sequence as its one shingle."""
    words, start = word_hashes(data, at)
    mult = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        full = full * mult + words[i : i + len(full)]
    full = mix64(full)
    sets, sizes = [], np.zeros(len(start), np.int64)
    for d in range(len(start) - 1):
        s, e = start[d], start[d + 1]
        if e - s >= k:
            own = np.sort(full[s : e - k + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif e > s:
            own = np.array([e - s], np.uint64)
            for i in range(s, e):
                own = mix64(own * mult + words[i : i + 1])
        else:
            continue
        sets.append(own)
        sizes[d + 1] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)
