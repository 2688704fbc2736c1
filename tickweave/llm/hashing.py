"""Vectorised hashing of words and shingles over a whole batch of texts (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_PLACE = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25], dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    values = values ^ (values >> np.uint64(33))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(29))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of a buffer; equal bytes have equal hashes wherever they stand."""
    n = ends - starts
    out = mix(n.astype(np.uint64) + _BASE)
    if not len(n):
        return out
    # Eight bytes at a time: the k-th block of every span long enough for it.
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.arange(len(n))
    block = 0
    while len(alive):
        at = starts[alive] + 8 * block
        left = np.minimum(n[alive] - 8 * block, 8)
        chunk = np.ascontiguousarray(words[at]).view("<u8").ravel()
        keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        out[alive] = mix(out[alive] * _PLACE[0] + (chunk & keep) + np.uint64(block + 1))
        block += 1
        alive = alive[n[alive] > 8 * block]
    return out


def word_spans(texts: Sequence[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, word starts, word ends and the index of each word's text. Words are runs of bytes outside `space`."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return data, starts, ends, owner


def shingle_sets(texts: Sequence[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text, ascending: (values as uint64, bounds) with bounds[i]:bounds[i + 1] for text i.

    A text of fewer words gives its whole sequence as one shingle, one without words none.
    """
    data, starts, ends, owner = word_spans(texts)
    words = span_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(words)) - first[owner] if len(words) else np.zeros(0, dtype=np.int64)
    whole = np.minimum(count, size)
    begin = place <= (count - whole)[owner] if len(words) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(begin)
    value = mix(whole[owner[at]].astype(np.uint64) + _BASE)
    for k in range(size):
        inside = whole[owner[at]] > k
        value[inside] = mix(value[inside] * _PLACE[2] + words[at[inside] + k] * _PLACE[3 + k % 5] + np.uint64(k))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(texts)))]).astype(np.int64)
    sets = [np.unique(value[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
    return (np.concatenate(sets) if sets else value), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
