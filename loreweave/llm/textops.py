"""Vectorised word kernels over Arrow string buffers (numpy only, no per-word Python).

A word is a maximal run of letters, digits and non-ASCII bytes, folded to lower case (ASCII and the
Latin-1 letters of UTF-8); everything else separates. Hashes are 64-bit polynomial hashes, mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .shared import large_text

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_SEGMENT = 1 << 20

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        m = max(n, _SEGMENT + 1)
        for name, base in (("p", _P), ("q", _PINV)):
            t = np.full(m, base, np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["p"], _tables["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words(NamedTuple):
    """Words of a run of documents: hash, first byte in its document, and document index of each; words before each document."""

    hashes: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]]


def words(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    """Split and hash every word. ``prefixes``: also the hash of each longer word's first k bytes, as (word index, hash)."""
    arr = large_text(texts)
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    base, end = int(off[0]), int(off[-1])
    if end == base:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64), {k: (none, np.zeros(0, np.uint64)) for k in prefixes})
    raw = np.frombuffer(arr.buffers()[2], np.uint8)[base:end]
    off = off - base
    low = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        after = raw[lead + 1]
        up = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        low[lead[up] + 1] += 0x20
    is_word = low != 0
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    heads = off[:-1]
    before[heads[heads < len(raw)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    tails = heads[heads > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    pre = {k: ([], []) for k in prefixes}
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right"))
        to = max(to, at + 1)
        s0, e0 = int(starts[at]), int(ends[to - 1])
        p, q = _powers(e0 - s0 + 1)
        total = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum(low[s0:e0].astype(np.uint64) * p[: e0 - s0], out=total[1:])
        s, e = starts[at:to] - s0, ends[at:to] - s0
        left, scale = total[s], q[s]
        hashes[at:to] = mix((total[e] - left) * scale)
        for k, (where, what) in pre.items():
            longer = np.flatnonzero(e - s > k)
            where.append(longer + at)
            what.append(mix((total[s[longer] + k] - left[longer]) * scale[longer] + np.uint64(k)))
        at = to
    doc = np.searchsorted(off, starts, side="right") - 1
    first = np.searchsorted(starts, off)
    joined = {k: (np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.uint64)) for k, (a, b) in pre.items()}
    return Words(hashes, starts - off[doc], doc, first, joined)


_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def simhash(features: np.ndarray, counts: np.ndarray, words64: int = 4) -> np.ndarray:
    """SimHash of each document, ``words64`` x 64 bits; ``features`` are its hashes in a row, ``counts`` how many each has.

    Eight one-byte counters share a machine word, so a byte of hashes costs one lookup and one add a feature.
    """
    n = len(counts)
    out = np.zeros((n, words64), np.uint64)
    has = np.flatnonzero(counts > 0)
    if not len(has):
        return out
    c = counts[has].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(c)[:-1]])
    per = (c + 254) // 255  # a counter holds 255
    seg_of = np.concatenate([[0], np.cumsum(per)[:-1]])
    within = np.arange(int(per.sum())) - np.repeat(seg_of, per)
    seg = np.repeat(begin, per) + within * 255
    half = c[:, None]
    for w in range(words64):
        h = mix(features ^ _SALTS[w])
        by = h.view(np.uint8).reshape(-1, 8)
        word = np.zeros(len(has), np.uint64)
        for b in range(8):
            lanes = np.add.reduceat(_LANES[by[:, b]], seg)
            sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), seg_of, axis=0)
            word |= np.packbits(2 * sums > half, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * b)
        out[has, w] = word
    return out


def shingles(w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word pairs of each document (its only word where it has one), and how many each has."""
    count = np.diff(w.first)
    if not len(w.hashes):
        return w.hashes, np.zeros(n_docs, np.int64)
    pair = w.hashes.copy()
    pair[:-1] = w.hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + (w.hashes[1:] ^ (w.hashes[1:] >> np.uint64(32)))
    keep = np.ones(len(pair), bool)
    many = count > 1
    keep[w.first[1:][many] - 1] = False
    single = w.first[:-1][count == 1]
    pair[single] = w.hashes[single]
    return pair[keep], np.where(many, count - 1, count)
