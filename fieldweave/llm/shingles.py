"""Distinct word shingles of whole texts as 64-bit values, from the bytes of an Arrow column."""

from __future__ import annotations

import hashlib

import numpy as np

from fieldweave.llm.common import U64, mix64, runs_of, span_hash, utf8_view

#: The white space that divides words, and A-Z to lower case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_place = np.random.default_rng(77).integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def shingle_sets(texts, words: int = 5, step: int = 1 << 18):
    """Yield for each row the sorted distinct shingles; a row with fewer words has its whole sequence as one.

    Bytes are taken in runs of about `step`; a row longer than that is cut at white space and its words put together again.
    """
    data, off = utf8_view(texts)
    for i, j in runs_of(off, step):
        if j == i + 1 and off[j] - off[i] > step:
            yield _set(np.concatenate(list(_long_row(data[off[i] : off[j]], step))), words)
        else:
            part = data[off[i] : off[j]]
            start, value = _words(part, off[i : j + 1] - off[i])
            at = np.searchsorted(start, off[i : j + 1] - off[i])
            full = _shingles(value, words)
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield _set(value[a:b], words, full[a : max(a, b - words + 1)])


def word_digests(texts, step: int = 1 << 18):
    """Yield for each row 16 bytes that stand for its sequence of words: a BLAKE2 digest of the words in lower case, one space between them."""
    data, off = utf8_view(texts)
    for i, j in runs_of(off, step):
        part = LOWER[data[off[i] : off[j]]]
        solid = ~SPACE[part]
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        part[~solid] = 0x20
        part, ends = part[keep], np.r_[0, np.cumsum(keep)][off[i : j + 1] - off[i]]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield hashlib.blake2b(part[a:b].tobytes().strip(b" "), digest_size=16).digest()


def exact_counts(a: bytes, b: bytes, words: int = 5) -> tuple[int, int, int]:
    """Sizes of two texts' sets of distinct shingles and of what they share, told apart by the words themselves, not by hashes."""
    number: dict[bytes, int] = {}
    x, y = ([number.setdefault(w, len(number)) for w in t.lower().split()] for t in (a, b))  # both split as SPACE and LOWER say
    if min(len(x), len(y)) < words:
        sizes = [len(s) and 1 if len(s) < words else exact_counts(t, t, words)[0] for s, t in ((x, a), (y, b))]
        return (1, 1, 1) if x and x == y else (*sizes, 0)
    both = np.array(x + y, np.int64)
    rank = both
    for k in range(1, words):  # ranks of ever longer windows; equal ranks are equal words
        rank = np.unique(rank[:-1] * len(number) + both[k:], return_inverse=True)[1]
    p, q = np.unique(rank[: len(x) - words + 1]), np.unique(rank[len(x) :])
    return len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))


def _long_row(data, step):
    a = 0
    while a < len(data):
        b = a + step
        while b < len(data) and not SPACE[data[b]]:
            b += 1
        yield _words(data[a:b], np.array([0, len(data[a:b])]))[1]
        a = b


def _words(data, off):
    """Where each word starts, and its value; words end at white space and at the ends of rows."""
    solid = np.r_[False, ~SPACE[data], False]
    at = np.flatnonzero(solid[1:] != solid[:-1])
    inner = np.unique(off[1:-1])
    joint = inner[solid[inner] & solid[inner + 1]]  # one row's last word touches the next one's first
    if len(joint):
        at = np.sort(np.r_[at, joint, joint])
    start, end = at[::2], at[1::2]
    return start, span_hash(LOWER[data], start, end - start)


def _shingles(value, words):
    n = max(0, len(value) - words + 1)
    out = np.zeros(n, U64)
    for k in range(words):
        out += value[k : n + k] * _place[k]
    return mix64(out)


def _set(value, words, full=None):
    if len(value) >= words:
        s = np.sort(_shingles(value, words) if full is None else full)
        return s[np.r_[True, s[1:] != s[:-1]]]
    if not len(value):
        return np.zeros(0, U64)
    return mix64(np.cumsum(value * _place[8 : 8 + len(value)], dtype=U64)[-1:] + U64(len(value)))
