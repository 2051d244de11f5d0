"""Vectorised word splitting and hashing over many texts at once.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z are
lower-cased first where asked for.  All these bytes are ASCII, so working on
UTF-8 bytes gives the words that working on code points would.  Hashes are 64
bits wide; two different words of a corpus share one with a chance of about
``n * n / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[0x41:0x5B] += 0x20
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(0, 2**64, 256, dtype=U) | U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_PLACE = _random.integers(0, 2**64, 64, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or n > len(_powers[base]):
        out = np.full(max(n, 1 << 16) * 5 // 4, base, U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``s`` with ``s[j] - s[i]`` the polynomial over bytes ``i..j-1``."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, independent of where it stands."""
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start] + (end - start).astype(U))


def run_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each place that has so many after it."""
    if len(data) < k:
        return np.zeros(0, U)
    s = prefix_hash(data, _BYTE)
    return mix((s[k:] - s[:-k]) * _power(_INVERSE, len(data) + 1 - k))


def slices(texts: list[bytes | None], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together (one text at least)."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a newline after each text, and where each text starts
    (one more entry for the end)."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return data, starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of each word of ``data``, which ends in white space."""
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and where each text's words begin (one
    more entry for the end)."""
    data, starts = join_texts(texts)
    start, end = word_bounds(data)
    first = np.searchsorted(start, starts)
    return span_hash(prefix_hash(data, _BYTE_LOWER if lower else _BYTE), start, end), first


def window_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each that has so many after it."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = word[:n] * _PLACE[0]
    for i in range(1, k):
        out += word[i : n + i] * _PLACE[i]
    return mix(out)


def shingles(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` lower-cased words of each text, in order of
    text and hash, and where each text's begin (one more entry for the end).
    A text of fewer words gives its whole sequence as one, a text without
    words none."""
    out, sizes = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for a, b in slices(texts):
        word, first = word_hashes(texts[a:b])
        window = window_hashes(word, k)
        count = np.diff(first)
        many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
        ends = np.cumsum(many)
        token = np.empty(int(many.sum()), U)
        for f, c, e, m in zip(first.tolist(), count.tolist(), ends.tolist(), many.tolist(), strict=False):
            if c >= k:
                token[e - m : e] = window[f : f + m]
                token[e - m : e].sort()
            elif c:
                token[e - 1] = mix((word[f : f + c] * _PLACE[8 : 8 + c]).sum(keepdims=True) + U(c))[0]
        fresh = np.ones(len(token), bool)
        fresh[1:] = token[1:] != token[:-1]
        fresh[(ends - many)[many > 0]] = True
        held = np.zeros(len(token) + 1, np.int64)
        np.cumsum(fresh, out=held[1:])
        out.append(token[fresh])
        sizes.append(held[ends] - held[ends - many])
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))
