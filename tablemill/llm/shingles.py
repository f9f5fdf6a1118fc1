"""Word shingles of whole texts as 64-bit hashes, vectorised over bytes.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased; both are single bytes in UTF-8. The set of a
text holds its distinct runs of ``WIDTH`` words; a text with fewer words has its whole sequence as the one element; a text
without words has the empty set.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
SLICE = 1 << 20  # bytes looked at together

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = _BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] += 32


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    room = max(SLICE + 4096, 1 << size.bit_length())
    if room not in _tables:
        _tables.clear()
        _tables[room] = _powers(int(_BASE), room), _powers(pow(int(_BASE), -1, 1 << 64), room)
    return _tables[room]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    return _hashed(data, _LOWER)[:2]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a text of any length, with its letters unchanged."""
    found, at = [], 0
    with np.errstate(over="ignore"):
        for part in text_slices(data):
            hashes, start, end = _hashed(part, _BYTES)
            found.append((hashes, start + at, end + at))
            at += len(part)
    return tuple(np.concatenate(column) for column in zip(*found))


def _hashed(data: bytes, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _table(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((fold[raw].astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start, end


def text_slices(data: bytes) -> list[bytes]:
    """Parts of about ``SLICE`` bytes, cut at white space."""
    out, at = [], 0
    while len(data) - at > SLICE:
        cut = max(data.rfind(c, at + 1, at + SLICE) for c in (b" ", b"\n", b"\t"))
        if cut < 0:
            cuts = [p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := data.find(c, at + SLICE)) >= 0]
            cut = min(cuts, default=len(data))
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def _runs(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    if n < WIDTH:
        value = np.uint64(n)
        for w in words:
            value = value * _STEP + w
        return mix(np.array([value], np.uint64))
    value = words[:n - WIDTH + 1]
    for k in range(1, WIDTH):
        value = value * _STEP + words[k:n - WIDTH + 1 + k]
    return mix(value)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted set of each text; short texts are hashed together."""
    with np.errstate(over="ignore"):
        out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate([*texts, None]):
            size = len(text or b"")
            if group and (i == len(texts) or held + size > SLICE):
                data = b" ".join([texts[g] or b"" for g in group])
                hashes, start = word_hashes(data)
                ends = np.cumsum([len(texts[g] or b"") + 1 for g in group])
                bounds = np.searchsorted(start, ends)
                for g, a, b in zip(group, [0, *bounds[:-1]], bounds):
                    out[g] = np.unique(_runs(hashes[a:b]))
                group, held = [], 0
            if i < len(texts):
                if size > SLICE:
                    words = np.concatenate([word_hashes(part)[0] for part in text_slices(text)])
                    out[i] = np.unique(_runs(words))
                else:
                    group.append(i)
                    held += size
        return out
