"""Whole texts to token ids through a bounded cache of their space-separated units.

Byte-level BPE pre-splits text so that a single space always starts a new piece: a unit (a space and the following
token) can be encoded by itself when the token is not empty and neither starts nor ends with white space. A text with
any other unit is encoded whole, so the result is always that of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20  # characters looked at together, so that a very long text needs no list of all its units
GROUP = 4 << 20  # characters of short texts looked at together
CACHED = 1_500_000  # units held by a Python worker
BYTES = 64  # of a unit and its ids; longer ones count as several


class Recent:
    """The ids of the strings met last, as Arrow and numpy data: what is looked up again costs no Python a string.

    ``many`` encodes a list of strings. Beyond ``cached`` of them, or ``BYTES`` for each, the older half is forgotten.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], cached: int):
        self.many, self.cached = many, cached
        self.strings = pa.array([], pa.string())
        self.ids, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    def make(self, unknown: list[str]) -> list[bytes | None]:
        return self.many(unknown)

    def numbers(self, strings: pa.DictionaryArray) -> np.ndarray:
        """Where the strings are held until the next call."""
        while len(self.strings) > self.cached or self.strings.nbytes + self.ids.nbytes > self.cached * BYTES:
            half = -(-len(self.strings) // 2)
            self.ids = self.ids[np.maximum(self.sizes[:half], 0).sum():]
            self.strings, self.sizes = self.strings[half:], self.sizes[half:]
        at = pc.index_in(strings.dictionary, value_set=self.strings)
        new = at.is_null()
        at = at.fill_null(-1).to_numpy()
        if unknown := strings.dictionary.filter(new):
            at = np.where(at < 0, len(self.strings) + np.cumsum(new.to_numpy(zero_copy_only=False)) - 1, at)
            ids = self.make(unknown.to_numpy(zero_copy_only=False).tolist())
            self.strings = pa.concat_arrays([self.strings, unknown])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(i or b"" for i in ids), "<u4")])
            self.sizes = np.concatenate([self.sizes, [-1 if i is None else len(i) // 4 for i in ids]])
        return at[strings.indices.to_numpy()]

    def gather(self, number: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of the strings of these numbers, packed, and where those of each end."""
        held = np.maximum(self.sizes, 0)
        begin, stop = np.cumsum(held) - held, np.cumsum(sizes)
        return self.ids[np.repeat(begin[number] - (stop - sizes), sizes) + np.arange(stop[-1])].tobytes(), stop


class TextEncoder(Recent):
    """Texts to little-endian unsigned 32-bit ids.

    ``whole`` encodes one text, ``many`` a list of units that each start with a space. What is not a unit by itself has
    the size -1.
    """

    def __init__(self, whole: Callable[[str], bytes], many: Callable[[list[str]], list[bytes]], cached: int = CACHED,
                 together: int = GROUP):
        super().__init__(many, cached)
        self.whole, self.together = whole, together

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            if len(text) > SLICE:
                out += self._group(group)
                out.append(self._long(text))
                group, held = [], 0
                continue
            group.append(text)
            held += len(text)
            if held > self.together:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def make(self, unknown: list[str]) -> list[bytes | None]:
        fits = [u != "" and u == u.strip() for u in unknown]
        ids = iter(self.many([" " + u for u, fit in zip(unknown, fits) if fit]))
        return [next(ids) if fit else None for fit in fits]

    def _group(self, texts: list[str]) -> list[bytes]:
        """Short texts together: each different token is looked up once, ids are gathered by number."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        ends = split.offsets.to_numpy()
        number = self.numbers(split.flatten().dictionary_encode())
        sizes = self.sizes[number]
        sizes[ends[:-1]] = 0  # the first token of a text follows no space
        odd = np.add.reduceat(sizes < 0, ends[:-1])
        flat, stop = self.gather(number, np.maximum(sizes, 0))
        cut = [0, *(stop[ends[1:] - 1] * 4).tolist()]
        out = []
        for k, text in enumerate(texts):
            first = text[:text.find(" ")] if ends[k + 1] - ends[k] > 1 else text
            if odd[k] or (ends[k + 1] - ends[k] > 1 and (not first or first[-1].isspace())):
                out.append(self.whole(text))
            else:
                out.append((self.whole(first) if first else b"") + flat[cut[k]:cut[k + 1]])
        return out

    def _long(self, text: str) -> bytes:
        at = text.find(" ")
        if at <= 0 or text[at - 1].isspace():
            return self.whole(text)
        parts = [self.whole(text[:at])]
        while at < len(text):
            end = text.rfind(" ", at + 1, at + SLICE) if len(text) - at > SLICE else len(text)
            end = text.find(" ", at + SLICE) if end < 0 else end
            end = len(text) if end < 0 else end
            number = self.numbers(pa.array(text[at + 1:end].split(" "), pa.string()).dictionary_encode())
            sizes = self.sizes[number]
            if (sizes < 0).any():
                return self.whole(text)
            parts.append(self.gather(number, sizes)[0])
            at = end
        return b"".join(parts)


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """Packed ids as an Arrow list column."""
    offsets = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes of the column, at least one row each."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size // max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
