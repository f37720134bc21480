"""Words of UTF-8 texts as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of texts looked at together, about.
PIECE = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", INVERSE)):
            one = np.full(max(n, 2 * PIECE), x, np.uint64)
            one[0] = 1
            _powers[name] = np.cumprod(one)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets of the texts in them): runs of texts of about `size` bytes. Nulls count as empty."""
    texts = texts.cast(pa.binary()).fill_null(b"") if texts.null_count or texts.type != pa.binary() else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data], for tables of 256 bytes. Read-only."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[i]:stops[i]]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


class Splitter:
    """Words are runs of bytes that `inside` (256 flags) tells.

    With `lower`, A-Z count as lower case, and with `latin` also the letters À to Þ.
    """

    def __init__(self, inside: np.ndarray, lower: bool = True, latin: bool = False):
        self.inside, self.latin = inside.astype(bool), latin
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32 * lower

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of the texts data[offsets[i]:offsets[i + 1]] starts and stops in data. Offsets in any order."""
        word = looked_up(self.inside, data)
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        begins[edges] = word[edges]
        ends[:-1] &= ~word[1:]
        ends[edges - 1] = word[edges - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, and where each starts and stops."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, stops = self.spans(data, offsets)
        low = looked_up(self.lower, data)
        if self.latin:
            low = low.copy()
            upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:][upper] += 32
        return hashed(low, starts, stops), starts, stops


#: Words between ASCII white space; and runs of letters and digits, where bytes of other scripts count as letters.
BETWEEN_BLANKS = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LETTERS = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
