"""64-bit hashes of words and shingles, computed over whole Arrow columns with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; longer texts are cut where words end.
CHUNK = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240607


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of the words between separator bytes; A-Z count as a-z unless keep_case."""

    def __init__(self, separators: bytes = SPACES, keep_case: bool = False):
        is_sep = np.zeros(256, bool)
        is_sep[list(separators)] = True
        self.is_word = ~is_sep
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(_SEED))
        if not keep_case:
            values[65:91] = values[97:123]
        self.values = values
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            r = np.full(n + 1, _BASE | 1, np.uint64)
            r[0] = 1
            self.powers = np.cumprod(r, dtype=np.uint64)
            r[1:] = pow(_BASE | 1, -1, 1 << 64)
            self.inverse = np.cumprod(r, dtype=np.uint64)

    def span(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data, and where they start; no word goes across an index in cuts."""
        n = len(data)
        self._grow(max(n, CHUNK))
        word = self.is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last[:-1] &= ~word[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts

    def long_text(self, data: np.ndarray) -> np.ndarray:
        found, at, n = [], 0, len(data)
        while at < n:
            end = min(at + CHUNK, n)
            while end < n and self.is_word[data[end]]:
                stop = np.flatnonzero(~self.is_word[data[end : end + CHUNK]])
                end = end + int(stop[0]) if len(stop) else min(end + CHUNK, n)
            found.append(self.span(data[at:end], np.zeros(0, np.int64))[0])
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of each text's words, one array for each row; null is empty."""
        data, offsets = text_bytes(texts)
        at, n = 0, len(offsets) - 1
        while at < n:
            if offsets[at + 1] - offsets[at] > CHUNK:
                yield self.long_text(data[offsets[at] : offsets[at + 1]])
                at += 1
                continue
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            cuts = offsets[at : end + 1] - offsets[at]
            hashes, starts = self.span(data[offsets[at] : offsets[end]], cuts)
            places = np.searchsorted(starts, cuts)
            for i in range(end - at):
                yield hashes[places[i] : places[i + 1]]
            at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of strings, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


_ODD = [np.uint64(int(x) | 1) for x in mix(np.arange(11, 75, dtype=np.uint64))]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle, none give none."""
    if not len(words):
        return words
    width = min(k, len(words))
    total = words[: len(words) - width + 1] * _ODD[0]
    for i in range(1, width):
        total = total + words[i : len(words) - width + 1 + i] * _ODD[i]
    return np.unique(mix(total + np.uint64(width)))
