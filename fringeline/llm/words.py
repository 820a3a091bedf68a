"""Words of whole texts as flat NumPy arrays.

A word is a maximal run of bytes other than space and the control bytes 9 to 13.  All functions take an
Arrow string array and work on its byte buffer, so the cost per word does not depend on Python objects.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
MIX_A = U64(0xFF51AFD7ED558CCD)
MIX_B = U64(0xC4CEB9FE1A85EC53)
#: Bytes of a word that is hashed and compared by itself, in linear time.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection of 64-bit words."""
    x = x ^ (x >> U64(33))
    x *= MIX_A
    x ^= x >> U64(33)
    x *= MIX_B
    x ^= x >> U64(33)
    return x


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, padded by eight
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # index of the first word of each text, and the number of words

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Row of the text that holds each word."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        length = self.end - self.start
        h = mix(length.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x51ED270B) % 2**64))
        long = np.flatnonzero(length > LONG)
        for i in long.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        view = self.view()
        left, at, rows = length, self.start, None
        if len(long):
            rows = np.flatnonzero(length <= LONG)
            left, at = left[rows], at[rows]
        while len(at):
            chunk = view[at]
            part = left < 8
            chunk[part] &= (U64(1) << (left[part].astype(U64) * U64(8))) - U64(1)
            more = left > 8
            if rows is None:
                h = mix(h * U64(3) ^ chunk)
                rows = np.flatnonzero(more)
            else:
                h[rows] = mix(h[rows] * U64(3) ^ chunk)
                rows = rows[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def view(self) -> np.ndarray:
        """The eight bytes from each byte on."""
        return np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data.data, strides=(1,))

    def unlike(self, other: np.ndarray) -> np.ndarray:
        """The words that are not equal to the word other[i], compared byte by byte."""
        length = self.end - self.start
        bad = [np.flatnonzero(length != length[other])]
        rows = np.flatnonzero((length == length[other]) & (other != np.arange(len(other))))
        for i in rows[length[rows] > LONG].tolist():
            if not np.array_equal(self.data[self.start[i] : self.end[i]], self.data[self.start[other[i]] : self.end[other[i]]]):
                bad.append(np.array([i]))
        rows = rows[length[rows] <= LONG]
        view, at, twin, left = self.view(), self.start[rows], self.start[other[rows]], length[rows]
        while len(rows):
            mask = np.where(left < 8, (U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1), ~U64(0))
            same = (view[at] ^ view[twin]) & mask == 0
            bad.append(rows[~same])
            more = same & (left > 8)
            rows, at, twin, left = rows[more], at[more] + 8, twin[more] + 8, left[more] - 8
        return np.sort(np.concatenate(bad))

    def classes(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its class, and a word of each class; a class holds equal words, all of them."""
        _, sample, place = np.unique(self.hashes(seed), return_index=True, return_inverse=True)
        bad = self.unlike(sample[place])  # other words of the same hash
        if len(bad):
            inner, more = Words(self.data, self.start[bad], self.end[bad], self.first).classes(seed + 1)
            place[bad] = len(sample) + inner
            sample = np.concatenate([sample, bad[more]])
        return place, sample


def plain_strings(texts: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return texts.cast(pa.large_string()).fill_null("")


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, padded by eight, and where each text starts and the last one ends."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(bounds[0]))
    return data, bounds - bounds[0]


def words_of(texts: pa.Array | pa.ChunkedArray, *, lower: bool = False) -> Words:
    """Words of every text; a null text has none.  lower: A to Z become a to z."""
    data, bounds = bytes_of(plain_strings(texts))
    size = len(data) - 8
    if lower:
        data[(data >= 65) & (data <= 90)] |= 32
    body = data[:size]
    inside = ~((body == 32) | ((body >= 9) & (body <= 13)))
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[cuts[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))
