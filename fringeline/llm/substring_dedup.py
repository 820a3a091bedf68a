"""Removal of word windows that an earlier document also holds, by recompression.

Rounds rename runs of equal symbols, then pairs of neighbours that a hash puts on the left and on the right
side.  A name is a hash of what it stands for, so names are global without a shared table, and whether a pair
is joined depends on the pair alone.  Hence inside any window all symbols, but for a few at either edge, are
named alike wherever that window occurs, and which ones those are depends on the window alone.  A window can repeat
only if all of those inner symbols occur in several documents; of such windows (few) the sequence of these symbols
and of the words beside them decides, as a 128-bit hash, with the smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringeline.llm import exchange as X
from fringeline.llm.words import U64, Words, mix, words_of

#: Rounds of the parse: r names runs, p names pairs.
ROUNDS = "rpppprppp"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
LAST = np.iinfo(np.int64).max


class Parse:
    """Symbols after all rounds: name, doc and first word of each, and for each word boundary the symbols that are certain."""

    def __init__(self, w: Words, rounds: str):
        doc = w.doc()
        name = w.hashes()
        n = len(name)
        word = np.arange(n)
        self.low = np.arange(n + 1)  # first certain symbol of a window that starts at this word
        self.high = np.arange(n + 1)  # symbol after the last certain one of a window that ends before this word
        for k, kind in enumerate(rounds):
            n = len(name)
            if not n:
                break
            if kind == "r":
                starts = X.group_starts(name, doc)
                inside = np.cumsum(starts) - 1
                at = np.flatnonzero(starts)
                run = np.diff(at, append=n)
                long = run > 1
                name, doc, word = name[at], doc[at], word[at]
                name[long] = mix(name[long] * U64(5) ^ mix(run[long].astype(U64)))
                low, high = inside + 1, inside
            else:
                right = (mix(name ^ U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U64(1)).astype(bool)
                joined = np.zeros(n, bool)  # with the symbol before
                joined[1:] = right[1:] & ~right[:-1] & (doc[1:] == doc[:-1])
                starts = ~joined
                inside = np.cumsum(starts) - 1
                at = np.flatnonzero(starts)
                pair = np.zeros(n, bool)
                pair[:-1] = joined[1:]
                left = np.flatnonzero(pair)
                name[left] = mix(name[left] * U64(3) ^ mix(name[left + 1] + U64(k + 1)))
                name, doc, word = name[at], doc[at], word[at]
                low = inside + right
                high = inside + right
            # a boundary at the end of all symbols stays there
            low, high = np.append(low, len(name)), np.append(0, high)
            self.low, self.high = low[self.low], high[self.high]
        self.name, self.doc, self.word = name, doc, np.append(word, len(w))


def distinct_names(parse: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, whether several rows hold them, and the place of each symbol's name."""
    order = np.argsort(parse.name, kind="stable")
    name, doc = parse.name[order], parse.doc[order]
    new = X.group_starts(name)
    group = np.cumsum(new) - 1
    several = np.zeros(int(new.sum()), bool)
    if len(name) > 1:
        several[group[1:][~new[1:] & (doc[1:] != doc[:-1])]] = True
    place = np.empty(len(name), np.int64)
    place[order] = group
    return name[new], several, place


class Windows:
    """Windows whose certain symbols all occur in several documents: place, owner, and distinct keys with the smallest owner."""

    def __init__(self, w: Words, parse: Parse, shared: np.ndarray, ids: np.ndarray, size: int):
        n = len(w)
        alone = np.concatenate([[0], np.cumsum(~shared)])
        i = np.arange(max(n - size + 1, 0))
        doc = w.doc()
        i = i[doc[i] == doc[i + size - 1]]
        low, high = parse.low[i], parse.high[i + size]
        some = alone[np.maximum(high, low)] == alone[low]
        i, low, high = i[some], low[some], high[some]
        self.at, owner = i, ids[doc[i]]
        k = [keys_of(w, parse, i, low, high, size, seed) for seed in (1, 2)]
        order = np.lexsort((owner, k[1], k[0]))
        k = [x[order] for x in k]
        new = X.group_starts(*k)
        self.keys, self.more, self.least = k[0][new], k[1][new], owner[order][new]
        self.place = np.empty(len(i), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.owner = owner


class Ranges:
    """Hashes of ranges of a sequence, whatever their place."""

    def __init__(self, values: np.ndarray, seed: int):
        m = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[seed - 1]
        n = len(values) + 1
        up, self.down = np.full(n, m, U64), np.full(n, pow(m, -1, 2**64), U64)
        up[0] = self.down[0] = 1
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(values * np.cumprod(up)[:-1])])
        self.down = np.cumprod(self.down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64))


def keys_of(w: Words, parse: Parse, at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hash of each window: the words before its certain symbols, these symbols, and the words after them."""
    if not len(at):
        return np.zeros(0, U64)
    words, names = Ranges(w.hashes(seed), seed), Ranges(mix(parse.name + U64(seed)), seed)
    end = at + size
    has = high > low
    first, last = np.where(has, parse.word[low], end), np.where(has, parse.word[np.maximum(high, low)], end)
    high = np.where(has, high, low)
    return mix(mix(words.of(at, first) * U64(3) ^ names.of(low, high)) * U64(5) ^ words.of(last, end))


def dedup_windows(docs: DataFrame, *, window: int = 50, rounds: str = ROUNDS, bucket_bytes: int = X.BUCKET_BYTES) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document of smaller doc_id.

    Windows are judged on the input.  Returns a row for each input row: doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space) and kept_text.  Null and empty texts have no words; texts shorter than
    a window keep all.  Rows of the same doc_id do not remove each other's words; a null doc_id counts as larger
    than any.  Texts of any length are taken whole, each in one bucket's task.  Extra columns are ignored.  An empty table gives an empty one.
    """
    buckets = X.bucket_count(docs, bucket_bytes)
    texts = X.in_buckets(docs, buckets)

    def names(key: tuple, table: pa.Table) -> pa.Table:
        own, several, _ = distinct_names(Parse(words_of(table["text"]), rounds))
        return X.pack(key[0].as_py(), own, [several], buckets)

    def is_shared(cols: list[np.ndarray]) -> np.ndarray:
        _, place, count = np.unique(cols[0], return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        several[place[cols[1]]] = True
        return ((count > 1) | several)[place]

    def judged(table: pa.Table, replies: pa.Table) -> tuple[Words, np.ndarray, Windows]:
        w = words_of(table["text"])
        ids = table["doc_id"].fill_null(LAST).to_numpy()
        parse = Parse(w, rounds)
        own, _, place = distinct_names(parse)
        shared = X.replies_of(replies, 0, own, buckets, bool)[place]
        return w, ids, Windows(w, parse, shared, ids, window)

    def candidates(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, c = judged(table, replies)
        return X.pack(key[0].as_py(), c.keys, [c.more, c.least], buckets)

    def has_smaller(cols: list[np.ndarray]) -> np.ndarray:
        keys, more, least = cols
        order = np.lexsort((least, more, keys))
        new = X.group_starts(keys[order], more[order])
        out = np.empty(len(keys), bool)
        out[order] = least[order][np.flatnonzero(new)][np.cumsum(new) - 1] < least[order] if len(keys) else False
        return out

    def cleaned(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        w, _, c = judged(table, replies)
        gone = X.replies_of(replies, 1, c.keys, buckets, bool)[c.place] | (c.owner > c.least[c.place])
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, c.at[gone], 1)
        np.add.at(edge, c.at[gone] + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        total = np.concatenate([[0], np.cumsum(~keep)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        sha, kept = [], []
        for k, text in enumerate(table["text"]):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            own = raw.split()
            if removed[k]:
                own = [x for x, stays in zip(own, keep[w.first[k] : w.first[k + 1]].tolist(), strict=True) if stays]
            joined = b" ".join(own)
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined)
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    asked = texts.groupBy("t").applyInArrow(names, X.ASK)
    shared = X.answers(asked, 0, [U64, bool], is_shared)
    tried = texts.groupBy("t").cogroup(shared.groupBy("t")).applyInArrow(candidates, X.ASK)
    smaller = X.answers(tried, 1, [U64, U64, np.int64], has_smaller)
    return texts.groupBy("t").cogroup(shared.unionByName(smaller).groupBy("t")).applyInArrow(cleaned, OUT)
