"""Byte-level BPE with word ends, by tree concatenation.

A text is normalised and split into words as the vocabulary's file says.  No word spans white space, so the ids of a
stretch without any depend on that alone, and each new stretch of a batch is worked out once.  Words of up to LEAF symbols are merged as they are, all together: a round finds
the lowest rank in each and merges its pairs.  A longer stretch without a split is cut into leaves; halves are encoded
side by side, and a level of the tree joins all its halves at once: the tokens nearest to each join are encoded anew
as one window, which grows until its outermost tokens on both sides are those that stood there.

Why that is exact: a sequence of tokens is the encoding of its text if and only if every two neighbours are the encoding
of theirs, since the first merge across a border would also be the first in that pair alone.  Neighbours inside the
halves and inside the window are such pairs, and where the window's outermost token is the one that stood there, so are
that token and the one beside the window.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.llm.sentencepiece_codec import in_batches, without
from fringeline.llm.shared import place, safe

#: Symbols of a leaf, and tokens on each side of a join's first window.
LEAF, SIDE = 64, 2
#: Stretches that are remembered and their characters, and characters of a text (and tokens of a list) that are worked on together.
HELD, HELD_CHARS, SLICE = 500_000, 1 << 23, 1 << 20
#: Bytes of text in a batch.
BATCH = 4 << 20
NONE = np.iinfo(np.int32).max
BLANK = regex.compile(r"\p{White_Space}+")
#: What str.split() takes for white space, and the vocabulary does not.
SEPARATORS = regex.compile(r"[\x1C-\x1F]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Model:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe = spec["model"]
        end, vocab = bpe["end_of_word_suffix"], bpe["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + end] for s in symbols])
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in bpe["merges"]]
        a, b, whole = np.array(pairs, np.int64).reshape(-1, 3).T
        key = a << 32 | b
        order = np.argsort(key)
        self.key, self.rank, self.whole = np.append(key[order], np.iinfo(np.int64).max), np.append(order, NONE), np.append(whole[order], 0)
        # a token's own merges come after the one that makes it: then all pairs of the lowest rank can be merged at once
        made = np.full(max(self.names) + 1, -1)
        np.maximum.at(made, whole, np.arange(len(whole)))
        self.ordered = bool((np.maximum(made[a], made[b]) < np.arange(len(a))).all())
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(words)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    # -- merging

    def ranks(self, tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each token's pair with the next one of its run, and where the merge stands in the tables."""
        key = tokens[:-1] << 32 | tokens[1:]
        at = np.searchsorted(self.key, key)
        rank = np.where(self.key[at] == key, self.rank[at], NONE)
        rank[np.cumsum(size)[:-1] - 1] = NONE
        return np.append(rank, NONE), np.append(at, 0)

    def merged(self, tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each of the runs of `size` tokens (none is empty) until no pair of it has a rank; tokens and sizes."""
        tokens, size = tokens.astype(np.int64), np.asarray(size, np.int64)
        runs, ended = np.arange(len(size)), []
        while len(runs):
            rank, at = self.ranks(tokens, size)
            low = np.minimum.reduceat(rank, np.cumsum(size) - size)
            still = low < NONE
            run = np.repeat(np.arange(len(size)), size)
            over = ~still[run]
            ended.append((np.repeat(runs[~still], size[~still]), tokens[over]))
            hit = np.flatnonzero((rank == low[run]) & ~over)
            if len(hit):
                # of pairs that overlap every second one counts, from the left
                new = np.append(True, np.diff(hit) > 1)
                start = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
                if not self.ordered:
                    hit = hit[np.append(True, np.diff(run[hit]) > 0)]
                tokens[hit] = self.whole[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            tokens, size, runs = tokens[keep], np.bincount(run[keep], minlength=len(size))[still], runs[still]
        of, flat = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(of, kind="stable")
        return flat[order], np.bincount(of)

    def many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word (none is empty), long ones by their trees."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(length)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        leaves = -(-length // LEAF)
        size = np.full(leaves.sum(), LEAF)
        size[np.cumsum(leaves) - 1] = length - (leaves - 1) * LEAF
        flat, size = self.merged(symbols, size)
        ends, at = np.cumsum(size), np.cumsum(leaves)
        trees = {}
        for k in np.flatnonzero(leaves > 1).tolist():
            trees[k] = [flat[ends[i] - size[i] : ends[i]] for i in range(at[k] - leaves[k], at[k])]
        self.grow(trees)
        flat, first, last = flat.tolist(), (ends[at - leaves] - size[at - leaves]).tolist(), ends[at - leaves].tolist()
        return [tuple(trees[k][0].tolist()) if k in trees else tuple(flat[i:j]) for k, (i, j) in enumerate(zip(first, last, strict=True))]

    def grow(self, trees: dict[int, list[np.ndarray]]) -> None:
        """Joins the parts of each tree, two by two, until one is left; a level of all trees at once."""
        while any(len(x) > 1 for x in trees.values()):
            halves = [(k, i) for k, x in trees.items() for i in range(0, len(x) - 1, 2)]
            joined = self.joined([(trees[k][i], trees[k][i + 1]) for k, i in halves])
            odd = {k: x[-1:] if len(x) % 2 else [] for k, x in trees.items()}
            for k in trees:
                trees[k] = []
            for (k, _), x in zip(halves, joined, strict=True):
                trees[k].append(x)
            for k, x in odd.items():
                trees[k] += x

    def joined(self, halves: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The encoding of each two halves' text, from their encodings."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(halves)
        open_, side = list(range(len(halves))), SIDE
        while open_:
            windows = [np.concatenate([halves[i][0][-side:], halves[i][1][:side]]) for i in open_]
            symbols = [self.symbols(w) for w in windows]
            flat, size = self.merged(np.concatenate(symbols), np.fromiter(map(len, symbols), np.int64, len(symbols)))
            ends, left = np.cumsum(size).tolist(), []
            for i, window, end, n in zip(open_, windows, ends, size.tolist(), strict=True):
                new = flat[end - n : end]
                a, b = halves[i]
                if (len(a) <= side or new[0] == window[0]) and (len(b) <= side or new[-1] == window[-1]):
                    out[i] = np.concatenate([a[:-side], new, b[side:]])
                else:
                    left.append(i)
            open_, side = left, 2 * side
        return out

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        """The single symbols that tokens were merged from."""
        if not hasattr(self, "_parts"):
            whole = np.full(max(self.names) + 1, -1)
            whole[self.whole[:-1]] = np.arange(len(self.whole) - 1)
            self._parts = whole
        out, stack = [], tokens[::-1].tolist()
        while stack:
            t = stack.pop()
            at = self._parts[t]
            if at < 0:
                out.append(t)
            else:
                stack += (int(self.key[at] & 0xFFFFFFFF), int(self.key[at] >> 32))
        return np.array(out, np.int64)

    # -- texts

    def slices(self, text: str) -> Iterator[list[str] | int]:
        """Stretches without white space of the normalised text, a list for each slice, and ids of special tokens between them."""
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            # letters one by one: a final sigma is no other letter than the rest
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if SEPARATORS.search(part):
                part = BLANK.sub(" ", part)
                cut = lambda x: x.strip(" ").split(" ")
            else:
                cut = str.split
            at = 0
            while at < len(part):
                gap = BLANK.search(part, at + SLICE) if len(part) - at > SLICE else None
                end = gap.start() if gap else len(part)
                yield cut(part[at:end])
                at = end

    def learn(self, stretches: set[str]) -> None:
        """Works out the ids of stretches; after it at least these are known."""
        new = stretches.difference(self.known)
        self.chars += sum(map(len, new))
        if len(self.known) + len(new) > HELD or self.chars > HELD_CHARS:
            self.known.clear()
            new = stretches
            self.chars = sum(map(len, new))
        new = sorted(new)
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            split = [self.words.findall(x) for x in some]
            words = sorted(set(chain.from_iterable(split)))
            ids = dict(zip(words, self.many([w.encode() for w in words]) if words else (), strict=True))
            self.known.update(zip(some, (tuple(chain.from_iterable(map(ids.__getitem__, x))) for x in split), strict=True))

    def spelt(self, slices: list[list[str] | int]) -> array:
        """Ids of slices whose stretches are all known."""
        out = array("i")
        for s in slices:
            out.extend((s,) if isinstance(s, int) else chain.from_iterable(map(self.known.__getitem__, s)))
        return out

    def encoded(self, texts: list[str | None]) -> Iterator[array | None]:
        """Ids of each text; the new stretches of all texts of up to a slice are worked out together, longer texts slice by slice."""
        short = [list(self.slices(t)) if t is not None and len(t) <= SLICE else None for t in texts]
        self.learn(set().union(*(s for x in short if x for s in x if not isinstance(s, int))))
        for t, own in zip(texts, short, strict=True):
            if t is None:
                yield None
                continue
            if own is not None:
                yield self.spelt(own)
                continue
            out = array("i")
            for s in self.slices(t):
                if not isinstance(s, int):
                    self.learn(set(s))
                out.extend(self.spelt([s]))
            yield out

    def pieces(self, ids: array | list[int]) -> Iterator[str]:
        """The decoded text, a slice at a time: tokens joined by spaces; ids without a token are left out."""
        name, lead = self.names.get, ""
        for at in range(0, len(ids), SLICE):
            some = " ".join([t for t in map(name, ids[at : at + SLICE]) if t is not None])
            if some:
                yield lead + some
                lead = " "


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, *, model_file: str, text: str = "text", batch: int = BATCH) -> DataFrame:
    """docs with the column ids (array<int>): the text's tokens, special tokens where a text spells them.

    A null text has null ids, an empty one an empty list.  Whole texts of any length are encoded, each row by itself, so
    repeated rows and their order do not matter; an empty table gives an empty one; other columns pass through whatever
    their names, and one named ids is replaced.  The file must be at model_file on every executor.
    """
    docs = without(docs, "ids")
    own, at = safe(docs), place(docs, text)
    schema = T.StructType([*own.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        for table in in_batches(rows, at, batch):
            ids = [None if x is None else np.frombuffer(x, np.int32) for x in codec.encoded(table[at].to_pylist())]
            yield from table.append_column("ids", pa.array(ids, pa.list_(pa.int32()))).to_batches()

    return own.mapInArrow(work, schema).toDF(*docs.columns, "ids")


def decode(rows: DataFrame, *, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the column `out`: the tokens of the ids, joined by spaces, as the vocabulary has no decoder.

    Null ids give null, empty lists an empty text, ids without a token nothing.  Repeated rows give repeated results, an
    empty table an empty one; other columns pass through whatever their names, and one named `out` is replaced.
    """
    rows = without(rows, out)
    own, at = safe(rows), place(rows, ids)
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        for b in batches:
            texts = [None if x is None else "".join(codec.pieces(x)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return own.mapInArrow(work, schema).toDF(*rows.columns, out)


def digests(docs: DataFrame, *, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 of every row.

    Null and empty texts have no tokens and the digests of empty texts; a null doc_id stays null; repeated rows give
    repeated results, an empty table an empty one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        decimal = {i: str(i) for i in codec.names}
        for table in in_batches(batches, "text", BATCH):
            n, spelt, decoded = [], [], []
            for ids in codec.encoded([t or "" for t in table["text"].to_pylist()]):
                own, said = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), SLICE):
                    own.update(((" " if at else "") + " ".join(map(decimal.__getitem__, ids[at : at + SLICE]))).encode())
                for piece in codec.pieces(ids):
                    said.update(piece.encode())
                n.append(len(ids))
                spelt.append(own.hexdigest())
                decoded.append(said.hexdigest())
            yield from pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": spelt, "decoded_sha256": decoded}).to_batches()

    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
