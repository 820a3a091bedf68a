"""SentencePiece encoding and decoding with a public BPE vocabulary, by suffix-array matching.

Equal words are encoded alike (see marked.py).  The words of a batch that are not known yet form a lattice (see
lattice.py).  Relaxing it follows the merge rule of the vocabulary: in every word the neighbouring segments whose
union is the best-ranked edge, the leftmost of them, become one, until no edge spans two segments.  Characters
that are no piece become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.llm.lattice import CELLS, SPACE, Lattice, Runs, Vocabulary, joined, ranges, vocabulary
from fringeline.llm.marked import LONG, Known, marked_words, segments
from fringeline.llm.shared import named, place, safe
from fringeline.llm.words import bytes_of, plain_strings

#: Bytes of a batch of texts.
BATCH = 2 << 20
NONE = np.iinfo(np.int64).max


def merged(words: Runs, vocab: Vocabulary, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and the ids of all words."""
    owner, parts = segments(words, vocab, cells)
    short, long = np.flatnonzero(parts.length <= LONG), np.flatnonzero(parts.length > LONG)
    size, ids = np.zeros(len(parts), np.int64), []
    for first, cell in parts.some(short).in_cells(cells):
        own, values = relaxed(Lattice(cell, vocab), vocab)
        size[short[first : first + len(cell)]] = own
        ids.append(values)
    for i in long.tolist():
        ids.append(heap_merged(parts.one(i), vocab))
        size[i] = len(ids[-1])
    ids = np.concatenate([np.zeros(0, np.int32), *ids])
    if len(long):  # back into the order of the parts
        order = np.concatenate([short, long])
        first = np.empty(len(parts), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        ids = ids[ranges(first, size)]
    return np.bincount(owner, size, len(words)).astype(np.int64), ids


def relaxed(lattice: Lattice, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and the ids of all words."""
    longest = vocab.longest
    flat = lattice.piece.reshape(-1)
    n = len(lattice.code)
    inside = np.ones(n, bool)
    inside[lattice.start + lattice.length] = False
    begin = np.flatnonzero(inside)  # of each segment
    word = np.repeat(np.arange(len(lattice.length)), lattice.length)
    length = np.ones(len(begin), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        both = length[:-1] + length[1:]
        edge = flat[begin[:-1] * longest + np.minimum(both, longest) - 1]
        can = (word[:-1] == word[1:]) & (both <= longest) & (edge >= 0)
        rank = np.full(len(begin), NONE)
        rank[:-1][can] = vocab.rank[edge[can]]
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, start)
        size = np.diff(start, append=len(begin))
        open_ = np.repeat(best < NONE, size)
        ends.append((word[~open_], begin[~open_], length[~open_]))
        hit = np.flatnonzero((rank == np.repeat(best, size)) & open_)
        hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])] if len(hit) else hit  # the leftmost of a word
        length[hit] += length[hit + 1]
        keep = open_
        keep[hit + 1] = False
        begin, word, length = begin[keep], word[keep], length[keep]
    word, begin, length = (np.concatenate(c) for c in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 3
    final = np.zeros(n, np.int64)  # in the order of their places
    final[begin] = length
    owner = np.repeat(np.arange(len(lattice.length)), lattice.length + 1)
    begin = np.flatnonzero(final)
    word, length = owner[begin], final[begin]
    count, ids = with_bytes(flat[begin * longest + length - 1], lattice.code[begin], vocab)
    return np.bincount(word, count, len(lattice.length)).astype(np.int64), ids


def with_bytes(ids: np.ndarray, code: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids in which a character that is no piece (-1) becomes the pieces of its UTF-8 bytes, and how many stand for each."""
    none = np.flatnonzero(ids < 0)
    c = code[none]
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    count = np.ones(len(ids), np.int64)
    count[none] = n
    first = np.cumsum(count) - count
    out = np.repeat(ids.astype(np.int32), count)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        has = n > k
        part = c[has] >> (6 * (n[has] - 1 - k))
        out[first[none[has]] + k] = vocab.byte[(part & 63) | 0x80 if k else part | lead[n[has]]]
    return count, out


def heap_merged(word: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The same for one long stretch that pieces span throughout, with a heap of merges, in n log n steps.

    A step of the heap is one number: rank, place and size.  Memory follows the stretch, a few hundred bytes a character.
    """
    n, longest = len(word), vocab.longest
    table = Lattice(joined([word]), vocab).piece
    length, after, before = array("i", [1]) * n, array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    rank = vocab.rank.tolist()
    heap: list[int] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (size := length[i] + length[j]) <= longest and (p := int(table[i, size - 1])) >= 0:
            heapq.heappush(heap, (rank[p] << 64) | (i << 16) | size)

    for i in range(n):
        offer(i)
    while heap:
        step = heapq.heappop(heap)
        i, size = (step >> 16) & ((1 << 48) - 1), step & 0xFFFF
        j = after[i]
        if not length[i] or j >= n or length[i] + length[j] != size:
            continue
        length[i], length[j], after[i] = size, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    size = np.array(length)
    at = np.flatnonzero(size)
    return with_bytes(table[at, size[at] - 1], word[at], vocab)[1]


class Codec:
    """Encodes batches of texts; words of earlier batches are known."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known = Known(lambda words: merged(words, vocab))

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text and the ids of all texts; null texts have none."""
        w = marked_words(texts)
        if not len(w):
            return np.zeros(len(w.first), np.int64), np.zeros(0, np.int32)
        place, first, size = self.known.classes(w)
        count = size[place]
        total = np.concatenate([[0], np.cumsum(count)])
        return total[w.first], self.known.values[ranges(first[place], count)]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and the ids of all texts."""
    return Codec(vocab).encode(pa.array(texts, pa.string()))


def decode_bytes(first: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and the UTF-8 bytes of lists of ids, without the mark in front of each."""
    data, start, size = _byte_pieces(vocab)
    size, at = size[ids], start[ids]
    head = first[:-1][np.diff(first) > 0]
    at[head] += 1  # the mark is one byte here
    size[head] -= 1
    total = np.concatenate([[0], np.cumsum(size)])
    return total[first], data[ranges(at, size)]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """Text of these ids, without the mark in front."""
    return decode_bytes(np.array([0, len(ids)]), np.asarray(ids, np.int64), vocab)[1].tobytes().decode("utf-8", "replace")


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _byte_pieces(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, and where each one starts and how long it is."""
    if id(vocab) not in _tables:
        table = [p.replace(SPACE, " ").encode() for p in vocab.pieces]
        for b, i in enumerate(vocab.byte.tolist()):
            table[i] = bytes([b])
        size = np.fromiter(map(len, table), np.int64, len(table))
        _tables[id(vocab)] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size
    return _tables[id(vocab)]


def in_batches(rows: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Batches cut or joined to hold about so many bytes of that column, at least one row."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in rows:
        lengths = np.diff(np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)) if batch.num_rows else np.zeros(0, np.int64)
        done = 0
        while done < batch.num_rows:
            ends = np.cumsum(lengths[done:])
            take = max(int(np.searchsorted(ends, size - total, "right")), 0 if held else 1)
            if take:
                held.append(batch.slice(done, take))
                total += int(ends[take - 1])
                done += take
            if done < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(docs: DataFrame, *, model_file: str, text: str = "text", batch: int = BATCH) -> DataFrame:
    """docs with the column ids (array<int>): the text's pieces.

    A null text has null ids, an empty text an empty list.  Every row is encoded whole and by itself, so repeated
    rows and their order do not matter; an empty table gives an empty one; other columns pass through whatever their
    names, and one named ids is replaced.  The model file must be at model_file on every executor.
    """
    docs = without(docs, "ids")
    own, at = safe(docs), place(docs, text)
    schema = T.StructType([*own.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(model_file))
        for table in in_batches(rows, at, batch):
            first, ids = codec.encode(table[at])
            null = table[at].is_null().to_numpy()
            offsets = pa.array(first.astype(np.int32), pa.int32(), mask=np.append(null, False)) if null.any() else pa.array(first.astype(np.int32), pa.int32())
            yield from table.append_column("ids", pa.ListArray.from_arrays(offsets, pa.array(ids))).to_batches()

    return own.mapInArrow(work, schema).toDF(*docs.columns, "ids")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs but for the columns of these names; names are taken as they are, dots and all."""
    return docs.select(*(named(c) for c in docs.columns if c.lower() not in {n.lower() for n in names}))


def decode(rows: DataFrame, *, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the column `out`: the text of the ids.

    Null ids give null, empty lists an empty text; lists of any length are decoded whole; bytes that are no UTF-8 become U+FFFD.  Repeated rows give repeated
    results, an empty table an empty one; other columns pass through whatever their names, and one named `out` is replaced.
    """
    rows = without(rows, out)
    own, at = safe(rows), place(rows, ids)
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file)
        for b in batches:
            lists = b.column(at)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first, data = decode_bytes(np.concatenate([[0], np.cumsum(size)]), lists.flatten().to_numpy(zero_copy_only=False), vocab)
            raw, valid = data.tobytes(), lists.is_valid().to_pylist()
            texts = [raw[i:j].decode("utf-8", "replace") if v else None for i, j, v in zip(first[:-1].tolist(), first[1:].tolist(), valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return own.mapInArrow(work, schema).toDF(*rows.columns, out)


def encoded_and_checked(docs: DataFrame, *, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit words) and round_trip (decoding gives the text; U+2581 in a text reads as a space).

    Null and empty texts have no ids and pass the round trip; a null doc_id stays null; repeated rows give repeated
    results, an empty table an empty one; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(model_file))
        for table in in_batches(batches, "text", BATCH):
            texts = plain_strings(table["text"])
            first, ids = codec.encode(texts)
            cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            raw = memoryview(ids.astype("<i4").tobytes())
            sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in cut]
            same = alike(*decode_bytes(first, ids, codec.vocab), *bytes_of(pc.replace_substring(texts, SPACE, " ")))
            yield from pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(np.diff(first), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), "ids_sha256": sha, "round_trip": pa.array(same)}).to_batches()

    return rows.mapInArrow(work, schema)


def alike(first: np.ndarray, data: np.ndarray, other: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts that start at `first` in data are those that start at `bounds` in other."""
    same = np.diff(first) == np.diff(bounds)
    size = np.where(same, np.diff(first), 0)
    if same.all():
        wrong = np.flatnonzero(data != other[: len(data)])
    else:
        wrong = np.flatnonzero(data[ranges(first[:-1], size)] != other[ranges(bounds[:-1], size)])
    same[np.searchsorted(np.cumsum(size), wrong, "right")] = False
    return same
