"""Texts that hold benchmark questions, also with other numbers, names or units.

Words are freed of outer punctuation and lower-cased; numbers, units and names (capitalised inside a sentence)
become typed placeholders, and what stood there is the slot's value.  A capitalised word that begins a line, or an
item's window, or a text's sentence, is read both as a name and as none.  Windows of such template tokens, and of the
words themselves, are hashed and joined with those of the benchmark.  The windows of a text that match an item at the same distance
form one alignment.  With the same values it is an exact copy; with other values it is re-parameterised if they
correspond one to one: equal slots of the item are equal in the text and different ones differ.  Where they don't,
those of its windows that have the same values are still an exact copy.

A template of few plain words says little by itself, so it has to bring more: it is looked up as a whole item only, its units
must be the item's own, and in the text it must be a sentence (or begin with a capital and end one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeline.llm import exchange as X
from fringeline.llm.sentencepiece_codec import in_batches
from fringeline.llm.shared import place, safe
from fringeline.llm.words import U64, Words, mix, words_of

WINDOW = 13
#: Tokens of a window that must not be placeholders if it is to match with other values.
LITERALS = 6
#: Plain words and units that a whole item of fewer plain words must have to match with other values.
LEAST = 3
#: Benchmark texts are taken in blocks of at most about so many bytes; each block is one pass over the texts.
BLOCK_BYTES = 8 << 20
BATCH = 2 << 20
NUMBER, UNIT, NAME = 1, 2, 3
#: No change of a window's first token, and the template code of a name.
NO, NAMED = U64(0), mix(np.array([NAME + 77], U64))[0]
#: Base of the window hashes, and its inverse.
UP = U64(0x9E3779B97F4A7C15)
DOWN = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Number words and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter"
UNITS = "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards mile miles g mg kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces l ml litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years mph kph dollar dollars cent cents euro euros percent degrees"
#: The lower case of each character that keeps its length, by code point.
LOWER = np.array([ord(low) if len(low := chr(c).lower()) == 1 and len(low.encode("utf-8", "replace")) == len(chr(c).encode("utf-8", "replace")) else c for c in range(1 << 16)], np.uint16)


def lower(data: np.ndarray) -> None:
    """Makes the letters of UTF-8 bytes lower-case, in place."""
    data[(data >= 65) & (data <= 90)] |= 32
    for lead, mask, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2)):
        at = np.flatnonzero((data & mask) == lead)
        at = at[at < len(data) - more]
        for k in range(1, more + 1):
            at = at[(data[at + k] & 0xC0) == 0x80]
        code = (data[at] & (0xFF ^ mask)).astype(np.uint16)
        for k in range(1, more + 1):
            code = (code << 6) | (data[at + k] & 63)
        low = LOWER[code]
        at, low = at[low != code], low[low != code]
        for k in range(more, 0, -1):
            data[at + k] = 0x80 | (low & 63)
            low = low >> 6
        data[at] = lead | low


class Tokens:
    """Template tokens of all texts: kind (0 a literal), hash of the bare lower-case word, template code, text, and word index.

    Whether a capitalised word is a name can be read in two ways: one that begins a line is a name in `code`, and a
    literal, as at a sentence's begin, in `by_line`; `broken` marks where they differ.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        w = words_of(texts)
        data, start, end, doc = w.data, w.start.copy(), w.end.copy(), w.doc()
        letter = np.zeros(256, bool)
        for low, high in ((48, 57), (65, 90), (97, 122), (128, 255)):
            letter[low : high + 1] = True
        for edge, step in ((start, 1), (end, -1)):
            rows = np.arange(len(start))
            while len(rows):
                rows = rows[(start[rows] < end[rows])]
                rows = rows[~letter[data[edge[rows] - (step < 0)]]]
                edge[rows] += step
        stop = np.isin(data[w.end - 1], np.frombuffer(b".!?:;\"')]", np.uint8)) if len(w) else np.zeros(0, bool)
        inner = np.zeros(len(w), bool)  # not at a text's or a sentence's begin
        inner[1:] = (doc[1:] == doc[:-1]) & ~stop[:-1]
        stops = np.concatenate([[0], np.cumsum(stop)])
        breaks = np.searchsorted(np.flatnonzero((data >= 10) & (data <= 13)), w.start)
        line = np.diff(breaks, prepend=0) > 0
        some = start < end
        start, end, self.doc = start[some], end[some], doc[some]
        at = np.flatnonzero(some)
        self.word = at - w.first[self.doc]
        # sentences: after a token's word, or a mark by itself, and before the next token
        self.ends = np.append((stops[at[1:]] > stops[at[:-1]]) | (self.doc[1:] != self.doc[:-1]), np.ones(min(len(at), 1), bool))
        self.begins = np.append(np.ones(min(len(at), 1), bool), self.ends[:-1]) | line[some]
        self.ends = self.ends | np.append(self.begins[1:], np.ones(min(len(at), 1), bool))
        a, b = data[start], data[np.minimum(start + 1, len(data) - 1)]
        self.capital = (a >= 65) & (a <= 90) & (b >= 97) & (b <= 122) & (end - start > 1)
        name = inner[some] & self.capital
        lower(data)
        self.value = Words(data, start, end, w.first).hashes()
        self.kind = np.zeros(len(start), np.int8)
        self.kind[name] = NAME
        for kind, fixed in ((UNIT, UNITS), (NUMBER, NUMBER_WORDS)):
            one = words_of(pa.array([fixed])).hashes()
            self.kind[np.isin(self.value, one)] = kind
        self.kind[(a >= 48) & (a <= 57)] = NUMBER
        self.code = np.where(self.kind > 0, mix(self.kind.astype(U64) + U64(77)), self.value)
        self.broken = (self.kind == NAME) & line[some]
        self.by_line = np.where(self.broken, self.value, self.code)
        self.first = np.searchsorted(self.doc, np.arange(len(w.first)))
        self.lines = np.concatenate([[0], np.cumsum(self.broken)])
        self.power = np.concatenate([np.ones(1, U64), np.cumprod(np.full(len(start), UP))])

    def windows(self, size: int) -> np.ndarray:
        """First token of each window inside one text."""
        i = np.arange(max(len(self.code) - size + 1, 0))
        return i[self.doc[i] == self.doc[i + size - 1]]

    def wrapped(self, i: np.ndarray, size: int) -> np.ndarray:
        """The windows that can be read in two ways."""
        return i[self.lines[i + size] > self.lines[i]]

    def sums(self, code: np.ndarray) -> np.ndarray:
        """Running sums of codes, each times its place's power, for hashes()."""
        return np.concatenate([np.zeros(1, U64), np.cumsum(code * np.cumprod(np.full(len(code), DOWN)))])

    def hashes(self, sums: np.ndarray, i: np.ndarray, size: int, change: np.ndarray | U64 = U64(0)) -> np.ndarray:
        """Hash of the window at each i, whatever its place; change is added to the code of its first token."""
        return mix((sums[i + size] - sums[i]) * self.power[i + 1] + change + U64(size))


class Windows:
    """Hashes of items' windows, to look up."""

    def __init__(self, h: np.ndarray, i: np.ndarray, item: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.h, self.i, self.item = h[order], i[order], item[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[h >> U64(44)] = True

    def find(self, i: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows i of hashes h that are here, with the item and the item's window, for each such item."""
        maybe = self.sieve[h >> U64(44)]
        i, h = i[maybe], h[maybe]
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        count = high - low
        low = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(i, count), self.item[low], self.i[low]


class Index:
    """Windows of benchmark items, by their words and as templates; an item shorter than a window is one window of its own length."""

    def __init__(self, items: list, texts: list[str], window: int, literals: int):
        self.items = items
        t = Tokens(pa.array(texts, pa.string()))
        self.value, self.kind = t.value, t.kind
        size = np.diff(t.first)
        words = t.sums(t.value)
        readings = [(code, t.sums(code), np.concatenate([[0], np.cumsum(code == t.value)])) for code in (t.code, t.by_line)]
        told = np.concatenate([[0], np.cumsum((t.kind == 0) | (t.kind == UNIT))])
        # items of a window's length or more without a template window of enough plain words are taken whole
        plain = np.concatenate([[0], np.cumsum(t.code == t.value)])
        full = t.windows(window)
        rich = np.unique(t.doc[full[plain[full + window] - plain[full] >= literals]])
        poor = np.flatnonzero(size >= window)
        poor = poor[~np.isin(poor, rich)]
        self.by_size = {}
        for n in sorted({window, *size[(size > 0) & (size < window)].tolist(), *size[poor].tolist()}):
            i = t.windows(n)
            whole = i[size[t.doc[i]] == n]
            i = whole if n != window else i
            at, h, few, few_h = [], [], [], []
            for own, (code, sums, plain) in zip((i, t.wrapped(i, n)), readings, strict=True):
                enough = plain[own + n] - plain[own] >= min(literals, n)
                thin = ~enough & (size[t.doc[own]] == n) & (told[own + n] - told[own] >= LEAST)
                for good, places, hashes in ((own[enough], at, h), (own[thin], few, few_h)):
                    # What stands before the first word isn't the item's own: it is also taken as a name, or as none.
                    turned = good[t.capital[good] & ((code[good] == NAMED) | (t.kind[good] == 0))]
                    change = np.where(code[turned] == NAMED, t.value[turned], NAMED) - code[turned]
                    places += [good, turned]
                    hashes += [t.hashes(sums, good, n), t.hashes(sums, turned, n, change)]
            at, h, few, few_h = (np.concatenate(x) for x in (at, h, few, few_h))
            self.by_size[n] = Windows(t.hashes(words, i, n), i, t.doc[i]), Windows(h, at, t.doc[at]), Windows(few_h, few, t.doc[few])

    def borne_out(self, t: Tokens, i: np.ndarray, there: np.ndarray, n: int) -> np.ndarray:
        """Which of the texts' windows i are sentences, or begin with a capital and end one, and have the units of the items' windows there."""
        at = np.arange(n)
        units = (self.kind[there[:, None] + at] != UNIT) | (self.value[there[:, None] + at] == t.value[i[:, None] + at])
        return (t.begins[i] | t.capital[i]) & t.ends[i + n - 1] & units.all(1)

    def alignments(self, t: Tokens) -> Iterator[tuple[int, int, bool, int, int]]:
        """(text, item, exact, tokens, first token) of each copy and each consistent alignment."""
        found = []
        words, template, by_line = (t.sums(code) for code in (t.value, t.code, t.by_line))
        for n, own in self.by_size.items():
            every = t.windows(n)
            # a capitalised word that begins a sentence may be a name too
            named = every[t.begins[every] & t.capital[every] & (t.kind[every] == 0)]
            for other, sums, at, change in ((0, words, every, NO), (1, template, every, NO), (1, by_line, t.wrapped(every, n), NO), (1, template, named, NAMED - t.code[named])):
                h = t.hashes(sums, at, n, change)
                i, item, there = own[other].find(at, h)
                found.append((t.doc[i], item, i - there, i, np.full(len(i), other), np.full(len(i), n)))
                if other and len(own[2].h):
                    i, item, there = own[2].find(at, h)
                    good = self.borne_out(t, i, there, n)
                    i, item, there = i[good], item[good], there[good]
                    found.append((t.doc[i], item, i - there, i, np.full(len(i), 1), np.full(len(i), n)))
        doc, item, shift, i, other, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
        order = np.lexsort((other, i, shift, item, doc))
        order = order[X.group_starts(doc[order], item[order], shift[order], i[order])]
        doc, item, shift, i, other, n = (x[order] for x in (doc, item, shift, i, other, n))
        if not len(doc):
            return
        new = X.group_starts(doc, item, shift)
        cut = np.append(np.flatnonzero(new), len(doc))
        step = np.where(np.append(new[1:], True), n, np.minimum(n, np.diff(i, append=0)))
        copied, size = np.maximum.reduceat(other, cut[:-1]) == 0, np.add.reduceat(step, cut[:-1])
        for a, b, exact, count in zip(cut[:-1].tolist(), cut[1:].tolist(), copied.tolist(), size.tolist(), strict=True):
            start = a
            if not exact:
                at, words = covered(i[a:b], n[a:b]), np.flatnonzero(other[a:b] == 0) + a
                slot = at[t.kind[at] > 0]
                here, there = t.value[slot], self.value[slot - shift[a]]
                pairs = np.unique(np.stack([here, there], 1), axis=0)
                if not len(pairs) == len(np.unique(here)) == len(np.unique(there)):
                    if not len(words):
                        continue
                    exact, count, start = True, len(covered(i[words], n[words])), words[0]
            yield int(doc[a]), int(item[a]), exact, count, int(t.word[i[start]])


def covered(i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Tokens of the windows at i of sizes n."""
    return np.unique(np.repeat(i, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def indices(benchmark: DataFrame, *, window: int, literals: int, block_bytes: int) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, by a hash of item_id."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for b in range(blocks):
        own = sorted(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield Index([r["item_id"] for r in own], [r["text"] for r in own], window, literals)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, literals: int = LITERALS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Alignments of texts with items: doc_id, item_id, kind (exact or reparameterised), n_tokens, first_word.

    A pair has one row, for its longest alignment (first by place, exact first).  kind is that of the windows that match:
    what lies outside them, such as another name at a sentence's begin, is not judged.  Null and empty texts on either side
    match nothing; an item with a null id is one like others, reported with a null item_id; repeated rows give repeated
    results; columns but doc_id, text and item_id, text are ignored; an
    empty benchmark gives no rows; texts of any length are taken whole.  Windows with fewer than `literals` plain words
    match with other values as whole items only, if they have LEAST plain words and units, their units are the same, and
    they are a sentence of the text or begin with a capital and end one; what is left, such as "Compute 12 plus 30", matches copies.
    """
    schema = "doc_id long, item_id long, kind string, n_tokens long, first_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indices(benchmark, window=window, literals=literals, block_bytes=block_bytes):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for table in in_batches(batches, "text", BATCH):
                t = Tokens(table["text"])
                best: dict[tuple[int, int], tuple] = {}
                for doc, item, exact, size, first in index.alignments(t):
                    key, value = (doc, item), (-size, not exact, first)
                    best[key] = min(best.get(key, value), value)
                ids = table["doc_id"]
                yield from pa.table({"doc_id": ids.take(pa.array([k[0] for k in best], pa.int64())), "item_id": pa.array([index.items[k[1]] for k in best], pa.int64()), "kind": pa.array(["reparameterised" if v[1] else "exact" for v in best.values()], pa.string()), "n_tokens": pa.array([-v[0] for v in best.values()], pa.int64()), "first_word": pa.array([v[2] for v in best.values()], pa.int64())}).to_batches()

        out = out.unionByName(rows.mapInArrow(work, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, literals: int = LITERALS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text holds no benchmark item; see contaminated().

    Null and empty texts stay; rows that repeat stay or go together; texts of any length are taken whole; an empty table gives an empty one.
    """
    out, at = safe(docs), place(docs, "text")
    for index in indices(benchmark, window=window, literals=literals, block_bytes=block_bytes):

        def work(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for table in in_batches(batches, at, BATCH):
                keep = np.ones(table.num_rows, bool)
                for doc, *_ in index.alignments(Tokens(table[at])):
                    keep[doc] = False
                yield from table.filter(pa.array(keep)).to_batches()

        out = out.mapInArrow(work, out.schema)
    return out.toDF(*docs.columns)
