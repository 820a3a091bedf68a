"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (lengths, kinds of characters, repetition) are standardised and mapped to cosines of random
directions, whose inner products approximate a Gaussian kernel.  The partitions' sums of outer products give the
normal equations of a ridge regression on the labels; a fold of the learning rows that the regression has not
seen gives the isotonic map from its output to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.llm.exchange import group_starts
from fringeline.llm.sentencepiece_codec import in_batches
from fringeline.llm.shared import named, safe
from fringeline.llm.words import U64, Words, mix, words_of

BATCH = 8 << 20
COSINES = 256
RIDGE = 1.0
BINS = 4096
#: Groups in which partitions' sums are added before the driver adds the groups.
TREE = 16
STATISTICS = [
    "log_words", "log_bytes", "mean_word", "word_spread", "upper", "lower", "digit", "symbol", "space", "line_breaks", "other_bytes",
    "no_letter_words", "capital_words", "symbol_ends", "sentence_ends", "doubled_symbols", "long_words", "distinct_words", "distinct_triples", "repeated_lines", "top_word", "doubled_words",
]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by text, and the count of the most frequent one."""
    order = np.lexsort((h, doc))
    start = np.flatnonzero(group_starts(doc[order], h[order])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(doc))
    owner = doc[order][start]
    most = np.zeros(n)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty or null one."""
    w = words_of(texts)
    n = len(w.first) - 1
    size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    data, at = w.data[:-8], np.concatenate([[0], np.cumsum(size)])
    kind = np.full(256, 3, np.uint8)  # symbol
    for code, spans in ((0, ((65, 90),)), (1, ((97, 122),)), (2, ((48, 57),)), (4, ((9, 13), (32, 32))), (5, ((128, 255),))):
        for low, high in spans:
            kind[low : high + 1] = code
    kinds = kind[data]
    share = [_per_text(kinds == k, at) / np.maximum(size, 1) for k in range(6)]
    lines = _per_text(data == 10, at)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & (kinds[1:] == 3)
    doc, words = w.doc(), np.diff(w.first).astype(float)
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean = _per_text(length, w.first) / some
    spread = np.sqrt(np.maximum(_per_text(length**2, w.first) / some - mean**2, 0))
    letters = np.concatenate([[0], np.cumsum((kinds <= 1) | (kinds == 5))])
    capitals = np.concatenate([[0], np.cumsum(kinds == 0)])
    small = np.concatenate([[0], np.cumsum(kinds == 1)])
    span = lambda c: c[w.end] - c[w.start]
    last = data[w.end - 1]
    h = w.hashes()
    twice = np.zeros(len(w), bool)
    twice[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = _distinct(doc, h, n)
    i = np.arange(max(len(w) - 2, 0))
    i = i[doc[i] == doc[i + 2]]
    triples, _ = _distinct(doc[i], mix(mix(h[i] * U64(3) ^ h[i + 1]) * U64(5) ^ h[i + 2]), n)
    many = np.maximum(words - 2, 1)
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), at[1:][size > 0]]))
    begin = np.concatenate([[0], ends])[:-1]
    full = ends > begin
    line = Words(w.data, begin[full], ends[full], at).hashes(3)
    owner = np.searchsorted(at, begin[full], "right") - 1
    own_lines, _ = _distinct(owner, line, n)
    all_lines = np.bincount(owner, minlength=n)
    cols = [
        np.log1p(words), np.log1p(size), mean, spread, *share[:4], share[4], lines / np.maximum(size, 1), share[5],
        _per_text(span(letters) == 0, w.first) / some, _per_text((span(capitals) > 1) & (span(small) == 0), w.first) / some, _per_text(kind[last] == 3, w.first) / some, _per_text(np.isin(last, np.frombuffer(b".!?", np.uint8)), w.first) / some,
        _per_text(doubled, at) / np.maximum(size, 1), _per_text(length > 15, w.first) / some, distinct / some, np.where(words > 2, triples / many, 1.0) * (words > 0), 1 - own_lines / np.maximum(all_lines, 1) * (all_lines > 0) - (all_lines == 0), top / some, _per_text(twice, w.first) / some,
    ]
    return np.stack(cols, 1)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the column stats (array<double>); a column of that name is replaced, others pass through.

    Null and empty texts have statistics of 0; very long texts are read whole; repeated rows have equal statistics; an empty
    table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in (text, "stats")]
    own = safe(docs.select(*map(named, keep), named(text)))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_batches(rows, f"c{len(keep)}", BATCH):
            x = statistics(table[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel()))
            yield from table.select(schema.names[:-1]).append_column("stats", lists).to_batches()

    return own.mapInArrow(work, schema).toDF(*keep, "stats")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    edges: np.ndarray  # outputs of the regression, rising
    level: np.ndarray  # the probability at each

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        c = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.direction + self.phase)
        return np.concatenate([c, z, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cosines(x[i : i + 4096]) @ self.weight for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.level), 0, 1)


def matrix_of(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return matrix_of(batch.column("stats"))


def summed(rows: DataFrame, part) -> list[np.ndarray] | None:
    """Sums over all rows of the arrays that part(batch) returns, added by partition, then by group, then here."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(b)
                total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[x.tobytes() for x in total]], pa.list_(pa.binary()))})

    def group(key: tuple, table: pa.Table) -> pa.Table:
        add = lambda parts: np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()
        return pa.table({"sums": pa.array([[add(p) for p in zip(*table["sums"].to_pylist(), strict=True)]], pa.list_(pa.binary()))})

    parts = rows.mapInArrow(partition, "sums array<binary>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    got = [r["sums"] for r in parts.groupBy("g").applyInArrow(group, "sums array<binary>").collect()]
    return [np.sum([np.frombuffer(p) for p in ps], axis=0) for ps in zip(*got, strict=True)] if got else None


def isotonic(x: np.ndarray, count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means by pooling adjacent violators: block centres and their levels."""
    blocks: list[list[float]] = []
    for c, n, g in zip(x.tolist(), count.tolist(), good.tolist(), strict=True):
        blocks.append([c * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(rows: DataFrame, *, cosines: int = COSINES, ridge: float = RIDGE, seed: int = 5) -> Model | None:
    """A model from rows (stats, label 0 or 1, calibrate boolean); None if there is none to learn from.

    Every row counts once, repeated ones each time; rows that are read are whole, so the order of rows does not matter
    beyond rounding; without a row to calibrate with, the learning rows calibrate.  Statistics and labels must not be
    null; other columns are ignored.
    """
    learn, calibrate = rows.where("NOT calibrate"), rows.where("calibrate")
    got = summed(learn, lambda b: [np.array([b.num_rows], float), (x := stats_of(b)).sum(0), (x**2).sum(0)])
    if got is None:
        return None
    n, total, squares = got
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    random = np.random.default_rng(seed)
    d = len(mean)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), random.normal(0, 1 / np.sqrt(d), (d, cosines)), random.uniform(0, 2 * np.pi, cosines), np.zeros(cosines + d + 1), np.zeros(0), np.zeros(0))

    def equations(b: pa.RecordBatch) -> list[np.ndarray]:
        c, y = model.cosines(stats_of(b)), b.column("label").to_numpy(zero_copy_only=False).astype(float)
        return [(c.T @ c).ravel(), c.T @ y]

    square, right = summed(learn, equations)
    m = len(right)
    penalty = ridge * np.eye(m)
    penalty[-1, -1] = 1e-6
    model.weight = np.linalg.solve(square.reshape(m, m) + penalty, right)

    def histogram(b: pa.RecordBatch) -> list[np.ndarray]:
        at = np.clip((model.raw(stats_of(b)) + 1) / 3 * BINS, 0, BINS - 1).astype(int)
        return [np.bincount(at, minlength=BINS).astype(float), np.bincount(at, b.column("label").to_numpy(zero_copy_only=False).astype(float), BINS)]

    count, good = summed(calibrate, histogram) or summed(learn, histogram)
    bins = np.flatnonzero(count)
    model.edges, model.level = isotonic((bins + 0.5) / BINS * 3 - 1, count[bins], good[bins])
    return model


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows with stats replaced by score (0 to 1); 0.5 without a model.  Other columns pass through, one named score is replaced; an empty table gives an empty one."""
    keep = [c for c in rows.columns if c not in ("stats", "score")]
    own = safe(rows.select(*map(named, keep), "stats"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix_of(b.column(b.num_columns - 1))) if model is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=schema.names)

    return own.mapInArrow(work, schema).toDF(*keep, "score")
