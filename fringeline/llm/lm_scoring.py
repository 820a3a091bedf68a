"""Texts scored by a bigram model with deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram, of its unigram, and an even share of
all types with one for unknown words.  The weights depend on how often the context was seen (by powers of two),
and are learned by expectation-maximisation on deleted counts: every training token is held out once, and its
own occurrence is taken from all counts.  Counts are over the whole training corpus: buckets of texts ask for
the counts of their n-grams by key ranges (exchange.py), so no table of all n-grams is joined or held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeline.llm import exchange as X
from fringeline.llm.words import U64, mix, words_of

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END, BEGIN = U64(0x9FB21C651E98DF25), U64(0x3C79AC492BA7B653)
UNIGRAM, BIGRAM, TOTALS, WEIGHTS = range(4)
#: Context-frequency classes, and half powers of two by which probabilities are binned for the estimation.
CLASSES, BINS = 40, 96
STEPS = 40


class Tokens:
    """Words of each text and one end after them, with the token before each."""

    def __init__(self, table: pa.Table, folds: int, held: int):
        w = words_of(table["text"], lower=True)
        n = np.diff(w.first) + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        last = self.first[1:] - 1
        self.token = np.empty(self.first[-1], U64)
        plain = np.ones(len(self.token), bool)
        plain[last] = False
        self.token[plain], self.token[last] = w.hashes(), END
        before = np.concatenate([[BEGIN], self.token[:-1]]).astype(U64)
        before[self.first[:-1]] = BEGIN
        self.pair = mix(self.token * U64(3) ^ mix(before + U64(1)))
        ids = table["doc_id"].to_pylist()
        self.held = np.fromiter((i is not None and zlib.crc32(str(i).encode()) % folds == held for i in ids), bool, len(ids))
        self.train = ~np.repeat(self.held, n)
        self.start = np.zeros(len(self.token), bool)
        self.start[self.first[:-1]] = True
        self.unigrams, self.at, self.uses = _counted(self.token, self.train)
        self.pairs, self.pair_at, self.pair_uses = _counted(self.pair, self.train)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each among them, and their training counts."""
    order = np.argsort(keys)
    new = X.group_starts(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[order][new], place, np.bincount(place, train, int(new.sum())).astype(np.int64)


def _totals(replies: pa.Table) -> tuple[int, int, int]:
    """Training tokens, types and texts."""
    for kind, body in zip(replies["kind"].to_pylist(), replies["body"], strict=True):
        if kind == TOTALS:
            return tuple(np.frombuffer(body.as_buffer(), np.int64).tolist())
    return 0, 0, 0


class Counts:
    """Training counts for each token: its own, its bigram's and its context's, and the even share."""

    def __init__(self, t: Tokens, replies: pa.Table, ranges: int):
        self.n, self.types, self.texts = _totals(replies)
        one = X.replies_of(replies, UNIGRAM, t.unigrams, ranges, None)
        self.own = one[t.at]
        self.pair = X.replies_of(replies, BIGRAM, t.pairs, ranges, None)[t.pair_at]
        self.context = np.concatenate([[0], self.own[:-1]])
        self.context[t.start] = self.texts

    def estimates(self, deleted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context class, and the bigram's and the unigram's estimates."""
        context = self.context - deleted
        group = np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1).astype(float))[1], CLASSES - 1), 0)
        return group, (self.pair - deleted) / np.maximum(context, 1) * (context > 0), (self.own - deleted) / max(self.n - deleted, 1)


EVEN_SHARE = np.array([0.0, 0.5, 0.5])


def learned(cells: np.ndarray, count: np.ndarray, even: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bigram, unigram, even) of one class, and how often each is used, from counts of binned estimates."""
    rest = cells % (BINS * BINS)
    level = np.concatenate([2.0 ** (-0.5 * np.arange(BINS - 1)), [0.0]])
    p = np.stack([level[rest // BINS], level[rest % BINS], np.full(len(cells), even)], 1)
    weights, seen = np.array([0.4, 0.5, 0.1]), np.zeros(3)
    for _ in range(STEPS):
        share = weights * p
        seen = (share * (count / np.maximum(share.sum(1), 1e-300))[:, None]).sum(0)
        weights = 0.999 * seen / max(seen.sum(), 1e-300) + 0.001 * EVEN_SHARE  # so that every token keeps some probability
    return weights, seen


def all_weights(classes: list[int], weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights by class; one that was not seen has those of all uses together."""
    out = np.tile(0.999 * seen.sum(0) / max(seen.sum(), 1e-300) + 0.001 * EVEN_SHARE, (CLASSES, 1))
    out[classes] = weights
    out[0] += out[0, 0] * np.array([-1.0, 0.5, 0.5])  # an unseen context has no bigrams
    return out


def scores(docs: DataFrame, *, folds: int = 7, held: int = 2, bucket_bytes: int = X.BUCKET_BYTES) -> DataFrame:
    """Base and model scores of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of doc_id (as text) modulo folds is not held; a row without doc_id is learned
    from.  A-Z count as a-z; a text's tokens are its words and one end, so a null or empty text has one token.
    base_score is add-one unigram, score the model's log10 probability.  Repeated rows count each; texts of any length are taken whole;
    other columns are ignored; an empty table gives no rows; without training rows every token has the even share.
    """
    buckets = X.bucket_count(docs, bucket_bytes)
    texts = X.in_buckets(docs, buckets)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        t = Tokens(table, folds, held)
        here = key[0].as_py()
        one = X.pack(here, t.unigrams, [t.uses], buckets, tight=True)
        two = X.pack(here, t.pairs, [t.pair_uses], buckets, tight=True)
        two = two.set_column(0, "p", pa.array(two["p"].to_numpy() + buckets, pa.int32()))
        return pa.concat_tables([one, two])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        kind, p = divmod(p, buckets)
        t, n, (keys, uses) = X.unpack_tight(table, 2)
        _, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, uses).astype(np.int64)
        out = total[place]
        ends = np.cumsum(n)
        body = [X.squeeze(out[e - s : e]) for e, s in zip(ends.tolist(), n.tolist(), strict=True)]
        return pa.table({"t": pa.array(t, pa.int32()), "kind": pa.array([kind] * len(t), pa.int32()), "p": pa.array([p] * len(t), pa.int32()), "body": pa.array(body, pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        """Training tokens, types and texts of a range of unigrams."""
        n = types = texts = 0
        if key[0].as_py() < buckets:
            _, _, (keys, uses) = X.unpack_tight(table, 2)
            n, texts = int(uses.sum()), int(uses[keys == END].sum())
            types = len(np.unique(keys[uses > 0]))
        return pa.table({"zero": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "types": pa.array([types], pa.int64()), "texts": pa.array([texts], pa.int64())})

    asked = texts.groupBy("t").applyInArrow(ask, X.ASK)
    replies = asked.groupBy("p").applyInArrow(answer, X.REPLY)

    def to_all(kind: int, body: bytes) -> Iterator[pa.RecordBatch]:
        """The same small body for every bucket."""
        for low in range(0, buckets, 4096):
            n = min(4096, buckets - low)
            yield pa.RecordBatch.from_pydict({"t": pa.array(range(low, low + n), pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "p": pa.array([0] * n, pa.int32()), "body": pa.array([body] * n, pa.binary())})

    def tell_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from to_all(TOTALS, np.array([b.column(c)[0].as_py() for c in ("n", "types", "texts")]).tobytes())

    ranges = asked.groupBy("p").applyInArrow(total, "zero int, n long, types long, texts long")
    totals = ranges.groupBy("zero").agg(*(F.sum(c).alias(c) for c in ("n", "types", "texts"))).mapInArrow(tell_totals, X.REPLY)
    known = replies.unionByName(totals)

    def binned(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        t = Tokens(table, folds, held)
        c = Counts(t, own, buckets)
        group, two, one = (x[t.train] for x in c.estimates(1))
        step = lambda p: np.where(p > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(p, 1e-30))), BINS - 2), BINS - 1).astype(np.int64)
        cell, count = np.unique((group.astype(np.int64) * BINS + step(two)) * BINS + step(one), return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(count, pa.int64()), "types": pa.array(np.full(len(cell), c.types), pa.int64())})

    cells = texts.groupBy("t").cogroup(known.groupBy("t")).applyInArrow(binned, "cell long, n long, types long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.max("types").alias("types"))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("cell")
        weights, seen = learned(rows["cell"].to_numpy(), rows["n"].to_numpy().astype(float), 1 / (rows["types"][0].as_py() + 1))
        return pa.table({"zero": pa.array([0], pa.int32()), "class": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "seen": pa.array([seen.tolist()], pa.list_(pa.float64()))})

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("class")
        body = all_weights(rows["class"].to_pylist(), np.array(rows["weights"].to_pylist()), np.array(rows["seen"].to_pylist())).tobytes()
        return pa.Table.from_batches(to_all(WEIGHTS, body))

    # a class has a bounded number of cells, whatever the corpus; one row a class, at most CLASSES of them, meets the others
    fits = cells.withColumn("class", F.floor(F.col("cell") / (BINS * BINS)).cast("int")).groupBy("class").applyInArrow(fit, "zero int, class int, weights array<double>, seen array<double>")
    weights = fits.groupBy("zero").applyInArrow(weigh, X.REPLY)

    def scored(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        t = Tokens(table, folds, held)
        c = Counts(t, own, buckets)
        body = next((b for k, b in zip(own["kind"].to_pylist(), own["body"], strict=True) if k == WEIGHTS), None)
        weight = np.frombuffer(body.as_buffer()).reshape(CLASSES, 3) if body is not None else np.tile([0.0, 0.0, 1.0], (CLASSES, 1))
        group, two, one = c.estimates(0)
        w = weight[group]
        p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (c.types + 1)
        add = lambda x: np.add.reduceat(x, t.first[:-1]) if len(x) else x
        base = np.log10((c.own + 1) / (c.n + c.types + 1))
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "held_out": pa.array(t.held, pa.bool_()), "n_tokens": pa.array(np.diff(t.first), pa.int64()), "n_known": pa.array(add((c.own > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(t.held), c.n), pa.int64()), "base_score": add(base), "score": add(np.log10(p))})

    return texts.groupBy("t").cogroup(known.unionByName(weights).groupBy("t")).applyInArrow(scored, OUT)
