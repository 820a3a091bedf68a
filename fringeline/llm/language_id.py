"""Language identification by unigram piece models whose segmentations are summed out.

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is the
sum over all ways to cut it into pieces, found by the forward algorithm on the lattice of the vocabulary's
occurrences (lattice.py); a text's is the product over its words.  A long word is cut where no piece spans, which
every segmentation does, and a long part is gone through character by character, so the sum is over all of them
however long a word is.  The piece probabilities come from expectation-maximisation (forward-backward) over
labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeline.llm.lattice import CELLS, Lattice, Runs, Vocabulary, joined, vocabulary
from fringeline.llm.marked import LONG, Known, code_points, marked_words, segments
from fringeline.llm.sentencepiece_codec import in_batches, without
from fringeline.llm.shared import place, safe
from fringeline.llm.words import plain_strings

#: Bytes of a batch of texts.
BATCH = 2 << 20
#: Texts a language is learned from, as an expected number of rows chosen by a hash of doc_id.
PER_LANGUAGE = 800
ROUNDS = 3
SMOOTHING = 0.05
#: Scale by character, so that products of probabilities neither vanish nor overflow within a word of LONG characters.
SCALE = 2.0**7
#: Characters of a longer part after which the running sums are scaled anew.
RESCALE = 32
UNDETERMINED = "und"
LETTER = r"\p{L}"


def scaled(prob: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Rows by piece, then the row of an unknown character, then of no piece; each times SCALE for each character."""
    length = np.array([max(1, len(p)) for p in vocab.pieces] + [1], float)
    return np.concatenate([prob * (SCALE**length)[:, None], np.zeros((1, prob.shape[1]))])


def by_length(lattice: Lattice, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
    """Words of each length, and for each (end, length) of an edge the row of its piece."""
    for n in np.unique(lattice.length).tolist():
        which = np.flatnonzero(lattice.length == n)
        start = lattice.start[which]
        edges = {}
        for end in range(1, n + 1):
            for size in range(1, min(end, vocab.longest) + 1):
                piece = lattice.piece[start + end - size, size - 1]
                if size == 1:
                    edges[end, size] = np.where(piece < 0, vocab.size, piece)
                elif (piece >= 0).any():
                    edges[end, size] = np.where(piece < 0, vocab.size + 1, piece)
        yield which, n, edges


def forward(edges: dict, n: int, words: int, table: np.ndarray) -> np.ndarray:
    alpha = np.zeros((n + 1, words, table.shape[1]))
    alpha[0] = 1
    for (end, size), piece in edges.items():
        alpha[end] += alpha[end - size] * table[piece]
    return alpha


def chain(part: np.ndarray, vocab: Vocabulary, table: np.ndarray, cells: int, held: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """forward() of one long part: its sums by language, and natural logs of what they were divided by.

    The lattice is made in blocks that overlap by a piece, and only as many sums as a piece is long are kept.  held
    gets, for each character, the rows of the pieces that end there by length, and the sums before it.
    """
    n, longest = len(part), vocab.longest
    alpha = np.zeros((longest, table.shape[1]))  # the last one is of the character before
    alpha[-1] = 1
    log = np.zeros(table.shape[1])
    for a in range(0, n, cells):
        low = max(0, a - longest + 1)
        piece = Lattice(joined([part[low : a + cells]]), vocab).piece
        for end in range(a + 1, min(a + cells, n) + 1):
            k = min(end, longest)
            rows = piece[end - low - np.arange(1, k + 1), np.arange(k)].astype(np.int64)
            rows[rows < 0] = vocab.size + 1
            if rows[0] > vocab.size:
                rows[0] = vocab.size
            if held is not None:
                held.append((rows, alpha[: -k - 1 : -1].copy(), log.copy()))
            alpha = np.concatenate([alpha[1:], (alpha[: -k - 1 : -1] * table[rows]).sum(0, keepdims=True)])
            if end % RESCALE == 0:
                top = np.maximum(alpha.max(0), 1e-300)
                alpha /= top
                log += np.log(top)
    return alpha[-1], log


def word_scores(words: Runs, vocab: Vocabulary, table: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Natural log of each word's probability in each language."""
    owner, parts = segments(words, vocab, cells)
    out = np.zeros((len(words), table.shape[1]))
    short, long = np.flatnonzero(parts.length <= LONG), np.flatnonzero(parts.length > LONG)
    for first, cell in parts.some(short).in_cells(cells):
        for which, n, edges in by_length(Lattice(cell, vocab), vocab):
            np.add.at(out, owner[short[first + which]], np.log(np.maximum(forward(edges, n, len(which), table)[n], 1e-300)))
    for i in long.tolist():
        last, log = chain(parts.one(i), vocab, table, cells)
        out[owner[i]] += np.log(np.maximum(last, 1e-300)) + log
    return out - words.length[:, None] * np.log(SCALE)


def fitted(texts: list[str | None], vocab: Vocabulary, cells: int = CELLS) -> np.ndarray:
    """Probability of each piece, and last of an unknown character."""
    w = marked_words(pa.array(texts, pa.string()))
    prob = np.full((vocab.size + 1, 1), 1 / (vocab.size + 1))
    if not len(w):
        return prob[:, 0]
    place, sample = w.classes()
    raw = w.data.tobytes()
    owner, parts = segments(code_points([raw[w.start[i] : w.end[i]] for i in sample.tolist()]), vocab, cells)
    count = np.bincount(place)[owner].astype(float)
    short, long = np.flatnonzero(parts.length <= LONG), np.flatnonzero(parts.length > LONG)
    for _ in range(ROUNDS):
        table, expected = scaled(prob, vocab), np.zeros(vocab.size + 2)
        for first, cell in parts.some(short).in_cells(cells):
            for which, n, edges in by_length(Lattice(cell, vocab), vocab):
                alpha = forward(edges, n, len(which), table)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[n] = count[short[first + which]] / np.maximum(alpha[n], 1e-300)
                for (stop, length), piece in sorted(edges.items(), reverse=True):
                    flow = table[piece, 0] * beta[stop]
                    beta[stop - length] += flow
                    expected += np.bincount(piece, flow * alpha[stop - length], vocab.size + 2)
        for i in long.tolist():
            expected += count[i] * chain_counts(parts.one(i), vocab, table, cells)
        expected = expected[:-1] + SMOOTHING
        prob = (expected / expected.sum())[:, None]
    return prob[:, 0]


def chain_counts(part: np.ndarray, vocab: Vocabulary, table: np.ndarray, cells: int) -> np.ndarray:
    """Expected counts of the pieces in one long part, in one language."""
    held: list = []
    last, log = chain(part, vocab, table, cells, held)
    expected = np.zeros(vocab.size + 2)
    n, longest = len(part), vocab.longest
    beta = np.zeros(n + 1)  # in the scale of the sums at the character it has come to
    beta[n] = 1 / max(last[0], 1e-300)
    after = log[0]
    for end in range(n, 0, -1):
        rows, alpha, before = held[end - 1]
        k = len(rows)
        beta[max(0, end - longest) : end + 1] *= np.exp(before[0] - after)
        after = before[0]
        flow = table[rows, 0] * beta[end]
        np.add.at(expected, rows, flow * alpha[:, 0])
        beta[end - k : end] += flow[::-1]
    return expected


def learn(labelled: DataFrame, *, vocab_file: str, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Piece probabilities of each lang in labelled (doc_id, text, lang), from about per_language whole texts each.

    Rows without lang or text teach nothing.  Which texts are used depends on a hash of doc_id alone, so rows of one
    doc_id are used together or not at all; rows that repeat count each time; very long texts are learned whole.  An
    empty table gives no models; other columns are ignored.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    part = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))))
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_003)) / 1_000_003
    some = rows.where(u < part[F.col("lang")]).select("lang", "text")

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        prob = fitted(table["text"].to_pylist(), vocabulary(vocab_file))
        return pa.table({"lang": [key[0].as_py()], "prob": pa.array([prob.tobytes()], pa.binary())})

    fits = some.groupBy("lang").applyInArrow(fit, "lang string, prob binary").collect()
    return {r["lang"]: np.frombuffer(r["prob"]) for r in sorted(fits)}


def identify(docs: DataFrame, models: dict[str, np.ndarray], *, vocab_file: str, batch: int = BATCH, pred_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """docs with the predicted language and its score, the posterior of that language (0 to 1) under equal priors.

    A null text, or one without a letter, is `und` with score 0, as is every text if no language was learned.  Ties
    go to the first language by name.  Rows are scored each by itself, so repeated rows get equal results; very long
    texts are scored whole; an empty table gives an empty one.  Other columns pass through whatever their names; those
    named like the two new ones are replaced.
    """
    docs = without(docs, pred_column, score_column)
    own, at = safe(docs), place(docs, "text")
    schema = T.StructType([*own.schema.fields, T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = sorted(models)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_file)
        table = scaled(np.stack([models[k] for k in names], 1), vocab) if names else None
        known = Known(lambda words: (np.ones(len(words), np.int64), word_scores(words, vocab, table)))
        for part in in_batches(rows, at, batch):
            texts = plain_strings(part[at])
            letters = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False) & bool(names)
            pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if letters.any():
                w = marked_words(texts)
                place, row, _ = known.classes(w)
                logs, doc = known.values[row], w.doc()
                total = np.stack([np.bincount(doc, x[place], len(texts)) for x in logs.T], 1)
                posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                pred = np.where(letters, np.array(names, object)[total.argmax(1)], pred)
                score = np.where(letters, posterior, score)
            yield from part.append_column("pred", pa.array(pred, pa.string())).append_column("score", pa.array(score)).to_batches()

    return own.mapInArrow(work, schema).toDF(*docs.columns, pred_column, score_column)


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds
