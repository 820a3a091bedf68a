"""Texts of megabytes are taken whole by the operators that gather from the corpus."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from fringeline.llm.jaccard_join import near_duplicates
from fringeline.llm.language_id import identify, learn
from fringeline.llm.lm_scoring import scores
from fringeline.llm.queries import VOCAB_FILE
from fringeline.llm.substring_dedup import dedup_windows

WORDS = 300_000


@pytest.fixture(scope="module")
def long():
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(5000)]
    return [r.choice(vocab) for _ in range(WORDS)]


def test_substring_dedup(spark, long):
    passage = [f"own{i}" for i in range(60)]
    text = long[:250_000] + passage + long[250_000:]
    rows = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(text))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_windows(rows).collect()}
    assert got[2] == (WORDS + 60, 60, hashlib.sha256(" ".join(long).encode()).hexdigest()) and got[1][1] == 0


def test_near_duplicates(spark, long):
    other = list(long)
    for k in range(0, WORDS, 10_000):
        other[k] = "changed"
    rows = spark.createDataFrame([(5, " ".join(long)), (7, " ".join(other)), (8, " ".join(reversed(long)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    shingles = len({tuple(long[i : i + 5]) for i in range(WORDS - 4)})
    assert got[5] == (shingles, 5) and got[7][1] == 5 and got[8][1] == 8


def test_lm_scoring(spark, long):
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    texts = [" ".join(long), "word1 word2"]
    got = {r.doc_id: r for r in scores(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    count = Counter(w for t in texts for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    want = sum(math.log10((count[w] + 1) / (n * 1.0 + v + 1)) for w in [*long, None])
    r = got[ids[0]]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (WORDS + 1, WORDS + 1, n) and r.base_score == pytest.approx(want, rel=1e-9) and math.isfinite(r.score)


def test_language_id(spark):
    say = {"a": "the house and the river of the old town ", "b": "das Haus und der alte Fluss in der Stadt "}
    rows = [(i, say[k] * 3, k) for i in range(8) for k in say]
    models = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocab_file=VOCAB_FILE)
    long = spark.createDataFrame([(i, say[k] * 80_000) for i, k in enumerate(say)], "doc_id long, text string")
    assert [r.lang_pred for r in identify(long, models, vocab_file=VOCAB_FILE).orderBy("doc_id").collect()] == ["a", "b"]
