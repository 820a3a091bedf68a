import itertools
import math
import os

import numpy as np
import pytest

from fringeline.llm import language_id, marked
from fringeline.llm.language_id import SCALE, chain, fitted, identify, learn, scaled, word_scores
from fringeline.llm.lattice import joined, vocabulary
from fringeline.llm.queries import VOCAB_FILE

from .cases import ODD, empty, table

pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB_FILE), reason="no public vocabulary here")


def test_forward_sums_all_segmentations():
    vocab = vocabulary(VOCAB_FILE)
    prob = np.random.default_rng(0).random((vocab.size + 1, 2))
    prob /= prob.sum(0)
    ids = {vocab.pieces[i]: i for i in vocab.ids.tolist()}
    for word in ("▁the", "▁hello", "ab☃c"):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[last:k])
                    last = k
            if all(p in ids or len(p) == 1 for p in parts):
                want += np.prod([prob[ids.get(p, vocab.size)] for p in parts], axis=0)
        got = word_scores(joined([np.array([ord(c) for c in word])]), vocab, scaled(prob, vocab))[0]
        assert np.allclose(got, np.log(want))


def test_long_words_are_summed_whole():
    vocab = vocabulary(VOCAB_FILE)
    prob = np.random.default_rng(1).random((vocab.size + 1, 2))
    prob /= prob.sum(0)
    table = scaled(prob, vocab)
    ids = {vocab.pieces[i]: i for i in vocab.ids.tolist()}

    def plain(word):
        alpha = np.zeros((len(word) + 1, 2))
        alpha[0] = 1
        for end in range(1, len(word) + 1):
            for size in range(1, min(end, vocab.longest) + 1):
                piece = ids.get(word[end - size : end], vocab.size if size == 1 else None)
                if piece is not None:
                    alpha[end] += alpha[end - size] * prob[piece] * 2.0 ** (12 * size)
        return np.log(alpha[-1]) - len(word) * 12 * np.log(2.0)

    for word in ("▁" + "internationalization" * 4, "▁" + "日本語のテキスト" * 9, "▁" + "a" * 70, "▁" + "=" * 60 + "x☃" * 10):
        want = plain(word)
        code = np.array([ord(c) for c in word])
        for cells in (1 << 18, 40):
            assert np.allclose(word_scores(joined([code]), vocab, table, cells)[0], want)
        last, log = chain(code, vocab, table, 25)
        assert np.allclose(np.log(last) + log - len(word) * np.log(SCALE), want)


def test_long_words_teach_as_they_are(monkeypatch):
    vocab = vocabulary(VOCAB_FILE)
    texts = ["internationalization" * 3 + " and a dog", "a" * 90, "the cat"]
    whole = fitted(texts, vocab)
    monkeypatch.setattr(language_id, "LONG", 5)
    monkeypatch.setattr(marked, "LONG", 5)
    assert np.allclose(fitted(texts, vocab, 30), whole, rtol=1e-9)


def test_learned_probabilities():
    p = fitted(["the cat and the dog"] * 3, vocabulary(VOCAB_FILE))
    assert math.isclose(p.sum(), 1) and (p > 0).all()


def test_accuracy_and_odd_rows(spark):
    en, de = "the house and the garden are by the river with old trees", "das haus und der garten sind bei dem fluss mit alten bäumen"
    texts = [en, de] * 20 + ODD + ["123 456", "!!"]
    df = table(spark, texts).drop("score").selectExpr("*", "'x' lang_pred").withColumnRenamed("lang", "old").selectExpr("*", "if(doc_id < 40, if(doc_id % 2 = 0, 'en', 'de'), null) lang")
    models = learn(df.where("doc_id < 30"), vocab_file=VOCAB_FILE)
    rows = identify(df, models, vocab_file=VOCAB_FILE, batch=500).where("doc_id is not null").collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 == 0 else "de") for r in rows if r.doc_id < 40)
    und = {r.text for r in rows if r.lang_pred == "und"}
    assert {None, "", " \t\n", "123 456", "!!"} == und
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_or_score(spark):
    assert learn(empty(spark), vocab_file=VOCAB_FILE) == {}
    assert {r.lang_pred for r in identify(table(spark), {}, vocab_file=VOCAB_FILE).collect()} == {"und"}
    assert identify(empty(spark), {}, vocab_file=VOCAB_FILE).collect() == []
