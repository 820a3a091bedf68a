import os

import numpy as np
import pyarrow as pa
import pytest

from fringeline.llm.lattice import vocabulary
from fringeline.llm.marked import code_points
from fringeline.llm.queries import VOCAB_FILE
from fringeline.llm.sentencepiece_codec import decode, decode_ids, encode, encode_texts, encoded_and_checked, merged
from fringeline.llm.words import Words, words_of

from .cases import ODD, empty, made_texts, table

pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB_FILE), reason="no public vocabulary here")
TEXTS = ["Hello  world\n\tx", "  a b ", " ", "\u0000a​", "a\r\nb", "x" * 300, " " * 200, "日本語 テキスト", "aaaaabababab" * 20, "<s> </s> <0x0A>", "▁ y", *made_texts(), *(t or "" for t in ODD)]


def test_same_ids_as_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=VOCAB_FILE)
    first, ids = encode_texts(TEXTS, vocabulary(VOCAB_FILE))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == model.encode(TEXTS)


def test_exact_round_trip():
    vocab = vocabulary(VOCAB_FILE)
    first, ids = encode_texts(TEXTS, vocab)
    assert [decode_ids(ids[a:b], vocab) for a, b in zip(first[:-1], first[1:], strict=True)] == [t.replace("▁", " ") for t in TEXTS]
    assert decode_ids(np.array([1, 2][:0]), vocab) == ""


def test_frames(spark):
    df = table(spark)
    rows = decode(encode(df, model_file=VOCAB_FILE, batch=3000), model_file=VOCAB_FILE).collect()
    assert len(rows) == df.count() and all(r.decoded == r.text for r in rows)
    checked = encoded_and_checked(df, model_file=VOCAB_FILE).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in checked)
    assert encode(empty(spark), model_file=VOCAB_FILE).collect() == []


def test_long_words_in_small_blocks():
    import sentencepiece

    model, vocab = sentencepiece.SentencePieceProcessor(model_file=VOCAB_FILE), vocabulary(VOCAB_FILE)
    words = ["x" * 700, "日本語テキスト" * 90, "internationalization" * 40, "=-" * 300 + "☃" * 40, "ab"]
    size, ids = merged(code_points([f" {w}".encode() for w in words]), vocab, cells=64)
    want = model.encode(words)
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Words, "hashes", lambda self, seed=0: (self.end - self.start).astype(np.uint64) % np.uint64(3) if seed < 2 else self.start.astype(np.uint64))
    w = words_of(pa.array(["aa bb aa cc aaaaa bbbbb aaaaa", "aa " + "y" * 602 + " " + "z" * 602 + " " + "y" * 602]))
    raw = w.data.tobytes()
    place, sample = w.classes()
    words = [raw[a:b] for a, b in zip(w.start, w.end, strict=True)]
    assert [words[sample[k]] for k in place] == words


def test_texts_of_megabytes():
    vocab = vocabulary(VOCAB_FILE)
    texts = ["日本語テキスト" * 100_000, "word " * 500_000, "a" * 300_000]
    first, ids = encode_texts(texts, vocab)
    assert [decode_ids(ids[a:b], vocab) for a, b in zip(first[:-1], first[1:], strict=True)] == texts
