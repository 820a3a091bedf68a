import hashlib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fringeline.llm.bpe_codec import Model, decode, digests, encode
from fringeline.llm.queries import WORD_FILE

from .cases import ODD, empty, table

LIBRARY = Tokenizer.from_file(WORD_FILE)
OWN = Model(WORD_FILE)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return next(OWN.encoded([text])).tolist()


def check(text):
    found = own(text)
    assert found == ids(text)
    assert "".join(OWN.pieces(found)) == LIBRARY.decode(found, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \t\n", "It's they'll 123 a1b2 !!'s", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "ΣΑΣ İstanbul É é ß", "a\x1cb\x85c\xa0d　e", "😀 漢字 ½²"])
def test_texts(text):
    check(text)


@pytest.mark.parametrize("text", ["a" * 100_001, "the" * 30_000, "!-" * 20_000, "ab" * 30_001, "é" * 5000, "x" * 64, "y" * 65, "z" * 128])
def test_stretches_without_a_split(text):
    check(text)


def test_texts_of_megabytes():
    r = random.Random(3)
    words = [w.removesuffix("</w>") for w in list(OWN.names.values())[600:40000]]
    check(" ".join(r.choice(words) for _ in range(300_000)))
    check("".join(r.choice(words) for _ in range(100_000)))


def test_every_assigned_code_point():
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    for at in range(0, len(some), 5000):
        check(" ".join(f"a{c}b {c}" for c in some[at : at + 5000]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "the", "in", "g", "'s", "!", "é", "漢", "<|endoftext|>", "1"]), max_size=400).map("".join))
def test_joins(text):
    check(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=60))
def test_any_text(text):
    check(text)


def test_merges_in_any_order():
    """A vocabulary whose merges do not follow one another is merged one pair at a time."""
    slow = Model(WORD_FILE)
    slow.ordered = False
    for text in ("aaaaaaa aaaa", "banana bananas", "mississippi" * 20):
        assert next(slow.encoded([text])).tolist() == ids(text)


def test_columns(spark):
    df = table(spark)
    rows = decode(encode(df, model_file=WORD_FILE), model_file=WORD_FILE)
    assert rows.columns == [c for c in df.columns if c != "ids"] + ["ids", "decoded"]
    for r in rows.collect():
        assert r.ids == (None if r.text is None else ids(r.text))
        assert r.decoded == (None if r.text is None else LIBRARY.decode(r.ids, skip_special_tokens=False))
    assert encode(empty(spark), model_file=WORD_FILE).count() == 0


def test_digests(spark):
    rows = digests(table(spark), model_file=WORD_FILE).collect()
    text = {r.doc_id: r.text or "" for r in table(spark).collect() if r.doc_id is not None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == table(spark).count() and len(text) > len(ODD)
    for r in rows:
        if r.doc_id is not None:
            x = ids(text[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), sha(" ".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False)))
    assert digests(empty(spark), model_file=WORD_FILE).count() == 0
