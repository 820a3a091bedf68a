import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeline.llm import exchange as X
from fringeline.llm.words import words_of


@settings(deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=600))
def test_squeezed_integers(values):
    x = np.array(values, np.uint64)
    raw = b"ab" + X.squeeze(x) + X.squeeze(x[::-1])
    a, at = X.unsqueeze(raw, len(x), 2)
    b, end = X.unsqueeze(raw, len(x), at)
    assert a.tolist() == values and b.tolist() == values[::-1] and end == len(raw)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200), st.integers(1, 9), st.booleans())
def test_packed_keys(keys, ranges, tight):
    k = np.array(sorted(keys), np.uint64)
    table = X.pack(3, k, [np.arange(len(k), dtype=np.uint64)], ranges, tight=tight)
    t, n, cols = X.unpack_tight(table, 2) if tight else X.unpack(table, [np.uint64, np.uint64])
    assert cols[0].tolist() == sorted(keys) and cols[1].tolist() == list(range(len(k)))
    assert n.sum() == len(k) and (t == 3).all() and table["p"].to_pylist() == sorted(set(table["p"].to_pylist()))


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cé\xa0😀", max_size=40)), max_size=12))
def test_words_are_those_of_bytes_split(texts):
    w = words_of(pa.array(texts, pa.string()))
    got = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]
    flat = [x for t in got for x in t]
    h = w.hashes().tolist()
    assert len(set(flat)) == len(set(h)) == len(set(zip(flat, h, strict=True)))


def test_rows_without_or_of_one_id_are_spread(spark):
    rows = [(None if i % 2 else 7, f"text {i}") for i in range(400)] + [(None, None)]
    dealt = X.in_buckets(spark.createDataFrame(rows, "doc_id long, text string"), 16).groupBy("t").count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 80


def test_buckets_grow_with_the_corpus(spark):
    df = spark.createDataFrame([("x" * 60_000,)] * 100, "text string")
    assert X.bucket_count(df) == 1
    assert X.bucket_count(df, 1000) == -(-6_000_000 // 48_000)  # the square root of 64 keys of 6 bytes times 6 MB
