import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fringeline.llm.substring_dedup import Parse, dedup_windows
from fringeline.llm.words import words_of

from .cases import empty, table, words


def plain(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, 10**9), 10**9 if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (10**9 if i is None else i):
                keep[k : k + size] = [False] * size
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("size", "bucket"), [(50, 6 << 20), (50, 4000), (7, 9000)])
def test_same_as_brute_force(spark, size, bucket):
    df = table(spark)
    got = Counter(tuple(r) for r in dedup_windows(df, window=size, bucket_bytes=bucket).collect())
    assert got == Counter(plain([(r.doc_id, r.text) for r in df.collect()], size))


def test_empty_table(spark):
    assert dedup_windows(empty(spark)).collect() == []


def test_certain_symbols_do_not_depend_on_context():
    r = np.random.default_rng(3)
    core = [f"w{i}" for i in r.integers(0, 5, 60)]
    seen = set()
    for k in range(8):
        text = " ".join([f"w{i}" for i in r.integers(0, 5, 9)] + core + [f"w{i}" for i in r.integers(0, 5, 7)])
        p = Parse(words_of(pa.array([text])), "rpppr")
        seen.add(tuple(p.name[p.low[9] : p.high[69]].tolist()))
    assert len(seen) == 1
