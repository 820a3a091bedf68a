import math
import zlib
from collections import Counter

import pytest

from fringeline.llm.lm_scoring import scores

from .cases import LOWER, empty, table, words


@pytest.mark.parametrize("bucket", [6 << 20, 3000])
def test_base_counts_and_scores(spark, bucket):
    df = table(spark)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r.doc_id, [*words((r.text or "").translate(LOWER)), None]) for r in df.collect()]
    count = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in rows)
    got = scores(df, bucket_bytes=bucket).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(spark):
    """The next word after a fixed beginning: all types and one unknown."""
    train = ["a b c"] * 5 + ["a c"] * 3 + ["b a"] * 2
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2][: len(train)]
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    types = ["a", "b", "c", "unknown"]
    rows = list(zip(ids, train, strict=True)) + [(test[0], "")] + [(test[1 + k], w) for k, w in enumerate(types)]
    got = {r.doc_id: r.score for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = {w: got[test[1 + k]] for k, w in enumerate(types)}
    assert one["a"] > one["unknown"] and 10 ** got[test[0]] < 1
    assert sum(10**s for s in one.values()) + 10 ** got[test[0]] < 1 + 1e-9


def test_empty_table_and_no_training_rows(spark):
    assert scores(empty(spark)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
