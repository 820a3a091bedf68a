import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fringeline.llm.resampling import resampled

from .cases import LOWER, empty, made_texts, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, orders):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, orders=2, buckets=10_000, percent=25, least=20, seed=7):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = Counter(bucket(g) for _, t in docs for g in grams(t, orders)[0])
    aim = Counter(bucket(g) for t in target for g in grams(t, orders)[0])
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for b, s in own.items()}
    rows = []
    for i, t in docs:
        g, n = grams(t, orders)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"orders": 1}, {"orders": 3, "buckets": 50}, {"percent": 100, "range_rows": 7}])
def test_as_plain(spark, options):
    df = table(spark)
    target = ["the and und w1 w2", "w3 the", None, ""]
    found = resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()
    options = {k: v for k, v in options.items() if k != "range_rows"}
    assert sorted((tuple(r) for r in found), key=str) == plain([(r.doc_id, r.text) for r in df.collect()], target, **options)


def test_gains_by_a_join(spark, monkeypatch):
    from fringeline.llm import resampling

    monkeypatch.setattr(resampling, "BROADCAST", 0)
    df = table(spark)
    target = ["the and"]
    found = resampled(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain([(r.doc_id, r.text) for r in df.collect()], target)


def test_long_text_empty_tables(spark):
    long = "word Über x1 " * 120_000
    df = spark.createDataFrame([(1, long), (2, made_texts()[-1])], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in resampled(df, none).collect()), key=str) == plain([(r.doc_id, r.text) for r in df.collect()], [])
    assert resampled(empty(spark), none).count() == 0
