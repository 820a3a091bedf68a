import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import fringeline.llm.top_k as top_k_module
from fringeline.llm.top_k import top_k

ROWS = 230


def vectors():
    r = random.Random(4)
    out = [(i, [r.choice([0.0, -0.5, 0.25, r.random()]) for _ in range(8)]) for i in range(ROWS)]
    out[20] = (20, None)
    out[21] = (21, [0.1, None] + [0.0] * 6)
    out[22] = (22, [float("nan")] * 8)
    out[23] = (23, [float("inf")] * 8)
    out[24] = (24, out[25][1])
    out[26] = (26, [])
    out[27] = (27, [1.0, 2.0])
    return out


@pytest.mark.parametrize(("block", "part", "k", "merged"), [(8192, 1024, 10, 64), (17, 3, 10, 3), (50, 100, 400, 2)])
def test_same_as_brute_force(spark, monkeypatch, block, part, k, merged):
    monkeypatch.setattr(top_k_module, "MERGED", merged)
    rows = vectors()
    good = {i: np.array([np.floor(1024 * x) for x in v] + [0] * (8 - len(v)), np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        ranked = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, part int")
    got = top_k(df, F.col("vec_id") % 10 == 0, k=k, block_rows=block, query_rows=part).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") == 0).collect() == []
    assert top_k(df.where("false"), F.col("vec_id") == 0).collect() == []
