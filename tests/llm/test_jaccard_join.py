from collections import Counter

import numpy as np
import pytest

from fringeline.llm.components import components
from fringeline.llm.jaccard_join import BitSketches, bit_sketch, links, near_duplicates, sketches

from .cases import LOWER, empty, made_texts, table, words


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


@pytest.mark.parametrize("bucket", [6 << 20, 5000])
def test_same_as_brute_force(spark, bucket):
    df = table(spark)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, bucket_bytes=bucket).collect())
    assert got == Counter(plain([(r.doc_id, r.text) for r in df.collect()]))


def test_small_sets_at_the_threshold(spark):
    texts = [" ".join(f"v{i}" for i in range(a, b)) for a in range(3) for b in range(a + 1, 24)]
    df = table(spark, texts)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == Counter(plain([(r.doc_id, r.text) for r in df.collect()]))


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_bounds_hold_for_random_sets():
    r = np.random.default_rng(1)
    for size in (1, 3, 9, 40, 300, 1500):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 9], r.integers(0, 2**63, len(a) // 9, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert BitSketches([bit_sketch(a), bit_sketch(b)]).differences(np.array([0]), np.array([1]))[0] <= differ
        if 7 * differ <= len(a) + len(b):
            s, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            parts = sketches(np.array([0, 1]), first, s, 3, 4)
            assert any(len(set(w[row == 0].tolist()) & set(w[row == 1].tolist())) for row, w, _, _ in parts)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 400)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {400: 400, 500: 400}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_different_texts_of_one_id(spark):
    def say(name, lo, hi):
        return " ".join(f"{name}{i}" for i in range(lo, hi))

    texts = [say("p", 0, 60), say("q", 0, 30), say("p", 2, 62), say("r", 0, 45), say("q", 1, 31), say("r", 1, 46), say("s", 0, 40), say("r", 2, 47), say("q", 2, 32), say("t", 0, 9)]
    ids = [5, 5, 1, 7, 3, 2, 9, 9, 11, 4]
    more = [(20, say("x", 0, 50)), (20, say("y", 0, 20)), (21, say("x", 0, 50)), (22, say("y", 0, 20)), (23, ""), (23, say("z", 0, 8)), (10, say("z", 0, 8))]
    for turn in (1, -1):
        rows = [*zip(ids, texts, strict=True), *more][::turn]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
        assert got == Counter(plain(rows))


def test_every_link_between_classes(spark):
    texts = made_texts() + [" ".join(f"v{i}" for i in range(a, a + 60)) for a in (0, 1, 2, 4, 7, 12, 19)]
    df = table(spark, texts)
    stand = {r.doc_id for r in near_duplicates(df).collect() if r.doc_id is not None and r.doc_id == r.class_id}
    sets = {i: shingles(texts[i]) for i in stand}
    want = {(i, j) for i, a in sets.items() for j, b in sets.items() if i > j and a and b and 4 * len(a & b) >= 3 * len(a | b)}
    got = [tuple(r) for r in links(df, bucket_bytes=5000).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 12
