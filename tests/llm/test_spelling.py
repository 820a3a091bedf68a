import random
import re
import zlib
from collections import Counter

import pytest

from fringeline.llm import spelling
from fringeline.llm.shared import written
from fringeline.llm.spelling import near_pairs, spelling_variants, variants, vocabulary

from .cases import LOWER, empty, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs, shortest=6, least=5):
    n = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain(n, times=5):
    form, n_near = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        n_near[w] = len(others)
        if others and -others[0][0] >= times * n[w]:
            form[w] = others[0][1]
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, n[w], form.get(w), root, n_near[w], n.get(form.get(w))))
    return sorted(rows)


def lexicon(count, letters, seed):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(count)}
    for w in sorted(words)[: count // 2]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]}
    return {w: 5 ** r.randrange(1, 6) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijßÿ"])
def test_as_plain(spark, letters):
    n = lexicon(250, letters, 5)
    found = variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(map(tuple, found)) == plain(n)


def test_pairs_once(spark):
    n = lexicon(150, "abc", 8)
    rows = spark.createDataFrame([(w,) for w in n] * 2 + [(None,)], "word string")
    found = [tuple(r) for r in near_pairs(rows).collect()]
    assert len(found) == len(set(found)) and all((len(a), a) < (len(b), b) for a, b in found)
    assert set(found) == {(a, b) for a in n for b in n if (len(a), a) < (len(b), b) and near(a, b)}


def test_chains_of_forms(spark):
    n = {"abcdefgh"[:6] + "z" * k: 5 ** (9 - k) for k in range(9)}
    found = {r.word: r.root for r in variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"abcdef"}


def test_documents(spark):
    r = random.Random(4)
    words = sorted(lexicon(40, "abcdeÉé", 3)) + ["Grüße", "Wörter", "ÀÉÎõü", "short"]
    texts = [" ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) for _ in range(300)) + "1x-" for _ in range(60)] + [None, "", "a" * 100_000]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs + docs[:3]], "doc_id long, text string, n int, word string").repartition(3)
    n = plain_words(docs + docs[:3])
    assert {r.word: r.n for r in vocabulary(df).collect()} == n
    assert sorted(map(tuple, spelling_variants(df).collect())) == plain(n)
    assert any(w not in {x.lower() for x in words} for w in n) or len(n) > 20


def test_awkward_tables(spark):
    df = table(spark)
    n = plain_words([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(map(tuple, spelling_variants(df).collect())) == plain(n)
    assert spelling_variants(empty(spark)).count() == 0


def test_tables_of_words_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(spelling, "written", kept)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    out = variants(spark.createDataFrame([("planet", 50), ("planets", 9), ("plannet", 5), ("plane", 1)], "word string, n long"))
    assert {r.word: r.root for r in out.collect()} == {"planet": "planet", "planets": "planet", "plannet": "planet", "plane": "planet"}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # the counts of bigrams, for each side of the pairs
    assert [p.count("BroadcastHashJoin") for p in plans if "BroadcastHashJoin" in p] == [2]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5
