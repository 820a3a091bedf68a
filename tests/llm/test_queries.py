"""The registered queries, on small tables: their columns and folds, and plain versions of whole outputs."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fringeline.llm import lm_scoring, quality, queries

from .cases import LOWER, ODD, made_texts, words

pytestmark = pytest.mark.skipif(not os.path.exists(queries.VOCAB_FILE), reason="no public vocabulary here")
PROSE = {"en": "the house and the garden are by the river with old trees while it rains", "de": "das haus und der garten sind bei dem fluss mit alten bäumen während es regnet", "es": "la casa y el jardín están junto al río con árboles viejos mientras llueve"}


def crc(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = [(t, None) for t in made_texts() + ODD]
    for lang, prose in PROSE.items():
        for _ in range(60):
            own = prose.split()
            r.shuffle(own)
            texts.append((" ".join(own) + r.choice(["", " %%% ### !!!", " " + " ".join(own)]), lang))
    return [(i, t, lang, f"s{i % 2}", len(t or "")) for i, (t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, None if i % 11 == 0 else int("%" not in (t or "")), i % 2) for i, t, *_ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    r = random.Random(5)
    spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(16)], 0) for i in range(250)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(0, PROSE["en"])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op12_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: queries.QUERIES[name](spark, folder).persist() for name in COLUMNS}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, rows, name):
    kinds = dict(results[name].dtypes)
    assert {c: t for c, t in (x.split() for x in COLUMNS[name].split(", "))}.items() <= kinds.items()
    if name not in ("op8_top_k", "op13_spelling_variants"):
        assert sorted(r.doc_id for r in results[name].collect()) == [r[0] for r in rows]


def test_folds(results):
    for name, folds, held in (("op5_quality", 5, 0), ("op9_lm_scoring", 7, 2), ("op10_language_id", 4, 2)):
        assert all(r.held_out == (crc(r.doc_id, folds) == held) for r in results[name].collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(results, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    other = con.sql(queries.ORACLE_SQL[name])
    df = results[name]
    assert sorted(df.columns) == sorted(other.columns)
    assert sorted(map(tuple, df.select(*other.columns).collect()), key=str) == sorted(other.fetchall(), key=str)


def test_languages_of_held_out_texts(results, rows):
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in results["op10_language_id"].collect() if r.held_out and lang[r.doc_id]]
    assert len(held) > 20 and all(r.lang_pred == lang[r.doc_id] for r in held)


def plain_model_scores(rows):
    """Deleted interpolation with dictionaries."""
    texts = {i: [*words((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    train = {i: t for i, t in texts.items() if crc(i, 7) != 2}
    one, two = Counter(w for t in train.values() for w in t), Counter(p for t in train.values() for p in zip(["<begin>", *t], t, strict=False))
    n, types = sum(one.values()), len(one)

    def estimates(t, deleted):
        for k, w in enumerate(t):
            context = (len(train) if k == 0 else one[t[k - 1]]) - deleted
            before = "<begin>" if k == 0 else t[k - 1]
            group = 0 if context <= 0 else min(math.frexp(context)[1], lm_scoring.CLASSES - 1)
            yield group, (two[before, w] - deleted) / context if context > 0 else 0.0, (one[w] - deleted) / max(n - deleted, 1)

    def binned(p):
        return 2.0 ** (-0.5 * min(round(-2 * math.log2(p)), lm_scoring.BINS - 2)) if p > 0 else 0.0

    cells = defaultdict(Counter)
    for t in train.values():
        for group, a, b in estimates(t, 1):
            cells[group][binned(a), binned(b)] += 1
    weight, seen, even = {}, np.zeros(3), 1 / (types + 1)
    for group, own in cells.items():
        w = np.array([0.4, 0.5, 0.1])
        for _ in range(lm_scoring.STEPS):
            used = sum(c * (w * (a, b, even)) / (w @ (a, b, even)) for (a, b), c in own.items())
            w = 0.999 * used / used.sum() + 0.001 * np.array([0, 0.5, 0.5])
        weight[group], seen = w, seen + used
    rest = 0.999 * seen / seen.sum() + 0.001 * np.array([0, 0.5, 0.5])
    weight = {g: weight.get(g, rest) for g in range(lm_scoring.CLASSES)}
    weight[0] = weight[0] + weight[0][0] * np.array([-1, 0.5, 0.5])
    return {i: sum(math.log10(weight[g] @ (a, b, even)) for g, a, b in estimates(t, 0)) for i, t in texts.items()}


def test_model_scores_as_with_dictionaries(results, rows):
    want = plain_model_scores(rows)
    got = {r.doc_id: r.score for r in results["op9_lm_scoring"].collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_quality_as_one_matrix(results, rows, folder, spark):
    """Ridge and calibration on all rows at once."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    x = quality.statistics(pa.array([t for _, t, *_ in rows], pa.string()))
    learn = [k for k, r in enumerate(rows) if crc(r[0], 5) not in (0, 4) and labels.get(r[0]) is not None]
    check = [k for k, r in enumerate(rows) if crc(r[0], 5) == 4 and labels.get(r[0]) is not None]
    label = np.array([labels.get(r[0]) or 0 for r in rows], float)
    mean, spread = x[learn].mean(0), x[learn].std(0)
    random_ = np.random.default_rng(5)
    direction, phase = random_.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], quality.COSINES)), random_.uniform(0, 2 * np.pi, quality.COSINES)
    z = np.clip((x - mean) / np.where(spread > 1e-9, spread, 1.0), -8, 8)
    c = np.concatenate([np.sqrt(2 / quality.COSINES) * np.cos(z @ direction + phase), z, np.ones((len(x), 1))], 1)
    penalty = quality.RIDGE * np.eye(c.shape[1])
    penalty[-1, -1] = 1e-6
    raw = c @ np.linalg.solve(c[learn].T @ c[learn] + penalty, c[learn].T @ label[learn])
    at = np.clip((raw + 1) / 3 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = sorted(set(at[check]))
    edges, level = quality.isotonic((np.array(bins) + 0.5) / quality.BINS * 3 - 1, np.array([(at[check] == b).sum() for b in bins], float), np.array([label[check][at[check] == b].sum() for b in bins]))
    want = np.clip(np.interp(raw, edges, level), 0, 1)
    got = {r.doc_id: r for r in results["op5_quality"].collect()}
    assert np.allclose([got[r[0]].score for r in rows], want, atol=2e-3)
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_decontamination_query(spark, folder):
    assert queries.QUERIES["op3_decontamination"](spark, folder).columns == ["doc_id", "item_id", "kind", "n_tokens", "first_word"]


def test_sentencepiece_query(spark, folder, rows):
    got = queries.QUERIES["op7_sentencepiece"](spark, folder).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
