import os

import pytest

import corpus_pipeline
from fringeline.llm import queries

from .cases import ODD, made_texts
from .test_decontamination import ITEM
from .test_jaccard_join import plain

pytestmark = pytest.mark.skipif(not os.path.exists(queries.VOCAB_FILE), reason="no public vocabulary here")


def test_stages_against_plain_rules(spark, tmp_path):
    import sentencepiece

    texts = made_texts() + ODD + ["so " + ITEM + " there", "write to a@b.cd please, dear reader of words"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [(i, t) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    first = {i for i, _, root in plain(kept) if i == root}
    kept = [(i, t.replace("a@b.cd", "<EMAIL>")) for i, t in kept if i in first and ITEM not in t]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCAB_FILE)
    assert got == {i: model.encode(t) for i, t in kept}


def test_texts_of_words_of_several_languages_stay(spark, tmp_path):
    shared = "radio metro hotel"
    rows = [(100 * k + i, f"{own} {shared} {own}", lang, "s", 0) for k, (lang, own) in enumerate((("de", "und nicht auch"), ("en", "the which with"), ("es", "los pero como"))) for i in range(30)]
    rows += [(1000, shared, None, "s", 0), (1001, "12 34", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    models = corpus_pipeline.learn(df, vocab_file=queries.VOCAB_FILE)
    assert corpus_pipeline.identify(df, models, vocab_file=queries.VOCAB_FILE).where("doc_id = 1000").first()["score"] < 0.5
    assert {r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()} == {r[0] for r in rows} - {1001}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row int"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1, 2)] * 3 + [(5, "", None, None, 0, 1, 2)], [(1, "ein Wort", None, "s", 8, 1, 2)] * 2])
def test_empty_null_and_unlabelled_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = corpus_pipeline.written(after, "stage")
    assert [tuple(r) for r in docs.collect()] == [r for r in rows if r[1]]
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == docs.count()


def test_columns_between_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{i}" for i in range(1, 14)]
