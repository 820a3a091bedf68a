"""Corpus preparation: documents in, token ids out, one operator a stage.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept.  All but the last return
the columns of documents; rows and texts change as the stage decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.llm.decontamination import clean
from fringeline.llm.jaccard_join import near_duplicates
from fringeline.llm.language_id import LETTER, UNDETERMINED, identify, learn
from fringeline.llm.personal_data import redacted
from fringeline.llm.queries import VOCAB_FILE
from fringeline.llm.sentencepiece_codec import encode
from fringeline.llm.shared import fresh, named, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined; null texts and texts without a letter go.

    Repeated rows stay or go together; other columns pass through whatever their names; an empty table gives an empty one.
    Where no row has a lang to learn from, every text with a letter stays.
    """
    models = learn(docs, vocab_file=VOCAB_FILE)
    if not models:
        return docs.where(F.regexp_like(F.col("text").cast("string"), F.lit(LETTER)))
    pred, score = (fresh(docs, c) for c in ("lang_pred", "lang_score"))
    known = identify(docs, models, vocab_file=VOCAB_FILE, pred_column=pred, score_column=score)
    return known.where(F.col(pred) != UNDETERMINED).select(*map(named, docs.columns))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of linked ones; rows without doc_id stay, and rows of one doc_id together.

    Null and empty texts link with nothing and stay; other columns pass through; an empty table gives an empty one.
    """
    others = near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*map(named, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts stay.

    Repeated rows stay or go together; other columns pass through whatever their names; an empty table gives an empty one.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with personal data in the text replaced by its kind, and n_chars of the new text; null texts stay.

    Other columns pass through whatever their names; an empty table gives an empty one.
    """
    done = redacted(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, repeated ones too; a null text has null ids and no tokens; other columns go."""
    ids = encode(docs.select("doc_id", "text"), model_file=VOCAB_FILE)
    return ids.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: No stage but the third's matching can be said in SQL; tests compare the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
