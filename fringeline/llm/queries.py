"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.llm import bpe_codec, quality
from fringeline.llm.decontamination import contaminated
from fringeline.llm.jaccard_join import near_duplicates
from fringeline.llm.language_id import fold, identify, learn
from fringeline.llm.lm_scoring import scores
from fringeline.llm.personal_data import personal_spans
from fringeline.llm.resampling import resampled
from fringeline.llm.sentencepiece_codec import encoded_and_checked
from fringeline.llm.sharding import shards
from fringeline.llm.shared import dealt, discard, written
from fringeline.llm.spelling import spelling_variants
from fringeline.llm.substring_dedup import dedup_windows
from fringeline.llm.top_k import top_k


#: Where the public vocabularies are, on the driver and on every executor.
VOCAB_FILE = "/opt/tokenizers/piece_bpe_32k.model"
WORD_FILE = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and lang of all documents, on all cores."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of folds 1 to 4 of five (fold 4 calibrates); a document with several labels counts once for each.

    Null and empty texts are scored by their statistics, which are 0; rows without doc_id are in fold 0, with repeated
    ones all alike; other columns are not read.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(quality.with_statistics(docs), "stats").withColumn("fold", F.coalesce(fold("doc_id", 5), F.lit(0)))
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    learned = written(rows.where("fold <> 0").join(labels, "doc_id").select("stats", "label", (F.col("fold") == 4).alias("calibrate")), "learned")  # three passes read it
    model = quality.fit(learned)
    discard(learned)
    scored = quality.score(rows, model)
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), shards=16)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_checked(documents(spark, sf_dir), model_file=VOCAB_FILE)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    models = learn(docs.where(~F.col("held_out")), vocab_file=VOCAB_FILE)
    return identify(docs.drop("lang"), models, vocab_file=VOCAB_FILE).select("doc_id", "held_out", "lang_pred", "score")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(documents(spark, sf_dir), model_file=WORD_FILE)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_top_k": op8_top_k,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_bpe": op11_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}
#: SQL of the operators that SQL can express whole; the others are tested against brute force in tests/llm.
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP1_SQL = f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w WHERE len(ws) >= 50)),
least AS (SELECT k, min(doc_id) m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o i FROM (SELECT win.doc_id, win.i, unnest(range(0, 50)) o FROM win JOIN least ON win.k = least.k AND least.m < win.doc_id)),
pos AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) i FROM w),
kept AS (SELECT pos.doc_id, count(gone.i) n, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY pos.i) s FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(s, '')) kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL)} ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) c FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.k = b.k GROUP BY a.doc_id, b.doc_id),
links AS (SELECT common.a, common.b, i = x.c + y.c - i same FROM common JOIN n x ON common.a = x.doc_id JOIN n y ON common.b = y.doc_id WHERE 100 * i >= 75 * (x.c + y.c - i)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) n_shingles, coalesce((SELECT min(b) FROM links WHERE same AND a = w.doc_id), w.doc_id) class_id, coalesce((SELECT min(b) FROM reach WHERE a = w.doc_id), w.doc_id) component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""
OP8_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(q) x, unnest(range(0, len(q))) d FROM v),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) score FROM t a JOIN t b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
# The crc32 of the bytes by its table; a row belongs to the sixteenth of all bytes that holds its middle one.
OP6_SQL = """WITH RECURSIVE g AS (SELECT k, CAST(k AS BIGINT) v, 0 n FROM (SELECT range k FROM range(256)) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM g WHERE n < 8),
crc AS (SELECT list(v ORDER BY k) t FROM g WHERE n = 8),
h AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) size, hex(encode(coalesce(text, ''))) h FROM documents),
s AS (SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * size - 2, 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) END text_crc32 FROM h, crc),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before, sum(size) OVER () total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 nr FROM s),
p AS (SELECT doc_id, size, text_crc32, nr, CAST(least(15, ((coalesce(before, 0) + size // 2) * 16) // total) AS INT) shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) text_crc32, 'bytes' law, shard, CAST(nr - min(nr) OVER (PARTITION BY shard) AS BIGINT) slot, CAST(NULL AS INT) grown_shard FROM p"""
CRC_SQL = """RECURSIVE g AS (SELECT k, CAST(k AS BIGINT) v, 0 n FROM (SELECT range k FROM range(256)) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM g WHERE n < 8),
crc AS (SELECT list(v ORDER BY k) t FROM g WHERE n = 8)"""


def crc_sql(value: str) -> str:
    """The crc32 of a column's UTF-8 bytes (it is not empty), by the table of CRC_SQL."""
    digits = f"hex(encode({value}))"
    byte = f"CAST(16 * (strpos('0123456789ABCDEF', {digits}[i]) - 1) + strpos('0123456789ABCDEF', {digits}[i + 1]) - 1 AS BIGINT)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(2 * octet_length(encode({value})) AS BIGINT), 2), lambda i: {byte})), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295)"


OP12_SQL = f"""WITH {CRC_SQL},
w AS (SELECT 0 src, doc_id id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT src, id, unnest(ws) x FROM w UNION ALL SELECT src, id, ws[i] || ' ' || ws[i + 1] FROM (SELECT src, id, ws, unnest(range(1, len(ws))) i FROM w)),
h AS (SELECT x, {crc_sql("x")} % 10000 b FROM (SELECT DISTINCT x FROM f), crc),
c AS (SELECT src, id, b FROM f JOIN h USING (x)),
n AS (SELECT b, CAST(count(*) FILTER (src = 0) AS DOUBLE) s, CAST(count(*) FILTER (src = 1) AS DOUBLE) t FROM c GROUP BY b),
k AS (SELECT sum(s) s_all, sum(t) t_all FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) g FROM n, k),
d AS (SELECT id, count(*) n_features, CAST(sum(g) AS BIGINT) total FROM c JOIN gain USING (b) WHERE src = 0 GROUP BY id),
s AS (SELECT id doc_id, len(ws) n_words, coalesce(n_features, 0) n_features, CASE WHEN n_features > 0 THEN CAST((total - ((total % n_features + n_features) % n_features)) // n_features AS BIGINT) ELSE 0 END weight FROM w LEFT JOIN d USING (id) WHERE src = 0),
u AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) nr, count(*) OVER () n FROM u WHERE n_words >= 20)
SELECT u.doc_id, CAST(n_features AS BIGINT) n_features, CAST(weight AS BIGINT) weight, score, CASE WHEN nr <= 25 * n // 100 THEN CAST(nr AS BIGINT) END rank FROM u LEFT JOIN r ON u.doc_id = r.doc_id"""
# Two words are near if dropping a code point of one gives the other, or dropping one at the same place of both gives the same.
OP13_SQL = f"""WITH {CRC_SQL},
o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) x FROM documents),
l AS (SELECT doc_id || ':' || translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') y, count(*) n FROM o WHERE length(x) >= 6 GROUP BY ALL),
h AS (SELECT split_part(y, ':', 2) x, n, {crc_sql("y")} h FROM l, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(x, 1, CAST(h % length(x) AS INT)) || substr(x, CAST(h % length(x) AS INT) + 2) ELSE x END word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) n FROM v GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) i FROM w)),
near AS (SELECT DISTINCT a.word a, b.word b FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
best AS (SELECT a, count(*) n_near, max(w.n) m, min_by(b, (-w.n, b)) form FROM near JOIN w ON near.b = w.word GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN m >= 5 * w.n THEN form END form, CASE WHEN m >= 5 * w.n THEN m END form_n FROM w LEFT JOIN best ON w.word = best.a),
r AS (SELECT word, form last FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.last = f.word WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.last FROM r JOIN f ON r.last = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.last, f.word) root, f.n, CAST(n_near AS BIGINT) n_near, CAST(form_n AS BIGINT) form_n FROM f LEFT JOIN e ON f.word = e.word"""
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op6_sharding": OP6_SQL, "op8_top_k": OP8_SQL, "op12_importance_resampling": OP12_SQL, "op13_spelling_variants": OP13_SQL}
