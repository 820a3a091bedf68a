"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by a rare-first q-gram prefix filter.

A word's positional bigrams are ordered by how many words hold them, rarest first.  One edit touches at most two bigrams,
so of two near words' three rarest ones a pair is the same bigram, at most one position apart: if none were, a surviving
bigram of either word would have to stand before the three of the other.  Such pairs are joined, and verified.

The join's key is narrower than the bigram, and misses nothing: the edit lies in one half of the word, so the other half
is the same in both, and the lengths are known.  Lengths, side, half and bigram are the key, so a bigram that many
words share does not bring them together unless half of the word is the same too.  Bigrams are of 90 letters, so their
counts are at most 8100 rows.  All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeline.llm.resampling import lowered
from fringeline.llm.shared import discard, written

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]"
#: One of so many runs has a code point dropped.
EVERY = 199
#: The hint of joins between tables that grow with the words.
SORTED = "merge"


def occurrences(docs: DataFrame, *, shortest: int, every: int = EVERY) -> DataFrame:
    """word of each run of letters in whole texts, lower-cased, of `shortest` code points or more.

    The crc32 of `<doc_id>:<word>` drops one code point of every so many runs, at the crc32 modulo its length.
    """
    # shorter runs cannot become longer; a maximal run of so many letters is what the greedy pattern takes
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run")).withColumn("run", lowered(F.col("run")))
    h, size = F.crc32(F.concat("doc_id", F.lit(":"), "run")), F.char_length("run")
    at = (h % size).cast("int")
    typed = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    word = F.when(h % every == 0, typed).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= shortest)


def vocabulary(docs: DataFrame, *, shortest: int = 6, least: int = 5) -> DataFrame:
    """word and n of the words that occur at least so often; counted in each task before the exchange."""
    return occurrences(docs, shortest=shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest(words: DataFrame, most: int = 3) -> DataFrame:
    """word, size and its `most` rarest bigrams as gram and pos; equally rare ones by their letters and position."""
    size = F.char_length("word")
    grams = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(F.substring(F.col("word"), i, F.lit(2)).alias("gram"), i.alias("pos")))
    rows = words.select("word", F.inline(grams))
    # at most the square of the number of letters
    held = rows.groupBy("gram").agg(F.count("*").alias("held"))
    each = rows.join(F.broadcast(held), "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("held", "gram", "pos"))), 1, most).alias("first"))
    return each.select("word", F.char_length("word").alias("size"), F.inline("first")).drop("held")


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b, each pair once, of words (of at least four code points) one edit apart; a is the shorter, or the smaller of two equally long ones.

    A null word is near nothing; repeated words count once; an empty table gives no pairs.
    """
    grams = rarest(words.select("word").where("word IS NOT NULL").distinct())
    sides = F.explode(F.array(F.lit("start"), F.lit("end")))

    def half(word: Column, n: Column) -> Column:
        return F.when(F.col("side") == "start", F.substring(word, F.lit(1), n)).otherwise(F.substring(word, -n, n))

    # the shorter word's length names the pair: half of it is the same in both
    one = grams.select(F.col("word").alias("a"), "gram", F.col("pos").alias("pos_a"), "size", sides.alias("side"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    one = one.withColumn("half", half(F.col("a"), (F.col("size") / 2).cast("int")))
    two = grams.select(F.col("word").alias("b"), "gram", F.col("pos").alias("pos_b"), F.col("size").alias("own"), sides.alias("side"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    two = two.withColumn("size", F.col("own") - F.col("more")).withColumn("half", half(F.col("b"), (F.col("size") / 2).cast("int")))
    near = (F.abs(F.col("pos_a") - F.col("pos_b")) <= F.col("more")) & ((F.col("more") == 1) | (F.col("a") < F.col("b")))
    found = one.join(two.drop("own").hint(SORTED), ["gram", "size", "side", "more", "half"]).where(near & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms (word, form) lead to.  Each round doubles the steps, over written tables.

    Forms must not lead back to a word.  Where no form has one itself, the first round is the last.
    """
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(step.join(ahead.hint(SORTED), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(step)
        step = after.select("word", "root")
        step._written_path = after._written_path
        if after.where("moved").limit(1).count() == 0:
            return step


def variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """word, n, form, root, n_near and form_n of words (word, n).

    form is the near word of largest n (ties: the smallest in code-point order) if that is at least `times` the word's own.
    A null word is dropped, and of repeated ones the largest n counts; an empty table gives no rows.
    """
    words = written(words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").cast("long").alias("n")), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    # the larger n and then the smaller word: the least of (-n, word)
    best = both.join(other.hint(SORTED), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("word"))).alias("best"))
    rows = words.join(best.withColumnRenamed("a", "word").hint(SORTED), "word", "left")
    has = -F.col("best.minus") >= times * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")), "forms")
    discard(words)
    discard(pairs)
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends.hint(SORTED), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """variants() of the vocabulary of whole texts.

    Null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows count each; other columns are
    ignored whatever their names; an empty table gives no rows.  Texts of any length are taken whole.
    """
    return variants(vocabulary(docs, shortest=shortest, least=least), times=times)
