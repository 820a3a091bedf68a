"""Small tables with the awkward rows every operator has to bear, and plain versions of the operators' rules."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t int, p string, key binary, shingles string, score string, ids string, `a.b` int, __base int"


def words(text):
    return WORDS.findall(text or "")


def made_texts(seed=1):
    """Texts with copies, near copies, shared passages, runs and periods of words."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "And", "und"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, base = say(70), say(180)
    out = [" ".join(say(n)) for n in (1, 2, 3, 4, 5, 6, 30, 49, 50, 51, 200)]
    out += [" ".join(say(40) + passage + say(30)) for _ in range(4)] + [" ".join(passage)] * 3
    for k in range(6):
        x = list(base)
        for _ in range(3 * k):
            x[r.randrange(len(x))] = r.choice(vocab)
        out.append("\t".join(x))
    out += ["same " * 60, "same " * 80, "x same " + "same " * 70, "a b " * 40, "b a " * 45, "c " + "a b " * 33, " ".join(base).upper(), " ".join(base) + "\n"]
    return out


ODD = [None, "", " \t\n", "one", "one", "  nbsp stays here", "x" * 20000, "😀 ü " * 30, "word " * 5000]


def table(spark, texts=None):
    """Rows in no order, with repeated rows, null ids and columns of clashing names."""
    texts = made_texts() + ODD if texts is None else texts
    rows = [(i, t, "en" if i % 3 else None, None, None, 1, "p", b"k", "s", "x", "y", 5, 6) for i, t in enumerate(texts)]
    rows += rows[3:5] + [(None, t, None, None, None, 1, "p", b"k", "s", "x", "y", 5, 6) for t in texts[8:10] + [None]]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
