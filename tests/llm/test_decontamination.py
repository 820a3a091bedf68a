import random

import numpy as np

from fringeline.llm.decontamination import clean, contaminated, lower

from .cases import SCHEMA, empty, table

ITEM = "A train leaves Boston at 9 and covers 120 miles in 2 hours before it meets Anna who paid 15 dollars; how fast did the train go?"
CHANGED = "yes. A train leaves Denver at 7 and covers 300 km in 5 hours before it meets Maria who paid 40 euros; how fast did the train go? End."
CLASH = "A train leaves Denver at 7 and covers 7 km in 5 hours before it meets Denver who paid 40 euros; how fast did the train go?"


def bench(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def test_kinds_and_slots(spark):
    texts = ["before " + ITEM.replace(" ", "\n") + " after", CHANGED, CLASH, "nothing of that sort is said here at all by anyone", None, ""]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(table(spark, texts[:4]).where("doc_id is not null"), bench(spark, [ITEM, None, ""])).collect()}
    assert got == {(0, 0): "exact", (1, 0): "reparameterised"}


def test_short_items_blocks_and_odd_rows(spark):
    items = ["seven small words make this whole item", "seven small words make this whole item", ITEM, None]
    texts = ["x seven small, words make this (whole) item y", ITEM.upper(), None, "", "z" * 5000]
    df = table(spark, texts + ["f"] * 8)
    got = {(r.doc_id, r.item_id) for r in contaminated(df, bench(spark, items), block_bytes=50).collect() if r.doc_id is not None}
    assert {(0, 0), (0, 1), (1, 2)} >= got >= {(0, 0), (0, 1)}


def test_clean_keeps_rows_and_columns(spark):
    df = table(spark, ["a " + ITEM, "clean text", None, ""] + ["more"] * 8)
    kept = clean(df, bench(spark, [ITEM]))
    assert kept.schema == df.schema
    assert sorted(kept.collect(), key=str) == sorted((r for r in df.collect() if ITEM not in (r.text or "")), key=str)


def test_exact_copies_as_brute_force_finds_them(spark):
    """Every item of which a text holds a window of 13 words (a shorter one whole), whatever the words are."""
    r = random.Random(7)
    vocab = ["the", "of", "Anna", "7", "12", "km", "hours", "Boston", "bake", "cake", "river", "3", "two", "Bob"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(r.choice([1, 3, 6, 8, 12, 13, 20, 40])) for _ in range(40)]
    texts = []
    for _ in range(60):
        one = list(r.choice(items))
        cut = sorted(r.sample(range(len(one) + 1), 2)) if len(one) > 13 and r.random() < 0.5 else (0, len(one))
        one = one[cut[0] : cut[1]]
        if one and r.random() < 0.3:
            one[r.randrange(len(one))] = "other"
        texts.append(" ".join(say(r.randrange(5)) + one + say(r.randrange(5))))

    def holds(text, item):
        low, n = [w.lower() for w in text.split()], min(13, len(item))
        own = [w.lower() for w in item]
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        return any(tuple(low[i : i + n]) in windows for i in range(len(low) - n + 1))

    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if holds(t, item)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.kind for x in contaminated(docs, bench(spark, [" ".join(i) for i in items])).collect()}
    assert {k for k, kind in got.items() if kind == "exact"} <= want <= set(got)


def test_short_items_of_numbers_and_single_clashes(spark):
    short = "What is 12 times 15 plus 7 minus 3 ?"
    long = " ".join(f"word{i}" for i in range(20)) + " 5 " + " ".join(f"next{i}" for i in range(14)) + " 9"
    docs = spark.createDataFrame([(0, f"so {short} yes"), (1, long[:-1] + "5"), (2, "What is that ?")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(docs, bench(spark, [short, long])).collect()}
    assert got == {(0, 0): "exact", (1, 1): "exact"}
    assert [r.doc_id for r in clean(docs, bench(spark, [short, long])).collect()] == [2]


def test_empty_tables(spark):
    assert contaminated(empty(spark), bench(spark, [ITEM])).collect() == []
    assert contaminated(table(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert clean(empty(spark), bench(spark, [ITEM])).columns == [c.split()[0].strip("`") for c in SCHEMA.split(", ")]


def test_exact_stretches_of_inconsistent_alignments(spark):
    long = "In the morning Anna buys 3 apples at the old market near the river and walks back home to bake a large cake for the whole class; later Anna sells 8 slices of it"
    once = long.replace("later Anna", "later Maria")
    merged = long.replace("3 apples", "8 apples")
    df = table(spark, ["x. " + once, "x. " + merged, CLASH] + ["f"] * 8)
    got = {(r.doc_id, r.item_id, r.kind, r.n_tokens, r.first_word) for r in contaminated(df, bench(spark, [long, ITEM])).collect()}
    assert got == {(0, 0, "exact", 28, 1), (1, 0, "exact", 28, 7)}
    assert {r.doc_id for r in clean(df, bench(spark, [long, ITEM])).collect()}.isdisjoint({0, 1})


def test_items_with_few_plain_words(spark):
    items = ["How many days in March?", "Compute 12 plus 30", "12 30 45 60 75 90 105 120 135 150 165 180 195 210 225", "Ask Anna, Bob, Cleo, Dora, Emil and Finn about 7 miles"]
    texts = [f"so. {x} there" for x in items] + ["Compute 14 plus 30"]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(table(spark, texts + ["f"] * 8), bench(spark, items)).collect() if r.doc_id is not None}
    assert got == {(i, i): "exact" for i in range(4)}


def test_copies_in_other_case_and_place(spark):
    items = ["How many small red apples are left in the old box?", ITEM, "Señora Íñigo Ñuñez of Ávila asks Ömer and Zoë about Łódź", "How many small red apples are left after 9 days?"]
    texts = ["Problem " + items[0], "Problem\n" + items[0], ITEM.upper(), ITEM.lower(), items[2].upper(), items[2].lower()]
    changed = ["Problem " + items[3].replace("9", "7"), "Problem\n" + items[3].replace("9", "7"), CHANGED.replace(" Denver", "\nDenver")]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(table(spark, texts + changed + ["f"] * 8), bench(spark, items)).collect() if r.doc_id is not None}
    assert got == {(k, i): "exact" for k, i in enumerate((0, 0, 1, 1, 2, 2))} | {(k, i): "reparameterised" for k, i in ((6, 3), (7, 3), (8, 1))}


def test_upper_cased_copy_is_required(spark):
    items = ["seven small words make this whole item", "seven small words make this whole item", ITEM, None]
    df = table(spark, ["x seven small, words make this (whole) item y", ITEM.upper(), None, "", "z" * 5000] + ["f"] * 8)
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench(spark, items), block_bytes=50).collect() if r.doc_id is not None} == {(0, 0), (0, 1), (1, 2)}


def test_lower_case_is_that_of_python():
    text = "".join(c for c in map(chr, range(0x20, 0x10000)) if not 0xD800 <= ord(c) < 0xE000)
    want = "".join(x if len(x := c.lower()) == 1 and len(x.encode()) == len(c.encode()) else c for c in text)
    data = np.frombuffer(text.encode(), np.uint8).copy()
    lower(data)
    assert data.tobytes().decode() == want


def test_items_with_a_null_id(spark):
    items = spark.createDataFrame([(None, ITEM), (None, "seven small words make this whole item"), (3, "another item that has no copy here"), (None, None)], "item_id long, text string")
    df = table(spark, ["a " + ITEM, "x seven small words make this whole item", "clean text"] + ["f"] * 8)
    assert {(r.doc_id, r.item_id, r.kind) for r in contaminated(df, items).collect() if r.doc_id is not None} == {(0, None, "exact"), (1, None, "exact")}
    assert {r.doc_id for r in clean(df, items, block_bytes=50).collect()} == {None, *range(2, 11)}


NAMES = "Anna Boris Clara David Elena Felix Greta Hugo Irene Jonas Karla Leo Mona Nils Olga Paul".split()
#: Short items and how their values change: {n} numbers, {a} and {b} names; units stay.
SHORT = (
    "What is {0} times {1} plus {2} minus {3} ?", "How many days are there in {0} weeks?", "Convert {0} miles to km", "If {a} has {0} apples and {b} has {1}, how many are there?",
    "Is {0} divided by {1} larger than {2}?", "{a} is {0} years old; how old is {b}, {1} years younger?", "Add {0} and {1}, then divide by {2}.", "How many minutes are in {0} hours and {1} minutes?",
)


def filled(form, r, taken=()):
    numbers = r.sample([n for n in range(2, 900) if n not in taken], 4)
    a, b = r.sample(NAMES, 2)
    return form.format(*numbers, a=a, b=b), set(numbers)


def test_short_items_with_other_values(spark):
    """Recall and precision on planted copies of short items with other values: all are found, and nothing else."""
    r = random.Random(11)
    items, texts, want = [], [], set()
    for k in range(80):
        text, taken = filled(SHORT[k % len(SHORT)], r)
        items.append(text)
        for n, around in enumerate(("{}", "Some words first. {} And more follow.", "So {} yes", "1)\n{}\nnext")):
            other, _ = filled(SHORT[k % len(SHORT)], r, taken)
            if other[-1] in "?." or n in (0, 3):
                want.add((len(texts), k % len(SHORT)))
            texts.append(around.format(other if other[-1] in "?." or n != 1 else other + "."))
            if texts[-1] != around.format(other):
                want.add((len(texts) - 1, k % len(SHORT)))
    decoys = ["they say that 5 times 7 plus 9 is a lot", "Convert 5 pounds to kg", "How many weeks are there in 3 days?", "there are 3 weeks", "What is 5 times 5 plus 6 minus 7 ?", "the list of 12 and 30"]
    texts += decoys
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = contaminated(docs, bench(spark, items)).collect()
    got = {(x.doc_id, x.item_id % len(SHORT)) for x in found}
    right = {g for g in got if g[0] < len(texts) - len(decoys)}
    assert got == right, [(texts[d], items[i]) for d, i in got - right]
    # numbers that happen to agree make other items' copies exact or clash; the form is right in all that is found
    assert right <= want | {(d, k) for d in range(len(texts)) for k in range(len(SHORT)) if d // 4 % len(SHORT) == k}
    assert len(want & right) >= 0.97 * len(want)


def test_long_items_of_few_plain_words(spark):
    item = "Sort 12, 45, 7, 88, 3, 91, 64, 25, 39, 70, 18, 52, 31, 6 and 77 in order"
    other = "Sort 13, 46, 8, 89, 4, 92, 65, 26, 40, 71, 19, 53, 32, 7 and 78 in order"
    clash = other.replace("46", "13")
    docs = spark.createDataFrame(list(enumerate([f"So. {other}. Then", f"So. {clash}. Then", other.removeprefix("Sort "), f"x {item} y"])), "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.n_tokens) for r in contaminated(docs, bench(spark, [item])).collect()}
    assert {(d, k) for d, k, _ in got} == {(0, "reparameterised"), (3, "exact")} and (0, "reparameterised", 19) in got
    assert {r.doc_id for r in clean(docs, bench(spark, [item])).collect()} == {1, 2}


def test_texts_of_megabytes(spark):
    """The item in the midst of a text of four megabytes."""
    filler = "some words of no interest 12 Anna km " * 55_000
    docs = spark.createDataFrame([(0, filler + CHANGED + " " + filler), (1, filler)], "doc_id long, text string")
    got = [tuple(r) for r in contaminated(docs, bench(spark, [ITEM])).select("doc_id", "item_id", "kind").collect()]
    assert got == [(0, 0, "reparameterised")]
