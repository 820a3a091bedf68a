import numpy as np
import pyarrow as pa
import pytest

from fringeline.llm import quality

from .cases import ODD, empty, made_texts, table


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array(ODD + made_texts()))
    assert x.shape == (len(ODD) + len(made_texts()), len(quality.STATISTICS)) and np.isfinite(x).all()
    assert (x[0] == 0).all() and (x[1] == 0).all()
    whole = quality.statistics(pa.array(ODD))
    assert np.allclose(whole, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in ODD]))


def test_isotonic_is_the_best_rising_fit():
    x, n, g = np.arange(6.0), np.array([1, 2, 1, 1, 3, 1.0]), np.array([0, 2, 0, 1, 1, 1.0])
    centre, level = quality.isotonic(x, n, g)
    assert (np.diff(level) > 0).all() and np.isclose(sum(n), 9)
    assert np.allclose(level, [0, 4 / 7, 1]) and centre[0] == 0


def test_held_out_accuracy(spark):
    r = np.random.default_rng(0)
    vocab = [f"wort{i}" for i in range(200)]
    good = [" ".join(r.choice(vocab, 60)) + "." for _ in range(150)]
    bad = [" ".join(w + "%%%" for w in r.choice(vocab, 60)) for _ in range(150)]
    df = table(spark, good + bad).where("doc_id is not null").select("doc_id", "text", "source")
    rows = quality.with_statistics(df).selectExpr("*", "if(doc_id < 150, 1, 0) label", "doc_id % 5 = 4 calibrate")
    model = quality.fit(rows.where("doc_id % 5 <> 0"))
    got = quality.score(rows.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([(s.score >= 0.5) == (s.label == 1) for s in got]) > 0.97
    assert all(0 <= s.score <= 1 for s in got)


def test_without_labels_or_rows(spark):
    rows = quality.with_statistics(table(spark).select("doc_id", "text")).selectExpr("*", "1 label", "false calibrate")
    assert quality.fit(rows.where("false")) is None
    assert {r.score for r in quality.score(rows, None).collect()} == {0.5}
    assert quality.with_statistics(empty(spark)).collect() == []


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    rows = quality.with_statistics(table(spark).select("doc_id", "text")).selectExpr("*", f"{label} label", "doc_id % 2 = 0 calibrate").where("doc_id is not null")
    assert all(abs(r.score - label) < 1e-6 for r in quality.score(rows, quality.fit(rows)).collect())
