"""The linear-time score against all pairs, held-out accuracy, and odd rows."""

import pathlib

import numpy as np
import pytest

from faultline.llm.quality_classifier import FactorisationMachine, classifier_score, features, fit_classifier, op10_quality_classifier, train
from faultline.llm.support import WordHashes

DATA = "/root/testdata/sf0.01"


def test_margin_equals_the_sum_over_pairs():
    random = np.random.default_rng(3)
    model = FactorisationMachine(0.3, random.normal(size=20), random.normal(size=(20, 4)))
    numbers, values = np.array([1, 4, 7, 19]), np.array([0.5, 1.0, 2.0, 0.1])
    pairs = sum(model.factor[a] @ model.factor[b] * x * y for i, (a, x) in enumerate(zip(numbers, values, strict=True)) for b, y in list(zip(numbers, values, strict=True))[i + 1 :])
    assert model.margin(numbers, values) == pytest.approx(0.3 + model.weight[numbers] @ values + pairs)


def test_interactions_are_learned():
    rows = [(int(a != b), np.array([a, 2 + b]), np.ones(2)) for a in (0, 1) for b in (0, 1)] * 100
    model = train(rows, 4)
    assert all((model.score(n, v) >= 0.5) == bool(y) for y, n, v in rows[:4])


def test_features():
    hashes = WordHashes()
    for text, metadata in ((None, (None,)), ("", (float("nan"),)), ("a b a", (12.0,)), ("x " * 100_000, (-5.0,))):
        numbers, values = features(text, metadata, hashes)
        assert len(numbers) == len(values) and len(set(numbers.tolist())) == len(numbers)
    assert features("a b a", (), hashes)[1][:2].sum() == pytest.approx(1)


def test_odd_rows_and_bounds(spark):
    rows = [(i, "good plain words of text " * 20 if i % 2 else "BAD!! $$$ %%% " * 20, i % 2, 5) for i in range(200)]
    odd = [(None, None, 1, None), (7, "", 1, 3), (8, "good plain words of text", None, 4), (8, "good plain words of text", None, 4)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, quality int, n_chars long").selectExpr("*", "'x' as score", "'y' as numbers")
    model = fit_classifier(table.where("quality is not null"), "text", "quality", ["n_chars"])
    got = table.select("text", "quality", classifier_score(spark, model, "text", ["n_chars"]).alias("s")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.s <= 1 for r in got)
    assert np.mean([(r.s >= 0.5) == bool(r.quality) for r in got[: len(rows)]]) > 0.99
    untrained = fit_classifier(table.limit(0), "text", "quality", ["n_chars"])
    assert {r.s for r in table.select(classifier_score(spark, untrained, "text", ["n_chars"]).alias("s")).collect()} == {0.5}
    one_kind = fit_classifier(table.where("quality = 1"), "text", "quality", ["n_chars"])
    assert table.select(classifier_score(spark, one_kind, "text", ["n_chars"]).alias("s")).first().s > 0.9


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [r for r in op10_quality_classifier(spark, DATA).collect() if r.held_out and r.doc_id in truth]
    right = {y: np.mean([r.predicted == y for r in held if truth[r.doc_id] == y]) for y in (0, 1)}
    assert right[0] > 0.7 and right[1] > 0.97
