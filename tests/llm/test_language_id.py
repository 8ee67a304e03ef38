"""Kernel values against sets of n-grams, held-out accuracy, and odd rows."""

import pathlib

import numpy as np
import pytest

from faultline.llm.language_id import WIDTHS, fit_languages, fit_ridge, has_letter, language_of, op8_language_id, presence, scaled

DATA = "/root/testdata/sf0.01"


def place_sets(text):
    """For each n, the places of the text's n-grams, each looked up by itself."""
    out, offset = [], 0
    for n, width in WIDTHS.items():
        grams = sorted({text[i : i + n] for i in range(len(text) - n + 1)})
        out.append({int(np.flatnonzero(row[offset : offset + width])[0]) for row in presence(grams)})
        offset += width
    return out


def test_kernel_is_the_mean_cosine_of_ngram_sets():
    texts = ["the cat sat", "the dog sat down", "der hund"]
    rows = scaled(presence(texts))
    for i, a in enumerate(map(place_sets, texts)):
        for j, b in enumerate(map(place_sets, texts)):
            want = np.mean([len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(a, b, strict=True)])
            assert rows[i] @ rows[j] == pytest.approx(want, abs=1e-6)
    assert (presence(["The CAT"]) == presence(["the cat"])).all()


def test_full_landmarks_give_exact_kernel_ridge():
    texts = ["the cat sat on a mat", "a dog and the bone", "der hund und die katze", "ein haus mit garten"]
    model = fit_ridge(["en", "en", "de", "de"], presence(texts), np.ones(4, bool))
    assert [x for x, _ in model.predict(texts)] == ["en", "en", "de", "de"]
    assert all(0 <= p <= 1 for _, p in model.predict(texts))


def rows():
    out = [(i, f"the house and that ship number {i} with this", "en") for i in range(30)]
    return out + [(100 + i, f"das haus und nicht schiff nummer {i} mit der", "de") for i in range(30)]


def test_odd_rows(spark):
    odd = [(None, "the house", "en"), (500, None, "en"), (501, "", "de"), (502, "123 !!", "en"), (503, "the house and", None), (503, "the house and", None), (504, "das haus und " * 50_000, None)]
    texts = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "'y' as place")
    model = fit_languages(texts)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): r.found for r in texts.select("doc_id", "text", language_of(spark, model).alias("found")).collect()}
    assert len(got) == len(rows()) + len(odd) - 1
    assert all(got[i, t].lang_pred == "und" and got[i, t].score == 0 for i, t, _ in odd[1:4])
    assert got[503, "the house and"].lang_pred == "en" and got[odd[-1][:2]].lang_pred == "de"


def test_nothing_to_learn(spark):
    texts = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = fit_languages(texts.limit(0))
    assert {r.found.lang_pred for r in texts.select(language_of(spark, model).alias("found")).collect()} == {"und"}
    assert texts.limit(0).select(language_of(spark, model)).count() == 0


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op8_language_id(spark, DATA).collect() if r.held_out]
    assert len(held) > 250 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("text, letters", [("½ ² ①", False), ("Ⅷ", False), ("12 _ !", False), ("é", True), ("12 ß", True), ("ª", True), ("\u0301", False)])
def test_numerals_are_no_letters(text, letters):
    assert has_letter(text) is letters
