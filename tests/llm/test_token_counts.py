"""Token counts against the library's own, whole text by whole text."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from faultline.llm.token_counts import UnitLengths, check_model, load_model, token_counts, tokens_of, units_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\r", "\t", "▁", "　", "\x00", "\x85", "é", "漢", "😀", "<s>", "</s>", "<0x0A>", "1", ",", ";\r", "don't"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return load_model(file.read())


def test_units_add_up_to_the_library_count(model):
    check_model(model)
    known, choose = UnitLengths(model, {}), random.Random(3)
    for _ in range(4000):
        text = "".join(choose.choice(PIECES) for _ in range(choose.randint(0, 25)))
        assert sum(known[u] for u in units_of(text)) == len(model.encode(text)), repr(text)


def test_tier_one_changes_no_count(spark, model):
    rows = [(i, "the cat sat on the mat " * (i % 7) + f"w{i}\nline", i) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, size long")
    got = {r.doc_id: r.n_tokens for r in token_counts(texts, PATH, order=["doc_id"]).collect()}
    assert got == {i: len(model.encode(t)) for i, t, _ in rows}


def test_odd_rows(spark, model):
    long = "word " * 200_000 + "x" * 50_000
    rows = [(1, None, "q"), (1, "", "q"), (None, " ", None), (2, "a  b", "q"), (2, "a  b", "q"), (3, long, "q")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, units string")
    got = token_counts(texts, PATH, order=["doc_id"])
    assert got.columns == ["doc_id", "text", "units", "n_tokens"]
    want = sorted(((i, len(model.encode(t)) if t else 0) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    assert token_counts(texts.limit(0), PATH, order=["doc_id"]).count() == 0


def test_texts_taken_together_count_as_by_themselves(model):
    choose, encoded = random.Random(8), []

    class Counted:
        def encode(self, units, **options):
            encoded.append(units)
            return model.encode(units, **options)

    texts = [choose.choice([None, "", " ", "".join(choose.choice(PIECES) for _ in range(choose.randint(0, 25)))]) for _ in range(2000)]
    known, column = UnitLengths(Counted(), {"the": 1}), pa.array(["skipped", *texts], pa.string()).slice(1)
    assert tokens_of(column, known).tolist() == [len(model.encode(t)) if t else 0 for t in texts]
    assert len(encoded) == 1 and len(set(encoded[0])) == len(encoded[0])  # one call, each unit once
    assert tokens_of(column.slice(5, 0), known).tolist() == [] and tokens_of(column, known).sum() == tokens_of(column[::-1], known).sum()
