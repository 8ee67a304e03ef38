"""The audit against a plain walk through every order, galloping against sets, and odd rows."""

import random
from collections import Counter
from itertools import permutations

import pytest

from faultline.llm import filter_audit as fa
from faultline.llm import support
from faultline.llm.support import join_beside_hot, materialise, text_pieces


@pytest.mark.parametrize("seed", range(30))
def test_galloping_equals_sets(seed):
    choose = random.Random(seed)
    lists = [sorted(choose.sample(range(60), choose.choice([0, 1, 5, 40]))) for _ in range(choose.randint(0, 5))]
    assert fa.union(lists) == sorted(set().union(*lists))
    a, b = (sorted(choose.sample(range(90), choose.choice([0, 1, 7, 60]))) for _ in range(2))
    assert fa.difference(a, b) == sorted(set(a) - set(b))
    for wanted in range(0, 95, 7):
        assert fa.gallop(a, 0, wanted) == sum(x < wanted for x in a)


def plain(documents, labels):
    """The audit by applying every order to every document."""
    least = {}
    for doc_id, text, _ in documents:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    rows = []
    for doc_id, text, lang in documents:
        text = text or ""
        words = text.encode().split()
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text)}
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and doc_id > least[text]}
        marks = [any(d == doc_id and doc_id is not None and row[at] == 1 for d, *row in labels) for at in (0, 1)]
        rows.append((lang or "", {f for f in fails if fails[f]}, *marks))
    out = Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for at, f in enumerate(order):
                before, key = set(order[:at]), (part, "".join(order), at + 1)
                for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    out[key, name] = 0
                for _, failed, good, toxic in (r for r in rows if r[0] == part):
                    out[key, "kept"] += not failed & (before | {f})
                    out[key, "unique_fails"] += failed == {f}
                    if f in failed:
                        first = not failed & before
                        out[key, "removed" if first else "redundant"] += 1
                        out[key, "good_lost"] += first and good
                        out[key, "toxic_lost"] += first and toxic
    return out


def check(got, documents, labels):
    want = plain(documents, labels)
    keys = {key for key, _ in want}
    assert {(r.part, r.filter_order, r.step) for r in got} == keys and len(got) == len(keys)
    shapley = Counter()
    for r in got:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[(r.part, r.filter_order, r.step), name], (r, name)
        shapley[r.part, r.filter_order[r.step - 1]] += r.removed
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)


def of(spark, documents, labels):
    docs = spark.createDataFrame([(*d, 1, "x") for d in documents], "doc_id long, text string, lang string, row int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = fa.numbered(fa.document_failures(docs.repartition(3)))
    return fa.audit(fa.with_marks(fa.with_copies(rows, "E"), marks), list(fa.FILTERS)).collect()


def test_equals_every_order(spark, monkeypatch):
    monkeypatch.setattr(fa, "RANGE_BITS", 4)  # many ranges, also within one written part
    monkeypatch.setattr(fa, "RANGE_ROWS", 16)
    choose = random.Random(3)
    documents, labels = [], []
    for i in range(250):
        words = [f"{choose.choice('aBcD')}{choose.randrange(300)}" for _ in range(choose.choice([20, 99, 100, 150]))]
        words += choose.choice([["$"], [], [], words[:60]])
        documents.append((i, " ".join(words), choose.choice(["de", "en", None, ""])))
        labels += [(i, choose.randint(0, 1), choose.randint(0, 1))] * choose.randint(0, 2)
    documents += [(300 + i, documents[i % 7][1], "en") for i in range(80)]
    check(of(spark, documents, labels), documents, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    documents = [(1, None, "a"), (2, "", "a"), (None, "", None), (None, long, ""), (4, long, "b"), (5, long, "b"), (5, long, "b"), (6, "É" * 9 + "A", "b"), (7, "x y " * 100, "c"), (8, "\t\n ", "c")]
    labels = [(2, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    check(of(spark, documents, labels), documents, labels)
    assert of(spark, [], []) == []


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(support, "EASY_ROWS", 10)
    monkeypatch.setattr(support, "HOT_KEYS", 20)
    keys = [1] * 900 + [2] * 40 + list(range(3, 60)) + [None] * 5
    rows = materialise(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int"), "rows")
    facts = spark.createDataFrame([(k, k * 10) for k in range(0, 50)], "k int, fact int")
    got = join_beside_hot(rows, facts, "k").collect()
    assert sorted((r.i, r.fact) for r in got) == [(i, None if k is None or k >= 50 else k * 10) for i, k in enumerate(keys)]
    assert join_beside_hot(rows.limit(0), facts, "k").count() == 0


def test_pieces_of_a_text():
    choose = random.Random(5)
    data = b"".join(choose.choice([b"a", b"bb", b" ", b"\n"]) for _ in range(5000)) + b"c" * 500
    for size in (1, 10, 64, 10_000):
        pieces = list(text_pieces(data, size))
        assert b"".join(pieces) == data and [w for p in pieces for w in p.split()] == data.split()
    assert list(text_pieces(b"")) == [b""]
