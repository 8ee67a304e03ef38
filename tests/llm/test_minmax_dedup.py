"""Components against a comparison of all pairs, with small blocks, hot groups and odd rows; what signatures promise."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import minmax_dedup as dedup
from faultline.llm.support import WordHashes, mixed


def plain(rows, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        size = min(3, len(words))
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset())
    owners, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    for found in owners.values():
        common.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((x for x in ids[find(i)] if x is not None), default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=str)


def result(spark, rows):
    documents = spark.createDataFrame([(*r, b"x", 1, "t") for r in rows], "doc_id long, text string, node binary, n_shingles int, bucket string")
    return sorted((tuple(r) for r in dedup.near_duplicates(documents.repartition(3)).collect()), key=str)


def corpus(seed=1):
    choose = random.Random(seed)
    word = lambda: "".join(choose.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(choose.randint(5, 90))) for _ in range(80)]
    texts += [f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" for t in texts[:60]]
    base = [word() for _ in range(120)]
    for _ in range(200):  # a group of near copies whose pairs lie on both sides of the least similarity
        near = base.copy()
        for at in choose.sample(range(120), choose.randint(0, 5)):
            near[at] = word()
        texts.append(" ".join(near))
    chain = [word() for _ in range(100)]
    for _ in range(30):  # each linked with the next one only
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(" ".join(chain))
    texts += [texts[3]] * 50 + [texts[4].upper(), "two words", "Two WORDS", "two  words", "one", "a a a a a", "a a a a"]
    choose.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("block_rows, first", [(256, [(0, 2), (2, 6)]), (8, [(0, 1)])])
def test_equals_all_pairs(spark, monkeypatch, block_rows, first):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(dedup, "FIRST_BANDS", first)
    rows = corpus()
    want = plain(rows)
    assert len({r[2] for r in want}) < 250
    assert result(spark, rows) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, long), (4, long + " end"), (4, long + " end"), (5, "a b c d"), (None, "A B C D"), (None, "q r s t"), (None, "q r s t"), (6, "\xa0 x\x85y z É"), (7, "\xa0 x\x85y z é")]
    assert result(spark, rows) == plain(rows)
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_bands():
    assert dedup.BANDS * dedup.ROWS == 2 * dedup.PERMUTATIONS
    assert dedup.missed(dedup.LEAST_PERCENT / 100) < 1e-5


def signatures(seed, similarity, size, pairs):
    """Signatures of pairs of random sets with this similarity."""
    out = []
    common = round(2 * size * similarity / (1 + similarity))
    for pair in range(pairs):
        values = mixed(np.arange(2 * size - common, dtype=np.uint64) + np.uint64((seed * pairs + pair) * 1000))
        out.append([dedup.signature(values[:size]), dedup.signature(values[size - common :])])
    return np.array(out), common / (2 * size - common)


def test_signatures_are_unbiased_and_vary_less_than_minima():
    found, similarity = signatures(2, 0.7, 12, 4000)
    equal = found[:, 0] == found[:, 1]
    assert equal.mean() == pytest.approx(similarity, abs=0.005)
    both = equal[:, : dedup.PERMUTATIONS] & equal[:, dedup.PERMUTATIONS :]
    assert both.mean() < similarity**2  # minimum and maximum of a permutation exclude each other a little
    independent = similarity * (1 - similarity) / (2 * dedup.PERMUTATIONS)
    assert equal.mean(axis=1).var() < independent


def test_measured_recall():
    found, similarity = signatures(4, 0.85, 60, 4000)
    shared = (dedup.band_keys(found[:, 0]) == dedup.band_keys(found[:, 1])).any(axis=1)
    assert similarity == pytest.approx(0.85, abs=0.01) and shared.mean() >= 0.999


def test_shingles_of_a_long_text_do_not_depend_on_its_pieces(monkeypatch):
    choose = random.Random(8)
    text = " ".join(choose.choice("abcdefg") * choose.randint(1, 9) for _ in range(5000))
    whole = dedup.shingle_set(text, WordHashes())
    pieces = dedup.text_pieces
    monkeypatch.setattr(dedup, "text_pieces", lambda data: pieces(data, 100))
    assert (dedup.shingle_set(text, WordHashes()) == whole).all()
