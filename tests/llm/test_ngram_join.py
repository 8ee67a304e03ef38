"""The join against all pairs, whatever the leaf size, with hot groups and odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import ngram_join as join
from faultline.llm.components import connected_components


def plain(rows, similarity=0.8):
    """class_id and n_links of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().split()
        size = min(5, len(words))
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset())
    owners, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    for found in owners.values():
        common.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((doc_id, least[find(i)] if sets[i] else doc_id, links[i]) for i, (doc_id, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    choose = random.Random(seed)
    word = lambda: "".join(choose.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(choose.randint(20, 120))) for _ in range(120)]
    texts += [f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" for t in texts[:60]]
    base = [word() for _ in range(100)]
    for _ in range(150):  # a group of near copies, each with up to three words changed
        near = base.copy()
        for _ in range(choose.randint(0, 3)):
            near[choose.randrange(100)] = word()
        texts.append(" ".join(near))
    for t in texts[:40]:
        words = t.split()
        words[choose.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [texts[3]] * 60 + ["two words", "two words", "two  words", "one", "a a a a a a a a a a", "a a a a a a a"]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("leaf_rows, block_rows", [(256, 512), (8, 16)])
def test_equals_all_pairs(spark, monkeypatch, leaf_rows, block_rows):
    monkeypatch.setattr(join, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(join, "BLOCK_ROWS", block_rows)
    rows = corpus()
    documents = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int").repartition(4)
    assert sorted((tuple(r) for r in join.ngram_join(documents).collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, long), (4, long + " end"), (4, long + " end"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (6, "\xa0 x\x85y z")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in join.ngram_join(documents).collect()), key=str) == plain(rows)
    assert join.ngram_join(documents.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(9, "a b c d e f g", 1), (3, "a b c d e f g", 2), (3, "a b c d e f g", 2), (None, "a b c d e f g", 3), (4, "h i j k l m", 4), (5, None, 5), (5, None, 5), (6, " ", 6), (None, "n o p q r", 7), (3, "other text with the same id", 8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, id_key int")
    kept = join.one_of_each_group(documents)
    assert kept.columns == documents.columns
    assert sorted(r.id_key for r in kept.collect()) == [2, 4, 5, 5, 6, 7, 8]
    assert join.one_of_each_group(documents.limit(0)).count() == 0


def test_runs_reach_the_recall():
    for recall in (0.9, 0.995):
        missed = (1 - join.survival(0.8, join.MAX_DEPTH)) ** join.runs_for(0.8, recall)
        assert missed <= 1 - recall
    assert join.survival(0.8, 0) == 1 and join.survival(0.8, 1) == pytest.approx(0.84)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100}


def test_recall_counts_that_runs_share_signatures():
    assert join.expected_recall(0.8, join.runs_for(0.8, join.RECALL), join.MAX_DEPTH) >= join.RECALL >= 0.9999
    assert join.expected_recall(0.8, 8, 1) > join.expected_recall(0.8, 8, join.MAX_DEPTH)
    with pytest.raises(ValueError, match="margin"):
        join.runs_for(0.8, 1.0)


def test_links_of_a_large_group_at_full_depth(spark, monkeypatch):
    monkeypatch.setattr(join, "LEAF_ROWS", 1)  # every bucket is split to the depth limit
    choose = random.Random(6)
    word = lambda: "".join(choose.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(200)], []
    for i in range(250):  # two changed words each: pairs of a similarity of 0.81 to 0.85
        near = base.copy()
        for at in choose.sample(range(5, 195), 2):
            near[at] = word()
        rows.append((i, " ".join(near)))
    want = plain(rows)
    got = sorted((tuple(r) for r in join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert sum(r[2] for r in want) > 50_000
    assert sum(r[2] for r in got) >= 0.9999 * sum(r[2] for r in want)
    assert [r[:2] for r in got] == [r[:2] for r in want]


def test_sets_of_texts_hashed_together():
    """As many shingles, and as many in common, as word by word; what a text's neighbours are changes nothing."""
    choose = random.Random(11)
    parts = ["a", "b", "longer-word", "é", "\x00", "a\x00", "x" * 8, "x" * 9, "y" * 64, "y" * 65, "z" * 200, "\xa0", " ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    texts = [choose.choice([None, "", " ", " ".join(choose.choice(parts) for _ in range(choose.randint(0, 30)))]) for _ in range(1500)]
    words = [(t or "").encode().split() for t in texts]
    plain = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    got = join.sets_of(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert [len(s) for s in got] == [len(s) for s in plain]
    assert all((np.diff(s.astype(object)) > 0).all() for s in got)
    for _ in range(3000):
        a, b = choose.randrange(1500), choose.randrange(1500)
        assert len(np.intersect1d(got[a], got[b])) == len(plain[a] & plain[b])
    assert all((join.sets_of(pa.array([t], pa.string()))[0] == s).all() for t, s in zip(texts[:200], got, strict=False))
    assert join.sets_of(pa.array([], pa.string())) == []
