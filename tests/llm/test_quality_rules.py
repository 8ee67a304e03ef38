"""Rule counts by a plain reading of the rules, and the forest's verdicts on planted rows."""

import random
import re
from collections import Counter

import numpy as np

from faultline.llm.quality_rules import COUNTS, QualityRules, base_failed, count_rules, fit_rules, grow_forest, mean_search_depth, rule_counts, statistics, threshold_of
from faultline.llm.support import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside))


def test_counts_equal_a_plain_reading():
    choose, hashes = random.Random(5), WordHashes()
    parts = ["a", "b", "é", "漢字", "#", "|", "a b a b a b", "\n", "\n", " ", "\t", "\x0b", "\x85", "\xa0", "　", "\x1c", "Und"]
    for _ in range(3000):
        text = "".join(choose.choice(parts) for _ in range(choose.randint(0, 30)))
        assert count_rules(text, hashes)[:5] == plain_counts(text), repr(text)
    assert count_rules(None, hashes)[:5] == plain_counts(None)


def test_path_lengths():
    points = np.concatenate([np.zeros((500, 2)), [[9.0, 9.0]]])
    scores = grow_forest(points).scores(points)
    assert scores[-1] > scores[:-1].max()
    assert mean_search_depth(2) == 1 and mean_search_depth(1) == 0
    one_value = grow_forest(np.ones((50, 3)))
    assert len(set(one_value.scores(np.ones((4, 3))))) == 1


def documents():
    choose = random.Random(2)
    prose = lambda n: " ".join("".join(choose.choice("abcdefgh") for _ in range(choose.randint(3, 8))) for _ in range(n))
    rows = [(i, prose(80)) for i in range(400)]
    rows += [(1000 + i, prose(70).replace(" ", "$$$ ")) for i in range(12)]
    rows += [(2000 + i, prose(70).upper().replace(" ", "!! ")) for i in range(12)]
    return rows + [(3000, None), (3001, ""), (3002, "few words"), (None, prose(90)), (5, rows[5][1]), (3003, "same " * 100)]


def test_verdicts(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i is not None and i % 2 == 0] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    counts = rule_counts(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")).cache()
    rules = fit_rules(counts, labels)
    got = [(r.doc_id, r.kept) for r in counts.select("doc_id", rules.kept_counts(spark, COUNTS).alias("kept")).collect()]
    kept = sorted((i for i, k in got if k), key=str)
    assert len(got) == len(rows)
    assert kept == sorted([*range(400), 5, None], key=str)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in texts.where(rules.kept_text(spark)).collect()), key=str) == kept


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    texts = spark.createDataFrame(documents()[:50], "doc_id long, text string")
    rules = fit_rules(rule_counts(texts), labels)
    assert rules.threshold == 1.0 and texts.where(rules.kept_text(spark)).count() == 50
    none = fit_rules(rule_counts(texts.limit(0)), labels)
    assert none == QualityRules(None, 1.0) and rule_counts(texts.limit(0)).count() == 0


def test_fixed_rules():
    assert base_failed(49, 0) and not base_failed(50, 25) and base_failed(50, 26)
    assert statistics(np.zeros((1, len(COUNTS)), np.int64)).shape == (1, 6)


def test_good_outliers_among_few_labels_leave_the_forest_on(spark):
    rows = [(i, text) for i, text in documents() if i is not None and i < 3000 and i != 5]
    choose = random.Random(4)
    odd = [(4000 + i, "".join(choose.choice("abcdefgh") for _ in range(300)) + "$$$!!! " + rows[i][1].upper().replace(" ", "$$$$!!!! ")) for i in range(3)]
    counts = rule_counts(spark.createDataFrame(rows + odd, "doc_id long, text string")).cache()
    for every in (1, 2, 4):  # the share of labels differs, the verdicts don't
        labels = spark.createDataFrame([(i, int(i < 1000 or i >= 4000)) for i, _ in rows + odd if i % every == 0 or i >= 4000], "doc_id long, quality int")
        rules = fit_rules(counts, labels)
        kept = {r.doc_id for r in counts.where(rules.kept_counts(spark, COUNTS)).collect()}
        assert kept == {i for i, _ in rows if i < 1000}


def test_threshold_of_least_weighted_error():
    assert threshold_of([(400, 300, 0), (620, 0, 20), (770, 1, 0)]) == 0.5095  # midway between 0.400 and 0.619
    assert threshold_of([(400, 3000, 0), (620, 0, 200), (770, 10, 0)]) == 0.5095
    assert threshold_of([(400, 300, 20), (620, 1, 0)]) == 1.0  # bad rows that look like good ones are not worth a good row
    assert threshold_of([(400, 999, 0), (500, 1, 0), (600, 1, 0)]) == 0.5  # good rows only: one in 1,000 may go
    assert threshold_of([(400, 0, 5)]) == threshold_of([]) == 1.0
