"""Quality rules: counted statistics of whole texts, and an isolation forest that judges their combination.

The forest follows its usual definition: every tree splits a subsample of rows at random values of random statistics,
and a row that is alone after few splits is anomalous. A row's score is 2^(-mean path length / expected length). The
threshold comes from all labelled rows, as a histogram of scores for each label: of all cuts between scores the one of
least weighted error, which is GOOD_WEIGHT times the share of good rows rejected plus the share of bad rows kept. Shares
don't depend on the number of labels, and a few odd good rows don't move the cut. The threshold lies midway between the
labelled rows on both sides of the cut; among cuts of equal error the one that rejects least counts. Without bad rows the
threshold is the lowest score above which no more than `good_loss` of the good ones lie; without good rows nothing is
rejected by the forest.

Defined results: null and empty texts have no words and fail the base rules. Repeated rows and ties give a row each.
An empty table gives an empty result. Only the id and the text are read, so other columns and their names don't matter.
A text of any length is counted whole; its words are held while it is (some 50 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import WordHashes, hash_sample, materialise, mixed, share, slices, table, word_hashes

#: Rows of a tree, trees, and so the rows of the fitting sample (those of low hash).
TREE_ROWS, TREES = 256, 100
#: A share of good labelled rows rejected weighs as much as so many times that share of bad ones kept.
GOOD_WEIGHT = 10
#: Share of the good labelled rows that the forest may reject where no row is labelled bad.
GOOD_LOSS = 0.001
SCORE_BINS = 1000
#: The range of each figure in ordinary prose.
ORDINARY = {
    "word length": (3, 10),
    "symbols a word": (0, 0.1),
    "share of repeated lines": (0, 0.3),
    "share of repeated words": (0, 0.2),
    "share of capitals": (0, 0.3),
    "marks a word": (0, 0.5),
}
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, MARKS = bytes(range(65, 91)), b"!?.,;:"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def repeated_words(words: list[bytes], hashes: WordHashes) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    factor = np.uint64(0x9E3779B97F4A7C15)
    window = mixed((word[:-2] * factor + word[1:-1]) * factor + word[2:])
    ordered = np.sort(window)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.isin(window, again)
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(words) - 2 + shift] |= twice
    return int(inside.sum())


def count_rules(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The counts named in COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    without = lambda characters: len(data) - len(data.translate(None, characters))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - without(BLANKS),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
        len(lines),
        without(UPPER),
        without(MARKS),
    )


def base_failed(n_words, n_repeat_words):
    """The fixed rules, for columns as well as for numbers."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def statistics(counts: np.ndarray) -> np.ndarray:
    """The forest's inputs: by how much each rule's figure exceeds the range of ordinary prose (ORDINARY).

    Ordinary documents meet in one point, so short paths belong to those that break rules, alone or in combination.
    """
    n_words, word_chars, n_symbols, dup_lines, repeat_words, n_lines, n_upper, n_marks = counts.astype(float).T
    words, characters = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    figures = {
        "word length": word_chars / words,
        "symbols a word": n_symbols / words,
        "share of repeated lines": dup_lines / np.maximum(n_lines, 1),
        "share of repeated words": repeat_words / words,
        "share of capitals": n_upper / characters,
        "marks a word": n_marks / words,
    }
    return np.stack([np.maximum(v - ORDINARY[k][1], 0) + np.maximum(ORDINARY[k][0] - v, 0) for k, v in figures.items()], axis=1)


@dataclass
class Forest:
    """Trees as arrays: node 2i+1 and 2i+2 are below node i; `depth` of a leaf includes what its rows would still need."""

    feature: np.ndarray
    split: np.ndarray
    depth: np.ndarray
    height: int
    expected: float

    def scores(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, split, depth in zip(self.feature, self.split, self.depth, strict=True):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.height):
                at = feature[node]
                below = 2 * node + 1 + (points[rows, at] >= split[node])
                node = np.where(at >= 0, below, node)
            total += depth[node]
        return 2.0 ** (-total / len(self.feature) / self.expected)


def mean_search_depth(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(sample: np.ndarray, seed: int = 11, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    random = np.random.default_rng(seed)
    rows = min(tree_rows, len(sample))
    height = int(np.ceil(np.log2(max(rows, 2))))
    nodes = 2 ** (height + 1)
    forest = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), height, max(mean_search_depth(rows), 1e-9))
    for tree in range(trees):
        open_nodes = [(0, 0, sample[random.choice(len(sample), rows, replace=False)])]
        while open_nodes:
            node, depth, points = open_nodes.pop()
            low, high = points.min(axis=0), points.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth == height or len(points) < 2 or not len(splittable):
                forest.depth[tree, node] = depth + mean_search_depth(len(points))
                continue
            feature = int(random.choice(splittable))
            split = random.uniform(low[feature], high[feature])
            right = points[:, feature] >= split
            if right.all():  # the draw met the lowest value
                split = np.nextafter(low[feature], high[feature])
                right = points[:, feature] >= split
            forest.feature[tree, node], forest.split[tree, node] = feature, split
            open_nodes += [(2 * node + 1, depth + 1, points[~right]), (2 * node + 2, depth + 1, points[right])]
    return forest


@dataclass
class QualityRules:
    """A fitted forest (none where there was nothing to fit) with its threshold."""

    forest: Forest | None
    threshold: float

    def kept(self, counts: np.ndarray) -> np.ndarray:
        passed = ~base_failed(counts[:, 0], counts[:, 4])
        if self.forest is not None and len(counts):
            passed &= self.forest.scores(statistics(counts)) <= self.threshold
        return passed

    def kept_counts(self, spark: SparkSession, columns: list[str]) -> Column:
        """The verdict from columns of counts."""
        rules = share(spark, self)

        @F.arrow_udf("boolean")
        def verdict(*counts: pa.Array) -> pa.Array:
            return pa.array(rules().kept(np.stack([c.to_numpy(zero_copy_only=False) for c in counts], axis=1)))

        return verdict(*columns)

    def kept_text(self, spark: SparkSession, text: str = "text") -> Column:
        """The verdict from a text."""
        rules = share(spark, self)

        @F.arrow_udf("boolean")
        def verdict(texts: pa.Array) -> pa.Array:
            counts = [count_rules(t, word_hashes()) for t in texts.to_pylist()]
            return pa.array(rules().kept(np.array(counts, np.int64).reshape(-1, len(COUNTS))))

        return verdict(text)


def rule_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the counts of every row, from one pass over the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches):
            counted = [count_rules(t, hashes) for t in batch.column(1).to_pylist()]
            columns = np.array(counted, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *COUNTS])

    chosen = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in COUNTS))


def threshold_of(bins: list[tuple[int, int, int]], good_loss: float = GOOD_LOSS) -> float:
    """The threshold from (bin, good rows, bad rows), ascending. A bin is the upper edge of its scores times SCORE_BINS."""
    n_good, n_bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not n_good:
        return 1.0
    if not n_bad:
        above = 0
        for edge, good, _ in reversed(bins):
            above += good
            if above > good_loss * n_good:
                return edge / SCORE_BINS
        return 1.0
    threshold, lost, kept = 1.0, 0, n_bad
    least = kept * n_good
    for (edge, *_), (upper, good, bad) in zip(reversed(bins[:-1]), reversed(bins[1:]), strict=True):
        lost, kept = lost + good, kept - bad
        error = GOOD_WEIGHT * lost * n_bad + kept * n_good  # in whole numbers, so equal errors are equal
        if error < least:
            threshold, least = (edge + upper - 1) / 2 / SCORE_BINS, error
    return threshold


def fit_rules(counts: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> QualityRules:
    """The forest over `counts` (as rule_counts gives them) and its threshold from `labels` (doc_id, quality 0 or 1)."""
    spark = counts.sparkSession
    judged = counts.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    sample = sorted(hash_sample(judged, TREE_ROWS * TREES, "doc_id", *COUNTS).select(*COUNTS).collect())
    if not sample:
        return QualityRules(None, 1.0)
    forest = grow_forest(statistics(np.array(sample, np.int64)))
    grown = share(spark, forest)

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(grown().scores(statistics(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1))))

    # A row with both labels counts as both.
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(*(F.max((F.col("quality") == q).cast("long")).alias(name) for name, q in (("good", 1), ("bad", 0))))
    labelled = judged.join(marks, "doc_id").withColumn("bin", F.ceil(score(*COUNTS) * SCORE_BINS))
    bins = labelled.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    return QualityRules(forest, threshold_of(sorted((row.bin, row.good, row.bad) for row in bins), good_loss))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialise(rule_counts(table(spark, sf_dir, "documents")), "rule-counts")
    rules = fit_rules(counts, table(spark, sf_dir, "labels"))
    return counts.select(
        "doc_id",
        *COUNTS[:5],
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        rules.kept_counts(spark, COUNTS).alias("kept"),
    )
