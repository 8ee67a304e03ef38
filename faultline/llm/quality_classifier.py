"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the shares of its hashed words (BUCKETS of them) and one indicator for each structure statistic's
or metadata column's bin. The score is the logistic of bias + sum w_i x_i + the pairwise interactions of all features,
which cost linear time by  1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

Fitted on about FIT_ROWS labelled rows, whose features (not texts) go to the driver; every row is scored in tasks.

Defined results: null and empty texts have no words and are scored from their structure bins. A null metadata value
has a bin of its own. Without labelled rows of both kinds every score is the share of ones (0.5 without any row).
Repeated rows and ties give a row each; an empty table gives an empty result. Of two labels of a row the greater counts. The
text and the metadata go in as columns and the score comes back by position, so names of other columns cannot clash. A text
of any length is scored whole; its words are held while it is (some 50 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.quality_rules import BLANKS, MARKS, SYMBOLS, UPPER, repeated_words
from faultline.llm.support import WordHashes, hash_sample, in_part, share, table, word_hashes

#: Labelled rows that the fit uses (about), hashed word features, length of a factor.
FIT_ROWS, BUCKETS, FACTORS = 4_000, 2**14, 8
EPOCHS, BATCH_ROWS, RATE, DECAY = 12, 64, 0.02, 1e-4
#: Upper edges of the bins of each structure statistic; the last bin is open.
EDGES = {
    "words": (0, 10, 25, 50, 100, 300, 1000, 3000, 10000),
    "word length": (2, 3, 4, 5, 6, 7, 8, 10, 15),
    "symbols a word": (0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.2),
    "marks a word": (0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.5),
    "share of capitals": (0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "share of repeated words": (0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "share of repeated lines": (0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
}
#: Bins of a metadata number: none, then one for each bit length.
METADATA_BINS = 65
STRUCTURE_BINS = sum(len(edges) + 1 for edges in EDGES.values())


def features(text: str | None, metadata: tuple, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one row."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    count, size = max(len(words), 1), max(len(data), 1)
    without = lambda characters: len(data) - len(data.translate(None, characters))
    lines = [line for line in data.split(b"\n") if line.strip()]
    figures = (
        len(words),
        (len(data) - without(BLANKS)) / count,
        without(SYMBOLS) / count,
        without(MARKS) / count,
        without(UPPER) / size,
        repeated_words(words, hashes) / count,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
    )
    number, numbers = BUCKETS, []
    for figure, edges in zip(figures, EDGES.values(), strict=True):
        numbers.append(number + int(np.searchsorted(edges, figure)))
        number += len(edges) + 1
    for value in metadata:
        numbers.append(number + (0 if value is None or not np.isfinite(value) else 1 + min(int(abs(value)).bit_length(), 63)))
        number += METADATA_BINS
    if not words:
        return np.array(numbers), np.ones(len(numbers))
    bucket = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) >> np.uint64(64 - 14)
    used, times = np.unique(bucket.astype(np.int64), return_counts=True)
    return np.concatenate([used, numbers]), np.concatenate([times / count, np.ones(len(numbers))])


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, numbers: np.ndarray, values: np.ndarray) -> float:
        terms = self.factor[numbers] * values[:, None]
        pairs = 0.5 * float((terms.sum(axis=0) ** 2 - (terms**2).sum(axis=0)).sum())
        return self.bias + float(self.weight[numbers] @ values) + pairs

    def score(self, numbers: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(numbers, values), -30, 30))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], width: int, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss, over shuffled batches of rows (label, feature numbers, values)."""
    random = np.random.default_rng(seed)
    share = np.clip(np.mean([label for label, _, _ in rows]), 0.01, 0.99) if rows else 0.5
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(width), np.zeros((width, FACTORS)))
    if len({label for label, _, _ in rows}) < 2:
        return model
    model.factor = random.normal(0, 0.05, (width, FACTORS))
    parameters = np.concatenate([model.weight[:, None], model.factor], axis=1)
    first, second, steps = np.zeros_like(parameters), np.zeros_like(parameters), 0
    for _ in range(EPOCHS):
        for at in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH_ROWS)):
            batch = [rows[i] for i in at]
            numbers, values = (np.concatenate([row[k] for row in batch]) for k in (1, 2))
            starts = np.cumsum([0, *(len(row[1]) for row in batch[:-1])])
            owner = np.repeat(np.arange(len(batch)), [len(row[1]) for row in batch])
            own = parameters[numbers]
            terms = own[:, 1:] * values[:, None]
            sums = np.add.reduceat(terms, starts)
            squares = np.add.reduceat((terms**2).sum(axis=1), starts)
            margin = model.bias + np.add.reduceat(own[:, 0] * values, starts) + 0.5 * ((sums**2).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([row[0] for row in batch])) / len(batch)
            by_term = np.empty_like(own)
            by_term[:, 0] = slope[owner] * values
            by_term[:, 1:] = slope[owner, None] * values[:, None] * (sums[owner] - terms)
            order = np.argsort(numbers, kind="stable")
            touched, begins = np.unique(numbers[order], return_index=True)
            gradient = np.add.reduceat(by_term[order], begins) + DECAY * parameters[touched]
            steps += 1
            first[touched] = 0.9 * first[touched] + 0.1 * gradient
            second[touched] = 0.99 * second[touched] + 0.01 * gradient**2
            parameters[touched] -= RATE * (first[touched] / (1 - 0.9**steps)) / (np.sqrt(second[touched] / (1 - 0.99**steps)) + 1e-8)
            model.bias -= RATE * float(slope.sum())
    model.weight, model.factor = parameters[:, 0].copy(), parameters[:, 1:].copy()
    return model


def fit_classifier(labelled: DataFrame, text: str, label: str, metadata: list[str]) -> FactorisationMachine:
    """Fit on `labelled`, a bounded table of rows with a text, a label of 0 or 1 and numeric metadata columns."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            label_of, texts, *more = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            found = [features(t, m, hashes) for t, m in zip(texts, zip(*more, strict=True) if more else [()] * len(texts), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label_of, pa.int32()), pa.array([n.astype(np.int32).tobytes() for n, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                ["label", "numbers", "values"],
            )

    chosen = labelled.select(F.col(label).cast("int"), F.col(text), *(F.col(c).cast("double") for c in metadata))
    rows = chosen.mapInArrow(extract, "label int, numbers binary, values binary").collect()
    ordered = sorted((r.label, bytes(r.numbers), bytes(r["values"])) for r in rows)
    decoded = [(y, np.frombuffer(n, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for y, n, v in ordered]
    return train(decoded, BUCKETS + STRUCTURE_BINS + METADATA_BINS * len(metadata))


def classifier_score(spark: SparkSession, model: FactorisationMachine, text: str, metadata: list[str]) -> Column:
    """The score of each row, between 0 and 1. The model's size is fixed by the constants above."""
    learned = share(spark, model)

    @F.arrow_udf("double")
    def score(texts: pa.Array, *more: pa.Array) -> pa.Array:
        hashes, columns = word_hashes(), [c.to_pylist() for c in more]
        rows = zip(texts.to_pylist(), zip(*columns, strict=True) if columns else [()] * len(texts), strict=True)
        return pa.array([learned().score(*features(t, m, hashes)) for t, m in rows], pa.float64())

    return score(F.col(text), *(F.col(c).cast("double") for c in metadata))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").where(~in_part("doc_id", 1) & F.col("doc_id").isNotNull())
    chosen = hash_sample(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), FIT_ROWS, "doc_id")
    labelled = documents.join(F.broadcast(chosen), "doc_id").limit(2 * FIT_ROWS)
    model = fit_classifier(labelled, "text", "quality", ["n_chars"])
    scored = documents.withColumn("score", classifier_score(spark, model, "text", ["n_chars"]))
    return scored.select("doc_id", in_part("doc_id", 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
