"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: for n = 1 to 4, two texts share a cosine of the sets of their
character n-grams (lower case), and the kernel is the mean of the four. N-grams are hashed into WIDTHS[n] places.
A Nystrom map over a few landmark texts of every language turns the kernel into coordinates; one ridge regression per
language, against all others, gives the scores. A batch of texts is scored by two matrix products.

Landmarks and fitting rows are bounded (LANDMARKS, FIT_ROWS for each language, of low hash); what goes to the driver is
their presence bits. Every row is scored over its whole text.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text where nothing could be
learned. Ties between languages go to the first in alphabetical order. Repeated rows give a row each; an empty table gives an
empty result. The text goes in as a column and the prediction comes back by position, so names of other columns cannot clash.
A text of any length is scored whole; its n-grams are held while it is (some 20 bytes a character).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.support import in_part, share, table

#: Places for the n-grams of each length.
WIDTHS = {1: 1024, 2: 4096, 3: 8192, 4: 16384}
WIDTH = sum(WIDTHS.values())
#: For each language: texts that span the map, and texts that the regression is fitted on.
LANDMARKS, FIT_ROWS = 12, 400
RIDGE, SHARPNESS, SCORED_ROWS = 1e-3, 4.0, 128
FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (as \\p{L} has it): numerals such as ² and Ⅷ are none."""
    return any(map(str.isalpha, text))


def presence(texts: list[str | None]) -> np.ndarray:
    """One row for each text: 1 where one of its n-grams falls, else 0."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        gram, offset = code * FACTORS[0], 0
        for n, width in WIDTHS.items():
            if n > 1:
                if len(code) < n:
                    break
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * FACTORS[1] + code[n - 1 :] * FACTORS[2]
            row[offset + (((gram ^ (gram >> np.uint32(13))) * FACTORS[0]) >> np.uint32(32 - width.bit_length() + 1)).astype(np.int64)] = 1
            offset += width
    return out


def scaled(presences: np.ndarray) -> np.ndarray:
    """Rows whose inner products are kernel values."""
    out, offset = presences.astype(np.float32), 0
    for width in WIDTHS.values():
        part = out[:, offset : offset + width]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(WIDTHS))
        offset += width
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        return scaled(presence(texts)) @ self.landmarks.T @ self.weights + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and t and has_letter(t)]
        for at in range(0, len(known), SCORED_ROWS):
            part = known[at : at + SCORED_ROWS]
            margins = self.margins([texts[i] for i in part])
            odds = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
            best = margins.argmax(axis=1)
            for i, k, p in zip(part, best, (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(part)), best], strict=True):
                out[i] = (self.languages[k], float(min(1.0, p)))
        return out


def fit_ridge(languages: list[str], presences: np.ndarray, is_landmark: np.ndarray) -> LanguageModel:
    """Nystrom coordinates over the landmark rows, then ridge regression of +1 / -1 for each language."""
    classes = sorted(set(languages))
    if not classes:
        return LanguageModel([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    rows = scaled(presences)
    landmarks = rows[is_landmark]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    usable = values > 1e-6 * values.max()
    to_coordinates = vectors[:, usable] / np.sqrt(values[usable])
    points = (rows @ landmarks.T).astype(float) @ to_coordinates
    targets = np.where(np.array(languages)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = (1 / np.array([languages.count(c) for c in languages]))[:, None]
    weight /= weight.sum()
    middle, level = (weight * points).sum(axis=0), (weight * targets).sum(axis=0)
    centred = points - middle
    solved = np.linalg.solve(centred.T @ (weight * centred) + RIDGE * np.eye(points.shape[1]), centred.T @ (weight * (targets - level)))
    return LanguageModel(classes, landmarks, (to_coordinates @ solved).astype(np.float32), (level - middle @ solved).astype(np.float32))


def fit_languages(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from the rows of `labelled` that have a language, a text with a letter and an id."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    ranked = usable.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(doc_id).bitwiseAND(2**62 - 1).alias("rank"))
    # Rows of a rank below a language's bound are about three times as many as are wanted, however many files there are.
    bound = F.least(F.lit(1.0), F.lit(3.0 * FIT_ROWS) / F.approx_count_distinct("doc_id")) * F.lit(2.0**62)
    chosen = (
        ranked.join(ranked.groupBy("lang").agg(bound.alias("bound")), "lang")
        .where("rank <= bound")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= FIT_ROWS)
        .groupBy("doc_id", "lang")
        .agg(F.min("place").alias("place"))
    )
    size = chosen.count()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                packed = np.packbits(presence(part.column(2).to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "place", "bits"])

    texts = usable.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # At most FIT_ROWS ids for each language, so they fit in every task.
    picked = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).limit(2 * size)
    rows = sorted((r.lang, r.place, bytes(r.bits)) for r in picked.select("lang", "place", "text").mapInArrow(bits, "lang string, place int, bits binary").collect())
    unpacked = np.unpackbits(np.frombuffer(b"".join(b for _, _, b in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :WIDTH] if rows else np.zeros((0, WIDTH))
    return fit_ridge([r[0] for r in rows], unpacked, np.array([r[1] <= LANDMARKS for r in rows], bool))


def language_of(spark: SparkSession, model: LanguageModel, text: str = "text") -> Column:
    """A struct of lang_pred and score."""
    learned = share(spark, model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = learned().predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["lang_pred", "score"])

    return predict(text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_languages(documents.where(~in_part("doc_id", 1)))
    found = documents.select("doc_id", language_of(spark, model).alias("found"))
    return found.select("doc_id", in_part("doc_id", 1).alias("held_out"), "found.lang_pred", "found.score")
