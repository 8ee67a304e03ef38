"""Token counts of whole texts by a map-side lookup in two tiers, without moving a pre-token.

A text of a sentencepiece BPE model falls into units that its merges never cross: a run of spaces with the characters
behind it, or a line feed with the characters behind it. That holds for models whose pieces have a space mark only at
their start (or nothing else) and no line feed, which `check_model` verifies. So a text's count is the sum over its units.

Tier one is a table of frequent units and their lengths, fitted on a bounded sample and sent to every task. It is a
cache: a unit that is not in it costs more, and counts the same. Tier two is a worker's own cache, filled by encoding
what tier one misses. Texts are split some hundreds at a time by Arrow, and every different unit of them is looked up once.

Null and empty texts have 0 tokens. Repeated rows and ties give a row each; other columns are passed through by
`token_counts` whatever their names, because the text goes in as one column and the count comes back by position. An
empty table gives an empty result. A text of any length is counted whole; its units are held while it is (some 50 bytes each).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import hash_sample, table, worker_value

#: The fitting sample of tier one: rows, and the longest text taken, in characters. Results do not depend on them.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 20_000
#: Units in tier one, of at most so many characters; units a worker keeps in tier two.
FREQUENT_UNITS, UNIT_CHARS, CACHED_UNITS = 65_536, 32, 400_000
SPACE_MARK = "▁"
RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")


def check_model(model) -> None:
    """Raise where a unit's tokens could depend on its neighbours."""
    for at in range(model.vocab_size()):
        piece = model.id_to_piece(at)
        if "\n" in piece or SPACE_MARK in piece.lstrip(SPACE_MARK):
            raise ValueError(f"piece {piece!r} crosses a unit's border")


def units_of(text: str) -> list[str]:
    """The units of a text. One that starts with a space mark is named without its first mark; a line feed stays."""
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, " ")
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.replace("\n", " \n").split(" ")
    return [unit[1:] if unit[0] == " " else unit for unit in RUNS.findall(f" {text}")]


class UnitLengths(dict):
    """Tokens of a unit: tier one's entries from the start, then every miss that was encoded here."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.most = model, len(frequent) + CACHED_UNITS
        self[""] = 1

    def __missing__(self, unit: str) -> int:
        length = len(self.model.encode(unit)) - (unit[0] == "\n")
        if len(self) < self.most and len(unit) <= UNIT_CHARS:
            self[unit] = length
        return length

    def of_all(self, units: list[str]) -> np.ndarray:
        """The tokens of units that are all different; what no tier has is encoded in one call."""
        found = list(map(self.get, units))
        missed = [at for at, length in enumerate(found) if length is None]
        if missed:
            unknown = [units[at] for at in missed]
            for at, unit, ids in zip(missed, unknown, self.model.encode(unknown, num_threads=1), strict=True):
                found[at] = length = len(ids) - (unit[0] == "\n")
                if len(self) < self.most and len(unit) <= UNIT_CHARS:
                    self[unit] = length
        return np.array(found, np.int64)


def texts_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all texts, as units_of has them, the texts' numbers in the order taken, and where the units of each begin, and the end."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE_MARK, " ")
    odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.match_substring(texts, "  "))
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    if pc.any(odd).as_py():
        split = pa.concat_arrays([split.filter(pc.invert(odd)), pa.array([units_of(t) for t in texts.filter(odd).to_pylist()], split.type)])
    place = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
    return split.flatten(), place, np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])


def tokens_of(texts: pa.Array, known: UnitLengths) -> np.ndarray:
    """The tokens of each text. Every different unit of the texts is looked up once."""
    units, place, starts = texts_units(texts)
    coded = units.dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(known.of_all(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()])])
    out = np.empty(len(texts), np.int64)
    out[place] = ends[starts[1:]] - ends[starts[:-1]]
    return out


def load_model(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def frequent_units(documents: DataFrame, text: str, order: list[str], proto: bytes) -> tuple[str, bytes]:
    """Tier one, packed: the frequent units joined by a character that no unit has, and one length byte for each.

    Fitted on about SAMPLE_ROWS rows of low hash whose text has at most SAMPLE_CHARS characters.
    """
    short = documents.where(F.length(text) <= SAMPLE_CHARS)
    sample = hash_sample(short, SAMPLE_ROWS, *order).select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counted.update(u for u in units_of(value) if 0 < len(u) <= UNIT_CHARS and " " not in u)
        model = load_model(proto)
        best = [unit for unit, n in counted.most_common(FREQUENT_UNITS) if n > 1]
        lengths = [min(255, len(ids) - (unit[0] == "\n")) for unit, ids in zip(best, model.encode(best), strict=True)] if best else []
        kept = [(unit, n) for unit, n in zip(best, lengths, strict=True) if n < 255]
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(u for u, _ in kept)]), pa.array([bytes(n for _, n in kept)], pa.binary())], ["units", "lengths"])

    rows = sample.coalesce(1).mapInArrow(count, "units string, lengths binary").collect()
    return (rows[0].units, bytes(rows[0].lengths)) if rows else ("", b"")


def token_counts(documents: DataFrame, model_path: str, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """`documents` with n_tokens: long, the tokens of the whole `text`. `order` are the columns that pick tier one's sample."""
    start = token_counter(documents, model_path, text, order)

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens_in = start()
        for batch in texts:
            # A few texts at a time: a batch has thousands.
            yield pa.array(np.concatenate([tokens_in(batch.slice(at, 500)) for at in range(0, max(1, len(batch)), 500)]), pa.int64())

    return documents.withColumn("n_tokens", count(F.col(text)))


def token_counter(documents: DataFrame, model_path: str, text: str = "text", order: list[str] | None = None) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """For use in a task: gives a function from texts to the tokens of each. Both tiers' starting data are bounded, whatever the corpus."""
    with open(model_path, "rb") as file:
        proto = file.read()
    check_model(load_model(proto))
    frequent = frequent_units(documents, text, order or [text], proto)
    shared = documents.sparkSession.sparkContext.broadcast((proto, frequent))
    key = ("unit lengths", hash((len(proto), proto[-64:], frequent)))

    def build() -> UnitLengths:
        model, (units, lengths) = load_model(shared.value[0]), shared.value[1]
        return UnitLengths(model, dict(zip(units.split(" "), lengths, strict=True)) if lengths else {})

    def start() -> Callable[[pa.Array], np.ndarray]:
        known = worker_value(key, build)
        return lambda texts: tokens_of(texts, known)

    return start


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(documents, public_tokenizers.path("piece_bpe_32k.model"), order=["doc_id"])
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )
