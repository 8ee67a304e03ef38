"""Benchmark decontamination: test items found inside documents of any length.

A short item hides in a long document: their Jaccard similarity is tiny, so the search is by containment and partitioned
by size. Items fall into classes by their number of shingles, [2^k, 2^(k+1)). For class k a document is cut into blocks
of 2^(k+1) shingles, and two neighbouring blocks make a window; an item that stands in the document unbroken lies in one window, which is
at most eight times its size. Window and item are candidates where one of HASHES minimum hashes agrees, and an item that stands
in pieces still meets the windows of its pieces. Candidates are verified by exact containment: the share of the item's
distinct shingles that the whole document has.

One pass over the documents does it, whatever the number of items: two bit tables of fixed size go to every task, one of
all item shingles and one of all items' minimum hashes. A document sends on the window hashes that fall on set bits and
its shingles that may be an item's; those few rows are joined with the items. A fuller bit table lets more rows
through and changes no result.

Words are compared without case and without ASCII punctuation. Defined results: null and empty texts and items of fewer
than SHINGLE words have no shingles and match nothing. Rows of equal id and text give one row for each item. An empty table on either
side gives an empty result. Rows without an id are found too, with a null id. Only ids and texts are read, so names of other
columns cannot clash. A text of any length is searched whole; its task holds 192 bytes a shingle meanwhile.

Recall: an item of 2^k shingles is looked for in windows of 2^(k+2), of a similarity of 0.25 at least when it is there word for
word and of 0.19 at a containment of 0.8, so that 24 minimum hashes miss it with a chance of 0.001 and 0.006 (items near 2^(k+1)
shingles almost never). Measured at a containment of 0.8, over 1,500 items a size: 0.9987 found of 16 shingles, 0.9993 of 32 and 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import WordHashes, fresh, materialise, mixed, shingle_hashes, slices, table, word_hashes

SHINGLE, CONTAINMENT = 5, 0.8
#: Minimum hashes of an item or window; bits of each table sent to the tasks.
HASHES, TABLE_BITS = 24, 25
#: A table is put together from chunks of so many bytes.
CHUNK = 2**16
PLAIN = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
FACTOR = mixed(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) | np.uint64(1)
SHIFT = mixed(np.arange(6001, 6001 + HASHES, dtype=np.uint64))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The hash of every shingle, in text order."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []
    return shingle_hashes(words, hashes, SHINGLE)


def size_class(n_shingles: int) -> int:
    return n_shingles.bit_length() - 1


def hash_keys(least: np.ndarray, k: int) -> np.ndarray:
    """Keys of minimum hashes (HASHES in each row of `least`) in size class k."""
    salt = mixed(np.arange(HASHES, dtype=np.uint64) + np.uint64(1 + HASHES * k))
    return mixed(least ^ salt)


def item_keys(values: np.ndarray) -> np.ndarray:
    return hash_keys((values[None, :] * FACTOR[:, None] + SHIFT[:, None]).min(axis=1), size_class(len(values)))


def window_keys(values: np.ndarray, classes: list[int]) -> np.ndarray:
    """The keys of all windows of a document for the given size classes."""
    keys, at, blocks = [], None, None
    permuted = values[None, :] * FACTOR[:, None] + SHIFT[:, None]
    for k in sorted(classes):
        length = 2 ** (k + 1)
        if blocks is None:
            blocks = np.minimum.reduceat(permuted, np.arange(0, len(values), length), axis=1)
        else:  # a block of this class is made of whole blocks of the class before
            blocks = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], length // at), axis=1)
        at = length
        windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
        keys.append(np.unique(hash_keys(windows.T, k)))
    return np.concatenate(keys)


def place_in_table(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def set_bits(bits: np.ndarray, values: np.ndarray) -> None:
    place = place_in_table(values)
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))


def on_set_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = place_in_table(values)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def prepared_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, k (size class), n_item, shingles and keys of the items that have shingles."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            sets = [np.unique(shingles(t, hashes)) for t in batch.column(1).to_pylist()]
            kept = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())),
                    pa.array([size_class(len(sets[i])) for i in kept], pa.int32()),
                    pa.array([len(sets[i]) for i in kept], pa.int32()),
                    pa.array([sets[i].astype("<u8").tobytes() for i in kept], pa.binary()),
                    pa.array([item_keys(sets[i]).view(np.int64) for i in kept], pa.list_(pa.int64())),
                ],
                ["item_id", "k", "n_item", "shingles", "keys"],
            )

    chosen = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(compute, "item_id long, k int, n_item int, shingles binary, keys array<long>")


def bit_tables(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of all shingles and of all keys. Tasks send the chunks they set bits in; chunks are merged by key."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2**TABLE_BITS // 8, np.uint8) for _ in range(2)]
        for batch in batches:
            for values, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                set_bits(tables[0], np.frombuffer(values, "<u8"))
                set_bits(tables[1], np.array(keys, np.int64).view(np.uint64))
        for which, bits in enumerate(tables):
            for chunk in np.flatnonzero(bits.reshape(-1, CHUNK).any(axis=1)):
                number = which * (len(bits) // CHUNK) + int(chunk)
                yield pa.RecordBatch.from_pydict({"chunk": [number], "bits": [bits[chunk * CHUNK : (chunk + 1) * CHUNK].tobytes()]}, schema=schema)

    schema = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for bits in batch.column(1).to_pylist():
                total |= np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": [key[0].as_py()], "bits": [total.tobytes()]}, schema=schema)

    filled = items.select("shingles", "keys").mapInArrow(fill, "chunk int, bits binary")
    both = np.zeros(2 * 2**TABLE_BITS // 8, np.uint8)
    for row in filled.groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").collect():
        both[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.bits, np.uint8)
    return both[: len(both) // 2], both[len(both) // 2 :]


def possible_documents(documents: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows that may hold an item: doc_id, text_key, their window hashes on set bits, and their shingles on set bits."""
    classes = sorted(row.k for row in items.select("k").distinct().collect())  # one number for each doubling of size
    shared = documents.sparkSession.sparkContext.broadcast((classes, *bit_tables(items)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (wanted, shingle_bits, key_bits) = word_hashes(), shared.value
        for batch in slices(batches):
            rows, keys, hits = [], [], []
            for row, value in enumerate(batch.column(2).to_pylist()):
                values = shingles(value, hashes)
                hit = on_set_bits(shingle_bits, values)
                if not hit.any():
                    continue  # a window hash is the hash of one of its shingles, so no item can match
                found = np.unique(window_keys(values, wanted))
                found = found[on_set_bits(key_bits, found)]
                if len(found):
                    rows.append(row)
                    keys.append(found.view(np.int64))
                    hits.append(np.unique(values[hit]).astype("<u8").tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.list_(pa.int64())), pa.array(hits, pa.binary())],
                ["doc_id", "text_key", "keys", "hits"],
            )

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(text).alias("text_key"), F.col(text).alias("text"))
    return chosen.mapInArrow(search, "doc_id long, text_key string, keys array<long>, hits binary")


def contained_items(documents: DataFrame, items: DataFrame, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_key, item_id, n_shared, n_item, containment of every document and item of at least that containment."""
    prepared = materialise(prepared_items(items, item_id, item_text), "items")
    found = materialise(possible_documents(documents, prepared, doc_id, text).withColumn("id_key", F.coalesce("doc_id", F.lit(-1))), "possible-documents")
    doc_keys = found.select("id_key", "text_key", F.explode("keys").alias("key"))
    candidates = doc_keys.join(prepared.select("item_id", F.explode("keys").alias("key")), "key").select("id_key", "text_key", "item_id").distinct()
    whole = candidates.join(found.select("doc_id", "id_key", "text_key", "hits").dropDuplicates(["id_key", "text_key"]), ["id_key", "text_key"])
    paired = whole.join(prepared.select("item_id", "n_item", "shingles"), "item_id")

    @F.arrow_udf("int")
    def in_common(mine: pa.Array, theirs: pa.Array) -> pa.Array:
        pairs = zip(mine.to_pylist(), theirs.to_pylist(), strict=True)
        return pa.array([len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True)) for a, b in pairs], pa.int32())

    counted = paired.withColumn("n_shared", in_common("hits", "shingles")).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return counted.where(F.col("containment") >= containment).select("doc_id", "text_key", "item_id", "n_shared", "n_item", "containment")


def without_contaminated(documents: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """`documents` without the rows that hold an item."""
    id_key, key = fresh(documents, "id_key"), fresh(documents, "text_key")
    found = contained_items(documents, items, containment).select(F.coalesce("doc_id", F.lit(-1)).alias(id_key), F.col("text_key").alias(key)).distinct()
    keyed = documents.withColumn(id_key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(key, F.md5("text"))
    return keyed.join(found, [id_key, key], "left_anti").drop(id_key, key)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")
