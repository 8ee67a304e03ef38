"""What the operators share: worker-side caches, word hashing, files in the shared folder, whole groups in tasks."""

from __future__ import annotations

import pickle
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import materialise, new_folder  # noqa: F401  (used by the operators)

WHITE_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words a worker's hash cache holds before it starts anew; the hashes do not depend on it.
CACHED_WORDS = 200_000
#: Values of `share` that a worker holds at once.
SHARED_VALUES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_part(doc_id: str | Column, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves `remainder` on division by 3; a null id is in no part."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == remainder, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_sample(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """About `rows` rows (at most twice as many), those of low hash of `order`: the same on any partitioning.

    Every task keeps its own share, so nothing but the sample is moved. For fitting only.
    """
    share = min(1.0, rows / max(df.count(), 1))
    return df.where(F.xxhash64(*order).bitwiseAND(2**31 - 1) < int(share * 2**31)).limit(2 * rows)


#: A key with more than this share of a table's rows is hot, so there are fewer than HOT_KEYS hot keys.
HOT_KEYS = 2000
#: Tasks that the rows of a hot key are dealt to.
HOT_PARTS = 64
#: Rows that one task can join whatever their keys.
EASY_ROWS = 300_000
#: Bits of the table that `those_wanted` sends to the tasks.
WANTED_BITS = 25
BITMAP_BITS = 32768  # of Spark's bitmap functions


def join_beside_hot(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """`rows`, a written table, with the columns of `facts`, which has each key once; null where it has none.

    The rows of hot keys are dealt to HOT_PARTS tasks, each of which gets their facts, so no task gets the rows of a key that
    holds a third of the table. Which keys are hot is broadcast: fewer than HOT_KEYS. Up to EASY_ROWS rows are joined as
    they are.
    """
    total = rows.count()
    if total <= EASY_ROWS:
        return rows.join(facts, list(keys), "left")
    share, part, is_hot = total // HOT_KEYS, fresh(rows, "_part"), fresh(rows, "_hot")
    hot = rows.groupBy(*keys).count().where(F.col("count") > share).select(*keys, F.lit(True).alias(is_hot))
    listed = F.broadcast(materialise(hot, "hot-keys"))
    dealt = rows.join(listed, list(keys), "left").withColumn(part, F.when(F.col(is_hot), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).otherwise(0))
    others = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(HOT_PARTS - 1).cast("long")))
    copied = facts.join(listed, list(keys)).drop(is_hot).withColumn(part, others)
    placed = facts.withColumn(part, F.lit(0).cast("long")).unionByName(copied)
    return dealt.drop(is_hot).join(placed, [*keys, part], "left").drop(part)


def slot_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Truth values for 2^bits slots: which of them the high bits of the keys (one column of 64-bit hashes) lie in.

    What comes to the driver has a fixed size, whatever the number of keys.
    """
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits) + 1
    placed = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    out = np.zeros((max(1, 2**bits // BITMAP_BITS), BITMAP_BITS // 8), np.uint8)
    for found in placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[found["bucket"] - 1] = np.frombuffer(found["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little")[: 2**bits].astype(bool)


def those_wanted(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose `key`, a 64-bit hash, is among those of `wanted` (one column), and a few others.

    A table of 2^WANTED_BITS bits is broadcast, so that a join that follows does not move what it has no use for; a full table
    lets everything pass.
    """
    packed = zlib.compress(np.packbits(slot_bitmap(wanted, WANTED_BITS)).tobytes(), 1)
    shared, bits = rows.sparkSession.sparkContext.broadcast(packed), WANTED_BITS

    def among(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for keys in batches:
            slot = (keys.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.array((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1)

    udf = F.arrow_udf(among, "boolean")
    return rows.where(udf(key))


def text_pieces(data: bytes, size: int = 2**20) -> Iterator[bytes]:
    """`data` cut behind white space into pieces of about `size` bytes, so that a long text's words are never all held at once."""
    at = 0
    while len(data) - at > size:
        space = WHITE_SPACE.search(data, at + size)
        if space is None:
            break
        yield data[at : space.end()]
        at = space.end()
    yield data[at:] if at else data


def worker_value(key: tuple, build: Callable[[], object], most: int = 1) -> object:
    """An object kept in the worker process, whichever task asks first, until `most` newer ones of its kind are asked for.

    The first part of the key is the kind. A worker outlives the job that fitted a cache or a model, so what earlier jobs
    left is dropped before the next is built; else every input that a session works on would add its own.

    Functions reach a worker by value, so their own globals last for one task; a module entry lasts longer.
    """
    holder = sys.modules.setdefault("_faultline_worker_values", types.ModuleType("_faultline_worker_values"))
    held = holder.__dict__.setdefault("held", {})
    if key in held:
        held[key] = held.pop(key)  # the last asked for is the last to go
    else:
        of_kind = [other for other in held if other[0] == key[0]]
        for other in of_kind[: max(0, len(of_kind) - most + 1)]:
            del held[other]
        held[key] = build()
    return held[key]


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives `value` in any task. It is sent once, as bytes that hold the code of its class as well, because
    Spark pickles what it broadcasts by reference to modules that executors may not have.
    """
    packed = cloudpickle.dumps(value)
    shared, key = spark.sparkContext.broadcast(packed), ("shared", xxhash.xxh3_128_hexdigest(packed))

    def get() -> object:
        return worker_value(key, lambda: pickle.loads(shared.value), SHARED_VALUES)

    return get


class WordHashes(dict):
    """64-bit hash of a word, computed once for each word the worker meets (up to CACHED_WORDS of them)."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes() -> WordHashes:
    return worker_value(("word hashes",), WordHashes)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """The hash of every run of `size` words, in text order. Fewer words than `size` give no shingle."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    return run_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), size)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes
APART = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one after the other, and the number of the first word of each text, and of the end.

    Taken from the texts' bytes, 8 at a time, with no Python object for a word. Words of up to 8 bytes differ in what is hashed.
    """
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if first == last:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    begins = ~APART[data]
    ends = begins.copy()
    border = np.zeros(len(data) + 1, bool)  # between two texts
    border[offsets - first] = True
    begins[1:] &= ~begins[:-1] | border[1:-1]
    ends[:-1] &= ~ends[1:] | border[1:-1]
    begin, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size -= begin
    out, padded, width = np.empty(len(begin), np.uint64), np.concatenate([data, np.zeros(LONG_WORD, np.uint8)]), np.arange(8)
    for at in range(0, len(begin), 16_384):
        start, n, found = begin[at : at + 16_384], size[at : at + 16_384], out[at : at + 16_384]
        found[:] = n
        for k in range(0, LONG_WORD, 8):
            more = np.flatnonzero(n > k) if k else slice(None)
            if k and not len(more):
                break
            eight = padded[start[more][:, None] + (width + k)].view("<u8")[:, 0] & BELOW[np.minimum(n[more] - k, 8)]
            found[more] = mixed(found[more] * np.uint64(0x9E3779B97F4A7C15) + mixed(eight))
        for i in np.flatnonzero(n > LONG_WORD):
            found[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + n[i]])
    return out, np.searchsorted(begin, offsets - first)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` word hashes."""
    total = words[: len(words) - size + 1].copy()
    for at in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[at : len(words) - size + 1 + at]
    return mixed(total)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a task sorted by `key`, cut so that no group lies in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        if held and held[-1].column(key)[held[-1].num_rows - 1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if keys[0] == last:
            held.append(batch)
            continue
        at = batch.num_rows - 1
        while keys[at - 1] == last:
            at -= 1
        yield pa.Table.from_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what runs inside: batches of at most so many rows between Spark and its workers, both of which hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for work that holds much more than its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def file_system(path: str):
    """The file system and the path in it: local or shared folders, and the stores pyarrow reads (s3, gs, hdfs)."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)
