"""Phrase collocations per language, mined by dynamic itemset counting.

The texts are dealt to a few shards, which are scanned in a cycle, a job for each. Words are counted from the first scan
on. A longer phrase becomes active before the first scan by which the counts of both its subphrases (without the last and
without the first word) have reached the threshold, is then counted in every scan for one full cycle, and its count is
complete; so words, pairs and triples are counted in the same scans, and the cycle ends when no phrase is active. A phrase
of f occurrences has subphrases of f at least, which reach the threshold within their own cycle: no phrase is missed.

When a phrase became able to carry longer ones is kept in one table per length, of a byte for each of 2^SLOT_BITS slots
of phrase keys, the only thing broadcast. Slots only ever get their round once, so every occurrence of a phrase agrees on
the scan in which its counting starts, also where keys share a slot: sharing makes a phrase active that need not be, and
leaves every count exact. A round's counts are merged with the counts so far by one shuffle, reduced in the tasks first;
phrases below the threshold after their cycle are dropped. Keys have 128 bits (two hashes of the language and the words).
Counts move as blocks, the sorted keys of one bucket with their counts in columns of bytes: a bucket is a range of keys, so
a task that has all blocks of one adds them up by itself, and knows which slots of its range were reached. There are as
many buckets as the text needs for each to fit a task. A last scan reads the words of what is left. Newly set slots come
to the driver as bitmaps of a fixed size.

Candidates are phrases of two words or more with f at least the threshold. Cut after k words, with l and r the counts of
the parts, a candidate scores floor(1000000 * a * a / (l * r)), in decimals; the least score over the cuts counts, ties
to the least k. A candidate whose words lie inside a longer candidate with at least half its count is dropped. Joins with
parts that many candidates share (support.join_beside_hot) don't gather the candidates of a frequent word in a task.

Defined results: A-Z are lowered; texts are split at `.,;:!?` and line ends (line feed to carriage return) into pieces,
those at spaces and tabs into words; phrases lie within pieces. Null and empty texts have no words. A null language is
`und`, joined with rows that say `und`. Repeated rows count each. Ties in score and count go by the phrase's UTF-8 bytes.
Languages without a candidate, and an empty table, give no rows. Texts of any length are split a piece at a time. Only the
columns named are read, so names of other columns cannot clash. Counts may reach 10^15.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import batch_rows, join_beside_hot, materialise, mixed, new_folder, slot_bitmap, table
from faultline.operators.ordered import top_per_group

LONGEST, THRESHOLD, TOP, SHARDS = 3, 10, 2000, 2
#: A table's slots: 2^SLOT_BITS bytes are broadcast for each length.
SLOT_BITS = 23
NEVER = 255
#: A count's tag holds the phrase's length above, and the scan in which its counting starts in so many bits.
START_BITS = 6
#: Bytes of text that a task works on at once; keys that it holds before it counts them.
HELD_BYTES, HELD_KEYS = 2**20, 2**19
#: Rows of texts, and of counts, that pass between Spark and a worker at once.
TEXT_ROWS, COUNT_ROWS = 250, 2**16
#: Bytes of text for each bucket of counts, counts in a block, and counts that a task collects before it adds them up.
BUCKET_BYTES, BLOCK_ROWS, MERGED_ROWS = 2**24, 2**12, 2**20
#: Bytes in a row group of the texts, so that a part of them is read by many tasks.
GROUP_BYTES = 2**23
#: A task that reads words holds the last phrase given out for each of 2^SEEN_BITS places.
SEEN_BITS = 21
#: Words of a longer text that its next part repeats, and the longest word, in bytes, that is hashed in blocks.
REPEATED, LONG_WORD = LONGEST - 1, 64
#: Parts that the texts are dealt to; shards are made of them.
PARTS = 16
BREAK = b"\xff"  # no byte of UTF-8
LOWERED = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + BREAK * 10 + b" ")
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts in reading order, found and hashed in one pass over their bytes.

    `skip` words at the start were counted with the part before; they are here for phrases that begin in them.
    """

    def __init__(self, data: bytes, lang: np.ndarray, lang_start: np.ndarray, skip: int) -> None:
        self.data, self.skip = data, skip
        code = np.frombuffer(data, np.uint8)
        apart = (code == 0x20) | (code == 0xFF)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], apart, [True]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(code == 0xFF), self.start)
        self.lang = lang[np.searchsorted(lang_start, self.start, side="right") - 1]
        self.hashes = self._hashed()

    def _hashed(self) -> list[np.ndarray]:
        """Two hashes of every word, from its bytes in blocks of eight and its length."""
        size = self.end - self.start
        blocks = np.ndarray(len(self.data), "<u8", self.data + bytes(8), strides=(1,))  # the eight bytes from every place on
        hashes = [size.astype(np.uint64) * factor for factor in MULTIPLIERS]
        at = np.arange(len(size))
        for offset in range(0, LONG_WORD, 8):
            at = at[size[at] > offset]
            if not len(at):
                break
            block = blocks[self.start[at] + offset] & BLOCK_MASKS[np.minimum(size[at] - offset, 8)]
            for lane, factor in enumerate(MULTIPLIERS):
                hashes[lane][at] = mixed(hashes[lane][at] * factor + (block ^ factor))
        for i in np.flatnonzero(size > LONG_WORD):
            for lane in range(2):
                hashes[lane][i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]], lane + 1)
        return hashes


#: What to keep of eight bytes of which so many belong to a word.
BLOCK_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)


def parts_of(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A translated text in parts of at most 2 * HELD_BYTES, and how many words at the start of each are repeated.

    Parts end between pieces where they can; else behind a word, and the next one repeats the words before it. A word longer than a
    part is cut, which can join no phrase's count: nothing that long occurs THRESHOLD times in one place.
    """
    at, kept = 0, b""
    while len(data) - at > HELD_BYTES:
        limit = at + HELD_BYTES
        end = data.rfind(BREAK, at, limit)
        if end > at:
            yield kept + data[at:end], len(kept.split())
            at, kept = end, b""
            continue
        end = data.rfind(b" ", at, limit)
        end = end if end > at else limit
        part = kept + data[at:end]
        yield part, len(kept.split())
        kept = b" ".join(part.rpartition(BREAK)[2].split()[-REPEATED:]) + b" " if REPEATED else b""
        kept = kept if len(kept) < HELD_BYTES // 2 else b""
        at = end
    yield kept + data[at:], len(kept.split())


def held_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of a task's rows (lang, text), some HELD_BYTES of text at a time, and the languages they refer to."""
    held, size, langs = [], 0, []

    def words() -> tuple[Words, list[str]]:
        names = sorted(set(langs))
        place = {name: i for i, name in enumerate(names)}
        starts = np.concatenate([[0], np.cumsum([len(part) + 1 for part in held])[:-1]])
        return Words(BREAK.join(held), np.array([place[name] for name in langs]), starts, 0), names

    for batch in batches:
        for lang, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = scalar.as_py().encode("utf-8", "surrogatepass").translate(LOWERED)
            if len(data) > HELD_BYTES:
                for part, skip in parts_of(data):
                    yield Words(part, np.zeros(1, np.int64), np.zeros(1, np.int64), skip), [lang]
                continue
            if size + len(data) > HELD_BYTES:
                yield words()
                held, size, langs = [], 0, []
            held.append(data)
            langs.append(lang)
            size += len(data) + 1
    if held:
        yield words()


def lang_hashes(names: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(name.encode(), seed + 101) for name in names], np.uint64)


class Phrases:
    """The phrases of rising length that start at each word. `inside[i]`: the phrase at i lies within a piece, and counts here."""

    def __init__(self, words: Words, names: list[str]) -> None:
        self.words, self.names = words, names
        self.of_lang = [lang_hashes(names, seed) for seed in range(2)]
        self.sums = list(words.hashes)
        self.length, self.whole = 1, np.ones(len(words.start), bool)

    @property
    def inside(self) -> np.ndarray:
        return self.whole & (np.arange(len(self.whole)) + self.length > self.words.skip)

    def lengthen(self) -> None:
        k, piece = self.length, self.words.piece
        self.sums = [s[:-1] * MULTIPLIERS[seed] + self.words.hashes[seed][k:] for seed, s in enumerate(self.sums)]
        self.whole, self.length = piece[:-k] == piece[k:], k + 1

    def keys(self, seed: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        lang = self.words.lang[: len(self.whole)][at]
        of_length = np.uint64(self.length * int(MULTIPLIERS[1 - seed]) % 2**64)
        return mixed(self.sums[seed][at] + self.of_lang[seed][lang] + of_length)

    def lang_keys(self) -> list[np.ndarray]:
        """Keys of the languages themselves, as of phrases of length 0."""
        return [mixed(hashes) for hashes in self.of_lang]

    def text(self, i: int) -> bytes:
        return b" ".join(self.words.data[self.words.start[i] : self.words.end[i + self.length - 1]].split())


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


COUNTS = "length int, k1 long, k2 long, n long"


def counts_batch(k1: np.ndarray, k2: np.ndarray, tag: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [k1.view(np.int64), k2.view(np.int64), tag.astype(np.int32), n.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["k1", "k2", "tag", "n"])


#: Counts of one bucket, each column as bytes, in the order of k1. `reached` has a bit for each slot of the bucket and length.
KINDS = {"k1": np.uint64, "k2": np.uint64, "tag": np.int32, "n": np.int64, "since": np.uint8}
BLOCKS = "bucket int, k1 binary, k2 binary, tag binary, n binary, since binary"
STATE = f"{BLOCKS}, reached binary"


def blocks(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A row for each bucket, of 2^bits, and BLOCK_ROWS counts. The columns are those of KINDS, sorted by k1."""
    bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    edges = np.unique(np.concatenate([edges, np.arange(0, len(bucket), BLOCK_ROWS)]))
    ends = np.append(edges, len(bucket))
    packed = [pa.array(bucket[edges])]
    for column, kind in zip(columns, KINDS.values(), strict=True):
        data = np.ascontiguousarray(column, kind)
        offsets = pa.py_buffer((ends * data.itemsize).astype(np.int32))
        packed.append(pa.Array.from_buffers(pa.binary(), len(edges), [None, offsets, pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(packed, ["bucket", *KINDS])


def as_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, tag, n = (column.to_numpy() for column in batch.columns)
        yield blocks([k1.view(np.uint64), k2.view(np.uint64), tag, n, np.full(len(k1), NEVER, np.uint8)], bits)


def opened(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of KINDS of all blocks in a batch, one after the other."""
    out = []
    for name, kind in KINDS.items():
        column = batch.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        data = column.buffers()[2]
        out.append(np.frombuffer(data, np.uint8)[first:last].copy().view(kind) if last > first else np.empty(0, kind))
    return out


def added_up(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of KINDS with every key once, in the order of k1: the sum of its counts, the least of the others."""
    k1, k2, tag, n, since = (np.concatenate(columns) for columns in zip(*held, strict=True))
    order = np.argsort(k1)
    k1, other = k1[order], k2[order]
    same = k1[1:] == k1[:-1]
    if (same & (other[1:] != other[:-1])).any():  # keys that differ in their second half only must not lie mixed
        order = np.lexsort((k2, k1[np.argsort(order)]))
        other = k2[order]
        same = (k1[1:] == k1[:-1]) & (other[1:] == other[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(k1) else np.empty(0, np.int64)
    if not len(first):
        return [k1, other, tag, n, since]
    return [k1[first], other[first], np.minimum.reduceat(tag[order], first), np.add.reduceat(n[order], first), np.minimum.reduceat(since[order], first)]


def merged(found: DataFrame, number: int, shards: int, threshold: int, lengths: int, bits: int) -> DataFrame:
    """The blocks of scan `number` - 1 and of those before it, added up by bucket, without the phrases that have lost.

    What has just reached the threshold has `number` as `since`; the slots of such phrases are the bits of `reached`.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column("bucket")[0].as_py()
                held.append(opened(batch))
                size += len(held[-1][0])
            if size > MERGED_ROWS:
                held = [added_up(held)]
                size = 0
        if not held:
            return
        k1, k2, tag, n, since = added_up(held)
        held.clear()
        new = (since == NEVER) & (n >= threshold)
        since[new] = number
        slot, length = slots(k1[new]) - (bucket << SLOT_BITS - bits), tag[new] >> START_BITS
        reached = np.zeros((lengths, 2 ** (SLOT_BITS - bits)), bool)
        within = (length > 0) & (length <= lengths)
        reached[length[within] - 1, slot[within]] = True
        kept = (tag >> START_BITS == 0) | (n >= threshold) | ((tag & 2**START_BITS - 1) + shards > number)
        batch = blocks([column[kept] for column in (k1, k2, tag, n, since)], bits)
        bitmap = [np.packbits(reached).tobytes() if new.any() else b""] + [b""] * (batch.num_rows - 1)
        if batch.num_rows:
            yield batch.append_column("reached", pa.array(bitmap, pa.binary()))

    return found.repartitionById(2**bits, "bucket").mapInArrow(compute, STATE)


def reached_slots(state: DataFrame, lengths: int, bits: int) -> np.ndarray:
    """Which slots were reached in the last scan: a row of truth values for each length."""
    out = np.zeros((lengths, 2**bits, 2 ** (SLOT_BITS - bits)), bool)
    for row in state.where(F.length("reached") > 0).select("bucket", "reached").toLocalIterator():
        found = np.unpackbits(np.frombuffer(row["reached"], np.uint8), count=lengths * out.shape[2])
        out[:, row["bucket"]] = found.reshape(lengths, -1)
    return out.reshape(lengths, -1)


def counts_of(state: DataFrame) -> DataFrame:
    """length, k1, k2 and n of the phrases in blocks."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                k1, k2, tag, n, _ = opened(batch.slice(at, 1))
                columns = [tag >> START_BITS, k1.view(np.int64), k2.view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["length", "k1", "k2", "n"])

    return state.select("bucket", *KINDS).mapInArrow(compute, COUNTS)


def sent(spark: SparkSession, tables: np.ndarray) -> Broadcast:
    """Tables on their way to the tasks: they are mostly empty, and held on disk by every executor."""
    return spark.sparkContext.broadcast(zlib.compress(tables.tobytes(), 1))


def received(shared: Broadcast, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), kind).reshape(-1, 2**SLOT_BITS)


class Counter:
    """Keys that wait to be counted, HELD_KEYS at most."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, k1: np.ndarray, k2: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((k1, k2, tag.astype(np.int32)))
        self.size += len(k1)
        if self.size >= HELD_KEYS:
            yield from self.counts()

    def counts(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            k1, k2, tag = (np.concatenate(columns) for columns in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            order = np.argsort(k1)
            k1, k2 = k1[order], k2[order]
            first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            n = np.diff(np.concatenate([first, [len(k1)]]))
            for at in range(0, len(first), COUNT_ROWS):
                some = first[at : at + COUNT_ROWS]
                yield counts_batch(k1[some], k2[some], tag[order[some]], n[at : at + COUNT_ROWS])


def scan(rows: DataFrame, number: int, shards: int, longest: int, tables: Broadcast, bits: int) -> DataFrame:
    """Counts of all phrases that are active in scan `number`, over a shard's rows, in blocks. Length 0 counts all words of a language.

    `tables[k - 1]` has for each slot the first scan before which a phrase of k words in it had reached the threshold.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, counter = received(tables, np.uint8), Counter()
        for words, names in held_words(batches):
            phrases = Phrases(words, names)
            if number < shards:
                at = np.flatnonzero(phrases.inside)
                yield from counter.add(phrases.keys(0, at), phrases.keys(1, at), np.full(len(at), 1 << START_BITS))
                n = np.bincount(words.lang[at], minlength=len(names))
                k1, k2 = phrases.lang_keys()
                order = np.argsort(k1)
                yield counts_batch(k1[order], k2[order], np.zeros(len(n)), n[order])
            while phrases.length < longest and len(phrases.whole) > 1:
                since = np.where(phrases.whole, ready[phrases.length - 1][slots(phrases.keys(0))], NEVER).astype(np.int32)
                start = np.maximum(since[:-1], since[1:])
                phrases.lengthen()
                at = np.flatnonzero((start <= number) & (number < start + shards) & phrases.inside)
                yield from counter.add(phrases.keys(0, at), phrases.keys(1, at), (phrases.length << START_BITS) + start[at])
        yield from counter.counts()

    return rows.select("lang", "text").mapInArrow(lambda batches: as_blocks(counted(batches), bits), BLOCKS)


def slot_bitmaps(rows: DataFrame, lengths: int) -> np.ndarray:
    """Which slots the keys of `rows` (length, k1) lie in: a row of truth values for each length."""
    return np.stack([slot_bitmap(rows.where(F.col("length") == length).select("k1"), SLOT_BITS) for length in range(1, lengths + 1)])


def dealt(documents: DataFrame, shards: int, lang: str, text: str) -> DataFrame:
    """lang, text, part and shard of all rows, written by part. A shard is every so many-th part.

    A task writes one part, so it holds one file open, and large tables give no small files; a table of few input
    splits has empty parts.
    """
    folder = new_folder(documents.sparkSession, "shards")
    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).write.option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(folder)
    written = documents.sparkSession.read.schema("lang string, text string, part int").parquet(folder)
    return written.withColumn("shard", F.pmod("part", F.lit(shards)))


def count_phrases(rows: DataFrame, shards: int = SHARDS, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """length, k1, k2, n: exact counts of all phrases with `threshold` occurrences, by key; length 0 holds all words of a language.

    `rows` (lang, text, shard) are written.
    """
    tables = np.full((max(1, longest - 1), 2**SLOT_BITS), NEVER, np.uint8)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(1, int(size // BUCKET_BYTES).bit_length()), SLOT_BITS)
    state, number, last_change = None, 0, 0
    while number < shards or number < last_change + shards:
        shared = sent(rows.sparkSession, tables)
        found = scan(rows.where(F.col("shard") == number % shards), number, shards, longest, shared, bits)
        found = found if state is None else state.select(*found.columns).unionByName(found)
        number += 1
        state = materialise(merged(found, number, shards, threshold, len(tables), bits), "counts")
        shared.destroy()
        reached = reached_slots(state, len(tables), bits) & (tables == NEVER)
        if reached.any():
            tables[reached], last_change = number, number
    return materialise(counts_of(state), "counts")


def read_words(rows: DataFrame, wanted: Broadcast, longest: int) -> DataFrame:
    """lang, length, k1, k2 and phrase of phrases in the wanted slots, mostly once a task; a phrase of length 0 is empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = received(wanted, bool), np.zeros(2**SEEN_BITS, np.uint64)
        for words, names in held_words(batches):
            phrases = Phrases(words, names)
            k1, k2 = phrases.lang_keys()
            columns = [pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b""] * len(names), pa.binary())], ["lang", "length", "k1", "k2", "phrase"])
            while True:
                k1 = phrases.keys(0)
                at = np.flatnonzero(phrases.inside & kept[phrases.length - 1][slots(k1)])
                k1, k2 = k1[at], phrases.keys(1, at)
                both = k1 ^ k2
                place = (both >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
                new = np.flatnonzero(seen[place] != both)
                first = new[np.unique(both[new], return_index=True)[1]]
                at, k1, k2 = at[first], k1[first], k2[first]
                seen[place[first]] = both[first]
                lang = pa.array(names, pa.string()).take(pa.array(words.lang[at]))
                columns = [lang, pa.array(np.full(len(at), phrases.length, np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
                text = pa.array([phrases.text(i) for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, text], ["lang", "length", "k1", "k2", "phrase"])
                if phrases.length == longest or len(phrases.whole) < 2:
                    break
                phrases.lengthen()

    return rows.select("lang", "text").mapInArrow(compute, "lang string, length int, k1 long, k2 long, phrase binary")


def with_words(rows: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, length, phrase and n of the counted phrases, their words read in one more scan; a phrase of length 0 is empty.

    The scan goes through the parts of the rows in growing steps, and looks in each for the phrases not found before it: frequent
    ones are read from the first small part, by few tasks, and only rare ones are looked for in all.
    """
    key, named, missing, parts = ["length", "k1", "k2"], None, counts, list(range(PARTS))
    while parts:
        step = len(parts) if named is None and PARTS < 4 else max(1, (PARTS - len(parts)) or 1)
        chosen, parts = parts[:step], parts[step:]
        wanted = sent(rows.sparkSession, slot_bitmaps(missing, longest))
        read = read_words(rows.where(F.col("part").isin(chosen)), wanted, longest).groupBy(*key).agg(F.min(F.struct("lang", "phrase")).alias("found"))
        found = materialise(missing.join(read, key).select(*key, "n", "found.lang", F.col("found.phrase").cast("string").alias("phrase")), "named")
        wanted.destroy()
        named = found if named is None else named.unionByName(found)
        if parts:
            missing = materialise(missing.join(found.select(*key), key, "left_anti"), "unnamed")
            if missing.isEmpty():
                break
    return named.select("lang", "length", "phrase", "n")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one contains. `phrases` (lang, length, phrase, n) are written."""
    word = F.split("phrase", " ")
    of = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    candidates = phrases.where("length > 1").select("lang", "phrase", F.col("n").alias("a"), "length", word.alias("words"))
    # Every shorter phrase of two words or more inside a candidate, with the greatest count of such a candidate.
    lengths = F.sequence(F.lit(2), F.col("length") - 1)
    inside = candidates.where("length > 2").select("lang", "words", "a", "length", F.explode(lengths).alias("m"))
    placed = inside.select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("at"))
    held = placed.groupBy("lang", of(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    alone = candidates.join(held, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    cuts = alone.select("lang", "phrase", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    parts = materialise(cuts.select("lang", "phrase", "a", "k", of(F.lit(1), F.col("k")).alias("first"), of(F.col("k") + 1, F.col("length")).alias("rest")), "cuts")
    counted_parts = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    with_l = materialise(join_beside_hot(parts, counted_parts, "lang", "first"), "cuts")
    with_r = join_beside_hot(with_l, counted_parts.withColumnsRenamed({"first": "rest", "l": "r"}), "lang", "rest")
    a, left, right = (F.col(name).cast("decimal(15,0)") for name in "alr")
    measured = with_r.withColumn("numerator", F.lit(1_000_000).cast("decimal(7,0)") * a * a).withColumn("denominator", left * right)
    lowest = F.min(F.struct(F.expr("numerator div denominator").alias("score"), "k", "l", "r")).alias("cut")
    return measured.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(documents: DataFrame, top: int = TOP, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first `top` candidates of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = dealt(documents, shards, lang, text)
    with batch_rows(documents.sparkSession, TEXT_ROWS):
        counts = count_phrases(rows, shards, longest, threshold)
        phrases = materialise(with_words(rows, counts, longest), "phrases")
    found = scored(phrases.where("length > 0"))
    best = top_per_group(found, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    totals = phrases.where("length = 0").select("lang", F.col("n").alias("all_words"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
