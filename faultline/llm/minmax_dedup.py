"""Near-duplicate detection with min-max hashing: one row per document with the component it is linked into.

Under each of PERMUTATIONS permutations of the hashed shingles both the least and the largest value of a set are kept, so
a signature of 2 * PERMUTATIONS values costs half the hash evaluations of as many minimum hashes. Two sets share a minimum
with a chance of their similarity, and a maximum likewise; the two events of one permutation exclude each other a little
(they cannot lie on the same shingle), so the share of equal values is unbiased and varies less than that of independent
minima. A band is ROWS minima, or ROWS maxima, of neighbouring permutations. With 16 bands of 4 a pair at exactly the
least similarity of 0.85 misses every band with a chance of 1 - (1 - 0.85^4)^16, below 1e-5 (`missed`).

Equal shingle sets are one set. Sets that share a band are compared on their full sets, in rounds. The first rounds
(FIRST_BANDS) take the buckets of a few bands, in blocks of about BLOCK_ROWS sets dealt anew in each band, and link what
they find: a large group of near copies is connected after them, through blocks that overlap at random. The last round
takes the buckets of all bands that still hold two components. There the sets outside the bucket's largest component meet
each other and that component, in pairs of blocks, less pairs met in an earlier band. All rounds leave out pairs of one
component and pairs whose signatures lie far below the similarity (MARGIN standard deviations). Within a meeting a set is compared with all sets not yet
in its component, so a block of near copies costs one comparison a set and not one a pair. All pairs that could join two
components are covered, whatever the size of a bucket; no list of pairs is written, and no task holds a whole bucket.

Result (doc_id, n_shingles, component_id, kept): component_id is the least doc_id reachable over links, kept tells whether
it is the row's own.

Defined results: words are runs of characters other than ASCII white space, A-Z in lower case. A text of one or two words
has them as its one shingle. Null, empty and blank texts have no shingles and are linked with nothing: their component is
their own id. Rows without an id take part; their component is null where no row of it has an id, and they are kept only
then. Repeated rows are copies with one id, each of which is kept or not as the id is. An empty table gives an empty
result. Very long texts are hashed a piece at a time (a word costs 16 bytes while a text is worked on). Only the two
columns named are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.components import connected_components
from faultline.llm.support import WordHashes, join_beside_hot, materialise, mixed, slices, table, text_pieces, those_wanted, whole_groups, word_hashes

SHINGLE, LEAST_PERCENT = 3, 85
PERMUTATIONS, ROWS = 32, 4
#: First and last band of the rounds that compare within blocks only.
FIRST_BANDS = [(0, 2), (2, 6)]
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK_ROWS = 256
#: Signatures may fall short of the similarity by so many standard deviations before a pair is left out.
MARGIN = 5.5
FACTOR = mixed(np.arange(7001, 7001 + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
SHIFT = mixed(np.arange(9001, 9001 + PERMUTATIONS, dtype=np.uint64))


def missed(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """The chance that a pair of this similarity shares no band."""
    return (1 - similarity**rows) ** bands


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes: only A-Z change
    split = (piece.split() for piece in text_pieces(data))
    word = np.concatenate([np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in split])
    width = min(size, len(word))
    if not width:
        return word
    total = word[: len(word) - width + 1].copy()
    for at in range(1, width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += word[at : len(word) - width + 1 + at]
    return np.unique(mixed(total + np.uint64(width)))


def signature(values: np.ndarray) -> np.ndarray:
    """The least value of a set under every permutation, then the largest, shortened to 32 bits."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), 2048):
        permuted = values[None, at : at + 2048] * FACTOR[:, None]
        permuted += SHIFT[:, None]
        np.minimum(least, permuted.min(axis=1), out=least)
        np.maximum(most, permuted.max(axis=1), out=most)
    return (np.concatenate([least, most]) >> np.uint64(32)).astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for every band of every signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for at in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, at])
    return keys


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, a hash of its text, and its shingle set's key (`node`), size and signature."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches, 200):
            facts = []
            for scalar in batch.column(2):
                found = shingle_set(scalar.as_py(), hashes)
                facts.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), signature(found).tobytes()) if len(found) else (None, 0, None))
            columns = list(zip(*facts, strict=True)) if facts else [[], [], []]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "text_key", "node", "n_shingles", "signature"])

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return chosen.mapInArrow(compute, "doc_id long, text_key long, node binary, n_shingles long, signature binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, band, node, size and a null root, for every band of a set that another set shares."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keys = band_keys(as_signatures(batch.column("signature")))
            owner = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            bands = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), bands, batch.column("node").take(owner)], ["bucket", "band", "node"])

    rows = materialise(nodes.select("node", "signature").mapInArrow(compute, "bucket long, band int, node binary"), "bands")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return materialise(join_beside_hot(rows, sizes, "bucket").where("size is not null").withColumn("root", F.lit(None).cast("binary")), "buckets")


def as_signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2 * PERMUTATIONS)


def least_equal(percent: int) -> float:
    """Signature values that a linked pair has in common, but for MARGIN standard deviations."""
    similarity, values = percent / 100, 2 * PERMUTATIONS
    return values * similarity - MARGIN * math.sqrt(values * similarity * (1 - similarity))


def worth_comparing(part: pa.Table, percent: int, earlier_bands: bool) -> np.ndarray:
    """Which pairs of a meeting's rows (node, n_shingles, signature, band, side, root) need an exact comparison."""
    data, sizes = as_signatures(part.column("signature")), part.column("n_shingles").to_numpy()
    side, root = part.column("side").to_numpy(), part.column("root").to_pylist()
    pairs = np.ones((len(side), len(side)), bool) if not side.any() else side[:, None] != side[None, :]
    np.fill_diagonal(pairs, False)
    number = {name: i for i, name in enumerate(dict.fromkeys(root))}
    component = np.array([number[name] if name is not None else -1 - i for i, name in enumerate(root)])
    pairs &= component[:, None] != component[None, :]
    pairs &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    band, least = part.column("band")[0].as_py(), least_equal(percent)
    for at in range(0, len(data), 32):
        rows = np.flatnonzero(pairs[at : at + 32].any(axis=1)) + at
        if not len(rows):
            continue
        equal = data[rows, None, :] == data[None, :, :]
        pairs[rows] &= equal.sum(axis=2) >= least
        if earlier_bands and band:
            pairs[rows] &= ~equal[:, :, : band * ROWS].reshape(len(rows), len(data), band, ROWS).all(axis=3).any(axis=2)
    return pairs


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others reach the similarity with one, by exact counts."""
    sizes = np.array([len(s) for s in others])
    values = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, values), len(one) - 1)
    common = np.add.reduceat(one[place] == values, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= percent * (len(one) + sizes - common)


def components_of(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """A label for every set, equal for sets connected by links among `pairs`. Pairs already connected are not compared."""
    label = np.arange(len(sets))
    for i in range(len(sets)):
        todo = np.flatnonzero(pairs[i] & (label != label[i]))
        if not len(todo):
            continue
        for j in todo[linked(sets[i], [sets[k] for k in todo], percent)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    return label


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each meeting of two or more, from a task sorted by meeting."""
    for rows in whole_groups(batches, "meeting"):
        key = rows.column("meeting").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield rows.slice(a, b - a).combine_chunks()


def compared(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, earlier_bands: bool) -> DataFrame:
    """Edges (a, b) that connect what is linked within each meeting. `rows`: meeting, band, side, node, root."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in meetings(batches):
            chosen = np.flatnonzero(worth_comparing(part, percent, earlier_bands).any(axis=1))
            if len(chosen):
                yield from part.take(pa.array(chosen)).to_batches()

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in meetings(batches):
            found = [np.frombuffer(s, "<u8") for s in part.column("set").to_pylist()]
            label = components_of(found, worth_comparing(part, percent, earlier_bands), percent)
            other = np.flatnonzero(label != np.arange(len(label)))
            node = part.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(label[other])).combine_chunks(), node.take(pa.array(other)).combine_chunks()], ["a", "b"])

    facts = nodes.select("node", "n_shingles", "signature")
    met = rows.join(facts, "node").repartition("meeting").sortWithinPartitions("meeting")
    names = "meeting long, band int, side int, node binary, root binary, n_shingles long, signature binary"
    order = [field.split()[0] for field in names.split(", ")]
    candidates = materialise(met.select(*order).mapInArrow(choose, names), "candidates")
    with_sets = candidates.join(sets, "node").repartition("meeting").sortWithinPartitions("meeting")
    return materialise(with_sets.select(*order, "set").mapInArrow(connect, "a binary, b binary"), "edges")


def full_sets(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node and set of `wanted` (node, doc_id, text_key), each from one row of that id and text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches, 200):
            sets = pa.array([shingle_set(scalar.as_py(), hashes).astype("<u8").tobytes() for scalar in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "set"])

    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))
    texts = documents.select(ids.alias("id_key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    keyed = materialise(wanted.select("node", F.coalesce("doc_id", F.lit(-1)).alias("id_key"), "text_key"), "wanted")
    key = F.xxhash64("id_key", "text_key")
    one = those_wanted(texts, key, keyed.select(key)).join(keyed, ["id_key", "text_key"]).select("node", "text")
    return materialise(one.mapInArrow(compute, "node binary, set binary").dropDuplicates(["node"]), "sets")


def in_blocks(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The buckets of the bands from first up to last in blocks, dealt by set and band."""
    block = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / BLOCK_ROWS))
    chosen = rows.where(F.col("band").between(first, last - 1))
    return chosen.select(F.xxhash64("bucket", block).alias("meeting"), "band", F.lit(0).alias("side"), "node", "root")


def still_mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets with two components or more: with root, top (the largest one there), n_top and n_others."""
    rooted = materialise(rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    spread = counts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    largest = spread.where("top.n < all").select("bucket", F.col("top.root").alias("top"), F.col("top.n").alias("n_top"), (F.col("all") - F.col("top.n")).alias("n_others"))
    return materialise(join_beside_hot(rooted, largest, "bucket").where("top is not null"), "mixed")


def in_pairs_of_blocks(found: DataFrame) -> DataFrame:
    """The sets outside a bucket's largest component meet each other and the largest, in pairs of blocks; a small bucket meets whole."""
    whole = (F.col("size") <= BLOCK_ROWS).alias("whole")
    blocks = found.select("*", whole, F.ceil(F.col("n_top") / BLOCK_ROWS).alias("tops"), F.ceil(F.col("n_others") / BLOCK_ROWS).alias("others"))
    own = F.pmod(F.xxhash64("node", "band"), F.when(F.col("root") == F.col("top"), F.col("tops")).otherwise(F.col("others")))
    placed = blocks.withColumn("own", own)
    among, to_top = F.sequence(F.lit(0).cast("long"), F.col("others") - 1), F.sequence(F.lit(0).cast("long"), F.col("tops") - 1)

    def meeting(kind: str, least: Column, most: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("bucket", F.lit(kind), least, most).alias("meeting"), side.cast("int").alias("side"))

    pair_side = lambda other: F.when(F.col("own") == other, 0).otherwise(F.when(F.col("own") < other, 1).otherwise(2))
    of_top = F.transform(among, lambda other: meeting("top", F.col("own"), other, F.lit(1)))
    of_other = F.concat(
        F.transform(to_top, lambda block: meeting("top", block, F.col("own"), F.lit(2))),
        F.transform(among, lambda other: meeting("others", F.least("own", other), F.greatest("own", other), pair_side(other))),
    )
    alone = F.array(meeting("whole", F.lit(0), F.lit(0), F.lit(0)))
    chosen = F.when(F.col("whole"), alone).when(F.col("root") == F.col("top"), of_top).otherwise(of_other)
    return placed.select("band", "node", "root", F.explode(chosen).alias("at")).select("at.meeting", "band", "at.side", "node", "root")


def near_duplicates(documents: DataFrame, percent: int = LEAST_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id, kept."""
    prints = materialise(fingerprints(documents, doc_id, text), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    grouped = prints.where("node is not null").groupBy("node").agg(
        F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    nodes = materialise(grouped, "shingle-sets")
    shared = buckets(nodes)
    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "first.doc_id", "first.text_key")
    sets = full_sets(documents, wanted, doc_id, text)
    mixed_rows, edges = shared, None
    for first, last in [*FIRST_BANDS, (0, BANDS)]:
        whole = (first, last) == (0, BANDS)
        if edges is not None and mixed_rows.isEmpty():
            break
        rows = in_pairs_of_blocks(mixed_rows) if whole else in_blocks(mixed_rows, first, last)
        found = compared(rows, nodes, sets, percent, whole)
        edges = found if edges is None else edges.union(found)
        roots = connected_components(edges)
        if not whole:
            mixed_rows = still_mixed(shared, roots)
    joined = nodes.select("node", "first").join(roots, "node", "left")
    placed = materialise(joined.select("node", F.coalesce("root", "node").alias("root"), "first"), "placed-sets")
    least = placed.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    classes = join_beside_hot(placed, least, "root").select("node", "component_id")
    found = join_beside_hot(prints.select("doc_id", "n_shingles", "node"), classes, "node")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
