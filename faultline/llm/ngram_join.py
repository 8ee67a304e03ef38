"""Jaccard self-join of documents on word shingles, by chosen paths.

Every distinct shingle set is embedded as SIGNATURE minimum hashes; two sets share each of them with a chance of their
similarity. A run starts with all sets in one bucket and splits buckets recursively: a bucket samples one or two
signature places (1 / similarity on average at first, DEEPER times as many below, drawn from the bucket's own path), and
a set goes to one child for each place, chosen by its hash there. So sets of the wanted similarity stay together at least
as often as they split, others part fast. A bucket of at most LEAF_ROWS sets, or at MAX_DEPTH, is a leaf: all its pairs are compared. Large leaves are compared
in blocks, so no task holds one whole and none is cut short. Runs repeat until the target recall is reached for pairs of
exactly the least similarity that need all MAX_DEPTH splits; pairs in smaller buckets are met more often. All runs split
by the same signatures, so the number of runs follows from the mean, over the binomial number of places that such a pair
agrees in, of the chance to survive the splits; pairs that the comparison of signatures leaves out count as missed.

Equal shingle sets form one class, whatever their number, and enter the join as one set. A pair that meets in several
leaves counts in the first of them only. Leaves first compare signatures, with a wide margin, to find the sets that need
an exact comparison at all; then intersections are counted exactly. Links leave the tasks as one row for each set and
leaf: how many documents it is linked with, and the least set it is connected to, so no list of pairs is ever written.

Result: one row per row of the input, with `class_id`, the least doc_id of its connected group, and `n_links`, the
number of other documents of its own shingle set or linked to it.

Defined results: words are runs of characters other than ASCII white space. A text of one to SHINGLE - 1 words has all of
them as its one shingle. Null, empty and blank texts have no shingles and no links; their class is their own id. Rows
without an id take part; class_id is null where no row of the group has an id. Repeated rows count as copies. An empty table
gives an empty result. Only the id and the text are read (and the columns asked for), so names of other columns cannot clash;
`one_of_each_group` passes them on whatever their names. A text of any length is taken whole: the hashes of its words are
held while its shingles are hashed (some 50 bytes each), and its signature is computed in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.components import connected_components
from faultline.llm.support import fresh, hashed_words, materialise, mixed, run_hashes, slices, table, those_wanted, whole_groups

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99999
SIGNATURE, LEAF_ROWS, MAX_DEPTH, BLOCK_ROWS = 64, 256, 3, 512
#: Places that a bucket below the first splits on, as a multiple of 1 / similarity.
DEEPER = 1.4
#: Signatures may fall short of the similarity by so many standard deviations before a pair is left out.
MARGIN = 5.5
SEED = np.uint64(0x5851F42D4C957F2D)
#: Called in a task, it gives a function from texts (or nulls) to a whole number for each.
Measure = Callable[[], Callable[[pa.Array], np.ndarray]]
FACTOR = mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
SHIFT = mixed(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values if keep.all() else values[keep]


def sets_of(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. Texts are hashed together, so their words are never Python objects."""
    words, first = hashed_words(texts)
    runs = run_hashes(words, size) if len(words) >= size else np.empty(0, np.uint64)
    out = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if 0 < end - begin < size:
            out.append(run_hashes(words[begin:end], end - begin) ^ np.uint64(end - begin))
        else:
            out.append(distinct(runs[begin : max(begin, end - size + 1)]))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """The least of the values under each of SIGNATURE permutations, shortened to 32 bits."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[None, at : at + 4096] * FACTOR[:, None] + SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def text_key(text: str | Column = "text") -> Column:
    return F.md5(F.col(text) if isinstance(text, str) else text)


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = (), measures: dict[str, Measure] | None = None) -> DataFrame:
    """Per row: its id, a key of its text, and its shingle set's key (`node`), size and signature, then the `carried` columns and the `measures` of its text."""

    measures = measures or {}
    names = ["doc_id", "text_key", "node", "n_shingles", "signature", *carried, *measures]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = [start() for start in measures.values()]
        for batch in slices(batches):
            texts = batch.column(2)
            sets = sets_of(texts)
            more = [pa.array(measure(texts), pa.int64()) for measure in measured]
            facts = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *facts, *batch.columns[3:], *more], names)

    own = [F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text")]
    chosen = documents.select(*own, *carried)
    fields = [(field.name, field.dataType.simpleString()) for field in chosen.schema.fields[3:]] + [(name, "long") for name in measures]
    more = "".join(f", `{name}` {kind}" for name, kind in fields)
    return chosen.mapInArrow(compute, "doc_id long, text_key string, node binary, n_shingles int, signature binary" + more)


def mean_places(similarity: float, depth: int) -> float:
    """How many places a bucket samples on average, after `depth` splits above it."""
    return (DEEPER if depth else 1) / similarity


def survival(similarity: float, depth: int, agreement: float | None = None) -> float:
    """The chance that a pair is still together, in some leaf, after `depth` splits of one run.

    `agreement` is the share of signature places in which the pair agrees, by default its similarity.
    """
    alive = 1.0
    for above in range(depth - 1, -1, -1):
        least = math.floor(mean_places(similarity, above))
        more = mean_places(similarity, above) - least
        apart = 1 - (similarity if agreement is None else agreement) * alive
        alive = 1 - (1 - more) * apart**least - more * apart ** (least + 1)
    return alive


def least_equal(similarity: float) -> float:
    """Signature places that a pair must agree in to be compared exactly."""
    return SIGNATURE * similarity - MARGIN * math.sqrt(SIGNATURE * similarity * (1 - similarity))


def expected_recall(similarity: float, runs: int, depth: int) -> float:
    """The chance that a pair of exactly this similarity is found, if it needs `depth` splits."""
    found = 0.0
    for equal in range(max(0, math.ceil(least_equal(similarity))), SIGNATURE + 1):
        chance = math.comb(SIGNATURE, equal) * similarity**equal * (1 - similarity) ** (SIGNATURE - equal)
        found += chance * (1 - (1 - survival(similarity, depth, equal / SIGNATURE)) ** runs)
    return found


def runs_for(similarity: float, recall: float, depth: int | None = None) -> int:
    depth = MAX_DEPTH if depth is None else depth
    if recall >= expected_recall(similarity, 10**6, depth):
        raise ValueError(f"signatures of {SIGNATURE} places and a margin of {MARGIN} do not reach a recall of {recall}")
    return next(runs for runs in range(1, 10**6 + 1) if expected_recall(similarity, runs, depth) >= recall)


def child_paths(path: np.ndarray, signatures: np.ndarray, places: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the children of rows in buckets `path`. Rows of one bucket use the same places, `places` on average."""
    draw = mixed(path ^ SEED)
    chance = (draw >> np.uint64(40)).astype(float) / 2**24
    more, least = places - math.floor(places), math.floor(places)
    rows, paths = [], []
    for k in range(least + 1):
        chosen = np.arange(len(path)) if k < least else np.flatnonzero(chance < more)
        # Different places for different k: an odd step around the signature.
        place = ((draw[chosen] & np.uint64(0xFFFF)) + np.uint64(k * 23)) % np.uint64(SIGNATURE)
        value = signatures[chosen, place.astype(np.int64)].astype(np.uint64)
        rows.append(chosen)
        paths.append(mixed(mixed(path[chosen] + place * np.uint64(0x9E3779B97F4A7C15)) ^ value))
    return np.concatenate(rows), np.concatenate(paths)


def split(rows: DataFrame, places: float, runs: int = 0) -> DataFrame:
    """Children of `rows` (path, node, signature), or of the roots of `runs` runs where rows have no path yet."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node")
            data = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, SIGNATURE)
            for run in range(runs or 1):
                path = np.full(len(node), mixed(np.array([run + 1], np.uint64))[0]) if runs else batch.column("path").to_numpy().view(np.uint64)
                owner, paths = child_paths(path, data, places)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), node.take(pa.array(owner))], ["path", "node"])

    return rows.mapInArrow(compute, "path long, node binary")


def leaves_of(nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """All leaves of all runs that hold two sets or more: path, node, size."""
    bucket_rows, leaves = split(nodes.select("node", "signature"), mean_places(similarity, 0), runs_for(similarity, recall)), None
    for depth in range(1, MAX_DEPTH + 1):
        bucket_rows = materialise(bucket_rows, "buckets")
        sizes = bucket_rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        sized = materialise(bucket_rows.join(sizes, "path"), "sized-buckets")
        small = sized if depth == MAX_DEPTH else sized.where(F.col("size") <= LEAF_ROWS)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = sized.where(F.col("size") > LEAF_ROWS)
        if depth == MAX_DEPTH or large.isEmpty():
            return leaves
        bucket_rows = split(large.join(nodes.select("node", "signature"), "node"), mean_places(similarity, depth))
    return leaves


def in_blocks(leaves: DataFrame) -> DataFrame:
    """Each leaf row once for every pair of blocks it takes part in: `meeting` names the pair, `side` the row's block in it."""
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    numbered = leaves.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    return paired.withColumn("meeting", meeting).withColumn("side", side).drop("size", "blocks", "own", "other")


def counted_here(path: int, side: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a meeting count in it: not within a block where two blocks meet, not met in an earlier leaf."""
    pairs = np.ones((len(side), len(side)), bool) if not side.any() else (side[:, None] != side[None, :])
    np.fill_diagonal(pairs, False)
    earlier = [s[s < path] for s in seen]
    values, place, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    shared = times > 1
    if shared.any():
        column = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(seen)), [len(e) for e in earlier])
        held = shared[place]
        member = np.zeros((len(seen), int(shared.sum())), np.float32)
        member[owner[held], column[place[held]]] = 1
        pairs &= (member @ member.T) == 0
    return pairs


def of_like_size(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :])


def similar_signatures(signatures: np.ndarray, similarity: float) -> np.ndarray:
    least = least_equal(similarity)
    out = np.zeros((len(signatures), len(signatures)), bool)
    for at in range(0, len(signatures), 32):
        out[at : at + 32] = (signatures[at : at + 32, None, :] == signatures[None, :, :]).sum(axis=2) >= least
    return out


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least the similarity, by exact counts. Only values that two sets share are kept."""
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column, owner = (np.cumsum(shared) - 1)[place], np.repeat(np.arange(len(sets)), sizes)
    held = shared[place]
    column, owner = column[held], owner[held]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, 8_000_000 // len(sets))
    for at in range(0, int(shared.sum()), width):
        chosen = (column >= at) & (column < at + width)
        member = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
        member[owner[chosen], column[chosen] - at] = 1
        common += member @ member.T
    return common / (sizes[:, None] + sizes[None, :] - common) >= similarity


def meetings(tables: Iterator[pa.Table]) -> Iterator[tuple[pa.Table, np.ndarray, list[np.ndarray]]]:
    """Each meeting of two or more rows: the table it is in, its row numbers, and every row's leaves."""
    for rows in tables:
        key = rows.column("meeting").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        seen = rows.column("seen").combine_chunks()
        offsets, values = seen.offsets.to_numpy(), seen.values.to_numpy()
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield rows, np.arange(a, b), [values[offsets[i] : offsets[i + 1]] for i in range(a, b)]


def to_compare(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows of meetings (with signatures) that have a partner there to compare exactly."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_of, at, seen in meetings(whole_groups(batches, "meeting")):
            part = table_of.slice(at[0], len(at))
            data = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, SIGNATURE)
            pairs = similar_signatures(data, similarity)
            if len(at) > 2 or pairs[0, 1]:
                pairs &= of_like_size(part.column("n_shingles").to_numpy(), similarity)
                pairs &= counted_here(part.column("path")[0].as_py(), part.column("side").to_numpy(), seen)
                chosen = np.flatnonzero(pairs.any(axis=1))
                if len(chosen):
                    yield from part.drop_columns(["signature"]).take(pa.array(chosen)).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "signature")
    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(compute, schema)


def links(rows: DataFrame, similarity: float) -> DataFrame:
    """Per row of a meeting (with sets) that has links there: node, links (documents), and the least node it is connected to."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_of, at, seen in meetings(whole_groups(batches, "meeting")):
            part = table_of.slice(at[0], len(at))
            node = part.column("node").to_pylist()
            sets = [np.frombuffer(s, "<u8") for s in part.column("set").to_pylist()]
            pairs = similar_sets(sets, similarity)
            pairs &= counted_here(part.column("path")[0].as_py(), part.column("side").to_numpy(), seen)
            linked = np.flatnonzero(pairs.any(axis=1))
            if not len(linked):
                continue
            number = pairs @ part.column("copies").to_numpy()
            order = np.argsort(np.array(node, dtype=object))
            rank = np.empty(len(node), np.int64)
            rank[order] = np.arange(len(node))
            while True:  # the least rank among neighbours, until nothing changes
                lower = np.minimum(rank, np.where(pairs, rank[None, :], len(node)).min(axis=1))
                if (lower == rank).all():
                    break
                rank = lower
            yield pa.RecordBatch.from_arrays(
                [pa.array([node[i] for i in linked], pa.binary()), pa.array(number[linked], pa.int64()), pa.array([node[order[rank[i]]] for i in linked], pa.binary())],
                ["node", "links", "least"],
            )

    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(compute, "node binary, links long, least binary")


def shingle_sets(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node and set for `wanted` (node, doc_id, text_key), each computed from one document of that text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.astype("<u8").tobytes() for s in sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))
    texts = documents.select(ids.alias("id_key"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    keyed = materialise(wanted.select("node", F.coalesce("doc_id", F.lit(-1)).alias("id_key"), "text_key"), "wanted")
    key = F.xxhash64("id_key", "text_key")
    one = those_wanted(texts, key, keyed.select(key)).join(keyed, ["id_key", "text_key"]).dropDuplicates(["id_key", "text_key"])
    return one.select("node", "text").mapInArrow(compute, "node binary, set binary")


def similarity_classes(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = (), measures: dict[str, Measure] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (with the `carried` columns and the `measures`), and for every shingle set: node, first (its group's least id with that row's text key), n_links."""
    prints = materialise(fingerprints(documents, doc_id, text, carried, measures), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = materialise(
        prints.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "shingle-sets",
    )
    leaves = materialise(leaves_of(nodes, similarity, recall), "leaves")
    seen = leaves.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("seen"))
    facts = nodes.select("node", "copies", "n_shingles", "signature").join(seen, "node")
    compare = materialise(to_compare(in_blocks(leaves).join(facts, "node"), similarity), "to-compare")
    wanted = compare.select("node").distinct().join(nodes, "node").select("node", "first.doc_id", "first.text_key")
    linked = materialise(links(compare.join(shingle_sets(documents, wanted, doc_id, text), "node"), similarity), "links")
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    number = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "copies", "first").join(number, "node", "left").join(roots, "node", "left")
    grouped = joined.select("node", F.coalesce("root", "node").alias("root"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = grouped.groupBy("root").agg(F.min("first").alias("first"))
    return prints, grouped.select("node", "root", "n_links").join(least, "root").select("node", "first", "n_links")


def ngram_join(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, class_id, n_links."""
    prints, classes = similarity_classes(documents, similarity, recall, doc_id, text)
    found = prints.select("doc_id", "node").join(classes.select("node", "first.doc_id", "n_links").withColumnRenamed("doc_id", "class_id"), "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_group(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`documents` with one row of every connected group, the one of least id; rows without a word all stay."""
    _, classes = similarity_classes(documents, similarity, recall)
    id_key, key = fresh(documents, "id_key"), fresh(documents, "text_key")
    keep = classes.select(F.coalesce("first.doc_id", F.lit(-1)).alias(id_key), F.col("first.text_key").alias(key)).distinct()
    keyed = documents.withColumn(id_key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(key, text_key("text"))
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = keyed.where(has_word).join(keep, [id_key, key], "left_semi").dropDuplicates([id_key, key])
    return chosen.unionByName(keyed.where(~has_word)).drop(id_key, key)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
