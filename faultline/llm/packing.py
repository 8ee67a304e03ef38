"""Best-fit packing of documents into training sequences, with conflicts.

A bin holds at most `capacity` tokens, at most `per_source` pieces of one source and at most one piece of a duplicate
cluster. Documents longer than a bin are cut into pieces, all of them full but the last; every token is packed once.

Pieces are dealt at random to shards of about SHARD_PIECES, whatever their source or cluster, and every shard is packed
by itself: pieces in order of falling length, open bins in order of their free space. A piece's search starts at the bin of least sufficient
space and goes on to its successors until one is compatible, by the bin's bitmaps of sources and clusters; without one it opens a new
bin. So a bin is the tightest compatible one of its shard. Sharding costs at most a few half-full bins a shard.

Defined results: rows whose length is null or not positive are in no bin and not in the result of `packed`; op9_packing gives
documents without a token a row of 0 tokens and no bin. A null source or cluster conflicts with nothing. Repeated rows are
packed each; ties in length go by id. An empty table gives an empty result. Only the columns named are read, so names of
others cannot clash; `with_cluster` replaces a column of the name it is given. Documents of any length are cut into pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.ngram_join import similarity_classes, text_key
from faultline.llm.support import fresh, join_beside_hot, materialise, table
from faultline.llm.token_counts import token_counter, token_counts

CAPACITY, PER_SOURCE, SHARD_PIECES = 4096, 4, 4096


@dataclass
class Bin:
    number: int
    used: int
    sources: int
    clusters: int


def pack(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> tuple[list[int], list[int]]:
    """The bin and the place in it of every piece. Pieces come in the order they are packed in."""
    source_bit = {s: i * per_source for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    shared = [c for c, n in Counter(clusters).items() if n > 1 and c is not None]  # others cannot conflict
    cluster_bit = {c: 1 << i for i, c in enumerate(shared)}
    slots = (1 << per_source) - 1
    free: list[tuple[int, int]] = []  # free space and number of each open bin, ascending
    bins: list[Bin] = []
    numbers, places = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        at_source, bit = source_bit.get(source), cluster_bit.get(cluster, 0)
        at = bisect_left(free, (length, -1))
        while at < len(free):
            chosen = bins[free[at][1]]
            if not chosen.clusters & bit and (at_source is None or chosen.sources >> at_source & slots != slots):
                del free[at]
                break
            at += 1
        else:
            chosen = Bin(len(bins), 0, 0, 0)
            bins.append(chosen)
        numbers.append(chosen.number)
        places.append(chosen.used)
        chosen.used += length
        chosen.clusters |= bit
        if at_source is not None:  # the next of the source's slots
            chosen.sources |= ((chosen.sources >> at_source & slots) + 1) << at_source
        if chosen.used < capacity:
            insort(free, (capacity - chosen.used, chosen.number))
    return numbers, places


def packed(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack `items` (doc_id, length, source, cluster): one row for each piece.

    doc_id, piece and start (its number and first token in the document), n_tokens, bin_id, place (its first token in the bin).
    """
    long = F.col("length").cast("long")
    last = F.floor((long - 1) / capacity)
    wanted = items.where(long > 0).select("doc_id", long.alias("length"), "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = wanted.select("doc_id", "piece", start.alias("start"), F.least(F.col("length") - start, F.lit(capacity)).alias("n_tokens"), "source", "cluster")
    # The row numbers are written, so a task that runs again finds the same.
    written = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-written.count() // shard_pieces))
    dealt = written.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def pack_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        columns = {name: rows.column(name) for name in ("doc_id", "piece", "start", "n_tokens")}
        numbers, places = pack(*(rows.column(name).to_pylist() for name in ("n_tokens", "source", "cluster")), capacity, per_source)
        bins = np.array(numbers, np.int64) + np.int64(rows.column("shard")[0].as_py()) * np.int64(2**24)
        return pa.table({**columns, "bin_id": pa.array(bins), "place": pa.array(places, pa.int64())})

    kind = items.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(pack_shard, f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, place long")


def packed_documents(documents: DataFrame, model_path: str, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Pack `documents` (doc_id, text, source) by their tokens. The default cluster is the text itself, so copies never meet in a bin.

    with_cluster gives clusters that near copies share.
    """
    chosen = documents.select("doc_id", "source", (F.xxhash64("text") if cluster is None else cluster).alias("cluster"), "text")
    counted = token_counts(chosen, model_path, order=["doc_id"]).select("doc_id", F.col("n_tokens").alias("length"), "source", "cluster")
    # Written, so that no filter above counts a second time.
    return packed(materialise(counted, "lengths"), capacity, per_source)


def with_cluster(documents: DataFrame, name: str) -> DataFrame:
    """`documents` with a column `name` (in place of one that it has): its group of near copies (ngram_join), or the hash of a text without shingles."""
    prints, classes = similarity_classes(documents)
    first = F.struct(F.coalesce("first.doc_id", F.lit(-1)).alias("doc_id"), "first.text_key")
    key = fresh(documents, "text_key")
    # Every row of a text has the same shingles, so a text has one class, whatever its rows' ids.
    found = prints.where("node is not null").select("node", "text_key").distinct().join(classes.select("node", F.xxhash64(first).alias(name)), "node")
    keyed = documents.withColumn(key, text_key("text"))
    joined = keyed.drop(name).join(found.select(F.col("text_key").alias(key), name), key, "left")
    return joined.withColumn(name, F.when(F.col("text").isNotNull(), F.coalesce(name, F.xxhash64("text")))).drop(key)


def measured(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, source, length (tokens) and cluster (as with_cluster has it) of every row, from one pass over the texts.

    Tokens and shingles are taken from a text by the same Python worker, so a task has one. What the pass gives is written; classes meet these small rows, and no text is moved but those to be compared.
    """
    texts = documents.select("doc_id", "text", "source", F.xxhash64("text").alias("text_hash"), F.col("text").isNotNull().alias("has_text"))
    tokens = token_counter(texts, model_path, order=["doc_id"])
    prints, classes = similarity_classes(texts, carried=("source", "text_hash", "has_text"), measures={"n_tokens": tokens})
    first = F.struct(F.coalesce("first.doc_id", F.lit(-1)).alias("doc_id"), "first.text_key")
    found = join_beside_hot(prints.drop("signature", "text_key"), classes.select("node", F.xxhash64(first).alias("cluster")), "node")
    cluster = F.when(F.col("has_text"), F.coalesce("cluster", "text_hash")).alias("cluster")
    return materialise(found.select("doc_id", "source", F.col("n_tokens").alias("length"), cluster), "lengths")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; one without a token has a row of 0 tokens in no bin."""
    import public_tokenizers

    items = measured(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = items.where("length <= 0").select("doc_id", zero.alias("piece"), zero.alias("start"), zero.alias("n_tokens"), none.alias("bin_id"), none.alias("place"))
    return packed(items).unionByName(empty)
