"""Interaction audit: what each filter of a chain removes, in every order, from sorted posting lists.

Every row gets a row number when its failures are written, and row numbers are cut into ranges of RANGE_ROWS. For each
part of the table and each range, the numbers of the rows that fail a filter are kept as one sorted list (a posting
list), beside lists of the good and of the toxic rows. For every set of filters the union of their lists comes from one
k-way merge that gallops: the list with the least head is run through, in doubling steps, up to the least head of the
others, and the run is copied whole. What a filter removes after such a set is its own list without that union, again by
galloping; what is lost of the good rows is that difference cut with their list. Sizes are summed over ranges; the orders
only look the sums up, since what a step removes depends on the set of filters before it and not on their order.

A list holds at most RANGE_ROWS numbers whatever the part's size, so no part is gathered in a task, and only sums (parts x
filters x sets) meet. Copies are found by the least id of every text: counts are combined in the map tasks, and the few
texts with a large share of the rows are joined by broadcast (support.join_beside_hot), so a giant group is not moved.

Defined results: null text counts as empty. A null part and an empty one are the same part, ''. Rows without an id are
counted; they are no copies of anything and have no label. Repeated rows count each; a row is a copy if an equal text
has a smaller id, so equal rows of one id are not copies of each other. Repeated labels: one that says so is enough. An
empty table has no parts. Very long texts are split into words a piece at a time. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.support import join_beside_hot, materialise, slices, table, text_pieces

FILTERS = "ABCDE"
RANGE_BITS = 16
RANGE_ROWS = 2**RANGE_BITS
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def gallop(ids: list[int], at: int, wanted: int) -> int:
    """The first place from `at` on whose id is `wanted` or more: steps double until one goes too far, then that one is halved."""
    step, last = 1, len(ids)
    while at + step < last and ids[at + step] < wanted:
        at += step
        step *= 2
    return bisect_left(ids, wanted, at, min(at + step, last))


def union(lists: list[list[int]]) -> list[int]:
    """All ids of sorted lists of distinct ids, ascending, each once."""
    out: list[int] = []
    heads = [[ids, 0] for ids in lists if ids]
    while len(heads) > 1:
        least = min(heads, key=lambda head: head[0][head[1]])
        ids, at = least
        limit = min(head[0][head[1]] for head in heads if head is not least)
        end = at + 1 if ids[at] == limit else gallop(ids, at, limit)
        if ids[at] != limit:  # an id that another list holds too comes from that list
            out += ids[at:end]
        least[1] = end
        if end == len(ids):
            heads.remove(least)
    return out + heads[0][0][heads[0][1] :] if heads else out


def difference(ids: list[int], others: list[int]) -> list[int]:
    """The ids that are not among the others; both ascend."""
    out: list[int] = []
    at = other = 0
    while at < len(ids):
        other = gallop(others, other, ids[at])
        if other == len(others):
            return out + ids[at:]
        if others[other] == ids[at]:
            at += 1
            continue
        end = gallop(ids, at, others[other])
        out += ids[at:end]
        at = end
    return out


def range_sizes(postings: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For every filter and set of other filters before it: set, filter, failing either, removed, and good and toxic removed."""
    numbers = range(len(postings))
    merged = {sum(1 << i for i in chosen): union([postings[i] for i in chosen]) for size in range(len(postings) + 1) for chosen in combinations(numbers, size)}
    for before, gone in merged.items():
        for i in numbers:
            if not before >> i & 1:
                removed = difference(postings[i], gone)
                lost = [len(removed) - len(difference(removed, marked)) for marked in (good, toxic)]
                yield before, i, len(merged[before | 1 << i]), len(removed), *lost


def document_failures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: Column | str = "lang") -> DataFrame:
    """doc_id, part, text_key and the failures A to D of every row's whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, failures = [], []
            for scalar in batch.column(2):
                content = scalar.as_py() or ""
                data, words, distinct = content.encode("utf-8", "surrogatepass"), 0, set()
                for piece in text_pieces(data):
                    found = piece.split()
                    words += len(found)
                    distinct.update(found)
                capitals = len(data) - len(data.translate(None, CAPITALS))
                has_symbol = len(data.translate(None, SYMBOLS)) < len(data)
                keys.append(xxhash.xxh3_128_digest(data))
                failures.append((words < 100, 100 * len(distinct) < 80 * words, 100 * capitals > 10 * len(content), has_symbol))
            columns = [pa.array(column, pa.bool_()) for column in zip(*failures, strict=True)] if failures else [pa.array([], pa.bool_())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), *columns], ["doc_id", "part", "text_key", *"ABCD"])

    part = F.col(part) if isinstance(part, str) else part
    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return chosen.mapInArrow(compute, "doc_id long, part string, text_key binary, A boolean, B boolean, C boolean, D boolean")


def with_copies(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (written) with `name`: whether an equal text, by text_key, has a smaller id."""
    copied = rows.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    found = join_beside_hot(rows, copied.where("least < most").select("text_key", "least"), "text_key")
    return found.withColumn(name, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` written with `row`, a number that ascends without gaps within each written part, so a task that runs again finds the same."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "failures")


def posting_lists(rows: DataFrame, filters: list[str]) -> DataFrame:
    """part, range, n_rows and the sorted lists: one for each filter, good and toxic. `rows` has them as booleans, and `row`."""
    place = F.col("row").bitwiseAND(RANGE_ROWS - 1).cast("int")
    lists = [F.sort_array(F.collect_list(F.when(F.col(name), place))).alias(name) for name in [*filters, "good", "toxic"]]
    return rows.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range")).agg(F.count("*").alias("n_rows"), *lists)


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """The audit of `rows` (part, row, good, toxic and a boolean for each filter, true where it fails), written rows numbered by `row`.

    One row for each part, order of the filters and step. The orders of n filters are n!, so n is small.
    """
    lists = materialise(posting_lists(rows, filters), "postings")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.to_pylist():
                measured = range_sizes([found[name] for name in filters], found["good"], found["toxic"])
                out += [(found["part"], found["n_rows"], *size) for size in measured]
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    names = ["n_rows", "before", "which", "failing", "removed", "good_lost", "toxic_lost"]
    schema = pa.schema([("part", pa.string())] + [(name, pa.int64()) for name in names])
    measured = lists.mapInArrow(sizes, "part string, " + ", ".join(f"{name} long" for name in names))
    summed = ["n_rows", "failing", "removed", "good_lost", "toxic_lost"]
    sums = materialise(measured.groupBy("part", "before", "which").agg(*(F.sum(name).alias(name) for name in summed)), "set-sizes")

    n = len(filters)
    # The orders in which a set of k filters comes first and this one next: k! before, (n - 1 - k)! after.
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("before") + 1)
    of_filter = sums.groupBy("part", "which").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("own"),
    )
    steps = [
        ("".join(filters[i] for i in order), at + 1, sum(1 << i for i in order[:at]), order[at])
        for order in permutations(range(n))
        for at in range(n)
    ]
    orders = sums.sparkSession.createDataFrame(steps, "filter_order string, step int, before long, which long")
    found = sums.join(F.broadcast(orders), ["before", "which"]).join(of_filter, ["part", "which"])
    return found.select(
        "part", "filter_order", "step", (F.col("n_rows") - F.col("failing")).alias("kept"), "removed",
        (F.col("own") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def with_marks(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`rows` with good and toxic, from their labels."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    joined = rows.join(marks.where("good or toxic"), "doc_id", "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(document_failures(table(spark, sf_dir, "documents")))
    return audit(with_marks(with_copies(rows, "E"), table(spark, sf_dir, "labels")), list(FILTERS))
