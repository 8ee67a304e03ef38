"""Ranks and running values over an order, without ever putting one group into one task.

A window over `partitionBy(group)` sorts a whole group in a single task, which fails once one run holds a
third of all rows. Here the rows are sorted globally (range partitions split inside a group, because the order
ends in a unique id), written once with their position, and each partition gets the totals of the partitions
before it. Only those totals, one row per group and partition, meet in a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import file_system, materialise

# monotonically_increasing_id keeps the partition number above this bit and the row position below it.
_PARTITION_BIT = 33
#: Totals that are sent to every task so that rows need not move: one for each group in each file.
FEW_TOTALS = 50_000


def _attach(rows: DataFrame, totals: DataFrame, keys: list[str], added: list[str]) -> DataFrame:
    """Join per-partition totals back. They come written, so Spark broadcasts them only if the files are small."""
    small = totals.withColumnsRenamed({key: f"_key_{key}" for key in keys})
    condition = reduce(and_, [rows[key].eqNullSafe(small[f"_key_{key}"]) for key in keys])
    return rows.join(small, condition, "left").select(rows["*"], *[small[name] for name in added])


def sorted_rows(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows in global order, written once, with their position `_seq` and partition `_part`."""
    ordered = df.orderBy(*[F.col(key) for key in group], *order).withColumn("_seq", F.monotonically_increasing_id())
    return materialise(ordered, "sorted").withColumn("_part", F.shiftright("_seq", _PARTITION_BIT))


def read_in_place(rows: DataFrame) -> DataFrame:
    """A written table of sorted rows with a partition for each of its files, in order: only the names of files are moved.

    Columns are read as they lie in the files; a time would need its unit changed, so there must be none.
    """
    spark, schema, columns = rows.sparkSession, rows.schema, rows.columns
    # Files are named by the number of the task that wrote them, and by a second one within it.
    files = sorted(rows.inputFiles(), key=lambda path: (int(re.search("part-([0-9]+)-[^/]*$", path)[1]), path))
    if not files:
        return rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    for found in pq.ParquetFile(file).iter_batches(4096, columns=columns):
                        yield found.select(columns)

    listed = spark.createDataFrame([(at, unquote(path)) for at, path in enumerate(files)], "part int, file string")
    return listed.repartitionById(len(files), "part").mapInArrow(read, schema)


def with_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", in_order: bool = False) -> DataFrame:
    """Row number 1..n of each group in `order`, which must end in a unique column.

    `in_order` gives the partitions, and the rows in them, in that order too, as an export writes them. The rows stay where
    the one sort has put them; only with more than FEW_TOTALS groups and parts are they sorted again.
    """
    rows = sorted_rows(df, group, order)
    parts = rows.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.select(
        *group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    totals = materialise(totals, "totals")
    few = in_order and totals.count() <= FEW_TOTALS
    lying = read_in_place(rows.drop("_part")).withColumn("_part", F.shiftright("_seq", _PARTITION_BIT)) if few else rows
    placed = _attach(lying, F.broadcast(totals) if few else totals, [*group, "_part"], ["_shift"])
    ranked = placed.withColumn(name, F.col("_seq") + F.col("_shift") + F.lit(1))
    return (ranked.orderBy("_seq") if in_order and not few else ranked).drop("_seq", "_part", "_shift")


def with_running(df: DataFrame, group: list[str], order: list[Column], *, sums: dict[str, Column] | None = None,
                 last_before: dict[str, Column] | None = None) -> DataFrame:
    """Running totals and carried values of each group in `order`, which must end in a unique column.

    `sums` adds the total up to and including each row. `last_before` adds the latest non-null value of the
    rows before each row.
    """
    sums, last_before = sums or {}, last_before or {}
    inputs = {f"_in_{name}": value for name, value in (sums | last_before).items()}
    rows = sorted_rows(df.withColumns(inputs), group, order)
    part_totals = [F.sum(f"_in_{name}").alias(f"_all_{name}") for name in sums]
    part_totals += [
        F.max_by(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), F.col("_seq"))).alias(f"_all_{name}")
        for name in last_before
    ]
    parts = rows.groupBy(*group, "_part").agg(*part_totals)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_all_{name}").over(before).alias(f"_carry_{name}") for name in sums]
    carried += [F.last(f"_all_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}") for name in last_before]
    # The rows are sorted by group, so a partition border cuts at most one group: only the later pieces of cut
    # groups carry anything, and there are fewer of them than partitions, however many groups there are.
    piece = F.row_number().over(Window.partitionBy(*group).orderBy("_part"))
    totals = parts.select(*group, "_part", piece.alias("_piece"), *carried).filter("_piece > 1").drop("_piece")
    placed = _attach(rows, materialise(totals, "totals"), [*group, "_part"], [f"_carry_{name}" for name in [*sums, *last_before]])

    local = Window.partitionBy(*group, "_part").orderBy("_seq")
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    results = {
        name: F.sum(f"_in_{name}").over(upto) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) for name in sums
    }
    results |= {
        name: F.coalesce(F.last(f"_in_{name}", ignorenulls=True).over(earlier), F.col(f"_carry_{name}"))
        for name in last_before
    }
    helpers = ["_seq", "_part", *inputs, *[f"_carry_{name}" for name in [*sums, *last_before]]]
    return placed.withColumns(results).drop(*helpers)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first `k` rows of each group. Every map task keeps at most `k` rows per group before the shuffle.

    Spark prunes this way up to spark.sql.optimizer.windowGroupLimitThreshold rows; larger `k` goes through the
    distributed rank.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        return with_rank(df, group, order, name).filter(F.col(name) <= k)
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
    return numbered.withColumn(name, F.col(name).cast("bigint"))
