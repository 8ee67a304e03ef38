"""A run's queue as sorted part files, with a manifest of their places and fence keys.

A ranking sorts the findings once and writes them in order. The manifest has a row for each part: how many rows lie before
it, and its first and last key. The rank of a row is that number plus its place in the file; it is added when the queue is
read, so no file holds it and no later step sorts again. After a review only the parts that lose or gain a row are written
anew: the rows of all others stay where they are, and their ranks follow from the manifest.

Parts are replaced by writing new files and then the manifest that names them, so a reader sees one ranking or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.session import materialise
from faultline.sources.store import file_system, folder_name

#: Manifest rows that are sent to every task without asking Spark whether they are few.
FEW_PARTS = 50_000


def queue_key() -> Column:
    """What the queue is sorted by, ascending: S4 first, U last, then score from high to low, then finding id."""
    level = F.col("unified.level")
    return F.struct(
        (level != "S4").alias("not_worst"),
        (level == "U").alias("unassessed"),
        (-F.coalesce(F.col("queue_score"), F.lit(0.0))).alias("minus_score"),
        F.col("finding_id").alias("finding_id"),
    )


def _stored() -> list[str]:
    return [name for name in schemas.struct(schemas.QUEUE).fieldNames() if name != "queue_rank"]


def _parts_folder(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/queue_parts/run_id={folder_name(run_id)}"


def _part_name() -> Column:
    """The name of the file a row lies in, as the manifest has it: from its ranking's folder on. Cut, not matched: it is taken for every row."""
    path = F.col("_metadata.file_path")
    short = F.substring_index(path, "/", -2)
    return F.when(short.startswith("_part="), F.substring_index(path, "/", -3)).otherwise(short)


def _measured(spark: SparkSession, folder: str) -> list[dict]:
    """File name, row count, first and last key of every part file in a folder."""
    keys = spark.read.schema(f"_key {schemas.QUEUE_KEY}").parquet(folder)
    parts = keys.groupBy(_part_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first"), F.max("_key").alias("last"))
    return [row.asDict() for row in parts.collect()]


def _order(key: tuple) -> tuple:
    """A key as Python sorts it; null comes first, as in Spark."""
    return tuple((value is not None, value if value is not None else 0) for value in key)


def _save_manifest(spark: SparkSession, root: str, run_id: str, parts: list[dict], today: str, reviewed: int) -> None:
    rows, before = [], 0
    for part in sorted(parts, key=lambda part: _order(part["first"])):
        rows.append((part["file"], part["n"], before, part["first"], part["last"], today, reviewed, run_id))
        before += part["n"]
    table = spark.createDataFrame(rows, f"{schemas.QUEUE_PARTS}, run_id string").coalesce(1)
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if rows:
        writer.parquet(f"{root.rstrip('/')}/queue")
    else:  # a run without findings: its empty manifest replaces an older one
        table.drop("run_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/queue/run_id={folder_name(run_id)}")


def write_ranking(scored: DataFrame, root: str, run_id: str, today: str, reviewed: int) -> None:
    """Sort one run's scored findings, write them, and make them the run's queue. `reviewed` is the last decision they hold."""
    spark, folder = scored.sparkSession, f"{_parts_folder(root, run_id)}/{uuid.uuid4().hex}"
    scored.select(*_stored(), queue_key().alias("_key")).orderBy("_key").write.parquet(folder)
    _save_manifest(spark, root, run_id, _measured(spark, folder), today, reviewed)


def read_manifest_rows(spark: SparkSession, root: str, run_id: str) -> list[dict]:
    """The parts of a run's queue in order."""
    found = _manifests(spark, root).filter(F.col("run_id") == run_id).collect()
    return sorted((row.asDict() for row in found), key=lambda row: row["before"])


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    from faultline.sources.readers import read_run_table

    return read_run_table(spark, root, "queue", schemas.QUEUE_PARTS)


def ranked_runs(spark: SparkSession, root: str) -> DataFrame:
    """The ids of the runs with a row in their queue, from the manifests alone."""
    return _manifests(spark, root).filter("n > 0").select("run_id").distinct()


def load_queue(spark: SparkSession, root: str) -> DataFrame:
    """The ranked findings of all runs that have a queue; ranks come from the manifests."""
    parts = _manifests(spark, root).select("file", "before", "run_id")
    files = [f"{_parts_folder(root, row['run_id'])}/{row['file']}" for row in parts.select("run_id", "file").collect()]
    fields = schemas.struct(schemas.QUEUE).fieldNames()
    if not files:
        return spark.createDataFrame([], schemas.struct(schemas.QUEUE).add("run_id", "string"))
    rows = spark.read.schema(schemas.struct(schemas.QUEUE)).parquet(*files).drop("queue_rank")
    placed = rows.select("*", _part_name().alias("file"), F.col("_metadata.row_index").alias("_place"))
    joined = placed.join(F.broadcast(parts) if len(files) <= FEW_PARTS else parts, "file")
    return joined.withColumn("queue_rank", F.col("before") + F.col("_place") + F.lit(1)).select(*fields, "run_id")


def queue_in_order(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """A run's queue with its partitions, and the rows in them, in rank order, for exports: each task reads its part in place."""
    parts = read_manifest_rows(spark, root, run_id)
    fields = schemas.struct(schemas.QUEUE)
    schema = fields.add("run_id", "string")
    if not parts:
        return spark.createDataFrame([], schema)
    base, stored = _parts_folder(root, run_id), _stored()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                system, place = file_system(f"{base}/{part['file']}")
                rank = part["before"]
                with system.open_input_file(place) as file:
                    for found in pq.ParquetFile(file).iter_batches(4096, columns=stored):
                        ranks = pa.array(range(rank + 1, rank + 1 + found.num_rows), pa.int64())
                        run = pa.array([run_id] * found.num_rows, pa.string())
                        columns = [found.column(name) for name in stored]
                        yield pa.RecordBatch.from_arrays([*columns, ranks, run], [*stored, "queue_rank", "run_id"])
                        rank += found.num_rows

    listed = spark.createDataFrame([(at, part["file"], part["before"]) for at, part in enumerate(parts)], "part int, file string, before bigint")
    # One partition for each part, in order: only the manifest's rows are moved.
    return listed.repartitionById(len(parts), "part").mapInArrow(read, schema)


def part_of(key: Column, fences: Column, n: int) -> Column:
    """The number of the part a key belongs to: the last of the `n` sorted first keys that is not above it, else the first part."""

    def halved(found: Column, _: Column) -> Column:
        middle = F.shiftright(found["low"] + found["high"], 1)
        above = F.struct(found["low"], middle.alias("high"))
        below = F.struct((middle + F.lit(1)).alias("low"), found["high"])
        return F.when(found["low"] >= found["high"], found).when(F.get(fences, middle) <= key, below).otherwise(above)

    whole = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), whole, halved, lambda found: F.greatest(found["low"] - F.lit(1), F.lit(0)))


def merge_changes(changed: DataFrame, root: str, run_id: str, today: str, reviewed: int) -> int:
    """Move `changed` findings (scored anew) to their places in the run's queue. Returns how many parts were written.

    Of the other findings, those in parts that lose or gain a row are read, and the ids of the rest.
    """
    spark, base = changed.sparkSession, _parts_folder(root, run_id)
    parts = read_manifest_rows(spark, root, run_id)
    fences = spark.createDataFrame([([part["first"] for part in parts],)], f"_fences array<{schemas.QUEUE_KEY}>")
    keyed = changed.select(*_stored(), queue_key().alias("_key")).crossJoin(F.broadcast(fences))
    moved = materialise(keyed.withColumn("_part", part_of(F.col("_key"), F.col("_fences"), len(parts))).drop("_fences"), "changed")
    number = {part["file"]: at for at, part in enumerate(parts)}
    ids = spark.read.schema("finding_id string").parquet(*[f"{base}/{file}" for file in number]).select("finding_id", _part_name().alias("file"))
    losing = ids.join(moved.select("finding_id"), "finding_id", "left_semi").select("file").distinct().collect()
    touched = sorted({number[row["file"]] for row in losing} | {row["_part"] for row in moved.select("_part").distinct().collect()})
    if not touched:
        _save_manifest(spark, root, run_id, parts, today, reviewed)
        return 0
    old = spark.read.schema(schemas.struct(schemas.QUEUE).add("_key", schemas.struct(f"k {schemas.QUEUE_KEY}")["k"].dataType))
    old = old.parquet(*[f"{base}/{parts[at]['file']}" for at in touched]).select("*", _part_name().alias("_file")).drop("queue_rank")
    numbers = spark.createDataFrame([(parts[at]["file"], at) for at in touched], "_file string, _part int")
    kept = old.join(F.broadcast(numbers) if len(touched) <= FEW_PARTS else numbers, "_file").drop("_file")
    kept = kept.join(moved.select("finding_id"), "finding_id", "left_anti")
    version = uuid.uuid4().hex
    rows = kept.unionByName(moved).repartition(len(touched), "_part").sortWithinPartitions("_part", "_key")
    rows.write.partitionBy("_part").parquet(f"{base}/{version}")
    untouched = [part for at, part in enumerate(parts) if at not in set(touched)]
    _save_manifest(spark, root, run_id, untouched + _measured(spark, f"{base}/{version}"), today, reviewed)
    return len(touched)
