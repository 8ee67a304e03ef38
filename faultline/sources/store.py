"""The store of one run: tables bucketed by image, and a log writer that makes rows durable while their job still runs.

A run's image records, verdicts and findings lie in `<root>/<table>/run_id=<run>`, dealt to the same number of buckets by
image id. Joins between them, and so the question of what is left to score, need no shuffle. The number of buckets is part
of the run's stored settings, so a run that is resumed, in this session or another, finds the layout it began with.

Scorer results are paid for, so they don't wait for the end of a job: a task writes a file after every `commit_rows` rows and
when it ends, by a rename, and no later failure takes that file away. A task that runs again after a failure skips the rows
its earlier attempts have saved (`saved_ids`); a job that runs again skips all saved rows by the anti-join. An attempt that
dies costs its calls since its last file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from faultline import schemas
from faultline.operators.records import distinct_images
from faultline.session import file_system

#: Characters that Spark writes as %XX in the name of a partition folder.
ESCAPED = set('"#%\'*/:=?\\\x7f{[]^') | {chr(code) for code in range(1, 32)}
BUCKET_COLUMN = "_bucket"


def folder_name(value: str) -> str:
    """`value` as Spark spells it in the name of a partition folder."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def attempt_prefix(job: str, partition: int) -> str:
    return f"part-{job}-{partition:05d}-"


def saved_ids(folder: str, job: str, key: str) -> Callable[[], set[str]]:
    """For use in a task: the keys that earlier attempts of the same task have saved."""

    def read() -> set[str]:
        context = TaskContext.get()
        if context is None or context.attemptNumber() == 0:
            return set()
        return keys_in_files(folder, attempt_prefix(job, context.partitionId()), key)

    return read


def keys_in_files(folder: str, prefix: str, key: str) -> set[str]:
    from pyarrow import fs

    system, base = file_system(folder)
    found: set[str] = set()
    for entry in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if entry.base_name.startswith(prefix):
            with system.open_input_file(entry.path) as file:
                found.update(pq.read_table(file, columns=[key]).column(key).to_pylist())
    return found


@dataclass
class Saved(WriterCommitMessage):
    """What one task has saved."""

    files: int
    rows: int


class LogWriter(DataSourceArrowWriter):
    """Writes what a task gets in files of about `commit_rows` rows, one at a time and for good."""

    def __init__(self, folder: str, job: str, commit_rows: int) -> None:
        self.folder, self.job, self.commit_rows = folder, job, commit_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Saved:
        context = TaskContext.get()
        system, base = file_system(self.folder)
        system.create_dir(base, recursive=True)
        prefix = f"{attempt_prefix(self.job, context.partitionId())}{context.attemptNumber()}"
        held: dict[int, list[pa.RecordBatch]] = {}
        files = rows = 0

        def save(bucket: int) -> None:
            nonlocal files
            found = pa.Table.from_batches(held.pop(bucket))
            # The row count and the bucket end the name, the latter as Spark looks for it; hidden until it is whole.
            name = f"{prefix}-{files:06d}-{found.num_rows}_{bucket:05d}.c000.snappy.parquet"
            with system.open_output_stream(f"{base}/.{name}") as file:
                pq.write_table(found, file, compression="snappy")
            system.move(f"{base}/.{name}", f"{base}/{name}")
            files += 1

        for batch in iterator:
            rows += batch.num_rows
            numbers = batch.column(batch.schema.get_field_index(BUCKET_COLUMN))
            plain = batch.drop_columns([BUCKET_COLUMN])
            for bucket in numbers.unique().to_pylist():
                part = plain.filter(pa.compute.equal(numbers, bucket))
                if part.num_rows:
                    held.setdefault(bucket, []).append(part)
                    if sum(b.num_rows for b in held[bucket]) >= self.commit_rows:
                        save(bucket)
        for bucket in list(held):
            save(bucket)
        return Saved(files, rows)

    def commit(self, messages: list[Saved | None]) -> None:
        """Nothing is left to do: every file was final when it was named."""

    def abort(self, messages: list[Saved | None]) -> None:
        """A failed job keeps what its tasks have saved."""


class RunLog(DataSource):
    """A sink for scorer results."""

    @classmethod
    def name(cls) -> str:
        return "faultline_run_log"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["folder"], self.options["job"], int(self.options["commit_rows"]))


@dataclass(frozen=True)
class RunStore:
    spark: SparkSession
    root: str
    run_id: str
    buckets: int

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}/run_id={folder_name(self.run_id)}"

    def bucket(self, key: str = "image_id") -> Column:
        """The bucket of a key, as Spark's own bucketing numbers it."""
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def _bucketed(self, name: str, ddl: str, key: str) -> DataFrame:
        # A catalog entry is the way to tell Spark that files are bucketed; a plan keeps what it has read of it.
        entry, folder = f"faultline_{uuid.uuid4().hex}", self.folder(name).replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {entry} ({ddl}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        try:
            return self.spark.table(entry)
        finally:
            self.spark.sql(f"DROP TABLE {entry}")

    def images(self) -> DataFrame:
        """The run's image records, with the columns they were given with."""
        return self._bucketed("images", self.spark.read.parquet(self.folder("images")).schema.toDDL(), "image_id")

    def gate(self) -> DataFrame:
        """The run's verdicts as they were logged; an image may be there twice after a failure."""
        return self._bucketed("gate", schemas.GATE_LOG, "image_id")

    def findings(self) -> DataFrame:
        return self._bucketed("findings", schemas.FINDING_LOG, "image_id")

    def save_images(self, images: DataFrame) -> DataFrame:
        """Replace the run's image records by the first row of each image id. Returns them as every stage is to read them."""
        entry, folder = f"faultline_{uuid.uuid4().hex}", self.folder("images")
        # Copies of an image are told in the bucket it is dealt to: one shuffle does both.
        dealt = distinct_images(images.repartition(self.buckets, "image_id")).write.bucketBy(self.buckets, "image_id")
        dealt.mode("overwrite").option("path", folder).saveAsTable(entry)
        self.spark.sql(f"DROP TABLE {entry}")
        return self.images()

    def save_rubric(self, rubric: DataFrame) -> None:
        """Keep the rubric versions that the run's findings name. A resumed run may add versions."""
        rubric.coalesce(1).write.mode("append").parquet(self.folder("rubrics"))

    def append(self, rows: DataFrame, name: str, job: str, commit_rows: int) -> None:
        """Save `rows` (with image_id) to one of the run's logs, each task's rows as it goes."""
        spark = rows.sparkSession  # a stream's batches have a session of their own
        spark.dataSource.register(RunLog)
        # Small batches and no buffer between a task's scorer and its writer, so that rows are saved as they are made.
        at_once = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(commit_rows), "spark.sql.execution.pandas.udf.buffer.size": "4"}
        before = {name: spark.conf.get(name) for name in at_once}
        options = {"folder": self.folder(name), "job": job, "commit_rows": str(commit_rows)}
        try:
            for setting, value in at_once.items():
                spark.conf.set(setting, value)
            rows.withColumn(BUCKET_COLUMN, self.bucket()).write.format(RunLog.name()).mode("append").options(**options).save()
        finally:
            for setting, value in before.items():
                spark.conf.set(setting, value)

    def files(self, name: str, prefix: str) -> list[str]:
        """The files of one of the run's logs whose names start with a prefix."""
        from pyarrow import fs

        system, base = file_system(self.folder(name))
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [f"{self.folder(name)}/{entry.base_name}" for entry in found if entry.base_name.startswith(prefix)]

    def saved_rows(self, name: str) -> int:
        """Rows in one of the run's logs, by the names of its files."""
        from pyarrow import fs

        system, base = file_system(self.folder(name))
        names = [entry.base_name for entry in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return sum(int(n.rpartition("_")[0].rpartition("-")[2]) for n in names if n.startswith("part-"))


def new_job() -> str:
    return uuid.uuid4().hex[:12]


def open_run(spark: SparkSession, root: str, run_id: str, settings: dict, buckets: int) -> RunStore:
    """The store of a run with its settings written. A run that is there already keeps its number of buckets."""
    kept = read_settings(spark, root).where(F.col("run_id") == run_id).select("buckets").first()
    store = RunStore(spark, root, run_id, kept["buckets"] if kept else buckets)
    row = spark.createDataFrame([(store.buckets, json.dumps(settings), run_id)], f"{schemas.SETTINGS}, run_id string")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root.rstrip('/')}/settings")
    return store


def read_rubric_versions(spark: SparkSession, root: str) -> DataFrame:
    """The rubric rows of every version that a run of the store was graded by."""
    from faultline.sources.readers import read_run_table

    return read_run_table(spark, root, "rubrics", schemas.RUBRIC).drop("run_id").distinct()


def run_configs(spark: SparkSession, root: str) -> DataFrame:
    """run_id, the settings as JSON, and the names of the gate and the grader of every run."""
    named = [F.get_json_object("settings", f"$.{name}").alias(name) for name in ("gate", "grader")]
    return read_settings(spark, root).select("run_id", "settings", *named)


def read_settings(spark: SparkSession, root: str) -> DataFrame:
    """run_id, buckets and settings (JSON) of every run."""
    from faultline.sources.readers import read_run_table

    return read_run_table(spark, root, "settings", schemas.SETTINGS)
