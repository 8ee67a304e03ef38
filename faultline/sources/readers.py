"""Sources: manifests, image folders, sidecars, dataset indexes, rubric files and run tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import schemas
from faultline.functions.columns import first_or_blank
from faultline.functions.text import numbered_id
from faultline.operators.ordered import with_rank
from faultline.operators.records import merged_with_sidecar
from faultline.session import file_system, materialise
from faultline.sources.ranking import load_queue, ranked_runs

#: Ranked runs whose findings are left out by the names of their folders.
LISTED_RUNS = 1000
#: Tasks that list folders, and files that a task reads, of which there are at most READING_TASKS.
LISTING_TASKS, FILES_A_TASK, READING_TASKS = 64, 1000, 10_000
#: Names, and bytes of files, that a task gives out at once.
NAMES_AT_ONCE, BYTES_AT_ONCE = 2**14, 2**23
IMAGE_NAME = r"\.([jJ][pP][eE]?[gG]|[pP][nN][gG])$"


def read_manifest(spark: SparkSession, path: str | list[str], position: bool = False) -> DataFrame:
    """A JSON-lines manifest with the fixed schema. A malformed row or a wrong type stops the read.

    `position` adds `pos`, which sorts rows in manifest order (file, place in the file), for taking the first ones.
    """
    images = spark.read.schema(schemas.struct(schemas.IMAGES)).option("mode", "FAILFAST").json(path)
    if not position:
        return images
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return images.select("*", place.alias("pos"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder; file contents are not read."""
    root = _listable(folder)
    if root is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        return files.select(_local_path("path").alias("path"))
    return _places(spark, root, "").select(F.concat(F.lit(f"{root}/"), "place").alias("path"))


def _local_path(column: str) -> Column:
    """A file URI as a plain path, without its percent escapes."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and bytes of every JPEG and PNG below a folder, whatever the case of its extension; other files are not opened.

    Tasks list the folder and read the files: Spark's reader would keep every path in the driver.
    """
    root = _listable(folder)
    if root is None:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}")
            .load(folder)
            .select(_local_path("path").alias("path"), "content")
        )
    places = _places(spark, root, IMAGE_NAME)
    files = places.count()
    tasks = max(min(files, spark.sparkContext.defaultParallelism), min(files // FILES_A_TASK, READING_TASKS), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        held: list[tuple[str, bytes]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            paths, contents = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        for batch in batches:
            for place in batch.column("place").to_pylist():
                with system.open_input_stream(f"{base}/{place}") as file:
                    held.append((f"{root}/{place}", file.read()))
                size += len(held[-1][1])
                if size >= BYTES_AT_ONCE or len(held) >= FILES_A_TASK:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return places.repartition(tasks, "place").mapInArrow(read, "path string, content binary")


def _listable(folder: str) -> str | None:
    """The folder without doubled slashes; none where only Spark can list it (its own stores, patterns, single files, no such folder)."""
    from pyarrow import fs

    try:
        system, base = file_system(folder)
        base = base.rstrip("/") or "/"
        if system.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):  # pa.ArrowInvalid is a ValueError
        return None
    return re.sub("/+", "/", base).rstrip("/") if isinstance(system, fs.LocalFileSystem) else folder.rstrip("/")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over, of files and of folders."""
    out = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _entries(root: str, place: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder below `root`, and whether each is a folder. Local folders are never held whole."""
    from pyarrow import fs

    system, base = file_system(root or "/")
    within = f"{base.rstrip('/')}/{place}"
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(within) as found:
            for entry in found:
                if entry.is_dir() or entry.is_file():  # a link to nothing is neither
                    yield entry.name, entry.is_dir()
    else:
        for info in system.get_file_info(fs.FileSelector(within.rstrip("/"))):
            yield info.base_name, info.type == fs.FileType.Directory


def _places(spark: SparkSession, root: str, wanted: str) -> DataFrame:
    """`place` of every file below `root` whose name matches `wanted`: its path from there.

    Tasks list the folders of one level after the other, and write what they find; the driver sees how many folders there are.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool]] = []

        def rows() -> pa.RecordBatch:
            places, kinds = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(kinds, pa.bool_())], ["place", "is_folder"])

        for batch in batches:
            for folder in batch.column("place").to_pylist():
                for name, is_folder in _entries(root, folder):
                    if not _hidden(name) and (is_folder or re.search(wanted, name)):
                        held.append((f"{folder}/{name}" if folder else name, is_folder))
                    if len(held) >= NAMES_AT_ONCE:
                        yield rows()
                        held = []
        if held:
            yield rows()

    folders, levels, number = spark.createDataFrame([("",)], "place string"), [], 1
    while number:
        dealt = folders.repartition(min(number, LISTING_TASKS))
        found = materialise(dealt.mapInArrow(listed, "place string, is_folder boolean"), "listed")
        levels.append(found.where("not is_folder").select("place"))
        folders = found.where("is_folder").select("place")
        number = folders.count()
    return reduce(DataFrame.unionAll, levels)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def jpeg_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG; pixels are not decoded."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        marker = head[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9]), int.from_bytes(head[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(head[at + 2 : at + 4])
    return None


@F.arrow_udf(StructType().add("width", "integer").add("height", "integer"))
def _jpeg_dimensions(heads: pa.Array) -> pa.Array:
    sizes = [jpeg_size(head) if head else None for head in heads.to_pylist()]
    parts = [pa.array([size[at] if size else None for size in sizes], pa.int32()) for at in (0, 1)]
    return pa.StructArray.from_arrays(parts, ["width", "height"])


def png_dimension(content: Column, at: int) -> Column:
    """A big-endian 32-bit size from a PNG header: width at byte 17, height at byte 21."""
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")


def scan_folder(spark: SparkSession, folder: str, asset_class: str, *, sidecar: str | None = None,
                source_dataset: str = "", split: str = "", prefix: str = "img") -> DataFrame:
    """Image records of a folder: hash, dimensions, ids numbered from 0 in path order, sidecar overlaid.

    Sizes come from the headers of the bytes that are read for the hash anyway (of a JPEG, its first mebibyte).
    """
    is_png = F.hex(F.substring("content", 2, 3)) == "504E47"
    files = image_files(spark, folder).select(
        "path",
        content_hash(F.col("content")).alias("sha256"),
        F.when(is_png, png_dimension(F.col("content"), 17)).alias("_w"),
        F.when(is_png, png_dimension(F.col("content"), 21)).alias("_h"),
        _jpeg_dimensions(F.when(~is_png, F.substring("content", 1, 2**20))).alias("_jpeg"),
    )
    sized = files.select("path", "sha256", "_w", "_h", "_jpeg.width", "_jpeg.height")
    # Written, and dealt anew: a sort looks at its rows twice, which would open every file twice, and many tasks give a few rows each.
    facts = materialise(sized.repartition("path"), "files")
    numbered = with_rank(facts, [], [F.split("path", "/")], "_n")
    records = numbered.select(
        numbered_id(prefix, F.col("_n") - 1).alias("image_id"),
        "path",
        "sha256",
        F.coalesce("_w", "width").alias("width"),
        F.coalesce("_h", "height").alias("height"),
        F.lit(asset_class).alias("asset_class"),
        F.lit(None).cast("double").alias("gsd_mm_per_px"),
        F.lit(None).cast("double").alias("irradiance_wm2"),
        F.lit(None).cast("string").alias("captured_on"),
        F.lit(source_dataset).alias("source_dataset"),
        F.lit(split).alias("split"),
        F.from_json(F.lit("{}"), schemas.LABELS).alias("labels"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
    )
    if sidecar is None:
        return records.drop("file_name")
    entries = read_sidecar(spark, sidecar)
    labelled = records.join(entries, "file_name", "left").withColumn(
        "labels", F.coalesce(F.from_json(F.try_element_at("entry", F.lit("labels")), schemas.LABELS), F.col("labels"))
    ).drop("entry")
    return merged_with_sidecar(labelled, entries).drop("file_name")


def read_sidecar(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Sidecar entries as (file_name, entry), `entry` a map of text that keeps the keys given with null.

    Each file is one JSON object keyed by file name; with `lines` each line is such an object, which lets Spark
    split a large sidecar.
    """
    objects = spark.read.text(path, wholetext=not lines)
    by_name = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return objects.select(F.explode(by_name).alias("file_name", "_entry")).select(
        "file_name", F.from_json("_entry", "map<string,string>").alias("entry")
    )


def read_csv_index(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A dataset index with a header line and a fixed schema."""
    return spark.read.option("header", "true").option("mode", "FAILFAST").schema(ddl).csv(path)


def read_label_column(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """The label column of a Parquet dataset with the row's file and place in it; image bytes are not read."""
    return spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(label).alias("label")
    )


def read_scene_index(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """Files of one split that carry a label, from `{"split": {file: split}, "label": {file: class}}`."""
    schema = "split map<string,string>, label map<string,string>"
    index = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    splits = index.select(F.explode("split").alias("file", "split")).filter(F.col("split") == split)
    labels = index.select(F.explode("label").alias("file", "class"))
    return splits.join(labels, "file").select("file", "class")


def read_rubrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rubric files as rows of (rubric_file, standard, allowed_values, subject, value, criterion, level, action, flag)."""
    row = (
        "struct<value: string, criterion: string, unified: string, action: string, defect: string, pattern: string,"
        " flag: string>"
    )
    schema = f"standard string, asset_label string, allowed_values array<string>, rows array<{row}>"
    files = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(paths)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("rubric_file"),
        "standard",
        "asset_label",
        "allowed_values",
        F.explode("rows").alias("r"),
    ).select(
        "rubric_file",
        "standard",
        "asset_label",
        "allowed_values",
        F.coalesce("r.defect", "r.pattern").alias("subject"),
        "r.value",
        "r.criterion",
        F.col("r.unified").alias("level"),
        "r.action",
        "r.flag",
    )


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A class crosswalk `{"map": {class: {..}}}` as rows of (class, attributes)."""
    schema = "map map<string,map<string,string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(
        F.explode("map").alias("class", "attributes")
    )


def read_run_table(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    """One table of a run store, empty with its schema when nothing has been written yet."""
    schema = schemas.struct(ddl).add("run_id", "string")
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_gate(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts, one per run and image: a repeated append after a failed job does not count twice."""
    return read_run_table(spark, root, "gate", schemas.GATE_LOG).dropDuplicates(["run_id", "image_id"])


def gated_ids(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Ids a run has gated: one column of one run's files, and no shuffle, since an anti-join ignores copies."""
    return read_run_table(spark, root, "gate", schemas.GATE_LOG).filter(F.col("run_id") == run_id).select("image_id")


def graded_ids(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return read_run_table(spark, root, "findings", schemas.FINDING_LOG).filter(F.col("run_id") == run_id).select("finding_id")


def logged_findings(spark: SparkSession, root: str) -> DataFrame:
    """The finding logs as they are: a finding may be there twice after a failure."""
    return read_run_table(spark, root, "findings", schemas.FINDING_LOG)


def one_of_each_finding(logged: DataFrame) -> DataFrame:
    return logged.dropDuplicates(["run_id", "finding_id"])


def load_raw_findings(spark: SparkSession, root: str) -> DataFrame:
    return one_of_each_finding(logged_findings(spark, root))


def load_findings(spark: SparkSession, root: str) -> DataFrame:
    """Ranked findings where a run has a queue, else its raw findings."""
    queue, logged, ranked = load_queue(spark, root), logged_findings(spark, root), ranked_runs(spark, root)
    first = [row["run_id"] for row in ranked.limit(LISTED_RUNS).collect()]
    # Folders of runs named in the plan are not read; the join drops the rows of any others before they are compared.
    logged = logged.filter(~F.col("run_id").isin(first)) if first else logged
    unranked = one_of_each_finding(logged.join(ranked, "run_id", "left_anti"))
    return queue.unionByName(unranked.select(*schemas.struct(schemas.FINDINGS).fieldNames(), "run_id"), allowMissingColumns=True)


def load_calls(spark: SparkSession, root: str) -> DataFrame:
    """The call log: one row per gate verdict and per graded target.

    Verdicts and findings are stored with their call in the same row, so a log can never miss or repeat a call
    its result does not.
    """
    usage = ["model", "input_tokens", "output_tokens", "note", "ts"]
    gate = load_gate(spark, root).select(
        "run_id", F.lit("gate").alias("stage"), "image_id", *usage, "seconds", "usd"
    )
    grade = load_raw_findings(spark, root).filter(F.col("ts").isNotNull()).select(
        "run_id",
        F.lit("grade").alias("stage"),
        first_or_blank(F.col("evidence.image_ids")).alias("image_id"),
        *usage,
        F.col("call_seconds").alias("seconds"),
        F.col("call_usd").alias("usd"),
    )
    return gate.unionByName(grade)


def load_reviews(spark: SparkSession, root: str) -> DataFrame:
    return read_run_table(spark, root, "reviews", schemas.REVIEWS.replace("run_id string, ", ""))


def list_datasets(images: DataFrame) -> DataFrame:
    """Datasets with a demo set, the mixed one first."""
    return images.select("source_dataset").distinct().orderBy(F.col("source_dataset") != "mixed", "source_dataset")
