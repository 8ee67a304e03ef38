"""Exports and indexes written as files and read back through the readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.queue_queries import FACTORS, QUEUE_VIEWS, _queue
from catalog.registry import query
from catalog.report_queries import (
    SCENE_SQL,
    STEEL_SQL,
    THERMAL_SQL,
    _documents,
    _files,
    _scene_records,
    _steel_records,
    _thermal_records,
)
from catalog.views import oracle
from faultline import schemas
from faultline.fixed_values import THERMAL_CLASSES
from faultline.operators.sampling import union_all
from faultline.operators.validation import image_rules, with_violations
from faultline.plans import evalset
from faultline.session import new_folder
from faultline.sources import readers, writers
from faultline.sources.store import file_system


@query(oracle(QUEUE_VIEWS, "select run_id, cast(queue_rank as bigint) as queue_rank, finding_id, level as unified_level, effective_action as action_code, criterion as criteria_matched from ranked", FACTORS))
def queue_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "queue_csv")
    writers.write_queue_csv(_queue(spark, sf_dir, in_order=True), path, in_order=True)
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    return rows.select("run_id", F.col("queue_rank").cast("bigint").alias("queue_rank"), "finding_id", "unified_level", "action_code", "criteria_matched")


@query(oracle("fx_findings", "select run_id, finding_id, native_value as condition_state, defect_type as defect, level as unified_level from fx_findings where asset_class = 'bridge_element'"))
def bridge_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "bridge_csv")
    writers.write_bridge_csv(_queue(spark, sf_dir, in_order=True), path, in_order=True)
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    return rows.select("run_id", "finding_id", "condition_state", "defect", "unified_level")


@query(oracle(QUEUE_VIEWS, "select run_id, cast(queue_rank as bigint) as queue_rank, finding_id, queue_score, native_value, confidence from ranked", FACTORS))
def findings_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "findings_json")
    writers.write_findings_json(_queue(spark, sf_dir, in_order=True), path, in_order=True, compression="gzip")
    rows = spark.read.schema(schemas.struct(schemas.QUEUE).add("run_id", "string")).option("mode", "FAILFAST").json(path)
    native, confidence = F.col("native_scale.value").alias("native_value"), F.col("measurements.confidence").alias("confidence")
    return rows.select("run_id", "queue_rank", "finding_id", "queue_score", native, confidence)


@query(oracle("fx_images", """select image_id, array_to_string([x for x in [case when path is null then 'path' end, case when width is null then 'width' end,
  case when asset_class = 'bicycle' then 'asset_class' end] if x is not null], ',') as violations
  from (select image_id, case when pos % 7 = 0 then null else path end as path, case when pos % 5 = 0 then null else width end as width,
    case when pos % 11 = 0 then 'bicycle' else asset_class end as asset_class from fx_images)
  where path is null or width is null or asset_class = 'bicycle'"""))
def image_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir).withColumns(
        {
            "path": F.when(F.col("pos") % 7 != 0, F.col("path")),
            "width": F.when(F.col("pos") % 5 != 0, F.col("width")),
            "asset_class": F.when(F.col("pos") % 11 == 0, "bicycle").otherwise(F.col("asset_class")),
        }
    )
    broken = with_violations(images, image_rules()).filter(F.size("violations") > 0)
    return broken.select("image_id", F.array_join("violations", ",").alias("violations"))


@query(oracle("", "select concat('corr_', origin, '_', name) as image_id, split, worst_class as grade from sliced where split is not null", STEEL_SQL))
def steel_csv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _documents(spark, sf_dir), new_folder(spark, "steel_index")
    kind, file_name = F.col("n_chars") % 3, F.concat(F.col("doc_id").cast("string"), F.lit(".jpeg"))
    docs.select(
        F.col("doc_id").alias("name"),
        F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"),
        F.when(kind == 0, "Fair").when(kind == 1, "Poor").otherwise("Severe").alias("worst_class"),
        *[F.lit("0.1").alias(name) for name in ("fair_frac", "poor_frac", "severe_frac")],
        file_name.alias("file_name"),
    ).write.option("header", "true").csv(path)
    ddl = "name bigint, split string, worst_class string, fair_frac string, poor_frac string, severe_frac string, file_name string"
    chosen = evalset.steel_set(readers.read_csv_index(spark, path, ddl), _files(docs, file_name))
    return chosen.select("image_id", "split", F.col("labels.grade_native").alias("grade"))


@query(oracle("", "select class, count(*) as n from thermal group by class", THERMAL_SQL))
def thermal_parquet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "thermal_index")
    _documents(spark, sf_dir).select((F.col("n_chars") % 12).alias("label"), F.lit("pixels").alias("image")).write.parquet(path)
    names = F.array(*map(F.lit, THERMAL_CLASSES))
    rows = readers.read_label_column(spark, path)
    return rows.groupBy(F.get(names, F.col("label").cast("int")).alias("class")).agg(F.count_distinct("file", "row").alias("n"))


@query(oracle("", "select file, class from scenes where regexp_extract(file, '[0-9]+')::bigint % 3 <> 0", SCENE_SQL))
def scene_json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document for each thousand scenes, as a large index comes in parts."""
    path = new_folder(spark, "scene_index")
    name = F.concat(F.lit("scene_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    kind = F.col("n_chars") % 3
    label = F.when(kind == 0, "Intact").when(kind == 1, "Damaged").otherwise("Collapsed")
    split = F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test")
    parts = _documents(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct(name, split))).alias("split"),
        F.map_from_entries(F.collect_list(F.struct(name, label))).alias("label"),
    )
    parts.drop("part").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_scene_index(spark, path)


PNG_HEAD = "89504E470D0A1A0A0000000D49484452"


def _write_pictures(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A PNG header of an image's size with its document's text behind it, a file for each document, a folder for a thousand of them.

    Returns the file names.
    """
    texts = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = views.view(spark, sf_dir, "fx_images").select(F.col("pos").alias("doc_id"), "width", "height", "asset_class")
    named = texts.join(sizes, "doc_id").withColumn("file_name", F.format_string("%012d.png", "doc_id"))
    head = F.unhex(F.concat(F.lit(PNG_HEAD), F.lpad(F.hex("width"), 8, "0"), F.lpad(F.hex("height"), 8, "0")))
    place = F.format_string("%09d/%s", F.floor(F.col("doc_id") / 1000), F.col("file_name")).alias("place")
    bytes_of = named.select(place, F.concat(head, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            places = batch.column("place").to_pylist()
            for part in {place.partition("/")[0] for place in places}:
                system.create_dir(f"{base}/{part}", recursive=True)
            for place, content in zip(places, batch.column("content"), strict=True):
                with system.open_output_stream(f"{base}/{place}") as file:
                    file.write(content.as_buffer())
            yield batch.select(["place"])

    saved = bytes_of.mapInArrow(save, "place string")
    saved.write.format("noop").mode("overwrite").save()
    return named.select("doc_id", "file_name", "asset_class")


@query(oracle("fx_images", f"""select concat('doc_', lpad(cast(n as varchar), cast(greatest(5, length(cast(n as varchar))) as int), '0')) as image_id, file_name, sha256, width, height,
  case when doc_id % 3 = 0 then asset_class else 'steel_coating' end as asset_class, case when doc_id % 3 = 0 then 0.5::double end as gsd_mm_per_px
  from (select d.doc_id, lpad(cast(d.doc_id as varchar), 12, '0') || '.png' as file_name, row_number() over (order by d.doc_id) - 1 as n, i.width, i.height, i.asset_class,
    sha256(unhex('{PNG_HEAD}' || lpad(to_hex(i.width), 8, '0') || lpad(to_hex(i.height), 8, '0')) || encode(coalesce(d.text, ''))) as sha256
    from documents d join fx_images i on i.pos = d.doc_id)"""))
def ingested_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of pictures with sidecars: digests, sizes from the headers, numbers in path order, sidecar values on top."""
    folder, sidecar = new_folder(spark, "pictures"), new_folder(spark, "sidecar")
    named = _write_pictures(spark, sf_dir, folder).filter(F.col("doc_id") % 3 == 0)
    entry = F.struct("file_name", F.struct("asset_class", F.lit(0.5).alias("gsd_mm_per_px")))
    objects = named.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))
    objects.select(F.to_json("entries").alias("value")).write.option("maxRecordsPerFile", 1).text(sidecar)
    found = readers.scan_folder(spark, folder, "steel_coating", sidecar=sidecar, source_dataset="docs", split="dev", prefix="doc")
    file_name = F.regexp_extract("path", "([^/]+)$", 1).alias("file_name")
    return found.select("image_id", file_name, "sha256", "width", "height", "asset_class", "gsd_mm_per_px")


def _wrapped(body: str, ctes: str) -> str:
    return f"select * from (with {ctes.strip()} {body})"


@query(
    _wrapped("select concat('corr_', origin, '_', name) as image_id, split, 'steel_coating' as asset_class from sliced where split is not null", STEEL_SQL)
    + " union all "
    + _wrapped("select concat('ir_test_', lpad(cast(row as varchar), cast(greatest(5, length(cast(row as varchar))) as int), '0')), split, 'pv_module' from sliced where split is not null", THERMAL_SQL)
    + " union all "
    + _wrapped("select concat('rn_test_', replace(file, '.jpg', '')), split, 'building_disaster' from sliced where split is not null", SCENE_SQL)
)
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation and development manifests of three datasets, as they are read back; the frozen digest is checked on the way."""
    folder = new_folder(spark, "evaluation")
    parts = [_steel_records(spark, sf_dir), _thermal_records(spark, sf_dir), _scene_records(spark, sf_dir)]
    frozen = evalset.build_evaluation_set(parts, folder).first()
    manifests = [readers.read_manifest(spark, f"{folder}/{name}") for name in ("eval_v1", "dev")]
    if frozen["rows"] != manifests[0].count():
        raise ValueError("the frozen digest is of another set")
    return union_all(manifests).select("image_id", "split", "asset_class")
