"""Image records: tiles, sizes, resume, records and labels, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import oracle
from faultline.fixed_values import CONCRETE_DAMAGE_CLASSES, CONCRETE_QUOTAS
from faultline.functions import text, tiles
from faultline.functions.routing import with_routing
from faultline.operators import records, sampling
from faultline.operators.ordered import with_rank
from faultline.operators.scoring import unusable_findings
from faultline.operators.validation import standard_for
from faultline.session import new_folder
from faultline.sources import readers, writers
from faultline.sources.readers import content_hash

SEED = 20260925

TILES = """
axes as (
  select image_id, width, height,
    case when width <= 1568 then [0] else list_sort(list_distinct(list_concat(range(0, width - 1568, 1332), [width - 1568]))) end as xs,
    case when height <= 1568 then [0] else list_sort(list_distinct(list_concat(range(0, height - 1568, 1332), [height - 1568]))) end as ys
  from fx_images
),
rows_of as (select image_id, width, height, xs, unnest(ys) as y0 from axes),
boxes as (select image_id, width, height, y0, unnest(xs) as x0 from rows_of),
numbered as (
  select *, row_number() over (partition by image_id order by y0, x0) - 1 as idx, count(*) over (partition by image_id) as n from boxes
),
targets as (
  select image_id, case when n = 1 then 'full' else concat('t', lpad(cast(idx as varchar), 2, '0')) end as tile, cast(x0 as int) as x0, cast(y0 as int) as y0,
    cast(least(x0 + 1568, width) as int) as x1, cast(least(y0 + 1568, height) as int) as y1 from numbered
)
"""


@query(oracle("fx_images", "select image_id, concat(image_id, '/', tile) as finding_id, tile, x0, y0, x1, y1 from targets", TILES))
def tile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = tiles.explode_targets(views.images(spark, sf_dir))
    corners = [F.col("bbox")[at].alias(name) for at, name in enumerate(("x0", "y0", "x1", "y1"))]
    return targets.select("image_id", "finding_id", "tile", *corners)


@query(oracle("fx_images", """select image_id, ew as enlarged_width, eh as enlarged_height,
  case when greatest(ew, eh) <= 1568 then ew else greatest(1, cast(floor(ew * (1568.0::double / greatest(ew, eh))) as int)) end as model_width,
  case when greatest(ew, eh) <= 1568 then eh else greatest(1, cast(floor(eh * (1568.0::double / greatest(ew, eh))) as int)) end as model_height
  from (select image_id, case when least(width, height) >= 224 then width else cast(floor(width * (224.0::double / least(width, height))) as int) end as ew,
    case when least(width, height) >= 224 then height else cast(floor(height * (224.0::double / least(width, height))) as int) end as eh from fx_images)"""))
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = tiles.enlarged(F.col("width"), F.col("height"))
    sized = views.images(spark, sf_dir).select("image_id", wide.alias("enlarged_width"), high.alias("enlarged_height"))
    wide, high = tiles.fitted(F.col("enlarged_width"), F.col("enlarged_height"))
    return sized.withColumns({"model_width": wide, "model_height": high})


@query(oracle("fx_images fx_gate_so_far", "select image_id from fx_images where image_id not in (select image_id from fx_gate_so_far)"))
def resume_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.not_yet_gated(views.images(spark, sf_dir), views.view(spark, sf_dir, "fx_gate_so_far")).select("image_id")


@query(oracle("fx_images fx_preds", "select image_id, concat(image_id, '/', tile) as finding_id from targets where concat(image_id, '/', tile) not in (select finding_id from fx_preds)", TILES))
def resume_ungraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = tiles.explode_targets(views.images(spark, sf_dir))
    return records.not_yet_graded(targets, views.preds(spark, sf_dir)).select("image_id", "finding_id")


@query(oracle("fx_images fx_gate", """select concat(i.image_id, '/full') as finding_id, i.asset_class, 'not_assessable' as defect_type, 'U' as level,
  case i.asset_class when 'bridge_element' then 'MBEI-CS' when 'steel_coating' then 'CorrosionCS' when 'pv_module' then 'IEC-62446-3-CoA' else 'FEMA-PDA' end as standard,
  'not_measurable' as flags, concat('0,0,', i.width, ',', i.height) as bbox, concat('gate marked image unusable: ', g.reason) as justification,
  concat('Not assessable: gate marked image unusable: ', g.reason, '. Re-image or use other NDT.') as action_basis, 0.0::double as confidence
  from fx_images i join fx_gate g on i.image_id = g.image_id where not g.usable"""))
def unusable_to_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = with_routing(views.gate(spark, sf_dir)).filter("routed and not usable").select("image_id", "reason", "model")
    waiting = views.images(spark, sf_dir).join(gate, "image_id").withColumn("standard", standard_for(F.col("asset_class")))
    return unusable_findings(waiting).select(
        "finding_id",
        "asset_class",
        "defect_type",
        F.col("unified.level").alias("level"),
        F.col("native_scale.standard").alias("standard"),
        F.array_join("unified.flags", ";").alias("flags"),
        F.array_join(F.col("evidence.bbox").cast("array<string>"), ",").alias("bbox"),
        "justification",
        F.col("action.basis").alias("action_basis"),
        F.col("measurements.confidence").alias("confidence"),
    )


@query(oracle("fx_images", r"""select image_id, concat('asset_class: ', asset_class, chr(10), 'gsd_mm_per_px: ', coalesce(printf('%.3f', gsd_mm_per_px), 'unknown'), chr(10),
  'irradiance_wm2: ', coalesce(printf('%.1f', irradiance_wm2), 'unknown'), chr(10), 'captured_on: ', coalesce(captured_on, 'unknown'), chr(10), 'image_size: ', width, 'x', height) as metadata from fx_images"""))
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    lines = text.metadata_lines(
        c("asset_class"),
        F.when(c("gsd_mm_per_px").isNotNull(), F.format_string("%.3f", "gsd_mm_per_px")),
        F.when(c("irradiance_wm2").isNotNull(), F.format_string("%.1f", "irradiance_wm2")),
        c("captured_on"),
        c("width"),
        c("height"),
    )
    return views.images(spark, sf_dir).select("image_id", lines.alias("metadata"))


NAMES_SQL = "list_sort(list_filter(string_split(label_text, ';'), lambda x: x <> ''))"
DAMAGE_SQL = "list_sort(list_filter(string_split(label_text, ';'), lambda x: x in (" + ", ".join(f"'{c}'" for c in CONCRETE_DAMAGE_CLASSES) + ")))"


@query(oracle("fx_images", f"""select image_id, array_to_string({NAMES_SQL}, ';') as all_labels, array_to_string({DAMAGE_SQL}, ';') as damage,
  try_cast(regexp_extract(fraction_text, 'Crack=([0-9.]+)', 1) as double) as crack, try_cast(regexp_extract(fraction_text, 'Rust=([0-9.]+)', 1) as double) as rust from fx_images"""))
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.col("labels")
    return views.images(spark, sf_dir).select(
        "image_id",
        F.array_join(labels["all_labels"], ";").alias("all_labels"),
        F.array_join(labels["classes_present"], ";").alias("damage"),
        F.try_element_at(labels["area_fracs"], F.lit("Crack")).alias("crack"),
        F.try_element_at(labels["area_fracs"], F.lit("Rust")).alias("rust"),
    )


@query(oracle("fx_images", f"""select image_id, concat_ws('; ', case when len({DAMAGE_SQL}) > 0 then concat('visible: ', array_to_string({DAMAGE_SQL}, ', ')) end,
  case when source_class <> '' then concat('dataset class: ', source_class) end) as note from fx_images"""))
def exemplar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.col("labels")
    return views.images(spark, sf_dir).select(
        "image_id", text.exemplar_note(labels["classes_present"], labels["source_class"]).alias("note")
    )


@query(oracle("fx_images", """select image_id, case when length(day) = 10 then day end as captured_on
  from (select image_id, replace(split_part(exif_text, ' ', 1), ':', '-') as day from fx_images)"""))
def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.images(spark, sf_dir).select("image_id", text.capture_date(F.col("exif_text")).alias("captured_on"))


@query(oracle("fx_images", """select image_id, concat('ir_test_', lpad(cast(pos as varchar), cast(greatest(5, length(cast(pos as varchar))) as int), '0')) as numbered,
  concat('rn_test_', pos) as named, concat('corr_', split, '_', pos) as split_named from fx_images"""))
def built_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = text.file_stem(F.col("path"))
    return views.images(spark, sf_dir).select(
        "image_id",
        text.numbered_id("ir_test", F.col("pos")).alias("numbered"),
        F.concat(F.lit("rn_test_"), stem).alias("named"),
        F.concat(F.lit("corr_"), "split", F.lit("_"), stem).alias("split_named"),
    )


@query(oracle("fx_images", "select image_id, coalesce(nullif(grade_native, ''), source_class) as truth from fx_images"))
def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.images(spark, sf_dir).select("image_id", text.truth_label(F.col("labels")).alias("truth"))


@query(oracle("fx_images", """select i.image_id, case when s.entry_kind = 'override' then 'building_disaster' else i.asset_class end as asset_class,
  case when s.entry_kind = 'null date' then null when s.entry_kind = 'override' then '2020-01-01' else i.captured_on end as captured_on
  from fx_images i left join sidecar s on s.image_id = i.image_id""", """
sidecar as (select image_id, case width % 3 when 0 then 'override' when 1 then 'null date' else 'empty' end as entry_kind from fx_images where gsd_mm_per_px is not null)"""))
def sidecar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir).withColumn("file_name", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    kind = F.col("width") % 3
    json = F.when(kind == 0, '{"asset_class": "building_disaster", "captured_on": "2020-01-01"}').when(kind == 1, '{"captured_on": null}').otherwise("{}")
    sidecar = images.filter(F.col("gsd_mm_per_px").isNotNull()).select(
        "file_name", F.from_json(json, "map<string,string>").alias("entry")
    )
    return records.merged_with_sidecar(images, sidecar).select("image_id", "asset_class", "captured_on")


@query(oracle("fx_images", """select image_id, coalesce(case when split = 'eval_v1' then 'eval' end, case when damage_present is not null then 'dev' end, 'run') as origin from fx_images"""))
def record_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir).select("image_id", "split", "labels")

    def source(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("image_id", F.lit(name).alias("origin"))

    return records.latest_by_precedence(
        [
            source("run", images),
            source("dev", images.filter(F.col("labels.damage_present").isNotNull())),
            source("eval", images.filter(F.col("split") == "eval_v1")),
        ]
    )


@query(oracle("fx_images", "select image_id, path from fx_images where width % 3 <> 0"))
def with_existing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that lacks a third of the files and has others besides."""
    images = views.images(spark, sf_dir)
    others = images.select(F.concat("path", F.lit(".bak")).alias("path"))
    listing = images.filter(F.col("width") % 3 != 0).select("path").union(others)
    return records.with_existing_file(images, listing).select("image_id", "path")


@query(oracle("fx_images", "select image_id, pos from fx_images where source_dataset = 'src3' order by pos limit 25"))
def first_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.of_dataset(views.images(spark, sf_dir), "src3", 25).select("image_id", "pos")


@query(oracle("fx_images", "select image_id from fx_images where asset_class = 'building_disaster'"))
def disaster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.for_disaster(views.images(spark, sf_dir)).select("image_id")


@query(oracle("fx_images fx_gate", "select count(*) as duplicates from fx_gate"))
def duplicate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir).select("image_id")
    return records.duplicate_count(images.unionByName(views.gate(spark, sf_dir).select("image_id")))


@query(oracle("fx_images", """select asset_class, place, image_id, grade_native as native_value from (
  select *, row_number() over (partition by asset_class order by turn, grade_native) as place from (
    select *, row_number() over (partition by asset_class, grade_native order by image_id) as turn from fx_images
    where split not like 'eval%' and grade_native is not null and coalesce(grade_source, '') <> '')) where place <= 3"""))
def exemplars_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.select_exemplars(views.images(spark, sf_dir)).drop("note").withColumn("place", F.col("place").cast("bigint"))


@query(oracle("fx_images", """select t.image_id, count(e.image_id) as n, coalesce(string_agg(e.image_id, ',' order by e.place), '') as exemplars
  from fx_images t left join chosen e on e.asset_class = t.asset_class and e.image_id <> t.image_id group by t.image_id""", """
chosen as (select asset_class, place, image_id from (
  select *, row_number() over (partition by asset_class order by turn, grade_native) as place from (
    select *, row_number() over (partition by asset_class, grade_native order by image_id) as turn from fx_images
    where split not like 'eval%' and grade_native is not null and coalesce(grade_source, '') <> '')) where place <= 5)"""))
def exemplars_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir)
    given = sampling.exemplars_for_targets(images, sampling.select_exemplars(images, 5))
    return given.select(
        "image_id",
        F.size("exemplars").cast("bigint").alias("n"),
        F.array_join(F.transform("exemplars", lambda e: e["image_id"]), ",").alias("exemplars"),
    )


SHUFFLED = f"row_number() over (partition by {{0}} order by md5(concat('{SEED}/', image_id)), image_id)"


@query(oracle("fx_images", f"""select image_id, asset_class, case when rn <= 20 then 'eval_v1' else 'dev' end as split from (
  select image_id, asset_class, {SHUFFLED.format('asset_class')} as rn from fx_images) where rn <= 20 or (asset_class <> 'pv_module' and rn <= 30) or (asset_class = 'pv_module' and rn > 25 and rn <= 28)"""))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = {
        name: [("eval_v1", 0, 20), ("dev", 20, 30)] for name in ("bridge_element", "steel_coating", "building_disaster")
    } | {"pv_module": [("eval_v1", 0, 20), ("dev", 25, 28)]}
    chosen = sampling.stratified_slices(views.images(spark, sf_dir).drop("split"), "asset_class", "image_id", slices, SEED)
    return chosen.select("image_id", "asset_class", "split")


@query(oracle("", "select doc_id, sha256(text) as sha256 from documents where text is not null"))
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's bytes, as a folder scan takes it of a file's."""
    docs = views.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", content_hash(F.col("text").cast("binary")).alias("sha256"))


def _quota_ctes() -> str:
    """The sequential choice written out step by step."""
    parts = [
        f"labelled as (select image_id, {DAMAGE_SQL} as classes, md5(concat('{SEED}/', image_id)) as h from fx_images)",
        "used0 as (select image_id from labelled where false)",
    ]
    for at, (name, quota) in enumerate(CONCRETE_QUOTAS, start=1):
        parts.append(
            f"used{at} as (select image_id from used{at - 1} union all (select image_id from labelled where list_contains(classes, '{name}')"
            f" and image_id not in (select image_id from used{at - 1}) order by h, image_id limit {quota}))"
        )
    last = f"used{len(CONCRETE_QUOTAS)}"
    parts += [
        f"ranked_rest as (select image_id, row_number() over (order by h, image_id) as rn from labelled where len(classes) > 0 and image_id not in (select image_id from {last}))",
        f"filled as (select image_id from {last} union all select image_id from ranked_rest where rn <= 50 - (select count(*) from {last}))",
        "clean as (select image_id, row_number() over (order by h, image_id) as rn from labelled where len(classes) = 0)",
        "rest as (select image_id, row_number() over (order by h, image_id) as rn from labelled where len(classes) > 0 and image_id not in (select image_id from filled))",
    ]
    return ", ".join(parts)


@query(oracle("fx_images", """select image_id, 'eval_v1' as split from filled union all select image_id, 'eval_v1' from clean where rn <= 10
  union all select image_id, 'dev' from rest where rn <= 10 union all select image_id, 'dev' from clean where rn > 10 and rn <= 15""", _quota_ctes()))
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir).select("image_id", F.col("labels.classes_present").alias("classes"))
    return sampling.quota_sample(images, "image_id", "classes", SEED)


@query(oracle("fx_images", """select count(*) as shared from (
  (select image_id from filled union all select image_id from clean where rn <= 10) intersect
  (select image_id from rest where rn <= 10 union all select image_id from clean where rn > 10 and rn <= 15))""", _quota_ctes()))
def eval_dev_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = quota_sample(spark, sf_dir)
    shared = sampling.overlap(chosen.filter(F.col("split") == "eval_v1"), chosen.filter(F.col("split") == "dev"))
    return shared.agg(F.count(F.lit(1)).alias("shared"))


@query(oracle("fx_images", "select asset_class, count(*) as n from fx_images group by asset_class"))
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_histogram(views.images(spark, sf_dir), "asset_class")


DEMO = "row_number() over (partition by source_dataset order by (grade_native is null), (not coalesce(damage_present, false)), image_id)"


@query(oracle("fx_images", f"select source_dataset, place, image_id from (select *, {DEMO} as place from fx_images) where place <= 10"))
def demo_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = sampling.demo_sets(views.images(spark, sf_dir), 10)
    return demo.select("source_dataset", F.col("place").cast("bigint").alias("place"), "image_id")


@query(oracle("fx_images", f"""select image_id, source_dataset, row_number() over (order by place, source_dataset) as pos from (
  select *, {DEMO} as place from fx_images) where place <= 3"""))
def demo_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = sampling.demo_sets(views.images(spark, sf_dir), 3)
    return with_rank(mixed, [], [F.col("place"), F.col("source_dataset")], "pos").select("image_id", "source_dataset", "pos")


@query(oracle("fx_images", f"""select image_id, width, height, asset_class, captured_on, damage_present, array_to_string({NAMES_SQL}, ';') as all_labels from fx_images"""))
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "manifest")
    writers.write_manifest(views.images(spark, sf_dir), folder)
    back = readers.read_manifest(spark, folder)
    return back.select(
        "image_id", "width", "height", "asset_class", "captured_on", F.col("labels.damage_present").alias("damage_present"),
        F.array_join("labels.all_labels", ";").alias("all_labels"),
    )


@query(oracle("fx_findings", "select run_id, finding_id, level, standard, native_value, confidence from fx_findings"))
def finding_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = views.findings(spark, sf_dir)
    encoded = findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))
    decoded = encoded.select(F.from_json("json", findings.schema).alias("f")).select("f.*")
    return decoded.select(
        "run_id", "finding_id", F.col("unified.level").alias("level"), F.col("native_scale.standard").alias("standard"),
        F.col("native_scale.value").alias("native_value"), F.col("measurements.confidence").alias("confidence"),
    )


DIGEST_SQL = """
hashed as (
  select sha256(concat('{"image_id":"', image_id, '","path":"', path, '","sha256":"', sha256, '","width":', width, ',"height":', height, ',"asset_class":"', asset_class, '"}')) as h
  from fx_images
),
words as (select count(*) as n, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * at}, 8))::bigint) as w{at}" for at in range(4)) + """ from hashed)
"""


@query(oracle("fx_images", "select n as rows, sha256(concat(n, '/', w0, '/', w1, '/', w2, '/', w3)) as digest, true as order_free from words", DIGEST_SQL))
def freeze_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir)
    flat = ["image_id", "path", "sha256", "width", "height", "asset_class"]
    stored = writers.freeze_digest(images, [*flat, "labels"]).select("digest")
    turned = writers.freeze_digest(images.orderBy(F.col("sha256").desc()), [*flat, "labels"]).select("digest")
    return writers.freeze_digest(images, flat).select("rows", "digest", (stored.scalar() == turned.scalar()).alias("order_free"))
