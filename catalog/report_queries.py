"""Scored reports and the evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.evaluation_queries import CELLS, DRAWS, GATE_VIEWS, GRADE_DRAWS, GRADING, GRADING_VIEWS
from catalog.registry import query
from catalog.views import oracle
from faultline.fixed_values import (
    SAMPLING_SEED,
    SCENE_SLICES,
    STEEL_SLICES,
    THERMAL_CLASSES,
    THERMAL_SLICES,
    THERMAL_TO_GRADE,
)
from faultline.functions.routing import with_routing
from faultline.plans import evalset, report
from faultline.plans.evalset import write_demo_manifests
from faultline.session import new_folder
from faultline.sources import readers


def _report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    calls = views.calls(spark, sf_dir).withColumn("usd", F.lit(0.0))
    return report.scored_report(
        views.images(spark, sf_dir), with_routing(views.gate(spark, sf_dir)), views.preds(spark, sf_dir), calls
    )


@query(oracle(GATE_VIEWS, """select p.run_id, p.n_rows as n, round(p.tp / p.t, 9) as recall, round(quantile_cont(s.recall, 0.025), 9) as recall_low, round(quantile_cont(s.recall, 0.975), 9) as recall_high,
  round(p.tp / p.p, 9) as "precision", round(quantile_cont(s."precision", 0.025), 9) as precision_low, round(quantile_cont(s."precision", 0.975), 9) as precision_high,
  round(2.0::double * (p.tp / p.p) * (p.tp / p.t) / (p.tp / p.p + p.tp / p.t), 9) as f1, round(quantile_cont(s.f1, 0.025), 9) as f1_low, round(quantile_cont(s.f1, 0.975), 9) as f1_high
  from point p join scores s on s.run_id = p.run_id group by p.run_id, p.n_rows, p.tp, p.p, p.t""", CELLS + "," + DRAWS))
def scored_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [f"{name}{side}" for name in ("recall", "precision", "f1") for side in ("", "_low", "_high")]
    return _report(spark, sf_dir)["gate"].select("run_id", "n", *[F.round(name, 9).alias(name) for name in shown])


@query(oracle(GRADING_VIEWS, """select p.run_id, p.asset_class, p.n_rows as n_assessed, round(p.exact_match, 9) as exact_match, round(quantile_cont(s.exact_match, 0.025), 9) as exact_match_low, round(quantile_cont(s.exact_match, 0.975), 9) as exact_match_high,
  round(p.within_one_grade, 9) as within_one_grade, round(quantile_cont(s.within_one_grade, 0.025), 9) as within_one_grade_low, round(quantile_cont(s.within_one_grade, 0.975), 9) as within_one_grade_high
  from point p join stats s on s.run_id = p.run_id and s.asset_class = p.asset_class group by p.run_id, p.asset_class, p.n_rows, p.exact_match, p.within_one_grade""", GRADING + "," + GRADE_DRAWS))
def scored_grading_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)["grading"].filter(F.col("n_assessed") > 0)
    shown = [f"{name}{side}" for name in ("exact_match", "within_one_grade") for side in ("", "_low", "_high")]
    return rows.select("run_id", "asset_class", "n_assessed", *[F.round(name, 9).alias(name) for name in shown])


def _files(docs: DataFrame, name: Column) -> DataFrame:
    return docs.select(
        name.alias("file_name"), F.concat(F.lit("/files/"), name).alias("path"), F.sha2(name, 256).alias("sha256"),
        F.lit(640).alias("width"), F.lit(480).alias("height"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")


def _slice_case(slices: dict, key: str) -> str:
    """Which split a place in a class's shuffle belongs to."""
    whens = " ".join(
        f"when {key} = '{name}' and rn > {start} and rn <= {stop} then '{split}'"
        for name, parts in slices.items()
        for split, start, stop in parts
    )
    return f"case {whens} end"


STEEL_SQL = f"""
steel as (select doc_id as name, case when lang = 'en' then 'train' else 'test' end as origin,
  case n_chars % 3 when 0 then 'Fair' when 1 then 'Poor' else 'Severe' end as worst_class from documents),
placed as (select *, row_number() over (partition by origin, worst_class order by md5(concat('{SAMPLING_SEED}/', name)), name) as rn from steel),
sliced as (select *, case when origin = 'test' then 'eval_v1' else {_slice_case(STEEL_SLICES, 'worst_class')} end as split from placed)
"""


@query(oracle("", "select concat('corr_', origin, '_', name) as image_id, split, worst_class as grade from sliced where split is not null", STEEL_SQL))
def steel_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steel_records(spark, sf_dir).select("image_id", "split", F.col("labels.grade_native").alias("grade"))


def _steel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    kind = F.col("n_chars") % 3
    file_name = F.concat(F.col("doc_id").cast("string"), F.lit(".jpeg"))
    index = docs.select(
        F.col("doc_id").alias("name"),
        F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"),
        F.when(kind == 0, "Fair").when(kind == 1, "Poor").otherwise("Severe").alias("worst_class"),
        *[F.lit("0.1").alias(name) for name in ("fair_frac", "poor_frac", "severe_frac")],
        file_name.alias("file_name"),
    )
    return evalset.steel_set(index, _files(docs, file_name))


THERMAL_SQL = f"""
names(label, class, grade) as (values {", ".join(f"({at}, '{name}', '{THERMAL_TO_GRADE[name]}')" for at, name in enumerate(THERMAL_CLASSES))}),
thermal as (select d.doc_id as row, n.class, n.grade from documents d join names n on n.label = d.n_chars % 12),
placed as (select *, row_number() over (partition by class order by md5(concat('{SAMPLING_SEED}/', row)), row) as rn from thermal),
sliced as (select *, {_slice_case(THERMAL_SLICES, 'class')} as split from placed)
"""


@query(oracle("", """select concat('ir_test_', lpad(cast(row as varchar), cast(greatest(5, length(cast(row as varchar))) as int), '0')) as image_id, split, class as source_class, grade,
  class <> 'No-Anomaly' as damage_present from sliced where split is not null""", THERMAL_SQL))
def thermal_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thermal_records(spark, sf_dir).select(
        "image_id", "split", F.col("labels.source_class").alias("source_class"), F.col("labels.grade_native").alias("grade"),
        F.col("labels.damage_present").alias("damage_present"),
    )


def _thermal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    padded = F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(5), F.length(F.col("doc_id").cast("string"))), F.lit("0"))
    files = _files(docs, F.concat(F.lit("test_"), padded, F.lit(".png")))
    rows = docs.select(F.col("doc_id").alias("row"), (F.col("n_chars") % 12).alias("label"))
    return evalset.thermal_set(rows, files)


SCENE_SQL = f"""
scenes as (select concat('scene_', doc_id, '.jpg') as file, case n_chars % 3 when 0 then 'Intact' when 1 then 'Damaged' else 'Collapsed' end as class from documents),
placed as (select *, row_number() over (partition by class order by md5(concat('{SAMPLING_SEED}/', file)), file) as rn from scenes),
sliced as (select *, {_slice_case(SCENE_SLICES, 'class')} as split from placed)
"""


@query(oracle("", """select concat('rn_test_', replace(file, '.jpg', '')) as image_id, split, class as source_class,
  case class when 'Intact' then 'Undamaged,Affected' when 'Damaged' then 'Minor,Major' else 'Destroyed' end as groups,
  case class when 'Intact' then 'S0' when 'Damaged' then 'S2' else 'S4' end as level from sliced where split is not null""", SCENE_SQL))
def scene_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_records(spark, sf_dir).select(
        "image_id", "split", F.col("labels.source_class").alias("source_class"),
        F.array_join("labels.fema_group", ",").alias("groups"), F.col("labels.unified_truth").alias("level"),
    )


def _scene_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    name = F.concat(F.lit("scene_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    kind = F.col("n_chars") % 3
    index = docs.select(name.alias("file"), F.when(kind == 0, "Intact").when(kind == 1, "Damaged").otherwise("Collapsed").alias("class"))
    return evalset.scene_set(index, _files(docs, name))


@query(oracle("fx_images", """select dataset, count(*) as n from (select source_dataset as dataset, row_number() over (partition by source_dataset order by image_id) as rn from fx_images) where rn <= 10 group by dataset
  union all select 'mixed', cast(sum(least(n, 3)) as bigint) from (select count(*) as n from fx_images group by source_dataset)"""))
def demo_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo manifests written and read back."""
    folder = new_folder(spark, "demo")
    images = views.images(spark, sf_dir)
    write_demo_manifests(images, images.select("path"), folder)
    by_dataset = readers.read_manifest(spark, f"{folder}/by_dataset").groupBy(F.col("source_dataset").alias("dataset"))
    mixed = readers.read_manifest(spark, f"{folder}/mixed").agg(F.count(F.lit(1)).alias("n"))
    return by_dataset.agg(F.count(F.lit(1)).alias("n")).unionByName(mixed.select(F.lit("mixed").alias("dataset"), "n"))
