"""Evaluation and development sets from dataset indexes, and the demo sets cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.fixed_values import (
    CONCRETE_DAMAGE_CLASSES,
    SAMPLING_SEED,
    SCENE_SLICES,
    SCENE_TO_DISASTER,
    SCENE_TO_LEVEL,
    STEEL_SLICES,
    THERMAL_CLASSES,
    THERMAL_SLICES,
    THERMAL_TO_GRADE,
    THERMAL_TO_LEVEL,
)
from faultline.functions.columns import lookup
from faultline.functions.text import file_stem, numbered_id, parse_fractions, parse_names
from faultline.operators.records import with_existing_file
from faultline.operators.sampling import demo_sets, mixed_demo, quota_sample, stratified_slices, union_all
from faultline.sources.writers import freeze_digest, write_manifest


def _labels(**given: Column) -> Column:
    """A labels struct with the given fields, null elsewhere."""
    fields = schemas.struct(schemas.IMAGES)["labels"].dataType.fields
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _class_list(name: Column, clean: str) -> Column:
    return F.when(name == clean, F.array().cast("array<string>")).otherwise(F.array(name))


def _records(rows: DataFrame, files: DataFrame, image_id: Column, asset_class: str, dataset: str, labels: Column) -> DataFrame:
    """Join the chosen rows to the file facts (path, sha256, width, height) by file name."""
    named = rows.select(
        "file_name", image_id.alias("image_id"), F.lit(asset_class).alias("asset_class"),
        F.lit(dataset).alias("source_dataset"), "split", labels.alias("labels"),
    )
    return named.join(files.select("file_name", "path", "sha256", "width", "height"), "file_name").drop("file_name")


def steel_set(index: DataFrame, files: DataFrame, seed: int = SAMPLING_SEED) -> DataFrame:
    """All test rows for evaluation; a few training rows of each damaged grade for development."""
    test = index.filter(F.col("split") == "test").withColumn("origin", F.col("split")).withColumn("split", F.lit("eval_v1"))
    train = index.filter(F.col("split") == "train").withColumn("origin", F.col("split")).drop("split")
    chosen = test.unionByName(stratified_slices(train, "worst_class", "name", STEEL_SLICES, seed))
    fractions = F.create_map(
        F.lit("Fair"), F.col("fair_frac").cast("double"), F.lit("Poor"), F.col("poor_frac").cast("double"),
        F.lit("Severe"), F.col("severe_frac").cast("double"),
    )
    labels = _labels(
        damage_present=F.lit(True), classes_present=F.array(F.lit("steel_corrosion")), grade_native=F.col("worst_class"),
        grade_scale=F.lit("CorrosionCS"), grade_source=F.lit("dataset"), area_fracs=fractions,
    )
    image_id = F.concat_ws("_", F.lit("corr"), "origin", F.col("name").cast("string"))
    return _records(chosen, files, image_id, "steel_coating", "corrosion_cs", labels)


def concrete_set(index: DataFrame, files: DataFrame, seed: int = SAMPLING_SEED) -> DataFrame:
    """Class quotas over labelled concrete images; the grades are added by a team later."""
    names = parse_names(F.col("labels"))
    known = F.array(*map(F.lit, CONCRETE_DAMAGE_CLASSES))
    parsed = index.withColumns({"_names": names, "_damage": F.array_sort(F.array_intersect(names, known))})
    splits = quota_sample(parsed, "name", "_damage", seed)
    chosen = parsed.join(F.broadcast(splits), "name")
    labels = _labels(
        damage_present=F.size("_damage") > 0, classes_present=F.col("_damage"), all_labels=F.col("_names"),
        grade_scale=F.lit("MBEI-CS"), area_fracs=parse_fractions(F.col("area_fracs")),
    )
    return _records(chosen, files, F.concat(F.lit("dacl_"), F.col("name").cast("string")), "bridge_element", "dacl10k", labels)


def thermal_set(label_rows: DataFrame, files: DataFrame, seed: int = SAMPLING_SEED) -> DataFrame:
    """Slices of each thermal class. `label_rows` has row numbers and class numbers; files are `test_<row>.png`."""
    name = F.element_at(F.array(*map(F.lit, THERMAL_CLASSES)), F.col("label").cast("int") + 1)
    rows = label_rows.select("row", name.alias("class"), F.concat(numbered_id("test", F.col("row")), F.lit(".png")).alias("file_name"))
    chosen = stratified_slices(rows, "class", "row", THERMAL_SLICES, seed)
    kind = F.col("class")
    labels = _labels(
        damage_present=kind != "No-Anomaly", classes_present=_class_list(kind, "No-Anomaly"), source_class=kind,
        grade_native=lookup(kind, THERMAL_TO_GRADE), grade_scale=F.lit("IEC-62446-3-CoA"),
        grade_source=F.lit("dataset-class-mapped"), unified_truth=lookup(kind, THERMAL_TO_LEVEL),
    )
    return _records(chosen, files, numbered_id("ir_test", F.col("row")), "pv_module", "ir_solar", labels)


def scene_set(index: DataFrame, files: DataFrame, seed: int = SAMPLING_SEED) -> DataFrame:
    """Slices of each scene class of the test files."""
    rows = index.select(F.col("file").alias("file_name"), "class")
    chosen = stratified_slices(rows, "class", "file_name", SCENE_SLICES, seed)
    kind = F.col("class")
    groups = F.lit(None).cast("array<string>")
    for scene, classes in SCENE_TO_DISASTER.items():
        groups = F.when(kind == scene, F.array(*map(F.lit, classes))).otherwise(groups)
    labels = _labels(
        damage_present=kind != "Intact", classes_present=_class_list(kind, "Intact"), source_class=kind, grade_native=kind,
        grade_scale=F.lit("RescueNet-3"), grade_source=F.lit("dataset"), fema_group=groups,
        unified_truth=lookup(kind, SCENE_TO_LEVEL),
    )
    image_id = F.concat(F.lit("rn_test_"), file_stem(F.col("file_name")))
    return _records(chosen, files, image_id, "building_disaster", "rescuenet", labels)


def build_evaluation_set(parts: list[DataFrame], folder: str) -> DataFrame:
    """Write the evaluation and development manifests and return the evaluation set's digest."""
    everything = union_all(parts)
    base = folder.rstrip("/")
    evaluation = everything.filter(F.col("split") == "eval_v1")
    write_manifest(evaluation, f"{base}/eval_v1")
    write_manifest(everything.filter(F.col("split") == "dev"), f"{base}/dev")
    digest = freeze_digest(evaluation)
    digest.write.mode("overwrite").json(f"{base}/frozen")
    return digest


def write_demo_manifests(images: DataFrame, files: DataFrame, folder: str, n: int = 10, mixed: int = 3) -> None:
    """One demo manifest per dataset and a mixed one, from the images whose files exist."""
    there = with_existing_file(images, files)
    base = folder.rstrip("/")
    fields = [name for name in schemas.struct(schemas.IMAGES).fieldNames() if name in images.columns]
    demo = demo_sets(there, n).select(*fields, F.col("source_dataset").alias("dataset"))
    demo.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("dataset").json(f"{base}/by_dataset")
    write_manifest(mixed_demo(there, mixed), f"{base}/mixed")
