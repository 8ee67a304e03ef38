"""Image records: deduplication, resume anti-joins, sidecar merge, precedence and file checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row_per(df: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """The first row of each key in `order`, or else the least by all its columns: the same on any partitioning."""
    row = F.struct(*[F.col(name) for name in df.columns])
    first = F.min(row) if order is None else F.min_by(row, F.struct(*order))
    return df.groupBy(key).agg(first.alias("_row")).select("_row.*")


def distinct_images(images: DataFrame) -> DataFrame:
    """The first row of each image id in manifest order. Duplicate rows would be scored, and paid for, twice."""
    order = ["pos", "path", "sha256"] if "pos" in images.columns else ["path", "sha256", "width", "height"]
    return one_row_per(images, "image_id", [F.col(name) for name in order])


def duplicate_count(images: DataFrame) -> DataFrame:
    extra = images.groupBy("image_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))


def not_yet_gated(images: DataFrame, gate: DataFrame) -> DataFrame:
    return images.join(gate.select("image_id"), "image_id", "left_anti")


def not_yet_graded(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Targets without a finding. Keyed by finding, so a run stopped between tiles resumes at the next tile."""
    return targets.join(findings.select("finding_id"), "finding_id", "left_anti")


def merged_with_sidecar(images: DataFrame, sidecar: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Overlay sidecar entries. A key that is present wins even when it is null; an absent key keeps the record's value.

    `sidecar` holds one row per file name with `entry`, a map of text.
    """
    joined = images.join(sidecar.select(F.col("file_name").alias(file_name), "entry"), file_name, "left")

    def overlay(name: str, kind: str) -> Column:
        given = F.coalesce(F.map_contains_key("entry", F.lit(name)), F.lit(False))
        return F.when(given, F.try_element_at("entry", F.lit(name)).try_cast(kind)).otherwise(F.col(name))

    kinds = {
        "image_id": "string",
        "asset_class": "string",
        "gsd_mm_per_px": "double",
        "irradiance_wm2": "double",
        "captured_on": "string",
    }
    present = {name: kind for name, kind in kinds.items() if name in images.columns}
    return joined.withColumns({name: overlay(name, kind) for name, kind in present.items()}).drop("entry")


def latest_by_precedence(sources: list[DataFrame], key: str = "image_id") -> DataFrame:
    """Records by id from several sources; a later source overwrites an earlier one."""
    tagged = [source.withColumn("_source", F.lit(at)) for at, source in enumerate(sources)]
    stacked = tagged[0]
    for source in tagged[1:]:
        stacked = stacked.unionByName(source, allowMissingColumns=True)
    row = F.struct(*[name for name in stacked.columns if name != "_source"])
    best = stacked.groupBy(key).agg(F.max_by(row, "_source").alias("_row"))
    return best.select("_row.*")


def with_existing_file(images: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file is in the listing."""
    return images.join(files.select("path"), "path", "left_semi")


def for_disaster(images: DataFrame) -> DataFrame:
    return images.filter(F.col("asset_class") == "building_disaster")


def of_dataset(images: DataFrame, dataset: str | None, limit: int = 0, position: str = "pos") -> DataFrame:
    """Optionally one dataset, optionally its first rows in manifest order."""
    chosen = images if dataset is None else images.filter(F.col("source_dataset") == dataset)
    return chosen.orderBy(position).limit(limit) if limit else chosen
