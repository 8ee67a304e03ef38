"""Selections: stratified slices, sequential quotas, exemplars and demo sets.

The shuffle order is a hash of seed and id, so a sample is the same on any partitioning and in any SQL engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import CONCRETE_QUOTAS
from faultline.functions.text import exemplar_note
from faultline.operators.ordered import top_per_group
from faultline.session import materialise


def hash_order(seed: int, id_column: str) -> list[Column]:
    """A seeded shuffle order that ends in the id itself."""
    return [F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_column).cast("string"))), F.col(id_column)]


def stratified_slices(df: DataFrame, stratum: str, id_column: str, slices: dict[str, list[tuple[str, int, int]]],
                      seed: int) -> DataFrame:
    """Fixed slices of each stratum's shuffle: `slices[class] = [(split, from, to), ...]`, from inclusive, to exclusive."""
    deepest = max(stop for parts in slices.values() for _, _, stop in parts)
    named = df.filter(F.col(stratum).isin(*slices))
    ranked = top_per_group(named, [stratum], hash_order(seed, id_column), deepest, "_rn")
    split = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, parts in slices.items():
        for name, start, stop in parts:
            inside = (F.col(stratum) == value) & (F.col("_rn") > start) & (F.col("_rn") <= stop)
            split = split.when(inside, name)
    return ranked.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_rn")


def class_histogram(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))


def quota_sample(df: DataFrame, id_column: str, classes_column: str, seed: int, *,
                 quotas: list[tuple[str, int]] | None = None, fill_to: int = 50, clean: int = 10,
                 dev_damaged: int = 10, dev_clean: int = 5) -> DataFrame:
    """An evaluation and a development set by sequential class quotas, using no image twice.

    `classes_column` holds the damage classes of a row, empty for a clean one. Classes are served in order, then
    the set is filled from any damage, then clean rows are added; the development set comes from the rest.
    No class can need more candidates than rows are taken in all, so that many per class are kept (before the shuffle). What a
    class may take is an anti-join of its candidates with the rows taken before it; both are bounded by the quotas.
    """
    quotas = CONCRETE_QUOTAS if quotas is None else quotas
    depth = sum(n for _, n in quotas) + fill_to + clean + dev_damaged + dev_clean
    wanted = F.array_intersect(F.array(*[F.lit(name) for name, _ in quotas]), F.col(classes_column))
    pools = F.when(F.size(classes_column) == 0, F.array(F.lit("clean"))).otherwise(F.concat(wanted, F.array(F.lit("damaged"))))
    pooled = df.select(id_column, F.explode(pools).alias("pool"))
    candidates = materialise(top_per_group(pooled, ["pool"], hash_order(seed, id_column), depth, "place"), "candidates")
    used = candidates.select(id_column).limit(0)
    for name, n in quotas:
        free = candidates.filter(F.col("pool") == name).join(F.broadcast(used), id_column, "left_anti")
        used = materialise(used.unionByName(free.orderBy("place").limit(n).select(id_column)), "taken")
    fill = max(0, fill_to - used.count())
    free = candidates.filter(F.col("pool") == "damaged").join(F.broadcast(used), id_column, "left_anti")
    numbered = free.orderBy("place").limit(fill + dev_damaged).withColumn("at", F.row_number().over(Window.orderBy("place")))
    damaged = numbered.select(id_column, F.when(F.col("at") <= fill, "eval_v1").otherwise("dev").alias("split"))
    unharmed = candidates.filter((F.col("pool") == "clean") & (F.col("place") <= clean + dev_clean))
    unharmed = unharmed.select(id_column, F.when(F.col("place") <= clean, "eval_v1").otherwise("dev").alias("split"))
    return used.withColumn("split", F.lit("eval_v1")).unionByName(damaged).unionByName(unharmed)


#: Exemplars that a grader is shown at most.
MAX_EXEMPLARS = 5


def exemplar_candidates(images: DataFrame) -> DataFrame:
    """Images that may be shown to a grader: graded by a named source and in no evaluation split."""
    return images.filter(
        ~F.col("split").startswith("eval")
        & F.col("labels.grade_native").isNotNull()
        & (F.coalesce(F.col("labels.grade_source"), F.lit("")) != "")
    )


def select_exemplars(images: DataFrame, k: int = 3, exclude_ids: list[str] | None = None) -> DataFrame:
    """Up to `k` (0 to 5) exemplars per asset class, one per grade in grade order, then a second of each, and so on."""
    k = max(0, min(MAX_EXEMPLARS, k))
    pool = exemplar_candidates(images)
    if exclude_ids:
        pool = pool.filter(~F.col("image_id").isin(*exclude_ids))
    graded = pool.withColumn("grade", F.col("labels.grade_native"))
    per_grade = top_per_group(graded, ["asset_class", "grade"], [F.col("image_id")], k, "_turn")
    chosen = top_per_group(per_grade, ["asset_class"], [F.col("_turn"), F.col("grade")], k, "place")
    return chosen.select(
        "asset_class",
        "place",
        "image_id",
        F.col("grade").alias("native_value"),
        exemplar_note(F.col("labels.classes_present"), F.col("labels.source_class")).alias("note"),
    )


def exemplars_for_targets(targets: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Attach to each target the exemplars of its class except its own image.

    A class shows its first MAX_EXEMPLARS; select_exemplars picks no more, so that many rows a class travel to the tasks.
    """
    item = F.struct("place", F.col("image_id"), "native_value", "note")
    first = top_per_group(exemplars, ["asset_class"], [F.col("place"), F.col("image_id")], MAX_EXEMPLARS, "_rn")
    by_class = first.groupBy("asset_class").agg(F.array_sort(F.collect_list(item)).alias("_exemplars"))
    joined = targets.join(F.broadcast(by_class), "asset_class", "left")
    others = F.filter("_exemplars", lambda e: e["image_id"] != F.col("image_id"))
    return joined.withColumn("exemplars", F.coalesce(others, F.array().cast(joined.schema["_exemplars"].dataType))).drop(
        "_exemplars"
    )


def demo_order() -> list[Column]:
    """Graded rows first, damaged before clean, then by id."""
    return [
        F.col("labels.grade_native").isNull(),
        ~F.coalesce(F.col("labels.damage_present"), F.lit(False)),
        F.col("image_id"),
    ]


def demo_sets(images: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` images of each dataset."""
    return top_per_group(images, ["source_dataset"], demo_order(), n, "place")


def mixed_demo(images: DataFrame, per_dataset: int = 3) -> DataFrame:
    """A few images of each dataset, interleaved so that the first rows already span all of them."""
    return demo_sets(images, per_dataset).orderBy("place", "source_dataset")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def overlap(first: DataFrame, second: DataFrame, id_column: str = "image_id") -> DataFrame:
    """Ids in both sets; empty when they are disjoint."""
    return first.select(id_column).intersect(second.select(id_column))
