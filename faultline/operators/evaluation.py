"""Gate and grading quality against dataset labels.

Raw rows are reduced to counted cells once; every rate, matrix and kappa is arithmetic on those cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import ASSET_CLASSES, GRADE_LABELS
from faultline.functions.columns import ratio
from faultline.functions.grades import grade_count, grade_label, pick_by_class, truth_ordinal, value_ordinals
from faultline.operators.ordered import top_per_group


def scored_images(images: DataFrame, routed_gate: DataFrame) -> DataFrame:
    """Images that are both in the manifest and gated, with the label and the routing side by side."""
    gate = routed_gate.select("run_id", "image_id", "usable", "routed")
    manifest = images.select("image_id", "asset_class", "source_dataset", "labels")
    return gate.join(manifest, "image_id")


def _zero_if(strict_zero: bool, value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)) if strict_zero else value


def f1(precision: Column, recall: Column) -> Column:
    both = F.coalesce(precision, F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    return F.coalesce(F.try_divide(F.lit(2.0) * both[0] * both[1], both[0] + both[1]), F.lit(0.0))


def _with_rates(cells: DataFrame, strict_zero: bool) -> DataFrame:
    c = F.col
    return cells.withColumns(
        {
            "n": c("tp") + c("fp") + c("fn") + c("tn"),
            "precision": _zero_if(strict_zero, ratio(c("tp"), c("tp") + c("fp"))),
            "recall": _zero_if(strict_zero, ratio(c("tp"), c("tp") + c("fn"))),
        }
    ).withColumn("f1", f1(c("precision"), c("recall")))


def gate_by_dataset(images: DataFrame, routed_gate: DataFrame, strict_zero: bool = False) -> DataFrame:
    """The gate's 2x2 counts per run and dataset; positive means routed.

    Unlabelled images are counted apart. `strict_zero` counts them as clean and reports 0 for undefined rates.
    """
    damage, routed = F.col("labels.damage_present"), F.col("routed")
    if strict_zero:
        damage = F.coalesce(damage, F.lit(False))
    cells = scored_images(images, routed_gate).groupBy("run_id", "source_dataset").agg(
        F.count_if(damage & routed).alias("tp"),
        F.count_if(~damage & routed).alias("fp"),
        F.count_if(damage & ~routed).alias("fn"),
        F.count_if(~damage & ~routed).alias("tn"),
        F.count_if(damage.isNull()).alias("unlabelled"),
        F.count_if(routed).alias("routed"),
        F.count_if(~F.col("usable")).alias("unusable"),
    )
    return _with_rates(cells, strict_zero)


def gate_overall(by_dataset: DataFrame, strict_zero: bool = False) -> DataFrame:
    """The same counts per run, rolled up from the per-dataset table instead of the raw rows."""
    counts = ["tp", "fp", "fn", "tn", "unlabelled", "routed", "unusable"]
    cells = by_dataset.groupBy("run_id").agg(*[F.sum(name).alias(name) for name in counts])
    scored = F.col("n") + F.col("unlabelled")
    return _with_rates(cells, strict_zero).withColumn("routing_fraction", ratio(F.col("routed"), scored))


def gate_misses(images: DataFrame, routed_gate: DataFrame) -> DataFrame:
    """Damaged images that were not routed, as rows."""
    return (
        scored_images(images, routed_gate)
        .filter(F.col("labels.damage_present") & ~F.col("routed"))
        .select("run_id", "image_id", "source_dataset")
    )


def capped_list(rows: DataFrame, by: list[str], item: str, k: int = 20) -> DataFrame:
    """A report line per group naming its first `k` items in order."""
    top = top_per_group(rows, by, [F.col(item)], k)
    return top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))


def predicted_by_image(findings: DataFrame) -> DataFrame:
    """Worst ordinal per image on each asset class's scale, ignoring U and values outside the scale.

    The image's class is known only after joining the manifest, so all four scales are reduced first: an image
    with very many findings meets the join as one row.
    """
    value, standard = F.col("native_scale.value"), F.col("native_scale.standard")
    graded = findings.filter(F.col("unified.level") != "U").select(
        "run_id",
        F.explode("evidence.image_ids").alias("image_id"),
        *[position.alias(name) for name, position in value_ordinals(value, standard).items()],
    )
    return graded.groupBy("run_id", "image_id").agg(*[F.max(name).alias(f"pred_{name}") for name in ASSET_CLASSES])


def predicted_ordinals(images: DataFrame, findings: DataFrame) -> DataFrame:
    """One predicted ordinal per image, null when everything was U or off the scale."""
    manifest = images.select("image_id", "asset_class")
    by_class = {name: F.col(f"pred_{name}") for name in ASSET_CLASSES}
    return (
        predicted_by_image(findings)
        .join(manifest, "image_id")
        .select("run_id", "image_id", "asset_class", pick_by_class(F.col("asset_class"), by_class).alias("pred"))
    )


def grading_pairs(images: DataFrame, routed_gate: DataFrame, findings: DataFrame) -> DataFrame:
    """Truth beside prediction for every routed image that has a truth; the prediction may be null."""
    truth = truth_ordinal(F.col("asset_class"), F.col("labels"))
    known = (
        scored_images(images, routed_gate)
        .filter("routed")
        .select("run_id", "image_id", "asset_class", truth.alias("truth"))
        .filter(F.col("truth").isNotNull())
    )
    by_class = {name: F.col(f"pred_{name}") for name in ASSET_CLASSES}
    return known.join(predicted_by_image(findings), ["run_id", "image_id"], "left").select(
        "run_id", "image_id", "asset_class", "truth", pick_by_class(F.col("asset_class"), by_class).alias("pred")
    )


def grading_cells(pairs: DataFrame) -> DataFrame:
    """Counted (truth, prediction) cells: at most k * (k + 1) rows per run and asset class."""
    return pairs.groupBy("run_id", "asset_class", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def weighted_kappa(n: Column, sum_truth: Column, sum_pred: Column, sum_truth2: Column, sum_pred2: Column,
                   sum_gap2: Column) -> Column:
    """Quadratic weighted kappa from moments.

    The expected squared gap of independent raters with these marginals is
    E[t^2] + E[p^2] - 2 E[t] E[p], so no table of marginal pairs is needed and the (k-1)^2 scale cancels.
    Both terms are whole numbers times n, counted exactly and divided once, so a table of any size whose raters can
    not disagree by chance gives zero.
    """
    n, t, p, t2, p2, gap2 = (c.cast("decimal(19,0)") for c in (n, sum_truth, sum_pred, sum_truth2, sum_pred2, sum_gap2))
    chance = n * (t2 + p2) - F.lit(2).cast("decimal(1,0)") * (t * p)
    agreed = F.lit(1.0) - F.try_divide((n * gap2).cast("double"), chance.cast("double"))
    return F.when(n > 0, F.coalesce(agreed, F.lit(0.0)))


def grading_rates(cells: DataFrame) -> DataFrame:
    """Per run and asset class: assessed share, exact and near agreement, error, kappa, over and under grading."""
    n, t, p = F.col("n"), F.col("truth"), F.col("pred")
    assessed = p.isNotNull()

    def total(value: Column, where: Column = assessed) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    sums = cells.groupBy("run_id", "asset_class").agg(
        F.sum(n).alias("n_routed_with_truth"),
        total(n).alias("n_assessed"),
        total(n, assessed & (t == p)).alias("_exact"),
        total(n, assessed & (F.abs(t - p) <= 1)).alias("_near"),
        total(n * F.abs(t - p)).alias("_gap"),
        total(n, assessed & (p > t)).alias("over_graded"),
        total(n, assessed & (p < t)).alias("under_graded"),
        total(n * t).alias("_t"),
        total(n * p).alias("_p"),
        total(n * t * t).alias("_t2"),
        total(n * p * p).alias("_p2"),
        total(n * (t - p) * (t - p)).alias("_gap2"),
    )
    c = F.col
    kappa = weighted_kappa(c("n_assessed"), c("_t"), c("_p"), c("_t2"), c("_p2"), c("_gap2"))
    return sums.select(
        "run_id",
        "asset_class",
        "n_routed_with_truth",
        "n_assessed",
        (F.lit(1.0) - ratio(c("n_assessed"), c("n_routed_with_truth"))).alias("u_rate"),
        ratio(c("_exact"), c("n_assessed")).alias("exact_match"),
        ratio(c("_near"), c("n_assessed")).alias("within_one_grade"),
        ratio(c("_gap"), c("n_assessed")).alias("mae"),
        kappa.alias("qwk"),
        "over_graded",
        "under_graded",
    )


def matrix_long(cells: DataFrame) -> DataFrame:
    """The confusion matrix with every cell of the scale, zeros included, and grade names."""
    k = grade_count(F.col("asset_class"))
    groups = cells.select("run_id", "asset_class").distinct()
    positions = F.sequence(F.lit(0), k - 1)
    domain = groups.withColumn("truth", F.explode(positions)).withColumn("pred", F.explode(positions))
    counted = cells.filter(F.col("pred").isNotNull())
    full = domain.join(counted, ["run_id", "asset_class", "truth", "pred"], "left")
    return full.select(
        "run_id",
        "asset_class",
        grade_label(F.col("asset_class"), F.col("truth")).alias("truth_grade"),
        grade_label(F.col("asset_class"), F.col("pred")).alias("pred_grade"),
        "truth",
        "pred",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def matrix_dense(cells: DataFrame) -> DataFrame:
    """The confusion matrix with one row per truth grade and one column per predicted ordinal."""
    widest = max(len(scale) for scale in GRADE_LABELS.values())
    columns = [
        F.sum(F.when(F.col("pred") == at, F.col("n")).otherwise(0)).alias(f"pred_{at}") for at in range(widest)
    ]
    return matrix_long(cells).groupBy("run_id", "asset_class", "truth").agg(*columns)


def confusion_text(cells: DataFrame) -> DataFrame:
    """Counted cells as `truth0->pred1: 3, ...` in key order, one line per run and asset class."""
    key = F.format_string("truth%d->pred%d", "truth", "pred")
    entries = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("n"))))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["n"].cast("string")))
    return cells.filter(F.col("pred").isNotNull()).groupBy("run_id", "asset_class").agg(
        F.array_join(lines, ", ").alias("confusion")
    )


def unassessed_images(pairs: DataFrame) -> DataFrame:
    """Routed images with a truth that produced no usable grade."""
    return pairs.filter(F.col("pred").isNull()).select("run_id", "asset_class", "image_id")


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """Assessed pairs with grade names."""
    ac = F.col("asset_class")
    return pairs.filter(F.col("pred").isNotNull()).select(
        "run_id",
        "image_id",
        "asset_class",
        grade_label(ac, F.col("truth")).alias("truth"),
        grade_label(ac, F.col("pred")).alias("pred"),
    )
