"""Agreement of human graders, per-class detection quality, and the cost model per thousand images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import ratio
from faultline.functions.tiles import image_tokens


def graded_side_by_side(grades: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """One row per image with the grades of two graders, and the grade that counts: the third's where they differ."""

    def of(grader: str) -> Column:
        return F.max(F.when(F.col("grader") == grader, F.col("grade")))

    sides = grades.groupBy("image_id").agg(of(first).alias("first"), of(second).alias("second"), of(third).alias("third"))
    both = sides.filter(F.col("first").isNotNull() & F.col("second").isNotNull())
    agreed = F.col("first") == F.col("second")
    return both.withColumn("adjudicated", F.when(agreed, F.col("first")).otherwise(F.col("third")))


def cohens_kappa(side_by_side: DataFrame) -> DataFrame:
    """Unweighted kappa from the counted grade pairs; null without rows or when chance agreement is certain."""
    cells = side_by_side.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    observed = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("first") == F.col("second"), F.col("n"))), F.lit(0)).alias("agreed"),
    )
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("first").alias("grade"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")),
                F.struct(F.col("second").alias("grade"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")),
            )
        ).alias("side")
    ).select("side.*")
    marginals = sides.groupBy("grade").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chance = marginals.agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("products"))
    both = observed.withColumn("products", chance.scalar())
    po, pe = ratio(F.col("agreed"), F.col("n")), F.try_divide(F.col("products"), F.col("n").cast("double") * F.col("n"))
    return both.select(
        "n", po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa")
    )


def class_detection(images: DataFrame, truth: str, found: str) -> DataFrame:
    """True and false positives and misses per class, from two arrays of classes on each image row."""
    named = images.select(
        F.explode(F.array_union(truth, found)).alias("class"), F.col(truth).alias("_truth"), F.col(found).alias("_found")
    )
    real, hit = F.array_contains("_truth", F.col("class")), F.array_contains("_found", F.col("class"))
    counts = named.groupBy("class").agg(
        F.count_if(real & hit).alias("tp"), F.count_if(~real & hit).alias("fp"), F.count_if(real & ~hit).alias("fn")
    )
    c = F.col
    return counts.withColumns(
        {
            "precision": F.coalesce(ratio(c("tp"), c("tp") + c("fp")), F.lit(0.0)),
            "recall": F.coalesce(ratio(c("tp"), c("tp") + c("fn")), F.lit(0.0)),
            "f1": F.coalesce(ratio(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")), F.lit(0.0)),
        }
    )


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.count(F.lit(1)).alias("classes"), F.avg("f1").alias("macro_f1"))


def cost_per_thousand(images: DataFrame, scenarios: DataFrame, prices: DataFrame, *, prompt_tokens: int = 300,
                      gate_output_tokens: int = 40, grade_output_tokens: int = 400) -> DataFrame:
    """USD per 1,000 images of each scenario (gate model, grade model, share passed on) at these image sizes.

    The images are reduced to their mean token count first; only that one number meets the scenarios.
    """
    tokens = image_tokens(F.col("width"), F.col("height"))
    mean = images.agg(F.avg(tokens.cast("double")).alias("image_tokens"))

    def usd(side: str, output_tokens: int) -> Column:
        price_in = F.coalesce(f"{side}_in", F.lit(0.0))
        price_out = F.coalesce(f"{side}_out", F.lit(0.0))
        return ((F.col("image_tokens") + prompt_tokens) * price_in + F.lit(output_tokens) * price_out) / F.lit(1000.0)

    def tariff(side: str) -> DataFrame:
        return prices.select(
            F.col("model").alias(f"{side}_model"),
            F.col("usd_per_mtok_in").alias(f"{side}_in"),
            F.col("usd_per_mtok_out").alias(f"{side}_out"),
        )

    priced = scenarios.join(tariff("gate"), "gate_model", "left").join(tariff("grade"), "grade_model", "left")
    total = usd("gate", gate_output_tokens) + F.col("pass_through") * usd("grade", grade_output_tokens)
    heavy = usd("grade", grade_output_tokens)
    return priced.withColumn("image_tokens", mean.scalar()).select(
        "scenario",
        "image_tokens",
        total.alias("usd_per_1000"),
        (F.lit(1.0) - F.try_divide(total, heavy)).alias("saving"),
    )
