"""Reviewer decisions: agreement, running agreement, replay, and the state they leave a finding in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import ratio
from faultline.operators.ordered import top_per_group, with_running


def _set_level() -> Column:
    """The level a decision sets; null when it accepts the level it found."""
    return F.when(F.col("action") == "overridden", F.col("new_level")).when(F.col("action") == "marked_u", F.lit("U"))


def agreement(reviews: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    counts = [F.count_if(F.col("action") == name).alias(name) for name in ("accepted", "overridden", "marked_u")]
    totals = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)
    return totals.withColumn("agreement_rate", ratio(F.col("accepted"), F.col("total")))


def timeline(reviews: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Every decision in id order with the share accepted so far. `by=()` runs over all runs together."""
    counted = with_running(
        reviews,
        list(by),
        [F.col("id")],
        sums={"n": F.lit(1).cast("bigint"), "accepted": (F.col("action") == "accepted").cast("bigint")},
    )
    return counted.withColumn("agreement_rate", ratio(F.col("accepted"), F.col("n")))


def replay(reviews: DataFrame, model_levels: DataFrame) -> DataFrame:
    """Every decision with the level just before it and the level it leaves.

    `model_levels` holds the graded level of each (run_id, finding_id).
    """
    carried = with_running(
        reviews.withColumn("set_level", _set_level()),
        ["run_id", "finding_id"],
        [F.col("id")],
        last_before={"level_before": F.col("set_level")},
    )
    graded = model_levels.select("run_id", "finding_id", F.col("level").alias("model_level"))
    joined = carried.join(graded, ["run_id", "finding_id"], "left")
    prior = F.coalesce("level_before", "model_level")
    return joined.withColumns({"prior_level": prior, "new_level": F.coalesce("set_level", prior)}).drop(
        "level_before", "set_level", "model_level"
    )


def final_state(reviews: DataFrame) -> DataFrame:
    """What the decisions leave per finding: the level set last, the level set before it, and the last decision.

    Built from the last decision and the last two level changes only, which Spark selects before the shuffle.
    """
    keys = ["run_id", "finding_id"]
    newest_first = [F.col("id").desc()]
    latest = top_per_group(reviews, keys, newest_first, 1).select(
        *keys,
        F.col("id").alias("last_id"),
        F.col("action").alias("status"),
        F.col("reviewer"),
        F.col("reviewed_at"),
    )
    changes = reviews.withColumn("set_level", _set_level()).filter(F.col("set_level").isNotNull())
    last_two = top_per_group(changes, keys, newest_first, 2)
    levels = last_two.groupBy(*keys).agg(
        F.max("id").alias("change_id"),
        F.max_by("set_level", "id").alias("set_level"),
        F.max(F.when(F.col("rn") == 2, F.col("set_level"))).alias("set_before"),
    )
    return latest.join(levels, keys, "left")


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with their reviewed level and review fields; findings without a decision are unchanged.

    `action` is not touched: the effective action follows from the current level when the queue is ranked.
    """
    keys = ["run_id", "finding_id"]
    joined = findings.join(final_state(reviews), keys, "left")
    model_level = F.col("unified.level")
    decided = F.col("last_id").isNotNull()
    level = F.coalesce(F.col("set_level"), model_level)
    changed_now = F.col("change_id") == F.col("last_id")
    prior = F.when(changed_now, F.coalesce(F.col("set_before"), model_level)).otherwise(level)
    reviewed = joined.withColumns(
        {
            "review": F.when(
                decided,
                F.struct(
                    F.col("status"),
                    F.col("reviewer"),
                    F.date_format("reviewed_at", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("reviewed_at"),
                    prior.alias("prior_level"),
                ),
            ).otherwise(F.col("review")),
            "unified": F.struct(
                level.alias("level"),
                F.col("unified.uncertainty").alias("uncertainty"),
                F.col("unified.flags").alias("flags"),
            ),
        }
    )
    return reviewed.select(*findings.columns)
