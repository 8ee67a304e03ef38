"""The ranked work queue: score factors, total order, export rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import first_or_blank
from faultline.functions.priority import bounded_criticality, consequence, severity_weight, urgency
from faultline.functions.text import element_of
from faultline.operators.ordered import top_per_group, with_rank
from faultline.operators.records import one_row_per

ASSET_COLUMNS = ["criticality", "production_loss_factor", "occupancy_factor", "found_on"]


def with_factors(findings: DataFrame, assets: DataFrame | None, today: dt.date | str, keyed: bool = False) -> DataFrame:
    """Add the four score factors and the score. `assets` is a table by image id; absent means defaults, and of several rows of an id the least counts.

    `keyed` findings come with their image_id: those of a run's store meet the assets where they lie.
    """
    keyed = findings if keyed else findings.withColumn("image_id", first_or_blank(F.col("evidence.image_ids")))
    if assets is None:
        known = keyed.withColumns({name: F.lit(None).cast("string" if name == "found_on" else "double") for name in ASSET_COLUMNS})
    else:
        register = one_row_per(assets.select("image_id", *ASSET_COLUMNS), "image_id")
        known = keyed.join(register, "image_id", "left")
    level = F.col("unified.level")
    factors = known.withColumns(
        {
            "severity_weight": severity_weight(level),
            "criticality": bounded_criticality(F.col("criticality")),
            "consequence": consequence(
                F.col("asset_class"), F.col("unified.flags"), F.col("production_loss_factor"), F.col("occupancy_factor")
            ),
            "urgency": urgency(F.col("found_on"), F.lit(str(today)).cast("date")),
        }
    )
    score = F.col("severity_weight") * F.col("criticality") * F.col("consequence") * F.col("urgency")
    return factors.withColumn("queue_score", score).drop("production_loss_factor", "occupancy_factor", "found_on")


def queue_order() -> list[Column]:
    """S4 first, U last, then score from high to low, then finding id."""
    level = F.col("unified.level")
    return [
        (level != "S4").asc(),
        (level == "U").asc(),
        F.coalesce(F.col("queue_score"), F.lit(0.0)).desc(),
        F.col("finding_id").asc(),
    ]


def escalated(findings: DataFrame) -> DataFrame:
    """S4 is escalated the same day. The stored action is kept; this is the effective one."""
    worst = F.col("unified.level") == "S4"
    action = F.col("action")
    return findings.withColumn(
        "action",
        F.struct(
            F.when(worst, "escalate").otherwise(action["code"]).alias("code"),
            F.when(worst, 0).otherwise(action["sla_days"]).alias("sla_days"),
            action["basis"].alias("basis"),
        ),
    )


def scored_findings(findings: DataFrame, assets: DataFrame | None, today: dt.date | str, keep_factors: bool = False, keyed: bool = False) -> DataFrame:
    """Findings with their score and effective action."""
    scored = escalated(with_factors(findings, assets, today, keyed))
    return scored if keep_factors else scored.drop("severity_weight", "criticality", "consequence", "urgency")


def rank_queue(findings: DataFrame, assets: DataFrame | None, today: dt.date | str,
               group: tuple[str, ...] = ("run_id",), keep_factors: bool = False, in_order: bool = False) -> DataFrame:
    """Score every finding and number the queue 1..n within each run. `in_order`: its rows come run by run in rank order, for an export."""
    scored = scored_findings(findings, assets, today, keep_factors)
    return with_rank(scored, list(group), queue_order(), "queue_rank", in_order)


def top_of_queue(findings: DataFrame, assets: DataFrame | None, today: dt.date | str, k: int = 10,
                 group: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The first `k` of each run's queue without ranking the rest."""
    scored = escalated(with_factors(findings, assets, today))
    return top_per_group(scored, list(group), queue_order(), k, "queue_rank")


def queue_rows(queue: DataFrame) -> DataFrame:
    """The flat queue export. Rounding happens here only."""
    c = F.col
    return queue.select(
        "run_id",
        "queue_rank",
        "queue_score",
        "finding_id",
        first_or_blank(c("evidence.image_ids")).alias("image_id"),
        "asset_class",
        "defect_type",
        c("native_scale.standard").alias("standard"),
        c("native_scale.value").alias("native_value"),
        c("unified.level").alias("unified_level"),
        c("unified.uncertainty").alias("uncertainty"),
        F.array_join("unified.flags", ";").alias("flags"),
        c("action.code").alias("action_code"),
        c("action.sla_days").alias("sla_days"),
        c("action.basis").alias("action_basis"),
        c("measurements.confidence").alias("confidence"),
        F.array_join("native_scale.criteria_matched", " | ").alias("criteria_matched"),
        "justification",
        c("review.status").alias("review_status"),
        c("review.reviewer").alias("reviewer"),
        c("review.prior_level").alias("prior_level"),
        F.array_join(c("evidence.bbox").cast("array<string>"), ",").alias("bbox"),
        c("evidence.tile").alias("tile"),
        "model",
        F.round("usd", 6).alias("usd"),
        F.round("seconds", 3).alias("seconds"),
    )


def bridge_rows(queue: DataFrame) -> DataFrame:
    """Element entry rows for bridge findings. Quantity stays blank unless an area was measured."""
    c = F.col
    area_m2 = F.round(c("measurements.area_cm2") / F.lit(10000.0), 4)
    return queue.filter(c("asset_class") == "bridge_element").select(
        "run_id",
        first_or_blank(c("evidence.image_ids")).alias("image_id"),
        "finding_id",
        element_of(c("defect_type")).alias("element"),
        c("defect_type").alias("defect"),
        c("native_scale.standard").alias("standard"),
        c("native_scale.value").alias("condition_state"),
        area_m2.alias("quantity"),
        F.when(area_m2.isNotNull(), "m2").otherwise("").alias("unit"),
        c("unified.level").alias("unified_level"),
        F.array_join("unified.flags", ";").alias("flags"),
        F.array_join("native_scale.criteria_matched", " | ").alias("criteria_matched"),
        c("measurements.confidence").alias("confidence"),
        c("review.status").alias("review_status"),
        c("review.reviewer").alias("reviewer"),
        c("review.prior_level").alias("prior_level"),
        "justification",
    )
