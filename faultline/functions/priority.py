"""The factors of the work-queue score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import SEVERITY_WEIGHT
from faultline.functions.columns import lookup


def urgency(found_on: Column, today: Column) -> Column:
    """1.0 for a date that is missing or not YYYY-MM-DD, else 1 + age/30 days, at most 2.0."""
    day = F.when(found_on.rlike(r"^\d{4}-\d{2}-\d{2}$"), found_on.try_cast("date"))
    age = F.greatest(F.lit(0), F.datediff(today, day)).cast("double")
    return F.when(day.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.lit(1.0) + age / F.lit(30.0)))


def bounded_criticality(criticality: Column) -> Column:
    return F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.coalesce(criticality.cast("double"), F.lit(1.0))))


def consequence(asset_class: Column, flags: Column, production_loss_factor: Column, occupancy_factor: Column) -> Column:
    structural = F.array_contains(flags, "load_posting_review") | F.array_contains(flags, "section_loss")
    return (
        F.when(asset_class == "pv_module", F.coalesce(production_loss_factor.cast("double"), F.lit(1.0)))
        .when(asset_class.isin("bridge_element", "steel_coating"), F.when(structural, 2.0).otherwise(1.0))
        .when(asset_class == "building_disaster", F.coalesce(occupancy_factor.cast("double"), F.lit(1.0)))
        .otherwise(F.lit(1.0))
    )


def severity_weight(level: Column) -> Column:
    """Weight of an assessable level; null for U, which makes the whole score null."""
    return lookup(level, SEVERITY_WEIGHT)
