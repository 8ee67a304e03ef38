"""Native grade values as ordinals, for dataset truth and for findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import (
    ASSET_CLASSES,
    DISASTER_TO_SCENE,
    GRADE_LABELS,
    LEVEL_ORDINAL,
    PV_GRADES,
    SCENE_GRADES,
    STEEL_GRADES,
)
from faultline.functions.columns import lookup, ordinal
from faultline.rubric_values import MEASURED_THRESHOLDS, MIN_IRRADIANCE_WM2, MM_PER_INCH


def truth_ordinal(asset_class: Column, labels: Column) -> Column:
    """Ordinal of the dataset label. Bridge labels count only when a team graded them."""
    team_grade = F.when(labels["grade_source"] == "team-graded", labels["grade_native"].try_cast("int") - 1)
    return (
        F.when(asset_class == "steel_coating", ordinal(labels["grade_native"], STEEL_GRADES))
        .when(asset_class == "pv_module", ordinal(labels["grade_native"], PV_GRADES))
        .when(asset_class == "building_disaster", ordinal(labels["source_class"], SCENE_GRADES))
        .when(asset_class == "bridge_element", team_grade)
    )


def value_ordinals(value: Column, standard: Column) -> dict[str, Column]:
    """The ordinal a native value has on each asset class's scale; null where it is not on it.

    A bridge value counts only on the element condition-state standard: a component rating of 3 is not CS3.
    """
    digits = F.when(standard == "MBEI-CS", F.regexp_replace(value, "[^0-9]", "")).try_cast("int")
    return {
        "bridge_element": F.when(digits.between(1, 4), digits - 1),
        "steel_coating": ordinal(value, STEEL_GRADES),
        "pv_module": ordinal(value, PV_GRADES),
        "building_disaster": ordinal(lookup(value, DISASTER_TO_SCENE), SCENE_GRADES),
    }


def pick_by_class(asset_class: Column, by_class: dict[str, Column]) -> Column:
    chosen = F.when(F.lit(False), F.lit(None))
    for name in ASSET_CLASSES:
        chosen = chosen.when(asset_class == name, by_class[name])
    return chosen


def grade_label(asset_class: Column, position: Column) -> Column:
    labels = {
        f"{name}/{at}": label for name in ASSET_CLASSES for at, label in enumerate(GRADE_LABELS[name])
    }
    return lookup(F.concat(asset_class, F.lit("/"), position.cast("string")), labels)


def grade_count(asset_class: Column) -> Column:
    return lookup(asset_class, {name: len(GRADE_LABELS[name]) for name in ASSET_CLASSES})


def level_ordinal(level: Column) -> Column:
    """S0..S4 as 0..4; null for U."""
    return lookup(level, LEVEL_ORDINAL)


def measured_value(standard: Column, subject: Column, crack_width_mm: Column, delta_t_k: Column,
                   irradiance_wm2: Column, percent_damage: Column) -> Column:
    """Native value from a measurement, or `not_measurable` when the needed one is missing or invalid.

    A temperature difference counts only at or above the irradiance the standard asks for.
    """
    measures = {
        "crack_width_in": crack_width_mm / F.lit(MM_PER_INCH),
        "delta_t_k": F.when(irradiance_wm2 >= MIN_IRRADIANCE_WM2, delta_t_k),
        "percent_damage": percent_damage,
    }
    result = F.lit("not_measurable")
    for rule_standard, rule_subject, measure, threshold, strict, value in MEASURED_THRESHOLDS:
        x = measures[measure]
        reached = x > threshold if strict else x >= threshold
        result = F.when((standard == rule_standard) & (subject == rule_subject) & reached, value).otherwise(result)
    return result
