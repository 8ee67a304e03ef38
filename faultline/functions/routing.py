"""First-pass routing: which images go on to the grader, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import FORCED_CLASSES, MIN_CLEAN_CONFIDENCE


def needs_grading(usable: Column, damage_present: Column, confidence: Column,
                  min_confidence: float = MIN_CLEAN_CONFIDENCE) -> Column:
    """Recall first: only a usable image called clean with enough confidence stays behind."""
    return ~usable | damage_present | (confidence < F.lit(float(min_confidence)))


def forced(asset_class: Column, classes: list[str] | tuple[str, ...] = tuple(FORCED_CLASSES)) -> Column:
    return asset_class.isin(*classes) if classes else F.lit(False)


def with_routing(verdicts, min_confidence: float = MIN_CLEAN_CONFIDENCE,
                 forced_classes: list[str] | tuple[str, ...] = tuple(FORCED_CLASSES)):
    """Add `routed` to stored verdicts and mark the reason of forced ones.

    The verdict itself is kept as stored, so a new threshold applies to images that are already gated.
    """
    by_verdict = needs_grading(F.col("usable"), F.col("damage_present"), F.col("confidence"), min_confidence)
    by_class = forced(F.col("asset_class"), forced_classes)
    note = F.concat(F.col("reason"), F.lit(" [forced: asset class "), F.col("asset_class"), F.lit("]"))
    return verdicts.withColumns(
        {"routed": by_verdict | by_class, "reason": F.when(by_class & ~by_verdict, note).otherwise(F.col("reason"))}
    )


def pass_through_verdict(images):
    """The verdict of a disabled gate: everything is usable, damaged and certain."""
    return images.withColumns(
        {
            "usable": F.lit(True),
            "damage_present": F.lit(True),
            "confidence": F.lit(1.0),
            "reason": F.lit("gate disabled"),
        }
    )


def caption(usable: Column, damage_present: Column, confidence: Column, routed: Column, reason: Column) -> Column:
    verdict = F.when(~usable, "unusable").when(damage_present, "damage").otherwise("clean")
    routing = F.when(routed, "routed").otherwise("not routed")
    mark = F.when(reason.contains("[forced:"), " (forced)").otherwise("")
    return F.concat(F.format_string("gate: %s %.2f · %s", verdict, confidence, routing), mark)
