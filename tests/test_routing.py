import builders
import pytest
from pyspark.sql import functions as F

from faultline.functions.routing import caption, needs_grading, with_routing


@pytest.mark.parametrize(
    ("usable", "damaged", "confidence", "routed"),
    [(True, False, 0.95, False), (False, False, 0.95, True), (True, True, 0.9, True), (True, False, 0.4, True), (True, False, 0.7, False)],
)
def test_routing_truth_table(spark, usable, damaged, confidence, routed):
    row = builders.gate(spark, [("a", usable, damaged, confidence)])
    assert row.select(needs_grading(F.col("usable"), F.col("damage_present"), F.col("confidence"))).first()[0] is routed


def test_forced_class_keeps_the_verdict_and_says_so(spark):
    rows = builders.gate(spark, [("a", True, False, 0.95, "pv_module"), ("b", True, True, 0.9, "pv_module"), ("c", True, False, 0.95)])
    got = {r.image_id: r for r in with_routing(rows).collect()}
    assert got["a"].routed and not got["a"].damage_present and got["a"].reason == "seen [forced: asset class pv_module]"
    assert got["b"].routed and got["b"].reason == "seen"
    assert not got["c"].routed


def test_forcing_can_be_switched_off(spark):
    rows = builders.gate(spark, [("a", True, False, 0.95, "pv_module")])
    got = with_routing(rows, forced_classes=()).first()
    assert not got.routed and "forced" not in got.reason


def test_a_new_threshold_applies_to_stored_verdicts(spark):
    rows = builders.gate(spark, [("a", True, False, 0.8)])
    assert not with_routing(rows).first().routed
    assert with_routing(rows, min_confidence=0.9).first().routed


def test_caption(spark):
    rows = with_routing(builders.gate(spark, [("a", True, False, 0.95, "pv_module"), ("b", False, False, 0.5)]))
    parts = [F.col(c) for c in ("usable", "damage_present", "confidence", "routed", "reason")]
    got = {r.image_id: r.c for r in rows.select("image_id", caption(*parts).alias("c")).collect()}
    assert got == {"a": "gate: clean 0.95 · routed (forced)", "b": "gate: unusable 0.50 · routed"}
