import builders
from pyspark.sql import functions as F

from faultline.functions.priority import urgency
from faultline.operators.queue import bridge_rows, queue_rows, rank_queue, top_of_queue

TODAY = "2026-09-25"


def assets(spark, rows):
    return spark.createDataFrame(
        rows, "image_id string, criticality double, production_loss_factor double, occupancy_factor double, found_on string"
    )


def test_s4_sorts_above_everything_and_is_escalated(spark):
    rows = builders.findings(spark, [builders.finding("a/full", "S4"), builders.finding("b/full", "S3")])
    known = assets(spark, [("b", 3.0, None, None, None)])
    got = rank_queue(rows, known, TODAY).orderBy("queue_rank").collect()
    assert [r.finding_id for r in got] == ["a/full", "b/full"]
    assert got[0].action.code == "escalate" and got[0].action.sla_days == 0 and got[1].action.code == "schedule"
    assert (got[0].queue_score, got[1].queue_score) == (27.0, 27.0)


def test_u_is_last_and_has_no_score(spark):
    rows = builders.findings(spark, [builders.finding("a/full", "U"), builders.finding("b/full", "S0")])
    got = rank_queue(rows, None, TODAY).orderBy("queue_rank").collect()
    assert [r.finding_id for r in got] == ["b/full", "a/full"] and got[1].queue_score is None and got[0].queue_score == 0.0


def test_structural_flags_double_and_criticality_is_bounded(spark):
    rows = builders.findings(
        spark,
        [
            builders.finding("a/full", "S1", flags=["section_loss"]),
            builders.finding("b/full", "S1"),
            builders.finding("c/full", "S1", asset_class="pv_module", flags=["section_loss"]),
            builders.finding("d/full", "S1", asset_class="building_disaster"),
        ],
    )
    known = assets(spark, [("b", 9.0, None, None, None), ("c", 0.1, 1.5, 7.0, None), ("d", None, 7.0, 2.5, None)])
    got = {r.finding_id: r.queue_score for r in rank_queue(rows, known, TODAY).collect()}
    assert got == {"a/full": 2.0, "b/full": 3.0, "c/full": 1.5, "d/full": 2.5}


def test_urgency(spark):
    dates = ["2026-01-01", "2026-09-25", "2026-09-10", "2027-01-01", None, "soon", "2026-9-1", "20260910", "2026-02-30"]
    rows = spark.createDataFrame([(d,) for d in dates], "d string")
    got = [r.u for r in rows.select(urgency(F.col("d"), F.lit(TODAY).cast("date")).alias("u")).collect()]
    assert got == [2.0, 1.0, 1.5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_runs_are_ranked_apart_and_top_k_agrees(spark):
    rows = builders.findings(
        spark,
        [builders.finding(f"i{at}/full", f"S{at % 5}", run_id=f"run{at % 2}") for at in range(40)],
    )
    ranked = rank_queue(rows, None, TODAY).select("run_id", "finding_id", "queue_rank")
    top = top_of_queue(rows, None, TODAY, 3).select("run_id", "finding_id", "queue_rank")
    assert sorted(map(tuple, top.collect())) == sorted(tuple(r) for r in ranked.collect() if r.queue_rank <= 3)
    for run in ("run0", "run1"):
        assert sorted(r.queue_rank for r in ranked.collect() if r.run_id == run) == list(range(1, 21))


def test_queue_row_fields(spark):
    row = builders.finding("a/t01", "S3", flags=["section_loss", "not_measurable"], confidence=0.5)
    row["usd"], row["seconds"] = 0.12345678, 1.23456
    got = queue_rows(rank_queue(builders.findings(spark, [row]), None, TODAY))
    assert got.columns == [
        "run_id", "queue_rank", "queue_score", "finding_id", "image_id", "asset_class", "defect_type", "standard", "native_value",
        "unified_level", "uncertainty", "flags", "action_code", "sla_days", "action_basis", "confidence", "criteria_matched",
        "justification", "review_status", "reviewer", "prior_level", "bbox", "tile", "model", "usd", "seconds",
    ]
    r = got.first()
    assert (r.flags, r.criteria_matched, r.bbox) == ("section_loss;not_measurable", "c1 | c2", "0,0,10,10")
    assert (r.image_id, r.usd, r.seconds) == ("a", 0.123457, 1.235)


def test_bridge_rows(spark):
    kinds = ["spall (pier cap)", "rust (girder) (web)", "cracking", "odd (x))"]
    rows = [
        builders.finding(f"i{at}/full", asset_class="bridge_element", defect_type=kind, area=None if at else 12345.0)
        for at, kind in enumerate(kinds)
    ] + [builders.finding("other/full")]
    got = {r.finding_id: r for r in bridge_rows(builders.findings(spark, rows)).collect()}
    assert [got[f"i{at}/full"].element for at in range(4)] == ["pier cap", "web", "", "x"]
    assert (got["i0/full"].quantity, got["i0/full"].unit) == (1.2345, "m2")
    assert (got["i1/full"].quantity, got["i1/full"].unit) == (None, "") and "other/full" not in got
