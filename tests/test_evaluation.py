import builders
import pytest
from pyspark.sql import functions as F

from faultline.functions.grades import measured_value, truth_ordinal
from faultline.functions.routing import with_routing
from faultline.operators import agreement, evaluation
from faultline.operators.runs import disaster_class_counts, disaster_counts, worst_levels


def steel(at, grade, **labels):
    return {"image_id": f"i{at}", "labels": {"damage_present": True, "grade_native": grade} | labels}


def test_truth_ordinals(spark):
    rows = [
        {"image_id": "a", "labels": {"grade_native": "Poor"}},
        {"image_id": "b", "asset_class": "pv_module", "labels": {"grade_native": "CoA 3"}},
        {"image_id": "c", "asset_class": "building_disaster", "labels": {"source_class": "Collapsed"}},
        {"image_id": "d", "asset_class": "bridge_element", "labels": {"grade_source": "team-graded", "grade_native": "3"}},
        {"image_id": "e", "asset_class": "bridge_element", "labels": {"grade_native": "3"}},
        {"image_id": "f", "asset_class": "bridge_element", "labels": {"grade_source": "team-graded", "grade_native": "n/a"}},
        {"image_id": "g", "labels": {}},
    ]
    got = builders.images(spark, rows).select("image_id", truth_ordinal(F.col("asset_class"), F.col("labels")).alias("t"))
    assert {r.image_id: r.t for r in got.collect()} == {"a": 2, "b": 2, "c": 2, "d": 2, "e": None, "f": None, "g": None}


@pytest.mark.parametrize(
    ("asset_class", "standard", "values", "expected"),
    [
        ("steel_coating", "CorrosionCS", [("Fair", "S1"), ("Severe", "S3"), ("Good", "S0")], 3),
        ("steel_coating", "CorrosionCS", [("Severe", "U"), ("Fair", "S1")], 1),
        ("steel_coating", "CorrosionCS", [("Severe", "U")], None),
        ("building_disaster", "FEMA-PDA", [("Major", "S3"), ("Inaccessible", "S1")], 1),
        ("bridge_element", "MBEI-CS", [("CS3", "S2")], 2),
        ("bridge_element", "MBEI-CS", [("CS9", "S2")], None),
        ("bridge_element", "NBI-0-9", [("3", "S3")], None),
        ("pv_module", "IEC-62446-3-CoA", [("CoA 2", "S2")], 1),
    ],
)
def test_predicted_ordinal(spark, asset_class, standard, values, expected):
    rows = [builders.finding(f"a/t{at}", lv, v, asset_class, standard) for at, (v, lv) in enumerate(values)]
    images = builders.images(spark, [{"image_id": "a", "asset_class": asset_class}])
    got = evaluation.predicted_ordinals(images, builders.findings(spark, rows)).collect()
    assert ([r.pred for r in got] or [None]) == [expected]


def matrix(spark, truth, pred, ac="steel_coating"):
    cells = spark.createDataFrame(
        [("run", ac, t, p, 1) for t, p in zip(truth, pred)], "run_id string, asset_class string, truth int, pred int, n bigint"
    )
    return cells.groupBy("run_id", "asset_class", "truth", "pred").agg(F.sum("n").alias("n"))


def brute_kappa(truth, pred, k):
    n = len(truth)
    row, col = [truth.count(i) for i in range(k)], [pred.count(i) for i in range(k)]
    num = sum((t - p) ** 2 for t, p in zip(truth, pred))
    den = sum((i - j) ** 2 * row[i] * col[j] / n for i in range(k) for j in range(k))
    return 1 - num / den if den else 0.0


@pytest.mark.parametrize(
    ("truth", "pred"),
    [([0, 1, 2, 3], [0, 1, 2, 3]), ([0, 0, 3, 3], [3, 3, 0, 0]), ([1, 1, 1], [1, 1, 1]), ([0, 1, 2, 3, 3, 1], [1, 1, 2, 2, 3, 0])],
)
def test_weighted_kappa(spark, truth, pred):
    got = evaluation.grading_rates(matrix(spark, truth, pred)).first()
    assert got.qwk == pytest.approx(brute_kappa(truth, pred, 4))
    assert got.exact_match == pytest.approx(sum(t == p for t, p in zip(truth, pred)) / len(truth))


def test_gate_counts_and_grading(spark):
    images = builders.images(
        spark,
        [steel(0, "Poor"), {"image_id": "i1", "labels": {"damage_present": False, "grade_native": "Good"}}, steel(2, "Fair"), {"image_id": "i3"}],
    )
    gate = with_routing(builders.gate(spark, [("i0", True, True, 0.9), ("i1", True, True, 0.9), ("i2", True, False, 0.9), ("i3", True, True, 0.9)]))
    found = builders.findings(spark, [builders.finding("i0/full", "S2", "Poor"), builders.finding("i1/full", "S1", "Fair")])
    by_dataset = evaluation.gate_by_dataset(images, gate)
    got = evaluation.gate_overall(by_dataset).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.unlabelled, got.n) == (1, 1, 1, 0, 1, 3)
    assert got.precision == 0.5 and got.recall == 0.5 and got.f1 == 0.5
    assert [r.image_id for r in evaluation.gate_misses(images, gate).collect()] == ["i2"]
    strict = evaluation.gate_overall(evaluation.gate_by_dataset(images, gate, True), True).first()
    assert (strict.tp, strict.fp, strict.fn, strict.tn) == (1, 2, 1, 0)
    pairs = evaluation.grading_pairs(images, gate, found)
    rates = evaluation.grading_rates(evaluation.grading_cells(pairs)).first()
    assert (rates.n_routed_with_truth, rates.n_assessed, rates.exact_match, rates.within_one_grade) == (2, 2, 0.5, 1.0)
    assert (rates.over_graded, rates.under_graded, rates.mae) == (1, 0, 0.5)
    dense = {r.truth: (r.pred_0, r.pred_1, r.pred_2, r.pred_3) for r in evaluation.matrix_dense(evaluation.grading_cells(pairs)).collect()}
    assert dense == {0: (0, 1, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 1, 0), 3: (0, 0, 0, 0)}
    assert evaluation.confusion_text(evaluation.grading_cells(pairs)).first().confusion == "truth0->pred1: 1, truth2->pred2: 1"


def test_routed_image_without_a_finding_is_unassessed(spark):
    images = builders.images(spark, [{"image_id": "p", "asset_class": "pv_module", "labels": {"grade_native": "CoA 2", "damage_present": True}}])
    gate = with_routing(builders.gate(spark, [("p", True, False, 0.9, "pv_module")]))
    pairs = evaluation.grading_pairs(images, gate, builders.findings(spark, [builders.finding("other/full")]))
    rates = evaluation.grading_rates(evaluation.grading_cells(pairs)).first()
    assert (rates.n_assessed, rates.u_rate, rates.qwk, rates.exact_match) == (0, 1.0, None, None)
    assert [r.image_id for r in evaluation.unassessed_images(pairs).collect()] == ["p"]


def test_published_gate_result(spark):
    """Counts of a published 50-image run give its published rates."""
    counts = {"corrosion_cs": (15, 0, 0, 0), "dacl10k": (10, 4, 0, 1), "ir_solar": (0, 0, 8, 4), "rescuenet": (5, 3, 0, 0)}
    images, verdicts = [], []
    for dataset, cells in counts.items():
        for at, (damaged, routed) in enumerate(sum(([c] * n for c, n in zip([(1, 1), (0, 1), (1, 0), (0, 0)], cells)), [])):
            name = f"{dataset}_{at}"
            images.append({"image_id": name, "source_dataset": dataset, "labels": {"damage_present": bool(damaged)}})
            verdicts.append((name, True, bool(routed), 0.9))
    by_dataset = evaluation.gate_by_dataset(builders.images(spark, images), with_routing(builders.gate(spark, verdicts)))
    got = evaluation.gate_overall(by_dataset).first()
    assert (got.n, got.routing_fraction) == (50, 0.74)
    assert (got.precision, got.recall) == (pytest.approx(0.8108108108108109), pytest.approx(0.7894736842105263)) and got.f1 == pytest.approx(0.8)
    per = {r.source_dataset: r for r in by_dataset.collect()}
    assert per["dacl10k"].precision == pytest.approx(0.7142857142857143) and per["rescuenet"].precision == 0.625
    assert per["ir_solar"].recall == 0.0 and per["ir_solar"].precision is None and per["ir_solar"].routed == 0


def test_disaster_counts(spark):
    rows = [
        builders.finding("a/full", "S4", "Destroyed", "building_disaster", "FEMA-PDA", confidence=0.9),
        builders.finding("b/full", "S3", "Major", "building_disaster", "FEMA-PDA", confidence=0.6),
        builders.finding("c/full", "S0", "Undamaged", "building_disaster", "FEMA-PDA", confidence=0.8),
        builders.finding("d/full", "U", "U", "building_disaster", "FEMA-PDA", confidence=0.0),
    ]
    table = builders.findings(spark, rows)
    got = disaster_counts(table).first()
    assert (got.n_findings, got.n_images, got.U, got.Destroyed, got.Inaccessible, got.other_values) == (4, 4, 1, 1, 0, 1)
    assert got.mean_confidence == pytest.approx((0.9 + 0.6 + 0.8) / 3) and got.u_rate == 0.25
    long = {r.native_value: r.n for r in disaster_class_counts(table).collect()}
    assert long == {"Undamaged": 1, "Affected": 0, "Minor": 0, "Major": 1, "Destroyed": 1, "Inaccessible": 0, "U": 1}
    assert disaster_counts(table.filter("false")).isEmpty()


def test_worst_level(spark):
    rows = [builders.finding("a/t0", "U"), builders.finding("a/t1", "S1"), builders.finding("a/t2", "S3"), builders.finding("b/t0", "U")]
    got = {r.image_id: r.level for r in worst_levels(builders.findings(spark, rows)).collect()}
    assert got == {"a": "S3", "b": "U"}


def test_cohens_kappa_and_adjudication(spark):
    grades = [("x", "a", "1"), ("x", "b", "1"), ("y", "a", "1"), ("y", "b", "2"), ("y", "c", "2"), ("z", "a", "2"), ("z", "b", "2"), ("w", "a", "1")]
    sides = agreement.graded_side_by_side(spark.createDataFrame(grades, "image_id string, grader string, grade string"), "a", "b", "c")
    assert {r.image_id: r.adjudicated for r in sides.collect()} == {"x": "1", "y": "2", "z": "2"}
    got = agreement.cohens_kappa(sides).first()
    po, pe = 2 / 3, (2 * 1 + 1 * 2) / 9
    assert got.n == 3 and got.kappa == pytest.approx((po - pe) / (1 - pe))


def test_class_detection(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"]), ([], [])], "t array<string>, p array<string>")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in agreement.class_detection(rows, "t", "p").collect()}
    assert got == {"a": (2, 0, 0), "b": (0, 0, 1), "c": (0, 1, 0)}
    assert agreement.macro_f1(agreement.class_detection(rows, "t", "p")).first().macro_f1 == pytest.approx(1 / 3)


def test_measured_values(spark):
    rows = spark.createDataFrame(
        [
            ("IEC-62446-3-CoA", "single hot cell", None, 12.0, 650.0, None, "CoA 2"),
            ("IEC-62446-3-CoA", "single hot cell", None, 40.0, 650.0, None, "CoA 2"),
            ("IEC-62446-3-CoA", "single hot cell", None, 41.0, 650.0, None, "CoA 3"),
            ("IEC-62446-3-CoA", "single hot cell", None, 41.0, 500.0, None, "not_measurable"),
            ("IEC-62446-3-CoA", "single hot cell", None, 41.0, None, None, "not_measurable"),
            ("MBEI-CS", "cracking (reinforced concrete)", 0.1, None, None, None, "CS1"),
            ("MBEI-CS", "cracking (reinforced concrete)", 2.0, None, None, None, "CS3"),
            ("MBEI-CS", "cracking (reinforced concrete)", None, None, None, None, "not_measurable"),
            ("FEMA-PDA", "building", None, None, None, 50.0, "Major"),
            ("FEMA-PDA", "building", None, None, None, 50.5, "Destroyed"),
        ],
        "s string, d string, w double, t double, i double, p double, want string",
    )
    got = rows.select("want", measured_value(*[F.col(c) for c in "sdwtip"]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_kappa_of_one_constant_class_is_zero_at_any_size(spark):
    cells = spark.createDataFrame([("run", "steel_coating", 2, 2, 100_000_007)], "run_id string, asset_class string, truth int, pred int, n bigint")
    assert evaluation.grading_rates(cells).first().qwk == 0.0
    near = cells.union(cells.selectExpr("run_id", "asset_class", "1", "2", "bigint(1)")).union(cells.selectExpr("run_id", "asset_class", "1", "1", "bigint(1)"))
    assert evaluation.grading_rates(near).first().qwk == pytest.approx(2 / 3, abs=1e-6)
