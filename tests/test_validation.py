import builders

from faultline.operators.validation import criteria_audit, finding_rules, rubric_table, split_valid, with_violations
from faultline.rubric_values import ALLOWED_VALUES, RUBRIC_ROWS


def test_each_rule_names_its_field(spark):
    broken = {
        "confidence": builders.finding("a", confidence=1.5),
        "level": builders.finding("b", level="S9"),
        "standard": builders.finding("c", standard="XYZ"),
        "flags": builders.finding("d", flags=["odd"]),
        "asset_class": builders.finding("e", asset_class="road"),
    }
    rows = builders.findings(spark, [*broken.values(), builders.finding("ok")])
    got = {r.finding_id: r.violations for r in with_violations(rows, finding_rules()).collect()}
    assert {row["finding_id"]: [name] for name, row in broken.items()} | {"ok": []} == got
    valid, quarantine = split_valid(rows, finding_rules())
    assert [r.finding_id for r in valid.collect()] == ["ok"] and quarantine.count() == 5


def test_missing_fields_are_violations(spark):
    row = builders.finding("a")
    del row["action"], row["justification"]
    got = with_violations(builders.findings(spark, [row]), finding_rules()).first().violations
    assert got == ["action_code", "action_basis", "justification"]


def test_rubric_is_complete(spark):
    assert rubric_table(spark).count() == len(RUBRIC_ROWS) == 42
    for standard, values in ALLOWED_VALUES.items():
        assert {r[2] for r in RUBRIC_ROWS if r[0] == standard} == set(values)


def test_criteria_audit(spark):
    def quoted(finding_id, level, value, standard, criteria):
        row = builders.finding(finding_id, level, value, "bridge_element", standard)
        row["native_scale"]["criteria_matched"] = criteria
        return row

    heavy = "Heavy build-up with rust staining."
    rows = [
        quoted("exact", "S2", "CS3", "MBEI-CS", [heavy]),
        quoted("paraphrase", "S2", "CS3", "MBEI-CS", ["Heavy rust."]),
        quoted("wrong level", "S1", "CS3", "MBEI-CS", [heavy]),
        quoted("upgrade", "S4", "CS4", "MBEI-CS", []),
        quoted("no rubric", "S2", "Ri 3", "ISO-4628-3", ["x"]),
        quoted("bad value", "S2", "CS7", "MBEI-CS", [heavy]),
    ]
    got = {r.finding_id: tuple(r)[2:] for r in criteria_audit(builders.findings(spark, rows)).collect()}
    assert got == {
        "exact": (False, 0, True, True),
        "paraphrase": (False, 1, True, False),
        "wrong level": (False, 0, True, False),
        "upgrade": (False, 0, True, True),
        "no rubric": (True, 0, False, False),
        "bad value": (False, 0, False, False),
    }
