"""Small tables in the library's schemas."""

import json

from pyspark.sql import functions as F

from faultline import schemas


def images(spark, rows):
    """Image records from dicts; unnamed fields take harmless defaults."""
    schema = schemas.struct(schemas.IMAGES)
    label_names = schema["labels"].dataType.fieldNames()
    full = []
    for row in rows:
        given = {
            "path": f"/images/{row['image_id']}.jpg", "sha256": "0" * 64, "width": 64, "height": 48,
            "asset_class": "steel_coating", "captured_on": "2026-09-01", "source_dataset": "fake", "split": "dev",
        } | row
        labels = given.get("labels") or {}
        given["labels"] = tuple(labels.get(name) for name in label_names)
        full.append(tuple(given.get(name) for name in schema.fieldNames()))
    return spark.createDataFrame(full, schema)


def finding(finding_id, level="S2", value="Poor", asset_class="steel_coating", standard="CorrosionCS", flags=(), image_id=None,
            confidence=0.8, defect_type="corrosion", area=None, run_id="run"):
    return {
        "finding_id": finding_id, "asset_class": asset_class, "defect_type": defect_type,
        "native_scale": {"standard": standard, "value": value, "criteria_matched": ["c1", "c2"]},
        "unified": {"level": level, "uncertainty": "+/-1", "flags": list(flags)},
        "measurements": {"area_cm2": area, "confidence": confidence},
        "action": {"code": "schedule", "sla_days": 90, "basis": "row 1"},
        "justification": "j",
        "evidence": {"image_ids": [image_id or finding_id.split("/")[0]], "bbox": [0, 0, 10, 10], "tile": "full"},
        "review": {"status": "pending"},
        "model": "fake", "usd": 0.0, "seconds": 0.0, "run_id": run_id,
    }


def findings(spark, rows):
    ddl = schemas.FINDINGS + ", run_id string"
    texts = spark.createDataFrame([(json.dumps(row),) for row in rows], "json string")
    return texts.select(F.from_json("json", ddl).alias("f")).select("f.*")


def gate(spark, rows, run_id="run"):
    """Verdict rows of (image_id, usable, damage_present, confidence[, asset_class])."""
    full = [(run_id, r[0], r[4] if len(r) > 4 else "steel_coating", r[1], r[2], float(r[3]), "seen", "fake") for r in rows]
    return spark.createDataFrame(
        full,
        "run_id string, image_id string, asset_class string, usable boolean, damage_present boolean, confidence double,"
        " reason string, model string",
    )


def number_of(row):
    return int(row["image_id"].rpartition("_")[2])


def fake_gate(image):
    """Number 0 shows nothing, number 1 cannot be judged, all later ones are corroded."""
    number = number_of(image)
    reasons = ("bare metal", "fogged lens", "corroded flange")
    return {
        "usable": number != 1,
        "damage_present": number > 1,
        "confidence": 0.25 if number == 1 else 0.875,
        "reason": reasons[min(number, 2)],
        "model": "fake-gate",
        "input_tokens": 16,
        "output_tokens": 4,
        "seconds": 0.125,
    }


def fake_grade(target):
    """Every fourth image is at the worst level; the value is the middle one of the rubric."""
    rows = target["rubric"]
    row = rows[len(rows) // 2]
    native = {"standard": target["standard"], "value": row["value"], "criteria_matched": [row["criterion"]]}
    contract = {
        "defect_type": "pitting",
        "native_scale": native,
        "unified": {"level": "S4" if number_of(target) % 4 == 3 else "S2", "uncertainty": "+/-2", "flags": []},
        "measurements": {"section_loss_pct": 6.5, "confidence": 0.625},
        "action": {"code": "monitor", "sla_days": 365, "basis": "middle row"},
        "justification": f"graded as {row['value']}",
    }
    return {"contract": contract, "model": "fake-grader", "input_tokens": 240, "output_tokens": 60, "seconds": 0.25}
