"""Pluggable scorers. A scorer is one remote call per row; Spark spreads the rows, this module guards the calls.

A gate scorer takes a dict of image fields and returns usable, damage_present, confidence and reason; a grade
scorer takes a dict of target fields and returns the finding contract, or None. Both may add model, input_tokens,
output_tokens and note. Results are expensive and not repeatable, so callers write them before reading them twice.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.text import metadata_lines
from faultline.operators.sampling import exemplars_for_targets
from faultline.operators.validation import finding_rules, rubrics_by_standard

Scorer = Callable[[dict], dict | None]
ATTEMPTS = 2
#: Rows that are answered before any of them leaves a task.
SLICE = 64


def check_scorer(name: str, scorer: object) -> None:
    """Fail before any job starts when a scorer is not callable."""
    if not callable(scorer):
        raise ValueError(f"unknown {name} scorer: {scorer!r}")


def scorer_name(scorer: object) -> str:
    return "none" if scorer is None else getattr(scorer, "__name__", type(scorer).__name__)


def _not_saved(batches: Iterator[pa.RecordBatch], key: str, saved: Callable[[], set[str]] | None) -> Iterator[pa.RecordBatch]:
    """Slices of the rows whose key an earlier attempt of this task has not saved already."""
    done = saved() if saved is not None else set()
    for batch in batches:
        if done:
            batch = batch.filter(pa.array([name not in done for name in batch.column(key).to_pylist()]))
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _usage(answer: dict | None, started: float, note: str) -> dict:
    answer = answer or {}
    return {
        "model": str(answer.get("model", "")),
        "input_tokens": int(answer.get("input_tokens", 0)),
        "output_tokens": int(answer.get("output_tokens", 0)),
        "seconds": round(float(answer.get("seconds", time.perf_counter() - started)), 3),
        "note": str(answer.get("note", note)),
        "ts": dt.datetime.now(dt.timezone.utc),
    }


def _is_verdict(answer: object) -> bool:
    return (
        isinstance(answer, dict)
        and isinstance(answer.get("usable"), bool)
        and isinstance(answer.get("damage_present"), bool)
        and isinstance(answer.get("confidence"), (int, float))
        and 0.0 <= answer["confidence"] <= 1.0
    )


def _gate_row(scorer: Scorer, image: dict) -> dict:
    started, problem, answer = time.perf_counter(), "", None
    for _ in range(ATTEMPTS):
        try:
            answer = scorer(image)
        except Exception as error:  # a failing service must not stop the run or drop the image
            answer, problem = None, f"{type(error).__name__}: {error}"
            continue
        if _is_verdict(answer):
            verdict = {name: answer[name] for name in ("usable", "damage_present", "confidence")}
            return verdict | {"reason": str(answer.get("reason", ""))} | _usage(answer, started, "")
        problem = "not a verdict"
    fallback = {"usable": True, "damage_present": True, "confidence": 0.0}
    reason = f"no valid verdict after {ATTEMPTS} attempts ({problem}); routed by default"
    usage = _usage(answer if isinstance(answer, dict) else None, started, problem)
    return fallback | {"reason": reason} | usage


USAGE_FIELDS = [
    ("model", pa.string()),
    ("input_tokens", pa.int64()),
    ("output_tokens", pa.int64()),
    ("seconds", pa.float64()),
    ("note", pa.string()),
    ("ts", pa.timestamp("us", "UTC")),
]


def _answered(call: Callable[[dict], dict], rows: list[dict], at_once: int) -> list[dict]:
    """The answers in row order, from up to `at_once` calls at a time."""
    if at_once <= 1:
        return [call(row) for row in rows]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(call, rows))


def gate_images(images: DataFrame, scorer: Scorer, at_once: int = 1, saved: Callable[[], set[str]] | None = None) -> DataFrame:
    """Score each image once, with one retry. After a second failure the image is routed, never dropped.

    `saved`, called in each task, names images that need no call because an earlier attempt's verdicts are stored.

    A task makes up to `at_once` calls at a time, from threads. A scorer sees plain values: whole numbers stay whole
    and missing values are None, whatever else is in the batch.
    """
    check_scorer("gate", scorer)
    kept = [name for name in ("image_id", "path", "asset_class", "width", "height", "source_dataset") if name in images.columns]
    fields = [("usable", pa.bool_()), ("damage_present", pa.bool_()), ("confidence", pa.float64()), ("reason", pa.string()), *USAGE_FIELDS]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _not_saved(batches, "image_id", saved):
            answers = _answered(lambda image: _gate_row(scorer, image), part.to_pylist(), at_once)
            columns = [pa.array([answer[name] for answer in answers], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("asset_class"), *columns], ["image_id", "asset_class", *dict(fields)])

    return images.select(*kept).mapInArrow(score, schemas.struct(schemas.GATE))


def _grade_row(scorer: Scorer, target: dict) -> dict:
    started, answer, note = time.perf_counter(), None, ""
    try:
        answer = scorer(target)
        note = "end_turn" if answer is not None else "no output"
    except Exception as error:  # a failing grade becomes U below, never a lost image
        note = f"{type(error).__name__}: {error}"
    contract = None if answer is None else json.dumps(answer.get("contract"))
    return {"contract_json": contract} | _usage(answer, started, note)


def grade_targets(targets: DataFrame, scorer: Scorer, exemplars: DataFrame | None = None, at_once: int = 1,
                  saved: Callable[[], set[str]] | None = None, rubrics: dict[str, list[dict]] | None = None) -> DataFrame:
    """Grade each target once and return contract text and usage beside the target's columns.

    The scorer also gets `rubric`, the rows of the target's standard, and `exemplars`, those of its class except
    the target's own image. A task makes up to `at_once` calls at a time, from threads.
    """
    check_scorer("grade", scorer)
    rubrics = rubrics_by_standard() if rubrics is None else rubrics
    with_metadata = targets.withColumn(
        "metadata",
        metadata_lines(*[F.col(name) for name in ("asset_class", "gsd_mm_per_px", "irradiance_wm2", "captured_on", "width", "height")]),
    )
    carried = ["finding_id", "image_id", "asset_class", "standard", "tile", "bbox", "gsd_mm_per_px", "irradiance_wm2"]
    asked = [*carried, "path", "metadata"]
    if exemplars is not None:
        with_metadata, asked = exemplars_for_targets(with_metadata, exemplars), [*asked, "exemplars"]
    schema = with_metadata.select(*carried).schema
    for field in schemas.struct(f"contract_json string, {schemas.USAGE}").fields:
        schema = schema.add(field)
    fields = [("contract_json", pa.string()), *USAGE_FIELDS]

    def grade(target: dict) -> dict:
        shown = [{name: e[name] for name in ("image_id", "native_value", "note")} for e in target.get("exemplars") or []]
        return _grade_row(scorer, target | {"rubric": rubrics.get(target["standard"], []), "exemplars": shown})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _not_saved(batches, "finding_id", saved):
            answers = _answered(grade, part.to_pylist(), at_once)
            columns = [pa.array([answer[name] for answer in answers], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([*(part.column(name) for name in carried), *columns], [*carried, *dict(fields)])

    return with_metadata.select(*asked).mapInArrow(score, schema)


def evidence_struct() -> Column:
    return F.struct(
        F.array("image_id").alias("image_ids"), "bbox", "tile", "gsd_mm_per_px", "irradiance_wm2"
    ).alias("evidence")


def pending_review() -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit("pending").alias("status"), text.alias("reviewer"), text.alias("reviewed_at"), text.alias("prior_level")
    ).alias("review")


def unassessable(reason: Column) -> dict[str, Column]:
    """The contract columns of a finding that could not be assessed: level U, never S0."""
    nothing = F.lit(None).cast("double")
    return {
        "defect_type": F.lit("not_assessable"),
        "native_scale": F.struct(
            F.col("standard"), F.lit("U").alias("value"), F.array().cast("array<string>").alias("criteria_matched")
        ),
        "unified": F.struct(
            F.lit("U").alias("level"), F.lit("+/-1").alias("uncertainty"), F.array(F.lit("not_measurable")).alias("flags")
        ),
        "measurements": F.struct(
            *[nothing.alias(name) for name in ("area_cm2", "crack_width_mm", "delta_t_k", "percent_area_rusted", "section_loss_pct")],
            F.lit(0.0).alias("confidence"),
        ),
        "action": F.struct(
            F.lit("monitor").alias("code"),
            F.lit(None).cast("int").alias("sla_days"),
            F.concat(F.lit("Not assessable: "), reason, F.lit(". Re-image or use other NDT.")).alias("basis"),
        ),
        "justification": reason,
    }


def unusable_findings(images: DataFrame) -> DataFrame:
    """U findings over the whole image for routed images the gate called unusable."""
    reason = F.concat(F.lit("gate marked image unusable: "), F.col("reason"))
    whole = images.withColumns(
        {
            "finding_id": F.concat(F.col("image_id"), F.lit("/full")),
            "tile": F.lit("full"),
            "bbox": F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height")),
        }
    )
    contract = [value.alias(name) for name, value in unassessable(reason).items()]
    return whole.select(
        "finding_id", "asset_class", *contract, evidence_struct(), pending_review(), "model",
        F.lit(0.0).alias("usd"),
        F.lit(0.0).alias("seconds"),
        "image_id",
    )


def graded_findings(graded: DataFrame) -> DataFrame:
    """Findings from priced grader answers, with the call beside each.

    A missing or invalid contract becomes a U finding with the reason; its call still counts in the log.
    """
    parsed = graded.withColumn("_contract", F.from_json("contract_json", schemas.CONTRACT, {"mode": "PERMISSIVE"}))
    names = schemas.struct(schemas.CONTRACT).fieldNames()
    flat = parsed.select("*", *[F.col(f"_contract.{name}").alias(name) for name in names])
    broken = F.lit(False)
    for rule in finding_rules().values():
        broken = broken | rule
    checked = flat.withColumn("_failed", F.coalesce(broken, F.lit(True)))
    reason = F.concat(F.lit("grader returned no contract ("), F.col("note"), F.lit(")"))
    blank = unassessable(reason)
    contract = [F.when(F.col("_failed"), blank[name]).otherwise(F.col(name)).alias(name) for name in names]
    return checked.select(
        "finding_id", "asset_class", *contract, evidence_struct(), pending_review(), "model",
        F.when(F.col("_failed"), 0.0).otherwise(F.col("usd")).alias("usd"),
        F.when(F.col("_failed"), 0.0).otherwise(F.col("seconds")).alias("seconds"),
        "input_tokens",
        "output_tokens",
        "note",
        "ts",
        F.col("seconds").alias("call_seconds"),
        F.col("usd").alias("call_usd"),
        "image_id",
    )
