"""Run reports: the evaluation tables, with intervals when scored, for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import bootstrap, evaluation, runs
from faultline.session import materialise


def evaluation_tables(images: DataFrame, routed_gate: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Gate per run, gate per dataset, grading rates and grading matrix.

    The counted cells are written once; every table here is arithmetic on them.
    """
    by_dataset = materialise(evaluation.gate_by_dataset(images, routed_gate), "gate_cells")
    cells = materialise(evaluation.grading_cells(evaluation.grading_pairs(images, routed_gate, findings)), "grade_cells")
    return {
        "gate": evaluation.gate_overall(by_dataset),
        "per_dataset": by_dataset,
        "grading": evaluation.grading_rates(cells),
        "matrix": evaluation.matrix_long(cells),
        "confusion": evaluation.confusion_text(cells),
        "cells": cells,
    }


def _gate_cells(by_dataset: DataFrame) -> DataFrame:
    """The 2x2 counts as (truth, routed, n) rows."""
    kinds = {"tp": (True, True), "fp": (False, True), "fn": (True, False), "tn": (False, False)}
    cells = F.array(
        *[
            F.struct(F.lit(truth).alias("truth"), F.lit(routed).alias("routed"), F.sum(name).alias("n"))
            for name, (truth, routed) in kinds.items()
        ]
    )
    counted = by_dataset.groupBy("run_id").agg(cells.alias("cells")).select("run_id", F.explode("cells").alias("c"))
    return counted.select("run_id", "c.*").filter(F.col("n") > 0)


def scored_report(images: DataFrame, routed_gate: DataFrame, findings: DataFrame, calls: DataFrame,
                  resamples: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """The evaluation tables with 95 percent intervals, and the measured cost and latency per stage."""
    tables = evaluation_tables(images, routed_gate, findings)
    gate_bounds = bootstrap.intervals(
        _gate_cells(tables["per_dataset"]), ["run_id"], ["truth", "routed"], bootstrap.gate_statistics(), resamples, seed
    ).select("run_id", "precision_low", "precision_high", "recall_low", "recall_high", "f1_low", "f1_high")
    assessed = tables["cells"].filter(F.col("pred").isNotNull())
    keys = ["run_id", "asset_class"]
    grade_bounds = bootstrap.intervals(assessed, keys, ["truth", "pred"], bootstrap.grading_statistics(), resamples, seed)
    grade_bounds = grade_bounds.select(
        *keys, "exact_match_low", "exact_match_high", "within_one_grade_low", "within_one_grade_high"
    )
    return tables | {
        "gate": tables["gate"].join(gate_bounds, "run_id", "left"),
        "grading": tables["grading"].join(grade_bounds, keys, "left"),
        "ops": runs.ops_by_stage(calls),
        "usd_per_image": runs.usd_per_image(calls, routed_gate, images),
    }


def run_report(routed_gate: DataFrame, findings: DataFrame, calls: DataFrame, images: DataFrame | None = None, *,
               configs: DataFrame | None = None, disaster_runs: DataFrame | None = None, top: int = 10) -> dict[str, DataFrame]:
    """Metrics of each run, the first rows of its queue, and the evaluation tables when images with labels are given.

    `images` needs a run_id to give the size of each run's manifest.
    """
    sized = images if images is not None and "run_id" in images.columns else None
    report = {"metrics": runs.run_metrics(routed_gate, findings, calls, images=sized, configs=configs, disaster_runs=disaster_runs)}
    if "queue_rank" in findings.columns:
        report["top"] = runs.top_list(findings.filter(F.col("queue_rank") <= top))
    return report if images is None else report | evaluation_tables(images, routed_gate, findings)
