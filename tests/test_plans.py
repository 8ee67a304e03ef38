"""What the plans over stored tables must look like: pruned scans, partial aggregation, no needless shuffle."""

import re

import builders
import pytest
from pyspark.sql import functions as F

from faultline.functions.routing import with_routing
from faultline.operators import evaluation, runs
from faultline.operators.queue import with_factors
from faultline.operators.records import not_yet_gated
from faultline.sources import readers, writers


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Stored images, verdicts and findings."""
    root = str(tmp_path_factory.mktemp("plans"))
    images = builders.images(spark, [{"image_id": f"i{at}", "labels": {"damage_present": True, "grade_native": "Poor"}} for at in range(20)])
    images.write.parquet(f"{root}/images")
    gate = builders.gate(spark, [(f"i{at}", True, True, 0.9) for at in range(20)])
    gate.write.partitionBy("run_id").parquet(f"{root}/gate")
    writers.append_log(builders.findings(spark, [builders.finding(f"i{at}/full") for at in range(20)]), root, "findings")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("images", "gate", "findings")} | {"root": root}


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(df):
    return re.findall(r"ReadSchema: (struct<.*)", plan(df))


def test_gate_cells_read_only_what_they_count(store):
    cells = evaluation.gate_by_dataset(store["images"], with_routing(store["gate"]))
    schemas = " ".join(read_schemas(cells))
    assert "labels:struct<damage_present:boolean>" in schemas
    assert not re.search(r"sha256|path|width|area_fracs|grade_native|reason:", schemas)


def test_predictions_read_only_grades(store):
    schemas = " ".join(read_schemas(evaluation.predicted_by_image(store["findings"])))
    assert "native_scale:struct<standard:string,value:string>" in schemas and "unified:struct<level:string>" in schemas
    assert not re.search(r"justification|criteria_matched|bbox|measurements|action", schemas)


def test_one_run_reads_one_partition(store):
    text = plan(store["gate"].filter(F.col("run_id") == "run").groupBy("usable").count())
    assert "PartitionFilters: [isnotnull(run_id" in text


def test_resume_reads_ids_only(spark, store):
    ids = readers.gated_ids(spark, store["root"], "run")
    text = plan(not_yet_gated(store["images"].select("image_id", "path"), ids))
    assert "LeftAnti" in text and "ReadSchema: struct<image_id:string>" in text


def test_counts_aggregate_before_the_shuffle(store):
    text = plan(runs.level_counts(store["findings"]))
    assert text.index("HashAggregate") < text.index("Exchange") < text.rindex("HashAggregate")
    assert text.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_scoring_a_queue_needs_no_python(store):
    text = plan(with_factors(store["findings"], None, "2026-09-25"))
    assert "Python" not in text and "InPandas" not in text
