"""Run facts: cost, latency, summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.evaluation_queries import ROUTED
from catalog.queue_queries import LEVEL_SQL
from catalog.registry import query
from catalog.views import oracle
from faultline.functions.routing import with_routing
from faultline.operators import runs
from faultline.operators.agreement import cost_per_thousand
from faultline.sources.readers import list_datasets

PRICED = views.price_cte() + """,
priced as (
  select c.*, (c.input_tokens * coalesce(p.usd_per_mtok_in, 0) + c.output_tokens * coalesce(p.usd_per_mtok_out, 0)) / 1000000.0::double as usd
  from fx_calls c left join prices p on c.model = p.model
)
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.priced(views.calls(spark, sf_dir), views.prices(spark))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_routing(views.gate(spark, sf_dir))


@query(oracle("fx_calls", "select call_id, model, usd from priced", PRICED))
def usd_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("call_id", "model", "usd")


@query(oracle("fx_calls", """select run_id, stage, count(*) as calls, round(sum(usd), 9) as usd, round(sum(seconds), 6) as seconds,
  cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from priced group by run_id, stage""", PRICED))
def cost_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cost_by_stage(_calls(spark, sf_dir)).withColumns({"usd": F.round("usd", 9), "seconds": F.round("seconds", 6)})


@query(oracle("fx_calls", """select run_id, stage, count(*) as calls, round(median(seconds), 6) as median_seconds, round(sum(usd), 4) as usd_total,
  string_agg(distinct model, ', ' order by model) as models from priced group by run_id, stage""", PRICED))
def ops_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.ops_by_stage(_calls(spark, sf_dir)).withColumn("median_seconds", F.round("median_seconds", 6))


@query(oracle("fx_calls", """select run_id, stage, model, count(*) as calls, round(sum(usd), 9) as usd, round(median(seconds), 6) as median_seconds,
  cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from priced group by run_id, stage, model""", PRICED))
def cost_by_stage_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cost_by_stage_model(_calls(spark, sf_dir)).withColumns(
        {"usd": F.round("usd", 9), "median_seconds": F.round("median_seconds", 6)}
    )


@query(oracle("fx_calls fx_gate fx_images", """select c.run_id, s.n as scored_images, round(c.usd / s.n, 5) as usd_per_image
  from (select run_id, sum(usd) as usd from priced group by run_id) c
  join (select g.run_id, count(*) as n from fx_gate g join fx_images i on g.image_id = i.image_id group by g.run_id) s on s.run_id = c.run_id""", PRICED))
def usd_per_scored_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.usd_per_image(_calls(spark, sf_dir), views.gate(spark, sf_dir), views.images(spark, sf_dir))


FACTS = ROUTED + "," + PRICED + f""",
per_image as (select run_id, count(*) as images from fx_images group by run_id),
per_gate as (select run_id, count(*) as gated, count(*) filter (where routed) as routed, count(*) filter (where not usable) as unusable from routed_gate group by run_id),
per_finding as (select run_id, count(*) as findings, count(distinct image_id) as graded_images, count(*) filter (where review_status <> 'pending') as reviews, {LEVEL_SQL},
  string_agg(distinct asset_class, ', ' order by asset_class) as asset_classes from fx_findings group by run_id),
per_call as (select run_id, sum(usd) as usd, sum(seconds) as seconds, sum(case when stage = 'gate' then seconds else 0 end) as seconds_gate,
  sum(case when stage = 'grade' then seconds else 0 end) as seconds_grade, string_agg(distinct model, ', ' order by model) as models from priced group by run_id),
facts as (select * from per_image join per_gate using (run_id) join per_finding using (run_id) join per_call using (run_id))
"""
FACT_VIEWS = "fx_images fx_gate fx_findings fx_calls"
LEVEL_NAMES = '"S0", "S1", "S2", "S3", "S4", "U"'


@query(oracle(FACT_VIEWS, f"""select run_id, images, gated, routed as routed_to_grader, routed::double / gated::double as routing_fraction, unusable, findings, {LEVEL_NAMES},
  round(usd, 4) as usd_total, round(usd / images::double, 5) as usd_per_image, round(seconds, 1) as seconds_total from facts""", FACTS))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarise(
        views.images(spark, sf_dir), _routed(spark, sf_dir), views.findings(spark, sf_dir), _calls(spark, sf_dir)
    )


@query(oracle(FACT_VIEWS, """select 'native_values' as part, run_id, case when value in (select value from allowed) then value else 'other' end as key, cast(count(*) as bigint) as n, null::double as usd
    from (select run_id, native_value as value from fx_findings) group by all
  union all select 'asset_classes', run_id, asset_class, cast(count(*) as bigint), null from fx_images group by all
  union all select 'cost_by_stage', run_id, stage, cast(count(*) as bigint), round(sum(usd), 6) from priced group by all
  union all select 'config', run_id, 'gate', 5, null from (select distinct run_id from fx_images)""",
  FACTS + ", " + views.rubric_cte() + ", allowed as (select distinct value from rubric)"))
def run_summary_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of a run's summary, one row an entry; the settings as the store gives them, here of a gate named `model`."""
    images = views.images(spark, sf_dir)
    configs = images.select("run_id").distinct().withColumn("settings", F.lit('{"gate": "model"}'))
    told = runs.summary_details(images, views.findings(spark, sf_dir), _calls(spark, sf_dir), configs)

    def entries(name: str, n: Column, usd: Column) -> DataFrame:
        return told.select("run_id", F.explode(name).alias("key", "value")).select(F.lit(name).alias("part"), "run_id", "key", n.alias("n"), usd.alias("usd"))

    value, none = F.col("value"), F.lit(None).cast("double")
    gate = F.get_json_object("config", "$.gate")
    return (
        entries("native_values", value, none)
        .unionByName(entries("asset_classes", value, none))
        .unionByName(entries("cost_by_stage", value["calls"], F.round(value["usd"], 6)))
        .unionByName(told.select(F.lit("config").alias("part"), "run_id", F.lit("gate").alias("key"), F.length(gate).cast("long").alias("n"), none.alias("usd")))
    )


@query(oracle(FACT_VIEWS, f"""select run_id, images, findings, round(usd, 4) as usd_total, routed from facts where run_id in ('run0', 'run2')""", FACTS))
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.batch_status(run_summary(spark, sf_dir), ["run0", "run2"])


@query(oracle(FACT_VIEWS, f"""select run_id, images, gated, routed, unusable, graded_images as graded, findings, round(usd, 5) as usd,
  round(seconds_gate, 1) as seconds_gate, round(seconds_grade, 1) as seconds_grade, {LEVEL_NAMES} from facts""", FACTS))
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.progress(
        views.images(spark, sf_dir), _routed(spark, sf_dir), views.findings(spark, sf_dir), _calls(spark, sf_dir)
    )


METRICS_SQL = f"""select run_id as run, case when run_id = 'run1' then 'surge' else 'inspect' end as mode, '' as gate, '' as grader, images, gated, routed, unusable, graded_images, findings, {LEVEL_NAMES},
  round(usd, 4) as usd_total, round(round(usd, 4) / images::double, 5) as usd_per_image, round(seconds_gate, 1) as seconds_gate, round(seconds_grade, 1) as seconds_grade, reviews, asset_classes, models from facts"""


@query(oracle(FACT_VIEWS, METRICS_SQL, FACTS))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = views.findings(spark, sf_dir)
    return runs.run_metrics(
        _routed(spark, sf_dir),
        findings,
        _calls(spark, sf_dir),
        images=views.images(spark, sf_dir),
        disaster_runs=findings.filter(F.col("run_id") == "run1").select("run_id"),
    )


@query(oracle(FACT_VIEWS, f"""select run, {LEVEL_NAMES}, usd_per_image, seconds_gate, seconds_grade, images, (seconds_gate + seconds_grade) / images::double as seconds_per_image
  from ({METRICS_SQL})""", FACTS))
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compare_runs(run_metrics(spark, sf_dir))


@query(oracle("fx_findings", "select run_id, count(distinct image_id) as graded_images from fx_findings group by run_id"))
def distinct_graded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.finding_counts(views.findings(spark, sf_dir)).select("run_id", "graded_images")


@query(oracle("fx_gate", "select distinct run_id from fx_gate where run_id not like '\\_%' escape '\\'"))
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.list_runs(views.gate(spark, sf_dir))


@query(oracle("fx_images", "select distinct source_dataset from fx_images"))
def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_datasets(views.images(spark, sf_dir))


SCENARIOS = [("heavy only", None, "model_error", 1.0), ("free gate", None, "model_error", 0.3), ("paid gate", "model_click", "model_error", 0.1)]


@query(oracle("fx_images", """select scenario, round(t, 6) as image_tokens, round(gate + pass_through * grade, 6) as usd_per_1000, round(1 - (gate + pass_through * grade) / grade, 9) as saving from (
  select s.scenario, m.t, s.pass_through, ((m.t + 300) * coalesce(g.usd_per_mtok_in, 0) + 40 * coalesce(g.usd_per_mtok_out, 0)) / 1000.0::double as gate,
    ((m.t + 300) * r.usd_per_mtok_in + 400 * r.usd_per_mtok_out) / 1000.0::double as grade
  from scenarios s join prices r on r.model = s.grade_model left join prices g on g.model = s.gate_model
  cross join (select avg(ceil(width / 28.0::double) * ceil(height / 28.0::double)) as t from fx_images) m)""",
  views.price_cte() + ", " + views.sql_values(SCENARIOS, "scenarios", "scenario, gate_model, grade_model, pass_through")))
def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.createDataFrame(SCENARIOS, "scenario string, gate_model string, grade_model string, pass_through double")
    costs = cost_per_thousand(views.images(spark, sf_dir), scenarios, views.prices(spark))
    return costs.select(
        "scenario",
        F.round("image_tokens", 6).alias("image_tokens"),
        F.round("usd_per_1000", 6).alias("usd_per_1000"),
        F.round("saving", 9).alias("saving"),
    )
