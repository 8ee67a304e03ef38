"""Scorer operators, the whole batch run, and the streaming forms, with formula scorers in place of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.image_queries import TILES
from catalog.queue_queries import URGENCY_SQL
from catalog.registry import query
from catalog.views import TODAY, oracle
from faultline.functions.routing import with_routing
from faultline.functions.tiles import explode_targets
from faultline.operators.sampling import select_exemplars, union_all
from faultline.operators.scoring import gate_images, grade_targets, graded_findings
from faultline.operators.validation import standard_for
from faultline.plans.batch import RunSettings, grading_targets, record_reviews, requeue, run_batch, run_disaster
from faultline.session import new_folder
from faultline.sources import readers, writers
from faultline.streaming import live


def formula_gate(image: dict) -> dict:
    """A verdict from the image size. Some sizes fail, as a remote service would."""
    width = int(image["width"])
    if width % 11 == 0:
        raise TimeoutError("no reply")
    confidence = 7.0 if width % 13 == 0 else width % 101 / 100
    return {
        "usable": int(image["height"]) >= 300,
        "damage_present": width % 3 != 0,
        "confidence": confidence,
        "reason": f"{width} wide",
        "model": "formula",
        "input_tokens": width,
        "output_tokens": 10,
        "seconds": 0.25,
    }


def formula_grade(target: dict) -> dict | None:
    """A contract from the tile position. Some answers are missing and some break the contract."""
    step = sum(int(v) for v in target["bbox"]) % 7
    if step == 6:
        return None
    rubric = target["rubric"]
    contract = {
        "defect_type": "formula defect",
        "native_scale": {"standard": target["standard"], "value": rubric[0]["value"], "criteria_matched": [rubric[0]["criterion"]]},
        "unified": {"level": "S9" if step == 5 else f"S{step}", "uncertainty": "+/-1", "flags": []},
        "measurements": {"area_cm2": 100.0 * step, "confidence": 0.75},
        "action": {"code": "schedule", "sla_days": 90, "basis": "row 1"},
        "justification": f"step {step}",
    }
    return {"contract": contract, "model": "formula", "input_tokens": 100, "output_tokens": 50, "seconds": 0.5}


GATE_SQL = """
verdicts as (
  select run_id, image_id, asset_class, width, height, captured_on,
    case when failed then true else height >= 300 end as usable, case when failed then true else width % 3 <> 0 end as damage_present,
    case when failed then 0.0::double else (width % 101)::double / 100 end as confidence, failed
  from (select *, (width % 11 = 0 or width % 13 = 0) as failed from fx_images)
),
routing as (select *, (not usable or damage_present or confidence < 0.7 or asset_class = 'pv_module') as routed from verdicts)
"""


@query(oracle("fx_images", """select image_id, usable, damage_present, confidence, failed as routed_by_default from verdicts""", GATE_SQL))
def batch_score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gate_images(views.images(spark, sf_dir), formula_gate)
    return scored.select(
        "image_id", "usable", "damage_present", "confidence", F.col("reason").endswith("routed by default").alias("routed_by_default")
    )


GRADE_SQL = TILES + """,
graded as (
  select t.*, (x0 + y0 + x1 + y1) % 7 as step, i.asset_class, i.run_id,
    case i.asset_class when 'bridge_element' then 'CS1' when 'steel_coating' then 'Good' when 'pv_module' then 'CoA 1' else 'Undamaged' end as first_value
  from targets t join fx_images i on t.image_id = i.image_id
)
"""


@query(oracle("fx_images", """select concat(image_id, '/', tile) as finding_id, case when step >= 5 then 'U' else concat('S', step) end as level,
  case when step >= 5 then 'U' else first_value end as native_value, case when step >= 5 then 0.0::double else 0.75::double end as confidence,
  case when step >= 5 then 'not_assessable' else 'formula defect' end as defect_type from graded""", GRADE_SQL))
def batch_score_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.images(spark, sf_dir)
    targets = explode_targets(images).withColumn("standard", standard_for(F.col("asset_class")))
    findings = graded_findings(grade_targets(targets, formula_grade).withColumn("usd", F.lit(0.0)))
    return findings.select(
        "finding_id", F.col("unified.level").alias("level"), F.col("native_scale.value").alias("native_value"),
        F.col("measurements.confidence").alias("confidence"), "defect_type",
    )


@query(oracle("fx_images", f"""select r.finding_id, r.level, r.queue_score, row_number() over (order by (r.level <> 'S4'), (r.level = 'U'), coalesce(r.queue_score, 0) desc, r.finding_id) as queue_rank from (
  select f.finding_id, f.level, case f.level when 'S0' then 0.0 when 'S1' then 1.0 when 'S2' then 3.0 when 'S3' then 9.0 when 'S4' then 27.0 end::double * f.urgency as queue_score from (
    select concat(a.image_id, '/', g.tile) as finding_id, case when g.step >= 5 then 'U' else concat('S', g.step) end as level, {URGENCY_SQL} as urgency
    from (select *, captured_on as found_on from routing) a join graded g on g.image_id = a.image_id where a.routed and a.usable
    union all select concat(a.image_id, '/full'), 'U', 1.0::double from routing a where not a.usable) f) r""", GATE_SQL + "," + GRADE_SQL))
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: gate, route, tile, grade, rank. Returns the stored queue."""
    root = new_folder(spark, "run")
    images = views.images(spark, sf_dir).drop("run_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = RunSettings(tiles=True, scorer_tasks=tasks, exports=False)
    exemplars = select_exemplars(images)
    run_batch(images, root, "all", formula_gate, formula_grade, TODAY, settings=settings, exemplars=exemplars)
    queue = readers.load_findings(spark, root)
    return queue.select("finding_id", F.col("unified.level").alias("level"), "queue_score", "queue_rank")


BATCH_SQL = f"""select r.finding_id, r.level, r.queue_score, row_number() over (order by (r.level <> 'S4'), (r.level = 'U'), coalesce(r.queue_score, 0) desc, r.finding_id) as queue_rank, r.usd from (
  select f.finding_id, f.level, f.usd, case f.level when 'S0' then 0.0 when 'S1' then 1.0 when 'S2' then 3.0 when 'S3' then 9.0 when 'S4' then 27.0 end::double * f.urgency as queue_score from (
    select concat(a.image_id, '/', g.tile) as finding_id, case when g.step >= 5 then 'U' else concat('S', g.step) end as level, case when g.step >= 5 then 0.0 else 0.0625 end::double as usd, {URGENCY_SQL} as urgency
    from (select *, captured_on as found_on from routing) a join graded g on g.image_id = a.image_id where a.routed and a.usable
    union all select concat(a.image_id, '/full'), 'U', 0.0::double, 1.0::double from routing a where not a.usable) f) r"""


@query(oracle("fx_images", BATCH_SQL, GATE_SQL + "," + GRADE_SQL))
def batch_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a part of the images, resumed over all of them with prices: every target is graded, and paid for, once."""
    root = new_folder(spark, "run")
    images = views.images(spark, sf_dir).drop("run_id")
    settings = RunSettings(tiles=True, exports=False)
    prices = spark.createDataFrame([("formula", 125.0, 1000.0)], "model string, usd_per_mtok_in double, usd_per_mtok_out double")
    for part in (images.filter(F.col("pos") % 3 == 0), images):
        run_batch(part, root, "all", formula_gate, formula_grade, TODAY, settings=settings, prices=prices)
    queue = readers.load_findings(spark, root)
    return queue.select("finding_id", F.col("unified.level").alias("level"), "queue_score", "queue_rank", "usd")


@query(oracle("fx_images", """select 'surge' as run_id, count(*) as n_findings, count(distinct image_id) as n_images,
  count(*) filter (where value = 'Undamaged') as "Undamaged", count(*) filter (where value <> 'Undamaged') as other_values,
  count(*) filter (where level = 'S0') as "S0", count(*) filter (where level = 'S4') as "S4", count(*) filter (where level = 'U') as "U",
  avg(case when level <> 'U' then 0.75::double end) as mean_confidence, count(*) filter (where level = 'U')::double / count(*)::double as u_rate
  from (select image_id, case when not usable or step >= 5 then 'U' else 'Undamaged' end as value, case when not usable or step >= 5 then 'U' else concat('S', step) end as level
    from (select *, (width + height) % 7 as step from routing) where routed and asset_class = 'building_disaster')""", GATE_SQL))
def disaster_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triage run over the building images of a manifest, whole frames only."""
    root, manifest = new_folder(spark, "run"), new_folder(spark, "manifest")
    writers.write_manifest(views.images(spark, sf_dir), manifest)
    settings = RunSettings(tiles=True, exports=False)
    counts, _ = run_disaster(spark, root, "surge", formula_gate, formula_grade, TODAY, manifest=manifest, settings=settings)
    return counts.select("run_id", "n_findings", "n_images", "Undamaged", "other_values", "S0", "S4", "U", "mean_confidence", "u_rate")


@query(oracle("fx_images", """select finding_id, status, level, row_number() over (order by (level <> 'S4'), (level = 'U'), coalesce(score, 0) desc, finding_id) as queue_rank from (
  select finding_id, status, level, case level when 'S0' then 0.0 when 'S1' then 1.0 when 'S2' then 3.0 when 'S3' then 9.0 when 'S4' then 27.0 end::double * urgency as score from (
    select concat(a.image_id, '/full') as finding_id, case when a.pos % 50 = 0 then 'overridden' else 'pending' end as status,
      case when a.pos % 50 = 0 then 'S4' when a.usable and (a.width + a.height) % 7 < 5 then concat('S', (a.width + a.height) % 7) else 'U' end as level, """ + URGENCY_SQL + """ as urgency
    from (select r.*, r.captured_on as found_on, i.pos from routing r join fx_images i using (image_id)) a where a.routed))""", GATE_SQL))
def batch_reviewed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, decisions on some of its findings, and the queue after only their parts were written anew."""
    root = new_folder(spark, "run")
    images = views.images(spark, sf_dir).drop("run_id")
    run_batch(images, root, "all", formula_gate, formula_grade, TODAY, settings=RunSettings(exports=False))
    found = readers.load_findings(spark, root).select("finding_id", F.regexp_extract("finding_id", "doc_([0-9]+)/", 1).cast("long").alias("id"))
    reviews = found.filter(F.col("id") % 50 == 0).select(
        "id", F.lit("all").alias("run_id"), "finding_id", F.lit("overridden").alias("action"), F.lit(None).cast("string").alias("prior_level"),
        F.lit("S4").alias("new_level"), F.lit("alice").alias("reviewer"), F.lit("2026-09-25 12:00:00").cast("timestamp").alias("reviewed_at"),
    )
    record_reviews(reviews, root)
    queue = requeue(images, root, "all", TODAY, exports=False)
    return queue.select("finding_id", F.col("review.status").alias("status"), F.col("unified.level").alias("level"), "queue_rank")


@query(oracle("fx_images fx_gate", """select concat(i.image_id, '/', t.tile) as finding_id,
  case i.asset_class when 'bridge_element' then 'MBEI-CS' when 'steel_coating' then 'CorrosionCS' when 'pv_module' then 'IEC-62446-3-CoA' else 'FEMA-PDA' end as standard
  from fx_images i join fx_gate g on g.image_id = i.image_id join targets t on t.image_id = i.image_id
  where g.usable and (g.damage_present or g.confidence < 0.7 or i.asset_class = 'pv_module')""", TILES))
def grading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grader would be asked."""
    routed = with_routing(views.gate(spark, sf_dir))
    return grading_targets(views.images(spark, sf_dir), routed, RunSettings(tiles=True)).select("finding_id", "standard")


@query(oracle("fx_images", "select image_id, usable, damage_present, confidence from verdicts", GATE_SQL))
def stream_incremental_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of manifests, the second repeating the first: each image is gated once."""
    root, inbox, checkpoint = (new_folder(spark, name) for name in ("run", "inbox", "checkpoint"))
    images = views.images(spark, sf_dir)
    for name, arrival in (("first", images.filter(F.col("split") == "dev")), ("second", images)):
        writers.write_manifest(arrival, f"{inbox}/{name}")
        stream = live.manifest_stream(spark, f"{inbox}/*")
        live.gate_arrivals(stream, root, "live", formula_gate, checkpoint).awaitTermination()
    return readers.load_gate(spark, root).select("image_id", "usable", "damage_present", "confidence")


def _finished(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over everything that is there. In complete mode the last batch holds the result."""
    folder, checkpoint = new_folder(spark, "stream"), new_folder(spark, "checkpoint")
    batches: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        target = f"{folder}/{number}"
        batch.write.mode("overwrite").parquet(target)
        batches.append(target)

    (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(*batches[-1:])
    numbered = [spark.read.schema(stream.schema).parquet(path).withColumn("batch", F.lit(at)) for at, path in enumerate(batches)]
    return union_all(numbered)


def _as_stream(df: DataFrame, spark: SparkSession) -> DataFrame:
    folder = new_folder(spark, "feed")
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


@query(oracle("fx_reviews", """select run_id, count(*) as total, count(*) filter (where action = 'accepted') as accepted,
  count(*) filter (where action = 'overridden') as overridden, count(*) filter (where action = 'marked_u') as marked_u,
  count(*) filter (where action = 'accepted')::double / count(*)::double as agreement_rate from fx_reviews group by run_id"""))
def stream_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _as_stream(views.reviews(spark, sf_dir), spark)
    return _finished(live.live_agreement(stream), spark, "complete")


def _call_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.calls(spark, sf_dir).withColumn("usd", F.col("input_tokens") / F.lit(1024.0))
    return _as_stream(calls, spark)


@query(oracle("fx_calls", """select run_id, stage, count(*) as calls, sum(input_tokens / 1024.0::double) as usd, round(sum(seconds), 6) as seconds,
  cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from fx_calls group by run_id, stage"""))
def stream_live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    live_rows = _finished(live.live_costs(_call_feed(spark, sf_dir)), spark, "complete")
    return live_rows.withColumn("seconds", F.round("seconds", 6))


@query(oracle("fx_calls", """select run_id, stage, bucket, count(*) as calls, sum(input_tokens / 1024.0::double) as usd, closes <= (select max(ts) - interval '2 hours' from fx_calls) as closed
  from (select *, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as bucket, time_bucket(interval '1 hour', ts) + interval '1 hour' as closes from fx_calls)
  group by run_id, stage, bucket, closes"""))
def stream_cost_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour with its calls, and whether the watermark has passed its end."""
    rows = live.latest_buckets(_finished(live.cost_per_bucket(_call_feed(spark, sf_dir)), spark, "update"))
    return rows.select("run_id", "stage", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("bucket"), "calls", "usd", "closed")
