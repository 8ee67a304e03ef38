"""The work queue, its factors, exports and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import TODAY, oracle
from faultline.functions.priority import urgency
from faultline.functions.routing import with_routing
from faultline.operators.queue import (
    bridge_rows,
    escalated,
    queue_rows,
    rank_queue,
    top_of_queue,
    with_factors,
)
from faultline.operators.review import agreement, apply_reviews, replay, timeline
from faultline.operators.runs import (
    disaster_class_counts,
    disaster_counts,
    level_counts,
    levels_long,
    ranked_list,
    value_counts,
    value_text,
)
from faultline.operators.validation import (
    BUILT_IN,
    criteria_audit,
    crosswalk,
    finding_rules,
    rubric_table,
    with_version,
    with_violations,
)
from faultline.plans.report import run_report
from faultline.session import new_folder
from faultline.sources import readers

URGENCY_SQL = f"""case when a.found_on is null or not regexp_full_match(a.found_on, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
  or try_cast(a.found_on as date) is null then 1.0::double
  else least(2.0::double, 1.0::double + greatest(0, date_diff('day', try_cast(a.found_on as date), date '{TODAY}'))::double / 30.0::double) end"""

FACTORS = f"""
factors as (
  select f.*, case f.level when 'S0' then 0.0 when 'S1' then 1.0 when 'S2' then 3.0 when 'S3' then 9.0 when 'S4' then 27.0 end::double as severity_weight,
    least(3.0, greatest(1.0, coalesce(a.criticality, 1.0)))::double as crit,
    case when f.asset_class = 'pv_module' then coalesce(a.production_loss_factor, 1.0)
         when f.asset_class in ('bridge_element', 'steel_coating') then case when f.flag in ('load_posting_review', 'section_loss') then 2.0 else 1.0 end
         when f.asset_class = 'building_disaster' then coalesce(a.occupancy_factor, 1.0) else 1.0 end::double as consequence,
    {URGENCY_SQL} as urgency
  from fx_findings f left join fx_assets a on f.image_id = a.image_id
),
scored as (select *, severity_weight * crit * consequence * urgency as queue_score from factors),
ranked as (
  select *, row_number() over (partition by run_id order by (level <> 'S4'), (level = 'U'), coalesce(queue_score, 0) desc, finding_id) as queue_rank,
    case when level = 'S4' then 'escalate' else action_code end as effective_action,
    case when level = 'S4' then 0 else sla_days end as effective_sla
  from scored
)
"""
QUEUE_VIEWS = "fx_findings fx_assets"


# What ranking itself reads: a caller that needs no more of a finding sorts and writes no more of it.
RANKED_BY = ["run_id", "finding_id", "asset_class", "unified", "action", "evidence"]


def _queue(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    return rank_queue(views.findings(spark, sf_dir), views.assets(spark, sf_dir), TODAY, in_order=in_order)


@query(oracle(QUEUE_VIEWS, """select run_id, queue_rank, queue_score, finding_id, image_id, level, effective_action as action from ranked""", FACTORS))
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = views.findings(spark, sf_dir).select(*RANKED_BY)
    return rank_queue(findings, views.assets(spark, sf_dir), TODAY).select(
        "run_id", "queue_rank", "queue_score", "finding_id", "image_id", F.col("unified.level").alias("level"), F.col("action.code").alias("action")
    )


@query(oracle(QUEUE_VIEWS, """select run_id, queue_rank, queue_score, finding_id, level, effective_action as action from ranked where queue_rank <= 10""", FACTORS))
def queue_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_of_queue(views.findings(spark, sf_dir), views.assets(spark, sf_dir), TODAY, 10)
    return top.select(
        "run_id", F.col("queue_rank").cast("bigint").alias("queue_rank"), "queue_score", "finding_id",
        F.col("unified.level").alias("level"), F.col("action.code").alias("action"),
    )


@query(oracle(QUEUE_VIEWS, """select run_id, finding_id, severity_weight, crit as criticality, consequence, urgency, queue_score from scored""", FACTORS))
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_factors(views.findings(spark, sf_dir), views.assets(spark, sf_dir), TODAY)
    return scored.select("run_id", "finding_id", "severity_weight", "criticality", "consequence", "urgency", "queue_score")


@query(oracle("fx_customer_assets", f"select a.image_id, a.found_on, {URGENCY_SQL} as urgency from fx_customer_assets a"))
def urgency_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    register = views.view(spark, sf_dir, "fx_customer_assets")
    return register.select("image_id", "found_on", urgency(F.col("found_on"), F.lit(TODAY).cast("date")).alias("urgency"))


@query(oracle("fx_findings", """select run_id, finding_id, case when level = 'S4' then 'escalate' else action_code end as action,
  case when level = 'S4' then '0' else coalesce(cast(sla_days as varchar), 'none') end as sla from fx_findings"""))
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalated(views.findings(spark, sf_dir)).select(
        "run_id", "finding_id", F.col("action.code").alias("action"),
        F.coalesce(F.col("action.sla_days").cast("string"), F.lit("none")).alias("sla"),
    )


@query(oracle(QUEUE_VIEWS, """select run_id, queue_rank, queue_score, finding_id, image_id, asset_class, defect_type, standard, native_value,
  level as unified_level, '+/-1' as uncertainty, flag as flags, effective_action as action_code, coalesce(cast(effective_sla as varchar), '') as sla_days,
  concat('row for ', native_value) as action_basis, confidence, criterion as criteria_matched, concat('graded ', native_value) as justification,
  review_status, null::varchar as reviewer, null::varchar as prior_level, concat(x0, ',', y0, ',', x0 + 100, ',', y0 + 80) as bbox, tile, model, round(usd, 6) as usd, round(seconds, 3) as seconds from ranked""", FACTORS))
def queue_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue_rows(_queue(spark, sf_dir))
    return rows.withColumn("sla_days", F.coalesce(F.col("sla_days").cast("string"), F.lit("")))


@query(oracle("fx_findings", r"""select run_id, image_id, finding_id,
  case when defect_type like '% (%' then regexp_replace(list_last(string_split(defect_type, ' (')), '\)+$', '') else '' end as element,
  defect_type as defect, standard, native_value as condition_state, coalesce(cast(round(area_cm2 / 10000, 4) as double), -1) as quantity,
  case when area_cm2 is null then '' else 'm2' end as unit, level as unified_level, flag as flags, criterion as criteria_matched, confidence, review_status,
  null::varchar as reviewer, null::varchar as prior_level, concat('graded ', native_value) as justification
  from fx_findings where asset_class = 'bridge_element'"""))
def bridge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge_rows(views.findings(spark, sf_dir))
    return rows.withColumn("quantity", F.coalesce("quantity", F.lit(-1.0)))


@query(oracle(QUEUE_VIEWS, """select run_id, queue_rank as rank, finding_id, image_id, native_value, level, confidence, effective_action as action,
  effective_sla as sla_days, concat('graded ', native_value) as justification from ranked""", FACTORS))
def triage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_list(_queue(spark, sf_dir))


@query(oracle(QUEUE_VIEWS, """select run_id, queue_rank as rank, finding_id, image_id, level, native_value, standard, effective_action as action,
  effective_sla as sla_days, queue_score as score from ranked where queue_rank <= 10""", FACTORS))
def run_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top list of each run's report."""
    calls, gate = views.calls(spark, sf_dir).withColumn("usd", F.lit(0.0)), with_routing(views.gate(spark, sf_dir))
    return run_report(gate, _queue(spark, sf_dir), calls)["top"]


LEVEL_SQL = ", ".join(f"count(*) filter (where level = '{lv}') as \"{lv}\"" for lv in ("S0", "S1", "S2", "S3", "S4", "U"))
CLASS_SQL = ", ".join(
    f"count(*) filter (where native_value = '{v}') as \"{v}\""
    for v in ("Undamaged", "Affected", "Minor", "Major", "Destroyed", "Inaccessible")
)


@query(oracle("fx_findings", f"""select run_id, count(*) as n_findings, count(distinct image_id) as n_images, {CLASS_SQL},
  count(*) filter (where native_value not in ('Undamaged', 'Affected', 'Minor', 'Major', 'Destroyed', 'Inaccessible')) as other_values, {LEVEL_SQL},
  round(avg(case when level <> 'U' then confidence end), 9) as mean_confidence,
  count(*) filter (where level = 'U')::double / count(*)::double as u_rate
  from fx_findings where asset_class = 'building_disaster' group by run_id"""))
def surge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    disaster = views.findings(spark, sf_dir).filter(F.col("asset_class") == "building_disaster")
    return disaster_counts(disaster).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(oracle("fx_findings", """select d.run_id, d.native_value, coalesce(c.n, 0) as n from domain_values d left join counted c
  on d.run_id = c.run_id and d.native_value = c.native_value
  union all select run_id, native_value, n from counted where native_value not in (select v from known)""", """
counted as (select run_id, native_value, count(*) as n from fx_findings group by run_id, native_value),
known(v) as (values ('Undamaged'), ('Affected'), ('Minor'), ('Major'), ('Destroyed'), ('Inaccessible')),
domain_values as (select distinct run_id, v as native_value from counted, known)"""))
def surge_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disaster_class_counts(views.findings(spark, sf_dir))


@query(oracle("fx_findings", f"select run_id, {LEVEL_SQL} from fx_findings group by run_id"))
def level_counts_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(views.findings(spark, sf_dir))


@query(oracle("fx_findings", """select r.run_id, l.level, count(f.finding_id) as "count" from (select distinct run_id from fx_findings) r
  cross join levels l left join fx_findings f on f.run_id = r.run_id and f.level = l.level group by r.run_id, l.level""",
  "levels(level) as (values ('S0'), ('S1'), ('S2'), ('S3'), ('S4'), ('U'))"))
def level_counts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels_long(level_counts(views.findings(spark, sf_dir)))


@query(oracle("fx_findings", """select run_id, native_value, count(*) as n from fx_findings group by run_id, native_value"""))
def native_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(views.findings(spark, sf_dir))


@query(oracle("fx_findings", """select run_id, string_agg(native_value || '=' || n, ';' order by native_value) as native_values
  from (select run_id, native_value, count(*) as n from fx_findings group by run_id, native_value) group by run_id"""))
def native_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_text(value_counts(views.findings(spark, sf_dir)), "native_value", "native_values")


@query(oracle("fx_reviews", """select run_id, count(*) as total, count(*) filter (where action = 'accepted') as accepted,
  count(*) filter (where action = 'overridden') as overridden, count(*) filter (where action = 'marked_u') as marked_u,
  count(*) filter (where action = 'accepted')::double / count(*)::double as agreement_rate from fx_reviews group by run_id"""))
def review_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement(views.reviews(spark, sf_dir))


@query(oracle("fx_reviews", """select run_id, id, finding_id, action, reviewer, row_number() over w as n,
  cast(sum(case when action = 'accepted' then 1 else 0 end) over w as bigint) as accepted,
  cast(sum(case when action = 'accepted' then 1 else 0 end) over w as double) / row_number() over w as agreement_rate
  from fx_reviews window w as (partition by run_id order by id rows unbounded preceding)"""))
def review_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(views.reviews(spark, sf_dir)).select(
        "run_id", "id", "finding_id", "action", "reviewer", "n", "accepted", "agreement_rate"
    )


@query(oracle("fx_reviews", """select id, row_number() over w as n,
  cast(sum(case when action = 'accepted' then 1 else 0 end) over w as double) / row_number() over w as agreement_rate
  from fx_reviews window w as (order by id rows unbounded preceding)"""))
def review_timeline_all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(views.reviews(spark, sf_dir), by=()).select("id", "n", "agreement_rate")


REPLAY = """
setting as (
  select r.*, case r.action when 'overridden' then r.new_level when 'marked_u' then 'U' end as set_level, f.level as model_level
  from fx_reviews r left join fx_findings f on r.run_id = f.run_id and r.finding_id = f.finding_id
),
replayed as (
  select *, coalesce(last_value(set_level ignore nulls) over (partition by run_id, finding_id order by id rows between unbounded preceding and 1 preceding), model_level) as prior
  from setting
),
last_state as (
  select *, coalesce(set_level, prior) as level_after, row_number() over (partition by run_id, finding_id order by id desc) as back from replayed
)
"""


@query(oracle("fx_reviews fx_findings", """select run_id, finding_id, id, action, prior as prior_level, coalesce(set_level, prior) as new_level
  from replayed""", REPLAY))
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = views.findings(spark, sf_dir).select("run_id", "finding_id", F.col("unified.level").alias("level"))
    return replay(views.reviews(spark, sf_dir), graded).select(
        "run_id", "finding_id", "id", "action", "prior_level", "new_level"
    )


@query(oracle("fx_reviews fx_findings", """select f.run_id, f.finding_id, coalesce(s.level_after, f.level) as level, coalesce(s.action, f.review_status) as status,
  s.reviewer as reviewer, s.prior as prior_level from fx_findings f left join last_state s on f.run_id = s.run_id and f.finding_id = s.finding_id and s.back = 1""", REPLAY))
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = apply_reviews(views.findings(spark, sf_dir), views.reviews(spark, sf_dir))
    return reviewed.select(
        "run_id", "finding_id", F.col("unified.level").alias("level"), F.col("review.status").alias("status"),
        F.col("review.reviewer").alias("reviewer"), F.col("review.prior_level").alias("prior_level"),
    )


@query(oracle(
    "fx_findings fx_assets fx_reviews",
    """select run_id, queue_rank, queue_score, finding_id, level, effective_action as action from ranked""",
    REPLAY
    + ", reviewed as (select f.* exclude (level), coalesce(s.level_after, f.level) as level from fx_findings f left join last_state s on f.run_id = s.run_id and f.finding_id = s.finding_id and s.back = 1),"
    + FACTORS.replace("from fx_findings f", "from reviewed f"),
))
def requeue_after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = views.findings(spark, sf_dir).select(*RANKED_BY, "review")
    reviewed = apply_reviews(findings, views.reviews(spark, sf_dir)).drop("review")
    return rank_queue(reviewed, views.assets(spark, sf_dir), TODAY).select(
        "run_id", "queue_rank", "queue_score", "finding_id", F.col("unified.level").alias("level"), F.col("action.code").alias("action")
    )


@query(oracle("fx_findings", """select run_id, finding_id, concat_ws(',',
  case when asset_class not in ('bridge_element', 'steel_coating', 'pv_module', 'building_disaster') then 'asset_class' end,
  case when standard not in ('NBI-0-9', 'MBEI-CS', 'ISO-4628-3', 'IEC-62446-3-CoA', 'FEMA-PDA', 'CorrosionCS') then 'standard' end,
  case when level not in ('S0', 'S1', 'S2', 'S3', 'S4', 'U') then 'level' end,
  case when not (confidence between 0 and 1) then 'confidence' end,
  case when action_code not in ('record', 'monitor', 'schedule', 'prioritize', 'escalate') then 'action_code' end) as violations from fx_findings"""))
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_violations(views.findings(spark, sf_dir), finding_rules())
    return checked.select("run_id", "finding_id", F.array_join("violations", ",").alias("violations"))


VERSIONS = views.rubric_cte() + """,
versions as (
  select 'built-in' as version, * from rubric
  union all select 'later', standard, subject, value, criterion, case when level = 'S1' then 'S2' else level end, case when action = 'monitor' then 'schedule' else action end, flag
  from rubric where standard = 'CorrosionCS' and value <> 'Poor'
),
graded as (select *, case when run_id = 'run0' or standard <> 'CorrosionCS' then 'built-in' else 'later' end as version from fx_findings)
"""


def _two_rubrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings graded by two versions of a rubric, and the later version as it is read back from a rubric file."""
    folder = new_folder(spark, "rubric")
    built_in = rubric_table(spark).filter((F.col("standard") == "CorrosionCS") & (F.col("value") != "Poor"))
    edited = built_in.withColumns(
        {
            "unified": F.when(F.col("level") == "S1", "S2").otherwise(F.col("level")),
            "action": F.when(F.col("action") == "monitor", "schedule").otherwise(F.col("action")),
        }
    )
    row = F.struct("value", "criterion", "unified", "action", F.col("subject").alias("defect"), "flag")
    edited.groupBy("standard").agg(F.collect_set("value").alias("allowed_values"), F.collect_list(row).alias("rows")).coalesce(1).write.json(folder)
    later = with_version(readers.read_rubrics(spark, folder))
    version = later.select(F.max("version").alias("_later"))  # one row
    findings = views.findings(spark, sf_dir).join(F.broadcast(version))
    first = (F.col("run_id") == "run0") | (F.col("native_scale.standard") != "CorrosionCS")
    return findings.withColumn("rubric_version", F.when(first, BUILT_IN).otherwise(F.col("_later"))).drop("_later"), later


@query(oracle("fx_findings", """select f.run_id, f.finding_id,
  f.standard not in (select standard from rubric) as no_rubric,
  cast(case when f.standard in (select standard from rubric) and not exists (select 1 from versions v where v.version = f.version and v.standard = f.standard and v.criterion = f.criterion) then 1 else 0 end as int) as unknown_criteria,
  coalesce(exists (select 1 from versions v where v.version = f.version and v.standard = f.standard and v.value = f.native_value) or f.level = 'U', false) as value_allowed,
  coalesce(exists (select 1 from versions v where v.version = f.version and v.standard = f.standard and v.value = f.native_value and v.criterion = f.criterion and v.level = f.level)
    or (f.level = 'S4' and f.native_value in ('CS4', 'Severe')) or f.level = 'U', false) as level_supported from graded f""", VERSIONS))
def rubric_version_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, later = _two_rubrics(spark, sf_dir)
    return criteria_audit(findings, later)


@query(oracle("fx_findings", """select f.run_id, f.finding_id, f.version = 'later' as later, v.level as rubric_level, v.action as rubric_action, v.flag as rubric_flag
  from graded f left join versions v on v.version = f.version and v.standard = f.standard and v.value = f.native_value
  and (v.subject is null or v.subject = 'any defect' or v.subject = f.defect_type)""", VERSIONS))
def rubric_version_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, rubric = _two_rubrics(spark, sf_dir)
    found = crosswalk(findings, rubric)
    return found.select("run_id", "finding_id", (F.col("rubric_version") != BUILT_IN).alias("later"), "rubric_level", "rubric_action", "rubric_flag")


AUDIT_CTES = views.rubric_cte() + """,
known as (select distinct standard from rubric),
allowed as (select distinct standard, value from rubric),
quoted as (select distinct standard, criterion from rubric)
"""


@query(oracle("fx_findings", """select f.run_id, f.finding_id, (k.standard is null) as no_rubric,
  cast(case when k.standard is null then 0 when q.criterion is null then 1 else 0 end as int) as unknown_criteria,
  case when k.standard is null then f.level = 'U' else (a.value is not null or f.level = 'U') end as value_allowed,
  (exists (select 1 from rubric r where r.standard = f.standard and r.value = f.native_value and r.criterion = f.criterion and r.level = f.level)
    or (f.level = 'S4' and f.native_value in ('CS4', 'Severe')) or f.level = 'U') as level_supported
  from fx_findings f left join known k on k.standard = f.standard
  left join allowed a on a.standard = f.standard and a.value = f.native_value
  left join quoted q on q.standard = f.standard and q.criterion = f.criterion""", AUDIT_CTES))
def rubric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria_audit(views.findings(spark, sf_dir))


@query(oracle("fx_findings", """select f.run_id, f.finding_id, r.level as rubric_level, r.action as rubric_action, r.flag as rubric_flag
  from fx_findings f left join rubric r on r.standard = f.standard and r.value = f.native_value
  and (r.subject is null or r.subject = 'any defect' or r.subject = f.defect_type)""", views.rubric_cte()))
def rubric_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk(views.findings(spark, sf_dir)).select("run_id", "finding_id", "rubric_level", "rubric_action", "rubric_flag")
