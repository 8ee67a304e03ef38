"""Routing, gate quality, grading quality and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import oracle
from faultline.functions.columns import percent_text
from faultline.functions.grades import measured_value, truth_ordinal
from faultline.functions.routing import caption, needs_grading, pass_through_verdict, with_routing
from faultline.operators import agreement as humans
from faultline.operators import bootstrap, evaluation
from faultline.operators.runs import worst_levels

ROUTED = """
routed_gate as (
  select g.*, (not usable or damage_present or confidence < 0.7 or asset_class = 'pv_module') as routed,
    case when usable and not damage_present and confidence >= 0.7 and asset_class = 'pv_module'
         then concat(reason, ' [forced: asset class ', asset_class, ']') else reason end as routed_reason
  from fx_gate g
)
"""

CELLS = ROUTED + """,
scored as (
  select g.run_id, g.image_id, g.usable, g.routed, i.asset_class, i.source_dataset, i.damage_present as truth_damage, i.truth, i.grade_native, i.grade_source, i.source_class
  from routed_gate g join fx_images i on g.image_id = i.image_id
),
by_dataset as (
  select run_id, source_dataset, count(*) filter (where truth_damage and routed) as tp, count(*) filter (where not truth_damage and routed) as fp,
    count(*) filter (where truth_damage and not routed) as fn, count(*) filter (where not truth_damage and not routed) as tn,
    count(*) filter (where truth_damage is null) as unlabelled, count(*) filter (where routed) as routed, count(*) filter (where not usable) as unusable
  from scored group by run_id, source_dataset
),
overall as (
  select run_id, count(*) filter (where truth_damage and routed) as tp, count(*) filter (where not truth_damage and routed) as fp,
    count(*) filter (where truth_damage and not routed) as fn, count(*) filter (where not truth_damage and not routed) as tn,
    count(*) filter (where truth_damage is null) as unlabelled, count(*) filter (where routed) as routed, count(*) filter (where not usable) as unusable
  from scored group by run_id
)
"""

RATES = """tp, fp, fn, tn, unlabelled, routed, unusable, tp + fp + fn + tn as n,
  tp::double / nullif(tp + fp, 0)::double as "precision", tp::double / nullif(tp + fn, 0)::double as recall,
  coalesce(2.0::double * coalesce(tp::double / nullif(tp + fp, 0)::double, 0) * coalesce(tp::double / nullif(tp + fn, 0)::double, 0)
    / nullif(coalesce(tp::double / nullif(tp + fp, 0)::double, 0) + coalesce(tp::double / nullif(tp + fn, 0)::double, 0), 0), 0) as f1"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_routing(views.gate(spark, sf_dir))


@query(oracle("fx_gate", "select run_id, image_id, (not usable or damage_present or confidence < 0.7) as routed from fx_gate"))
def route_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = needs_grading(F.col("usable"), F.col("damage_present"), F.col("confidence"))
    return views.gate(spark, sf_dir).select("run_id", "image_id", routed.alias("routed"))


@query(oracle("fx_gate", "select run_id, image_id, routed, routed_reason as reason from routed_gate", ROUTED))
def forced_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("run_id", "image_id", "routed", "reason")


@query(oracle("fx_images", "select image_id, true as usable, true as damage_present, 1.0::double as confidence, 'gate disabled' as reason from fx_images"))
def disabled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = pass_through_verdict(views.images(spark, sf_dir))
    return verdicts.select("image_id", "usable", "damage_present", "confidence", "reason")


@query(oracle("fx_gate", """select run_id, image_id, concat('gate: ', case when not usable then 'unusable' when damage_present then 'damage' else 'clean' end, ' ',
  printf('%.2f', confidence), ' · ', case when routed then 'routed' else 'not routed' end,
  case when contains(routed_reason, '[forced:') then ' (forced)' else '' end) as caption from routed_gate""", ROUTED))
def gate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(name) for name in ("usable", "damage_present", "confidence", "routed", "reason")]
    return _routed(spark, sf_dir).select("run_id", "image_id", caption(*parts).alias("caption"))


GATE_VIEWS = "fx_images fx_gate"


@query(oracle(GATE_VIEWS, f"select run_id, {RATES}, routed::double / (tp + fp + fn + tn + unlabelled)::double as routing_fraction from (select run_id, cast(tp as bigint) as tp, fp, fn, tn, unlabelled, routed, unusable from overall)", CELLS))
def gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate_overall(evaluation.gate_by_dataset(views.images(spark, sf_dir), _routed(spark, sf_dir)))


@query(oracle(GATE_VIEWS, f"select run_id, source_dataset, {RATES} from by_dataset", CELLS))
def gate_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate_by_dataset(views.images(spark, sf_dir), _routed(spark, sf_dir))


@query(oracle(GATE_VIEWS, """select run_id, tp, fp, fn, tn, coalesce(tp::double / nullif(tp + fp, 0)::double, 0) as "precision", coalesce(tp::double / nullif(tp + fn, 0)::double, 0) as recall from (
  select run_id, count(*) filter (where coalesce(truth_damage, false) and routed) as tp, count(*) filter (where not coalesce(truth_damage, false) and routed) as fp,
    count(*) filter (where coalesce(truth_damage, false) and not routed) as fn, count(*) filter (where not coalesce(truth_damage, false) and not routed) as tn
  from scored group by run_id)""", CELLS))
def gate_confusion_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_dataset = evaluation.gate_by_dataset(views.images(spark, sf_dir), _routed(spark, sf_dir), strict_zero=True)
    return evaluation.gate_overall(by_dataset, strict_zero=True).select(
        "run_id", "tp", "fp", "fn", "tn", "precision", "recall"
    )


@query(oracle(GATE_VIEWS, "select run_id, image_id, source_dataset from scored where truth_damage and not routed", CELLS))
def gate_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate_misses(views.images(spark, sf_dir), _routed(spark, sf_dir))


@query(oracle(GATE_VIEWS, """select run_id, string_agg(image_id, ', ' order by image_id) as items from (
  select run_id, image_id, row_number() over (partition by run_id order by image_id) as rn from scored where truth_damage and not routed) where rn <= 20 group by run_id""", CELLS))
def gate_misses_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = evaluation.gate_misses(views.images(spark, sf_dir), _routed(spark, sf_dir))
    return evaluation.capped_list(misses, ["run_id"], "image_id", 20)


@query(oracle(GATE_VIEWS, """select run_id, coalesce(printf('%.1f%%', 100.0::double * (tp::double / nullif(tp + fn, 0)::double)), 'n/a') as recall_text,
  coalesce(printf('%.1f%%', 100.0::double * (tp::double / nullif(tp + fp, 0)::double)), 'n/a') as precision_text from overall""", CELLS))
def gate_rates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = evaluation.gate_overall(evaluation.gate_by_dataset(views.images(spark, sf_dir), _routed(spark, sf_dir)))
    return overall.select(
        "run_id", percent_text(F.col("recall")).alias("recall_text"), percent_text(F.col("precision")).alias("precision_text")
    )


GRADING = CELLS + """,
truths as (
  select run_id, image_id, asset_class, routed, case asset_class
      when 'steel_coating' then case grade_native when 'Good' then 0 when 'Fair' then 1 when 'Poor' then 2 when 'Severe' then 3 end
      when 'pv_module' then case grade_native when 'CoA 1' then 0 when 'CoA 2' then 1 when 'CoA 3' then 2 end
      when 'building_disaster' then case source_class when 'Intact' then 0 when 'Damaged' then 1 when 'Collapsed' then 2 end
      when 'bridge_element' then case when grade_source = 'team-graded' then try_cast(grade_native as int) - 1 end end as truth
  from scored
),
predicted as (
  select run_id, image_id, max(case asset_class
      when 'steel_coating' then case native_value when 'Good' then 0 when 'Fair' then 1 when 'Poor' then 2 when 'Severe' then 3 end
      when 'pv_module' then case native_value when 'CoA 1' then 0 when 'CoA 2' then 1 when 'CoA 3' then 2 end
      when 'building_disaster' then case native_value when 'Undamaged' then 0 when 'Affected' then 0 when 'Minor' then 1 when 'Major' then 1 when 'Destroyed' then 2 end
      when 'bridge_element' then case when standard = 'MBEI-CS' then try_cast(regexp_replace(native_value, '[^0-9]', '', 'g') as int) - 1 end end) as pred
  from fx_preds where level <> 'U' group by run_id, image_id
),
pairs as (
  select t.run_id, t.image_id, t.asset_class, t.truth, p.pred from truths t left join predicted p on t.run_id = p.run_id and t.image_id = p.image_id
  where t.routed and t.truth is not null
),
cells as (select run_id, asset_class, truth, pred, count(*) as n from pairs group by all),
scale(asset_class, k) as (values ('bridge_element', 4), ('steel_coating', 4), ('pv_module', 3), ('building_disaster', 3)),
names(asset_class, ord, grade) as (values ('bridge_element', 0, 'CS1'), ('bridge_element', 1, 'CS2'), ('bridge_element', 2, 'CS3'), ('bridge_element', 3, 'CS4'),
  ('steel_coating', 0, 'Good'), ('steel_coating', 1, 'Fair'), ('steel_coating', 2, 'Poor'), ('steel_coating', 3, 'Severe'),
  ('pv_module', 0, 'CoA 1'), ('pv_module', 1, 'CoA 2'), ('pv_module', 2, 'CoA 3'),
  ('building_disaster', 0, 'Intact'), ('building_disaster', 1, 'Damaged'), ('building_disaster', 2, 'Collapsed')),
dense as (
  select g.run_id, g.asset_class, t.ord as truth, p.ord as pred, t.grade as truth_grade, p.grade as pred_grade, coalesce(c.n, 0) as n
  from (select distinct run_id, asset_class from cells) g join names t on t.asset_class = g.asset_class join names p on p.asset_class = g.asset_class
  left join cells c on c.run_id = g.run_id and c.asset_class = g.asset_class and c.truth = t.ord and c.pred = p.ord
)
"""
GRADING_VIEWS = "fx_images fx_gate fx_preds"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grading_pairs(views.images(spark, sf_dir), _routed(spark, sf_dir), views.preds(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grading_cells(_pairs(spark, sf_dir))


@query(oracle("fx_preds", """select run_id, image_id, coalesce(max(case when level <> 'U' then level end), 'U') as level from fx_preds group by run_id, image_id"""))
def worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_levels(views.preds(spark, sf_dir))


@query(oracle(GRADING_VIEWS, "select image_id, asset_class, coalesce(truth, -1) as truth from (select distinct image_id, asset_class, truth from truths)", GRADING))
def truth_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = views.images(spark, sf_dir).join(views.gate(spark, sf_dir).select("image_id"), "image_id", "left_semi")
    truth = truth_ordinal(F.col("asset_class"), F.col("labels"))
    return gated.select("image_id", "asset_class", F.coalesce(truth, F.lit(-1)).alias("truth"))


@query(oracle(GRADING_VIEWS, "select p.run_id, p.image_id, i.asset_class, coalesce(p.pred, -1) as pred from predicted p join fx_images i on i.image_id = p.image_id", GRADING))
def predicted_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = evaluation.predicted_ordinals(views.images(spark, sf_dir), views.preds(spark, sf_dir))
    return predicted.withColumn("pred", F.coalesce("pred", F.lit(-1)))


@query(oracle(GRADING_VIEWS, "select run_id, image_id, asset_class, truth, coalesce(pred, -1) as pred from pairs", GRADING))
def truth_and_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("pred", F.coalesce("pred", F.lit(-1)))


@query(oracle(GRADING_VIEWS, """select p.run_id, p.image_id, p.asset_class, t.grade as truth, q.grade as pred from pairs p
  join names t on t.asset_class = p.asset_class and t.ord = p.truth join names q on q.asset_class = p.asset_class and q.ord = p.pred""", GRADING))
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.labelled_pairs(_pairs(spark, sf_dir))


@query(oracle(GRADING_VIEWS, "select run_id, asset_class, image_id from pairs where pred is null", GRADING))
def unassessed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unassessed_images(_pairs(spark, sf_dir))


@query(oracle(GRADING_VIEWS, "select run_id, asset_class, truth_grade, pred_grade, truth, pred, n from dense", GRADING))
def grading_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.matrix_long(_cells(spark, sf_dir))


@query(oracle(GRADING_VIEWS, """select run_id, asset_class, truth, cast(sum(case when pred = 0 then n else 0 end) as bigint) as pred_0,
  cast(sum(case when pred = 1 then n else 0 end) as bigint) as pred_1, cast(sum(case when pred = 2 then n else 0 end) as bigint) as pred_2,
  cast(sum(case when pred = 3 then n else 0 end) as bigint) as pred_3 from dense group by run_id, asset_class, truth""", GRADING))
def grading_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.matrix_dense(_cells(spark, sf_dir))


@query(oracle(GRADING_VIEWS, """select run_id, asset_class, string_agg(concat('truth', truth, '->pred', pred, ': ', n), ', ' order by truth, pred) as confusion
  from cells where pred is not null group by run_id, asset_class""", GRADING))
def confusion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_text(_cells(spark, sf_dir))


@query(oracle(GRADING_VIEWS, """select run_id, asset_class, cast(sum(n) as bigint) as n_routed_with_truth, cast(coalesce(sum(n) filter (where pred is not null), 0) as bigint) as n_assessed,
  1.0::double - coalesce(sum(n) filter (where pred is not null), 0)::double / sum(n)::double as u_rate,
  coalesce(sum(n) filter (where pred = truth), 0)::double / nullif(sum(n) filter (where pred is not null), 0)::double as exact_match,
  coalesce(sum(n) filter (where abs(pred - truth) <= 1), 0)::double / nullif(sum(n) filter (where pred is not null), 0)::double as within_one_grade,
  sum(n * abs(truth - pred))::double / nullif(sum(n) filter (where pred is not null), 0)::double as mae,
  cast(coalesce(sum(n) filter (where pred > truth), 0) as bigint) as over_graded, cast(coalesce(sum(n) filter (where pred < truth), 0) as bigint) as under_graded
  from cells group by run_id, asset_class""", GRADING))
def grading_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grading_rates(_cells(spark, sf_dir)).drop("qwk")


@query(oracle(GRADING_VIEWS, """select o.run_id, o.asset_class, round(case when sum(o.w * r.n * c.n) = 0 then 0.0::double
    else 1.0::double - sum(o.w * o.n)::double / (sum(o.w * r.n * c.n)::double / any_value(t.n)::double) end, 9) as qwk
  from (select *, (truth - pred) * (truth - pred) as w from dense) o
  join (select run_id, asset_class, truth, sum(n) as n from dense group by all) r on r.run_id = o.run_id and r.asset_class = o.asset_class and r.truth = o.truth
  join (select run_id, asset_class, pred, sum(n) as n from dense group by all) c on c.run_id = o.run_id and c.asset_class = o.asset_class and c.pred = o.pred
  join (select run_id, asset_class, sum(n) as n from dense group by all) t on t.run_id = o.run_id and t.asset_class = o.asset_class
  group by o.run_id, o.asset_class""", GRADING))
def qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluation.grading_rates(_cells(spark, sf_dir))
    return rates.select("run_id", "asset_class", F.round("qwk", 9).alias("qwk"))


def draws_sql(cells: str, keys: str, categories: str, result: str, width: int) -> str:
    """Counts of every cell and resample: conditional binomials down a tree of the given width, by inversion at numbered hashes."""
    text = ", '/', ".join(["'0'", *keys.split(", "), "start", "'{width}'", "b"])
    parts = [f"""{result}_places as (select *, row_number() over (partition by {keys} order by {categories}) - 1 as pos from {cells})""",
             f"""{result}_came{width} as (
  select {keys}, b, 0 as start, total as came from (select {keys}, cast(sum(n) as bigint) as total from {cells} group by all), (select unnest(generate_series(0, 999)) as b)
)"""]
    while width > 1:
        half = width // 2
        uniform = f"(('0x' || substr(md5(concat({text.format(width=width)})), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double"
        parts += [f"""{result}_share{width} as (
  select {keys}, pos // {width} * {width} as start, cast(sum(n) as bigint) as whole, cast(coalesce(sum(n) filter (where pos % {width} < {half}), 0) as bigint) as lefts from {result}_places group by all
)""", f"""{result}_range{width} as (
  select *, greatest(0, floor(came * p - 10 * sqrt(came * p * (1 - p)) - 20))::bigint as lo, least(came, ceil(came * p + 10 * sqrt(came * p * (1 - p)) + 30))::bigint as hi
  from (select distinct {keys}, start, came, lefts::double / whole::double as p from {result}_came{width} join {result}_share{width} using ({keys}, start) where lefts > 0 and lefts < whole)
)""", f"""{result}_upto{width} as (
  select {keys}, start, came, hi, k, sum(exp(lgamma(came + 1) - lgamma(k + 1) - lgamma(came - k + 1) + k * ln(p) + (came - k) * ln(1 - p))) over (partition by {keys}, start, came order by k rows unbounded preceding) as upto
  from (select *, unnest(generate_series(lo, hi)) as k from {result}_range{width})
)""", f"""{result}_drawn{width} as (
  select {keys}, b, start, came, coalesce(min(k) filter (where upto >= u), max(hi)) as drawn
  from (select *, {uniform} as u from {result}_came{width}) join {result}_upto{width} using ({keys}, start, came) group by {keys}, b, start, came
)""", f"""{result}_split{width} as (
  select {keys}, b, start, c.came, case when s.lefts = 0 then 0 when s.lefts = s.whole then c.came else d.drawn end as goes
  from {result}_came{width} c join {result}_share{width} s using ({keys}, start) left join {result}_drawn{width} d using ({keys}, b, start)
)""", f"""{result}_came{half} as (
  select {keys}, b, start, goes as came from {result}_split{width} union all select {keys}, b, start + {half}, came - goes from {result}_split{width}
)"""]
        width = half
    parts.append(f"""{result} as (
  select {keys}, {categories}, c.b, cast(c.came as bigint) as n from {result}_places p join (select {keys}, b, start as pos, came from {result}_came1) c using ({keys}, pos)
)""")
    return ",\n".join(parts)


DRAWS = f"""
gate_cells as (
  select run_id, truth_damage as truth, routed, count(*) as n from scored where truth_damage is not null group by all
),
{draws_sql("gate_cells", "run_id", "truth, routed", "hits", 4)},
stats as (
  select run_id, b, coalesce(sum(n) filter (where truth and routed), 0)::double as tp, coalesce(sum(n) filter (where routed), 0)::double as p, coalesce(sum(n) filter (where truth), 0)::double as t
  from hits group by run_id, b
),
rates as (select run_id, b, coalesce(tp / nullif(p, 0), 0) as "precision", coalesce(tp / nullif(t, 0), 0) as recall from stats),
scores as (select *, coalesce(2.0::double * "precision" * recall / nullif("precision" + recall, 0), 0) as f1 from rates),
point as (
  select run_id, cast(sum(n) as bigint) as n_rows, sum(n) filter (where truth and routed)::double as tp, sum(n) filter (where routed)::double as p, sum(n) filter (where truth)::double as t
  from gate_cells group by run_id
)
"""


@query(oracle(GATE_VIEWS, """select p.run_id, p.n_rows, round(p.tp / p.t, 9) as recall, round(quantile_cont(s.recall, 0.025), 9) as recall_low, round(quantile_cont(s.recall, 0.975), 9) as recall_high,
  round(p.tp / p.p, 9) as "precision", round(quantile_cont(s."precision", 0.025), 9) as precision_low, round(quantile_cont(s."precision", 0.975), 9) as precision_high,
  round(2.0::double * (p.tp / p.p) * (p.tp / p.t) / (p.tp / p.p + p.tp / p.t), 9) as f1, round(quantile_cont(s.f1, 0.025), 9) as f1_low, round(quantile_cont(s.f1, 0.975), 9) as f1_high
  from point p join scores s on s.run_id = p.run_id group by p.run_id, p.n_rows, p.tp, p.p, p.t""", CELLS + "," + DRAWS))
def bootstrap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluation.scored_images(views.images(spark, sf_dir), _routed(spark, sf_dir))
    truth = F.col("labels.damage_present")
    cells = (
        scored.filter(truth.isNotNull())
        .groupBy("run_id", truth.alias("truth"), "routed")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = bootstrap.intervals(cells, ["run_id"], ["truth", "routed"], bootstrap.gate_statistics())
    return found.select("run_id", "n_rows", *[F.round(name, 9).alias(name) for name in found.columns[2:]])


GRADE_DRAWS = f"""
assessed_cells as (select * from cells where pred is not null),
{draws_sql("assessed_cells", "run_id, asset_class", "truth, pred", "grade_hits", 64)},
stats as (
  select run_id, asset_class, b, coalesce(sum(n) filter (where truth = pred), 0)::double / sum(n)::double as exact_match, coalesce(sum(n) filter (where abs(truth - pred) <= 1), 0)::double / sum(n)::double as within_one_grade
  from grade_hits group by run_id, asset_class, b
),
point as (
  select run_id, asset_class, cast(sum(n) as bigint) as n_rows, coalesce(sum(n) filter (where truth = pred), 0)::double / sum(n)::double as exact_match,
    coalesce(sum(n) filter (where abs(truth - pred) <= 1), 0)::double / sum(n)::double as within_one_grade from cells where pred is not null group by run_id, asset_class
)
"""


@query(oracle(GRADING_VIEWS, """select p.run_id, p.asset_class, p.n_rows, round(p.exact_match, 9) as exact_match, round(quantile_cont(s.exact_match, 0.025), 9) as exact_match_low, round(quantile_cont(s.exact_match, 0.975), 9) as exact_match_high,
  round(p.within_one_grade, 9) as within_one_grade, round(quantile_cont(s.within_one_grade, 0.025), 9) as within_one_grade_low, round(quantile_cont(s.within_one_grade, 0.975), 9) as within_one_grade_high
  from point p join stats s on s.run_id = p.run_id and s.asset_class = p.asset_class group by p.run_id, p.asset_class, p.n_rows, p.exact_match, p.within_one_grade""", GRADING + "," + GRADE_DRAWS))
def bootstrap_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).filter(F.col("pred").isNotNull())
    found = bootstrap.intervals(cells, ["run_id", "asset_class"], ["truth", "pred"], bootstrap.grading_statistics())
    return found.select("run_id", "asset_class", "n_rows", *[F.round(name, 9).alias(name) for name in found.columns[3:]])


GRADES_SQL = """
grades as (
  select concat('doc_', doc_id) as image_id, 'ab' as grader, case when n_chars % 23 = 0 then 'U' else cast(1 + n_chars % 4 as varchar) end as grade from documents
  union all select concat('doc_', doc_id), 'cd', case when n_chars % 29 = 0 then 'U' else cast(1 + (n_chars + case when lang = 'en' then 0 else 1 end) % 4 as varchar) end from documents
  union all select concat('doc_', doc_id), 'ef', cast(1 + (n_chars + 1) % 4 as varchar) from documents where lang <> 'fr'
),
sides as (
  select image_id, max(case when grader = 'ab' then grade end) as first, max(case when grader = 'cd' then grade end) as second, max(case when grader = 'ef' then grade end) as third
  from grades group by image_id
)
"""


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("image_id"), "n_chars", "lang"
    )
    n, english = F.col("n_chars"), F.col("lang") == "en"
    first = F.when(n % 23 == 0, "U").otherwise((1 + n % 4).cast("string"))
    second = F.when(n % 29 == 0, "U").otherwise((1 + (n + F.when(english, 0).otherwise(1)) % 4).cast("string"))
    third = F.when(F.col("lang") != "fr", (1 + (n + 1) % 4).cast("string"))
    rows = docs.select(
        "image_id",
        F.explode(
            F.array(*[F.struct(F.lit(g).alias("grader"), v.alias("grade")) for g, v in (("ab", first), ("cd", second), ("ef", third))])
        ).alias("r"),
    )
    return rows.select("image_id", "r.grader", "r.grade").filter(F.col("grade").isNotNull())


@query(oracle("", """select image_id, first, second, case when first = second then first else third end as adjudicated from sides where first is not null and second is not null""", GRADES_SQL))
def adjudicated_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = humans.graded_side_by_side(_grades(spark, sf_dir), "ab", "cd", "ef")
    return sides.select("image_id", "first", "second", "adjudicated")


@query(oracle("", """select n, round(po, 9) as observed, round(pe, 9) as expected, round((po - pe) / (1 - pe), 9) as kappa from (
  select (select count(*) from sides) as n, (select count(*) filter (where first = second)::double / count(*)::double from sides) as po,
    (select sum(a.n::double * b.n::double) from (select first as g, count(*) as n from sides group by 1) a join (select second as g, count(*) as n from sides group by 1) b on a.g = b.g)
      / ((select count(*) from sides)::double * (select count(*) from sides)::double) as pe)""", GRADES_SQL))
def grader_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    kappa = humans.cohens_kappa(humans.graded_side_by_side(_grades(spark, sf_dir), "ab", "cd", "ef"))
    return kappa.select("n", *[F.round(name, 9).alias(name) for name in ("observed", "expected", "kappa")])


DETECTION_SQL = """
truth as (select doc_id, c as class from (select doc_id, unnest(case when n_chars % 6 = 0 then ['Crack', 'Rust'] when n_chars % 6 = 1 then ['Spalling'] else []::varchar[] end) as c from documents)),
found as (select doc_id, c as class from (select doc_id, unnest(case when n_chars % 4 = 0 then ['Crack'] when n_chars % 4 = 1 then ['Rust', 'Spalling'] when lang = 'de' then ['Wetspot'] else []::varchar[] end) as c from documents)),
per_class as (
  select coalesce(t.class, f.class) as class, count(*) filter (where t.class is not null and f.class is not null) as tp, count(*) filter (where t.class is null) as fp, count(*) filter (where f.class is null) as fn
  from truth t full join found f on t.doc_id = f.doc_id and t.class = f.class group by 1
),
rated as (
  select *, coalesce(tp::double / nullif(tp + fp, 0)::double, 0) as "precision", coalesce(tp::double / nullif(tp + fn, 0)::double, 0) as recall,
    coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0)::double, 0) as f1 from per_class
)
"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    none = F.array().cast("array<string>")

    def names(*values: str):
        return F.array(*map(F.lit, values))

    truth = F.when(n % 6 == 0, names("Crack", "Rust")).when(n % 6 == 1, names("Spalling")).otherwise(none)
    found = (
        F.when(n % 4 == 0, names("Crack"))
        .when(n % 4 == 1, names("Rust", "Spalling"))
        .when(F.col("lang") == "de", names("Wetspot"))
        .otherwise(none)
    )
    return views.table(spark, sf_dir, "documents").select(truth.alias("truth"), found.alias("found"))


@query(oracle("", 'select class, tp, fp, fn, "precision", recall, f1 from rated', DETECTION_SQL))
def class_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return humans.class_detection(_detections(spark, sf_dir), "truth", "found")


@query(oracle("", "select count(*) as classes, round(avg(f1), 9) as macro_f1 from rated", DETECTION_SQL))
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_class = humans.class_detection(_detections(spark, sf_dir), "truth", "found")
    return humans.macro_f1(per_class).withColumn("macro_f1", F.round("macro_f1", 9))


MEASURED_SQL = """
measured as (
  select concat('part_', p_partkey) as item_id, p_retailprice,
    case p_partkey % 4 when 0 then 'MBEI-CS' when 1 then 'MBEI-CS' when 2 then 'IEC-62446-3-CoA' else 'FEMA-PDA' end as standard,
    case p_partkey % 4 when 0 then 'cracking (reinforced concrete)' when 1 then 'cracking (prestressed concrete)' when 2 then 'single hot cell' else 'building' end as subject,
    case when p_size = 1 then null else p_size * 0.0254::double end as crack_width_mm, p_size::double as delta_t_k, (500 + p_size * 10)::double as irradiance_wm2,
    case when p_size = 2 then null else p_size + 0.5::double end as percent_damage
  from part
)
"""


@query(oracle("", """select item_id, case
    when subject = 'cracking (reinforced concrete)' then case when w > 0.05 then 'CS3' when w >= 0.012 then 'CS2' when w >= 0 then 'CS1' else 'not_measurable' end
    when subject = 'cracking (prestressed concrete)' then case when w > 0.009 then 'CS3' when w >= 0.004 then 'CS2' when w >= 0 then 'CS1' else 'not_measurable' end
    when subject = 'single hot cell' then case when irradiance_wm2 < 600 then 'not_measurable' when delta_t_k > 40 then 'CoA 3' when delta_t_k >= 10 then 'CoA 2' else 'not_measurable' end
    else case when percent_damage > 50 then 'Destroyed' when percent_damage >= 26 then 'Major' when percent_damage >= 10 then 'Minor' when percent_damage >= 1 then 'Affected' when percent_damage >= 0 then 'Undamaged' else 'not_measurable' end end as native_value
  from (select *, crack_width_mm / 25.4::double as w from measured)""", MEASURED_SQL))
def measured_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey") % 4, F.col("p_size")
    standard = F.when(key <= 1, "MBEI-CS").when(key == 2, "IEC-62446-3-CoA").otherwise("FEMA-PDA")
    subject = (
        F.when(key == 0, "cracking (reinforced concrete)")
        .when(key == 1, "cracking (prestressed concrete)")
        .when(key == 2, "single hot cell")
        .otherwise("building")
    )
    value = measured_value(
        standard,
        subject,
        F.when(size != 1, size * F.lit(0.0254)),
        size.cast("double"),
        (500 + size * 10).cast("double"),
        F.when(size != 2, size + F.lit(0.5)),
    )
    return views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), "p_partkey").alias("item_id"), value.alias("native_value")
    )
