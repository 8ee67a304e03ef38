"""Inspection tables derived from the given tables.

Each view is one SQL text that both engines run; the Spark side then nests its columns into the table schemas
the operators take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import parse_fractions, parse_names
from faultline.fixed_values import CONCRETE_DAMAGE_CLASSES
from faultline.rubric_values import RUBRIC_ROWS

TODAY = "2026-09-25"

# Documents stand for images: every document is one image of a dataset (its source), in one of three runs.
FX_IMAGES = """
select concat('doc_', doc_id) as image_id, doc_id as pos, concat('run', doc_id % 3) as run_id,
  concat('/images/', source, '/', doc_id, '.jpg') as path, concat(md5(concat('a', doc_id)), md5(concat('b', doc_id))) as sha256,
  asset_class, source as source_dataset, case when doc_id % 10 < 3 then 'eval_v1' else 'dev' end as split,
  cast(24 + (n_chars * 7) % 4729 as int) as width, cast(40 + (n_chars * 3) % 3417 as int) as height,
  case when n_chars % 3 = 0 then null else cast(n_chars % 50 as double) / 8 end as gsd_mm_per_px,
  case when asset_class = 'pv_module' then cast(400 + n_chars % 500 as double) end as irradiance_wm2,
  case when doc_id % 13 = 0 then null when doc_id % 11 = 0 then '2026/09/01'
       else concat('2026-0', 1 + doc_id % 9, '-1', doc_id % 10) end as captured_on,
  damage_present, truth,
  case asset_class
    when 'bridge_element' then case when truth is null then 'n/a' else concat('', truth + 1) end
    when 'steel_coating' then case truth when 0 then 'Good' when 1 then 'Fair' when 2 then 'Poor' when 3 then 'Severe' end
    when 'pv_module' then case truth when 0 then 'CoA 1' when 1 then 'CoA 2' when 2 then 'CoA 3' end end as grade_native,
  case when asset_class = 'bridge_element' and doc_id % 3 <> 0 then 'team-graded' when truth is null then null else 'dataset' end as grade_source,
  case when asset_class = 'building_disaster' then
    case truth when 0 then 'Intact' when 1 then 'Damaged' when 2 then 'Collapsed' end end as source_class,
  concat(case when n_chars % 4 = 0 then 'Crack;' else '' end, case when n_chars % 7 = 0 then 'ACrack;' else '' end,
    case when n_chars % 5 = 0 then 'Spalling;' else '' end, case when n_chars % 6 = 0 then 'Rust;' else '' end,
    case when n_chars % 11 = 0 then 'ExposedRebars;' else '' end, case when n_chars % 9 = 0 then 'Efflorescence;' else '' end,
    case when n_chars % 8 = 0 then 'Wetspot;' else '' end, case when n_chars % 3 = 0 then 'Bearing;' else '' end) as label_text,
  concat('Crack=0.', n_chars % 10, ';;Rust=0.', n_chars % 7, ';') as fraction_text,
  case when doc_id % 17 = 0 then '2026:9:1 10:00' when doc_id % 19 = 0 then ''
       else concat('2026:0', 1 + doc_id % 9, ':1', doc_id % 10, ' 10:00:00') end as exif_text
from (
  select d.doc_id, d.source, d.n_chars,
    case d.doc_id % 4 when 0 then 'bridge_element' when 1 then 'steel_coating' when 2 then 'pv_module' else 'building_disaster' end as asset_class,
    (l.quality = 0 or l.toxic = 1) as damage_present,
    case when l.doc_id is null then null when d.doc_id % 4 >= 2 then least((1 - l.quality) * 2 + l.toxic, 2)
         else (1 - l.quality) * 2 + l.toxic end as truth
  from {documents} d left join {labels} l on d.doc_id = l.doc_id
) labelled
"""

# Verdicts on every image.
FX_GATE = """
select concat('run', doc_id % 3) as run_id, concat('doc_', doc_id) as image_id,
  case doc_id % 4 when 0 then 'bridge_element' when 1 then 'steel_coating' when 2 then 'pv_module' else 'building_disaster' end as asset_class,
  n_chars >= 500 as usable, lang <> 'en' as damage_present, cast((doc_id * 37) % 101 as double) / 100 as confidence,
  concat('seen in ', lang) as reason, concat('gate_', lang) as model
from {documents}
"""

# A gate log that a later dataset is still waiting for.
FX_GATE_SO_FAR = FX_GATE + " where source <> 'src19'"

# Orders stand for graded findings, customers for the assets they were found on.
FX_FINDINGS = """
select finding_id, image_id, run_id, asset_class, level,
  case when o_orderkey % 7 = 0 then 'section_loss' when o_orderkey % 7 = 1 then 'load_posting_review'
       when o_orderkey % 7 = 2 then 'not_measurable' else '' end as flag,
  case asset_class
    when 'bridge_element' then case when o_orderkey % 97 = 0 then 'CS9' else concat('CS', least(ord + 1, 4)) end
    when 'steel_coating' then case ord when 0 then 'Good' when 1 then 'Fair' when 2 then 'Poor' else 'Severe' end
    when 'pv_module' then concat('CoA ', least(ord, 2) + 1)
    else case when level = 'U' then 'Inaccessible' else
      case ord when 0 then 'Undamaged' when 1 then 'Affected' when 2 then 'Minor' when 3 then 'Major' else 'Destroyed' end end end as native_value,
  case asset_class
    when 'bridge_element' then case when o_orderkey % 89 = 0 then 'ISO-4628-3' else 'MBEI-CS' end
    when 'steel_coating' then 'CorrosionCS' when 'pv_module' then 'IEC-62446-3-CoA' else 'FEMA-PDA' end as standard,
  case asset_class
    when 'bridge_element' then case o_orderkey % 3 when 0 then 'None.' when 1 then 'Heavy build-up with rust staining.' else 'Heavy build up, rust.' end
    when 'steel_coating' then 'Rust seen on the flange.'
    when 'pv_module' then 'Single cell warmer than the module by 10 to 40 K.'
    else 'No visible damage to roof, walls or surroundings.' end as criterion,
  case o_orderkey % 5 when 0 then 'exposed rebar' when 1 then 'spall (pier cap)' when 2 then 'cracking (reinforced concrete)'
       when 3 then 'rust (girder) (web)' else 'single hot cell' end as defect_type,
  case ord when 0 then 'record' when 1 then 'monitor' when 2 then 'schedule' when 3 then 'prioritize' else 'schedule' end as action_code,
  case when ord = 0 then null else cast(120 - 30 * ord as int) end as sla_days,
  case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 5000 as double) * 8 end as area_cm2,
  case when o_orderkey % 211 = 0 then 1.5e0 else cast((o_orderkey * 13) % 101 as double) / 100 end as confidence,
  case when o_orderkey % 6 = 0 then 'full' else concat('t0', o_orderkey % 6) end as tile,
  cast(o_orderkey % 1000 as int) as x0, cast(o_orderkey % 700 as int) as y0,
  case when o_orderstatus = 'F' then 'accepted' else 'pending' end as review_status,
  concat('grader_', n_regionkey) as model, cast(o_orderkey % 64 as double) / 1024 as usd, cast(o_orderkey % 4096 as double) / 128 as seconds
from (
  select concat('ord_', o.o_orderkey) as finding_id, concat('cust_', o.o_custkey) as image_id, concat('run', o.o_orderkey % 3) as run_id,
    case c.c_mktsegment when 'AUTOMOBILE' then 'bridge_element' when 'BUILDING' then 'building_disaster'
                        when 'FURNITURE' then 'pv_module' else 'steel_coating' end as asset_class,
    case when o.o_orderstatus = 'P' and o.o_orderkey % 5 = 0 then 'U' when o.o_orderpriority = '1-URGENT' then 'S4'
         when o.o_orderpriority = '2-HIGH' then 'S3' when o.o_orderpriority = '3-MEDIUM' then 'S2'
         when o.o_orderpriority = '4-NOT SPECIFIED' then 'S1' else 'S0' end as level,
    case o.o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 1 else 0 end as ord,
    o.o_orderkey, o.o_orderstatus, n.n_regionkey
  from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
) graded
"""

# All customers as assets.
FX_CUSTOMER_ASSETS = """
select concat('cust_', c.c_custkey) as image_id, cast(n.n_regionkey as double) * 0.875e0 as criticality,
  1 + cast(c.c_custkey % 5 as double) / 4 as production_loss_factor, 1 + cast(c.c_custkey % 3 as double) / 2 as occupancy_factor,
  case when c.c_custkey % 17 = 0 then null when c.c_custkey % 19 = 0 then '2026/09/01' when c.c_custkey % 23 = 0 then '2026-02-30'
       else concat('2026-0', 7 + c.c_custkey % 3, '-', 10 + c.c_custkey % 20) end as found_on
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
"""

# The asset register: customers in good standing. The others have no entry and take the defaults.
FX_ASSETS = FX_CUSTOMER_ASSETS + " where c.c_acctbal >= 0"

# Events stand for model calls and for reviewer decisions. Seconds are multiples of 1/4096, finer than a millisecond;
# their sums are exact in any order, so a rounded total cannot depend on it.
FX_CALLS = """
select event_id as call_id, ts, concat('run', event_id % 3) as run_id,
  case when event_type in ('click', 'view') then 'gate' else 'grade' end as stage, concat('model_', event_type) as model,
  concat('doc_', user_id) as image_id, user_id * 10 as input_tokens, event_id % 900 as output_tokens,
  floor(value * 4096) / 4096.0e0 as seconds
from {events}
"""

FX_REVIEWS = """
select event_id as id, ts as reviewed_at, concat('run', event_id % 3) as run_id, concat('ord_', user_id) as finding_id,
  case event_type when 'click' then 'accepted' when 'view' then 'accepted' when 'error' then 'overridden' else 'marked_u' end as action,
  case when event_type = 'error' then concat('S', event_id % 5) end as new_level, concat('reviewer_', event_id % 7) as reviewer
from {events}
"""

# One to three graded tiles per document image.
FX_PREDS = """
select concat('doc_', doc_id, '/t0', k) as finding_id, concat('doc_', doc_id) as image_id, concat('run', doc_id % 3) as run_id,
  case doc_id % 4 when 0 then 'bridge_element' when 1 then 'steel_coating' when 2 then 'pv_module' else 'building_disaster' end as asset_class,
  case when (doc_id * 31 + k * 17) % 11 = 0 then 'U' else concat('S', step % 5) end as level,
  case doc_id % 4
    when 0 then case when step % 6 = 5 then '3' else concat('CS', 1 + step % 4) end
    when 1 then case step % 5 when 0 then 'Good' when 1 then 'Fair' when 2 then 'Poor' when 3 then 'Severe' else 'Rusty' end
    when 2 then concat('CoA ', 1 + step % 3)
    else case step % 6 when 0 then 'Undamaged' when 1 then 'Affected' when 2 then 'Minor' when 3 then 'Major' when 4 then 'Destroyed' else 'Inaccessible' end
  end as native_value,
  case doc_id % 4 when 0 then case when step % 6 = 5 then 'NBI-0-9' else 'MBEI-CS' end when 1 then 'CorrosionCS' when 2 then 'IEC-62446-3-CoA' else 'FEMA-PDA' end as standard,
  cast((doc_id * 29 + k) % 101 as double) / 100 as confidence
from (
  select d.doc_id, t.k, d.doc_id * 7 + t.k * 3 as step
  from {documents} d join (select 0 as k union all select 1 as k union all select 2 as k) t on t.k <= d.n_chars % 3
) tiles
"""

VIEWS = {
    "fx_images": FX_IMAGES,
    "fx_gate": FX_GATE,
    "fx_gate_so_far": FX_GATE_SO_FAR,
    "fx_findings": FX_FINDINGS,
    "fx_assets": FX_ASSETS,
    "fx_customer_assets": FX_CUSTOMER_ASSETS,
    "fx_calls": FX_CALLS,
    "fx_reviews": FX_REVIEWS,
    "fx_preds": FX_PREDS,
}
TABLES = ["documents", "labels", "orders", "customer", "nation", "events"]

# A price list as a caller would supply it: USD per million tokens, in and out. Each token costs a multiple of 1e-4,
# so that no total sits on a rounding edge.
PRICE_LIST = [("model_click", 100.0, 500.0), ("model_view", 200.0, 1000.0), ("model_error", 400.0, 2000.0)]


def oracle(views: str, body: str, ctes: str = "") -> str:
    """The SQL of a query: the named views, further expressions, and the final select."""
    given = {name: name for name in TABLES}
    parts = [f"{name} as ({VIEWS[name].format(**given).strip()})" for name in views.split()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """A fixed list as a CTE."""

    def literal(value: object) -> str:
        if value is None:
            return "null"
        if isinstance(value, float):
            return f"{value!r}::double"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return str(value)

    lines = ", ".join("(" + ", ".join(literal(value) for value in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {lines})"


def rubric_cte() -> str:
    return sql_values(RUBRIC_ROWS, "rubric", "standard, subject, value, criterion, level, action, flag")


def price_cte() -> str:
    return sql_values(PRICE_LIST, "prices", "model, usd_per_mtok_in, usd_per_mtok_out")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_LIST, "model string, usd_per_mtok_in double, usd_per_mtok_out double")


def damage_classes(labels: Column) -> Column:
    return F.array_sort(F.array_intersect(labels, F.array(*map(F.lit, CONCRETE_DAMAGE_CLASSES))))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parse_names(F.col("label_text"))
    labels = F.struct(
        F.col("damage_present"),
        damage_classes(names).alias("classes_present"),
        names.alias("all_labels"),
        F.col("grade_native"),
        F.col("grade_source"),
        F.col("source_class"),
        parse_fractions(F.col("fraction_text")).alias("area_fracs"),
    )
    return view(spark, sf_dir, "fx_images").withColumn("labels", labels)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_gate")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_assets")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_calls").withColumn("ts", F.col("ts").cast("timestamp"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_reviews").withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    blank = F.lit(None).cast("double")
    return view(spark, sf_dir, "fx_findings").select(
        "run_id",
        "finding_id",
        "asset_class",
        "defect_type",
        F.struct(
            "standard", c("native_value").alias("value"), F.array("criterion").alias("criteria_matched")
        ).alias("native_scale"),
        F.struct(
            "level",
            F.lit("+/-1").alias("uncertainty"),
            F.when(c("flag") == "", F.array().cast("array<string>")).otherwise(F.array("flag")).alias("flags"),
        ).alias("unified"),
        F.struct(
            "area_cm2",
            blank.alias("crack_width_mm"),
            blank.alias("delta_t_k"),
            blank.alias("percent_area_rusted"),
            blank.alias("section_loss_pct"),
            "confidence",
        ).alias("measurements"),
        F.struct(c("action_code").alias("code"), "sla_days", F.concat(F.lit("row for "), "native_value").alias("basis")).alias("action"),
        F.concat(F.lit("graded "), "native_value").alias("justification"),
        F.struct(
            F.array("image_id").alias("image_ids"),
            F.array(c("x0"), c("y0"), c("x0") + 100, c("y0") + 80).alias("bbox"),
            "tile",
            blank.alias("gsd_mm_per_px"),
            blank.alias("irradiance_wm2"),
        ).alias("evidence"),
        F.struct(
            c("review_status").alias("status"), _text(None).alias("reviewer"), _text(None).alias("reviewed_at"), _text(None).alias("prior_level")
        ).alias("review"),
        "model",
        "usd",
        "seconds",
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return view(spark, sf_dir, "fx_preds").select(
        "run_id",
        "finding_id",
        "asset_class",
        F.struct("standard", c("native_value").alias("value")).alias("native_scale"),
        F.struct("level").alias("unified"),
        F.struct("confidence").alias("measurements"),
        F.struct(F.array("image_id").alias("image_ids")).alias("evidence"),
        F.struct(F.lit("pending").alias("status")).alias("review"),
    )
