"""Table schemas of the finding contract and of the run logs."""

from pyspark.sql.types import StructType

LABELS = (
    "struct<damage_present: boolean, classes_present: array<string>, all_labels: array<string>,"
    " grade_native: string, grade_scale: string, grade_source: string, source_class: string,"
    " fema_group: array<string>, unified_truth: string, area_fracs: map<string,double>, control: string>"
)

IMAGES = (
    "image_id string, path string, sha256 string, width int, height int, asset_class string,"
    " gsd_mm_per_px double, irradiance_wm2 double, captured_on string, source_dataset string, split string,"
    f" labels {LABELS},"
    " client_id string, asset_id string, source_video string, frame_time_s double"
)

CONTRACT = (
    "defect_type string,"
    " native_scale struct<standard: string, value: string, criteria_matched: array<string>>,"
    " unified struct<level: string, uncertainty: string, flags: array<string>>,"
    " measurements struct<area_cm2: double, crack_width_mm: double, delta_t_k: double,"
    " percent_area_rusted: double, section_loss_pct: double, confidence: double>,"
    " action struct<code: string, sla_days: int, basis: string>,"
    " justification string"
)

FINDINGS = (
    f"finding_id string, asset_class string, {CONTRACT},"
    " evidence struct<image_ids: array<string>, bbox: array<int>, tile: string, gsd_mm_per_px: double,"
    " irradiance_wm2: double>,"
    " review struct<status: string, reviewer: string, reviewed_at: string, prior_level: string>,"
    " model string, usd double, seconds double"
)

QUEUE = f"{FINDINGS}, queue_score double, queue_rank bigint"

USAGE = (
    "model string, input_tokens bigint, output_tokens bigint, seconds double, note string, ts timestamp"
)

QUEUE_KEY = "struct<not_worst: boolean, unassessed: boolean, minus_score: double, finding_id: string>"

QUEUE_PARTS = (
    f"file string, n bigint, before bigint, first {QUEUE_KEY}, last {QUEUE_KEY}, today string, reviewed bigint"
)

GATE = (
    "image_id string, asset_class string, usable boolean, damage_present boolean, confidence double, reason string,"
    f" {USAGE}"
)

GATE_LOG = f"{GATE}, usd double"

FINDING_LOG = (
    f"{FINDINGS}, input_tokens bigint, output_tokens bigint, note string, ts timestamp, call_seconds double,"
    " call_usd double, image_id string, rubric_version string"
)

REVIEWS = (
    "id bigint, run_id string, finding_id string, action string, prior_level string, new_level string,"
    " reviewer string, reviewed_at timestamp"
)

SETTINGS = "buckets int, settings string"

RUBRIC = (
    "version string, standard string, subject string, value string, criterion string, level string, action string, flag string"
)

PRICES = "model string, usd_per_mtok_in double, usd_per_mtok_out double"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
