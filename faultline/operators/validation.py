"""Contract checks and the rubric audit, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.fixed_values import ACTION_CODES, ASSET_CLASSES, FLAGS, LEVELS, STANDARDS
from faultline.rubric_values import ALLOWED_VALUES, BRIDGE_ALTERNATIVE, RUBRIC_ROWS, STANDARD_OF_CLASS


#: The version of the rubric rows in rubric_values.
BUILT_IN = "built-in"
RUBRIC_COLUMNS = ["version", "standard", "subject", "value", "criterion", "level", "action", "flag"]
#: Rubric rows that a run may hold: all of them go to every task.
MAX_RUBRIC_ROWS = 10_000


def rubric_table(spark: SparkSession) -> DataFrame:
    """The built-in rubric rows."""
    rows = spark.createDataFrame(
        RUBRIC_ROWS, "standard string, subject string, value string, criterion string, level string, action string, flag string"
    )
    return rows.select(F.lit(BUILT_IN).alias("version"), "*")


def with_version(rubric: DataFrame) -> DataFrame:
    """Rubric rows (readers.read_rubrics) with the version of their standard: a digest of its rows, so an edited file is
    another version and an unchanged one is not."""
    text = F.to_json(F.struct(*RUBRIC_COLUMNS[2:]), {"ignoreNullFields": "false"})
    digests = rubric.groupBy("standard").agg(F.md5(F.array_join(F.array_sort(F.collect_list(text)), "\n")).alias("version"))
    return rubric.drop("version").join(digests, "standard").select(*RUBRIC_COLUMNS)


def effective_rubric(override: DataFrame | None, spark: SparkSession) -> DataFrame:
    """The rubric a run grades by: the standards that `override` has rows for, and the built-in rows of the others."""
    built_in = rubric_table(spark)
    if override is None:
        return built_in
    given = with_version(override)
    return given.unionByName(built_in.join(given.select("standard").distinct(), "standard", "left_anti"))


def rubric_rows(rubric: DataFrame) -> list[dict]:
    """Rubric rows as plain dicts, for scorers."""
    rows = [row.asDict() for row in rubric.select(*RUBRIC_COLUMNS).limit(MAX_RUBRIC_ROWS + 1).collect()]
    if len(rows) > MAX_RUBRIC_ROWS:
        raise ValueError(f"a rubric has at most {MAX_RUBRIC_ROWS} rows")
    unknown = {row["standard"] for row in rows} - set(STANDARDS)
    if unknown:
        raise ValueError(f"rubric rows of unknown standards: {sorted(unknown, key=str)}")
    return rows


def rubrics_by_standard(rows: list[dict] | None = None) -> dict[str, list[dict]]:
    """The rubric rows of each standard as plain dicts, by default the built-in ones."""
    names = RUBRIC_COLUMNS[1:]
    known = [dict(zip(names, row)) for row in RUBRIC_ROWS] if rows is None else [{name: row[name] for name in names} for row in rows]
    return {standard: [row for row in known if row["standard"] == standard] for standard in ALLOWED_VALUES}


def rubric_by_standard(rubric: DataFrame) -> DataFrame:
    """One row per version and standard with its allowed values and its rows."""
    row = F.struct("value", "criterion", "level")
    return rubric.groupBy("version", "standard").agg(F.collect_set("value").alias("allowed_values"), F.collect_list(row).alias("rubric"))


def _version(findings: DataFrame) -> Column:
    """The rubric version a finding was graded by."""
    given = F.col("rubric_version") if "rubric_version" in findings.columns else F.lit(None).cast("string")
    return F.coalesce(given, F.lit(BUILT_IN))


def standard_for(asset_class: Column, bridge_alternative: bool = False) -> Column:
    """The standard an asset class is graded on; only bridges have an alternative."""
    table = dict(STANDARD_OF_CLASS)
    if bridge_alternative:
        table["bridge_element"] = BRIDGE_ALTERNATIVE
    result = F.lit(None).cast("string")
    for name, standard in table.items():
        result = F.when(asset_class == name, standard).otherwise(result)
    return result


def image_rules() -> dict[str, Column]:
    c = F.col
    return {
        "image_id": c("image_id").isNull(),
        "path": c("path").isNull(),
        "sha256": c("sha256").isNull(),
        "width": c("width").isNull(),
        "height": c("height").isNull(),
        "asset_class": ~F.coalesce(c("asset_class").isin(ASSET_CLASSES), F.lit(False)),
    }


def finding_rules() -> dict[str, Column]:
    """Each rule is true when the finding breaks it."""
    c = F.col

    def outside(value: Column, allowed: list[str]) -> Column:
        return ~F.coalesce(value.isin(allowed), F.lit(False))

    confidence = c("measurements.confidence")
    flags = c("unified.flags")
    return {
        "finding_id": c("finding_id").isNull(),
        "asset_class": outside(c("asset_class"), ASSET_CLASSES),
        "defect_type": c("defect_type").isNull(),
        "standard": outside(c("native_scale.standard"), STANDARDS),
        "native_value": c("native_scale.value").isNull(),
        "criteria_matched": c("native_scale.criteria_matched").isNull(),
        "level": outside(c("unified.level"), LEVELS),
        "uncertainty": c("unified.uncertainty").isNull(),
        "flags": flags.isNull() | (F.size(F.array_except(flags, F.array(*map(F.lit, FLAGS)))) > 0),
        "confidence": ~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)),
        "action_code": outside(c("action.code"), ACTION_CODES),
        "action_basis": c("action.basis").isNull(),
        "justification": c("justification").isNull(),
    }


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `violations`, the names of the broken rules in rule order."""
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.withColumn("violations", F.array_compact(names))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = with_violations(df, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def criteria_audit(findings: DataFrame, rubric: DataFrame | None = None) -> DataFrame:
    """Check every quoted criterion and the value and level it implies against the rubric of the finding's standard.

    Findings with a `rubric_version` are checked against that version's rows of `rubric`, others against the built-in ones.

    A level may exceed its rubric row only by the documented upgrade: CS4 or Severe with instability is S4. U is
    always allowed. A standard without rubric rows is reported as such.
    """
    known_rows = rubric_table(findings.sparkSession)
    if rubric is not None:
        known_rows = known_rows.unionByName(rubric.filter(F.col("version") != BUILT_IN).select(*RUBRIC_COLUMNS))
    rubric = rubric_by_standard(known_rows)
    standard, value = F.col("native_scale.standard"), F.col("native_scale.value")
    quoted, level = F.col("native_scale.criteria_matched"), F.col("unified.level")
    joined = findings.withColumn("_version", _version(findings)).join(
        rubric, (standard == rubric["standard"]) & (F.col("_version") == rubric["version"]), "left"
    )
    known = F.transform("rubric", lambda row: row["criterion"])
    levels_of_quote = F.transform(
        F.filter("rubric", lambda row: (row["value"] == value) & F.array_contains(quoted, row["criterion"])),
        lambda row: row["level"],
    )
    upgrade = (level == "S4") & value.isin("CS4", "Severe")
    no_rubric = F.col("rubric").isNull()
    return joined.select(
        "run_id",
        "finding_id",
        no_rubric.alias("no_rubric"),
        F.coalesce(F.size(F.array_except(quoted, known)), F.lit(0)).alias("unknown_criteria"),
        F.coalesce(F.array_contains("allowed_values", value) | (level == "U"), F.lit(False)).alias("value_allowed"),
        F.coalesce(F.array_contains(levels_of_quote, level) | upgrade | (level == "U"), F.lit(False)).alias("level_supported"),
    )


def crosswalk(findings: DataFrame, rubric: DataFrame | None = None) -> DataFrame:
    """The rubric row of each finding by version, standard, subject and value: its level, action and flag.

    A rubric row without a subject applies to any defect on its standard. `rubric` as in criteria_audit.
    """
    known_rows = rubric_table(findings.sparkSession)
    if rubric is not None:
        known_rows = known_rows.unionByName(rubric.filter(F.col("version") != BUILT_IN).select(*RUBRIC_COLUMNS))
    rows = known_rows.select(
        F.col("version").alias("_version"),
        F.col("standard").alias("_standard"),
        "subject",
        F.col("value").alias("_value"),
        F.col("level").alias("rubric_level"),
        F.col("action").alias("rubric_action"),
        F.col("flag").alias("rubric_flag"),
    )
    match = (
        (_version(findings) == F.col("_version"))
        & (F.col("native_scale.standard") == F.col("_standard"))
        & (F.col("native_scale.value") == F.col("_value"))
        & (F.col("subject").isNull() | (F.col("subject") == "any defect") | (F.col("subject") == F.col("defect_type")))
    )
    return findings.join(rows, match, "left").drop("_version", "_standard", "_value", "subject")
