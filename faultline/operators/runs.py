"""Facts per run: counts, levels, cost by stage, summaries and comparisons, for all runs in one pass."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import ASSET_CLASSES, DISASTER_CLASSES, LEVELS
from faultline.functions.columns import first_or_blank, key_counts, ratio
from faultline.functions.grades import level_ordinal
from faultline.operators.records import one_row_per
from faultline.rubric_values import ALLOWED_VALUES
from faultline.session import materialise


def first_image() -> Column:
    return F.try_element_at(F.col("evidence.image_ids"), F.lit(1))


def tariff(prices: DataFrame) -> DataFrame:
    """One row a model: of several prices of a model, the least."""
    return one_row_per(prices.select("model", "usd_per_mtok_in", "usd_per_mtok_out"), "model")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with `usd` from token counts; a model without a price costs nothing, one with several the least."""
    usd = (
        F.col("input_tokens") * F.coalesce("usd_per_mtok_in", F.lit(0.0))
        + F.col("output_tokens") * F.coalesce("usd_per_mtok_out", F.lit(0.0))
    ) / F.lit(1e6)
    return calls.join(tariff(prices), "model", "left").withColumn("usd", usd).drop("usd_per_mtok_in", "usd_per_mtok_out")


def gate_counts(routed_gate: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return routed_gate.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gated"),
        F.count_if("routed").alias("routed"),
        F.count_if(~F.col("usable")).alias("unusable"),
    )


def level_counts(findings: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One column per level, zero when absent."""
    return findings.groupBy(*by).agg(*[F.count_if(F.col("unified.level") == name).alias(name) for name in LEVELS])


def finding_counts(findings: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct(first_image()).alias("graded_images"),
        F.count_if(F.col("review.status") != "pending").alias("reviews"),
        F.array_join(F.array_sort(F.collect_set("asset_class")), ", ").alias("asset_classes"),
        *[F.count_if(F.col("unified.level") == name).alias(name) for name in LEVELS],
    )


def value_counts(findings: DataFrame) -> DataFrame:
    """Findings per native value."""
    return findings.groupBy("run_id", F.col("native_scale.value").alias("native_value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def value_text(counts: DataFrame, key: str, name: str) -> DataFrame:
    """Counted keys of a fixed vocabulary as one text per run, in key order."""
    return counts.groupBy("run_id").agg(key_counts(F.col(key), F.col("n")).alias(name))


def cost_by_stage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("usd").alias("usd"),
        F.sum("seconds").alias("seconds"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


#: Bits of a value that each counting pass looks at, from the highest on: a pass keeps 2^22 counts a group at most.
RADIX_BITS = (20, 22, 22)


def sortable_bits(value: Column) -> Column:
    """The bits of a double as a whole number that sorts like the double."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _digit(bits: Column, number: int) -> Column:
    """The digit of `bits` that pass `number` counts; the first one keeps the sign."""
    below = sum(RADIX_BITS[number + 1 :])
    moved = F.shiftright(bits, below)
    return moved if number == 0 else moved.bitwiseAND(F.lit(2 ** RADIX_BITS[number] - 1))


def _counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("seconds").alias("_least"), F.max("seconds").alias("_most"))


def median_seconds(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The exact median of the logged seconds of each group, by counting the digits of the values' bits.

    The first pass counts each group's values by their highest bits, and finds the counts that the one or two middle
    places fall into. Only values with those bits are counted by their next ones, and so on, until a place is left with
    one value; as many passes as there are digits always do. Nothing is sorted but counts, and no task holds a group.
    """
    values = calls.filter(F.col("seconds").isNotNull()).select(*keys, "seconds", sortable_bits(F.col("seconds")).alias("_bits"))
    whole = Window.partitionBy(*keys)
    counted = _counts(values.withColumn("_d0", _digit(F.col("_bits"), 0)), [*keys, "_d0"])
    upto = F.sum("_n").over(whole.orderBy("_d0").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_total": F.sum("_n").over(whole)})
    middle = F.array((F.col("_total") + 1).cast("bigint") - F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 1) / 2))
    each = placed.withColumn("_place", F.explode(F.array_distinct(middle))).filter("_upto - _n < _place and _place <= _upto")
    found = materialise(each.select(*keys, "_d0", "_place", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_inside"), "_least", "_most"), "places")
    settled = [found.filter("_least = _most").select(*keys, "_least")]
    for number in range(1, len(RADIX_BITS)):
        still = found.filter("_least <> _most").drop("_least", "_most")
        if still.isEmpty():
            break
        renamed = still.withColumnsRenamed({key: f"_key_{key}" for key in keys} | {f"_d{at}": f"_known{at}" for at in range(number)})
        same = [values[key].eqNullSafe(renamed[f"_key_{key}"]) for key in keys]
        same += [_digit(values["_bits"], at) == renamed[f"_known{at}"] for at in range(number)]
        joined = values.join(renamed, reduce(and_, same)).drop(*[f"_key_{key}" for key in keys])
        known = [f"_known{at}" for at in range(number)]
        by = [*keys, *known, "_place", "_inside"]
        counted = _counts(joined.withColumn(f"_d{number}", _digit(F.col("_bits"), number)), [*by, f"_d{number}"])
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(f"_d{number}").rowsBetween(Window.unboundedPreceding, 0))
        each = counted.withColumn("_upto", upto).filter("_upto - _n < _inside and _inside <= _upto")
        inside = (F.col("_inside") - F.col("_upto") + F.col("_n")).alias("_inside")
        digits = [F.col(f"_known{at}").alias(f"_d{at}") for at in range(number)]
        found = materialise(each.select(*keys, *digits, f"_d{number}", "_place", inside, "_least", "_most"), "places")
        settled.append(found.filter("_least = _most").select(*keys, "_least"))
    # A group has one middle value or two.
    return reduce(DataFrame.union, settled).groupBy(*keys).agg(((F.min("_least") + F.max("_least")) / 2).alias("median_seconds"))


def ops_by_stage(calls: DataFrame) -> DataFrame:
    keys = ["run_id", "stage"]
    totals = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum("usd"), 4).alias("usd_total"),
        F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"),
    )
    return totals.join(median_seconds(calls, keys), keys, "left").select(*keys, "calls", "median_seconds", "usd_total", "models")


def cost_by_stage_model(calls: DataFrame) -> DataFrame:
    keys = ["run_id", "stage", "model"]
    totals = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("usd").alias("usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    columns = [*keys, "calls", "usd", "median_seconds", "input_tokens", "output_tokens"]
    return totals.join(median_seconds(calls, keys), keys, "left").select(*columns)


def usd_per_image(calls: DataFrame, gate: DataFrame, images: DataFrame) -> DataFrame:
    """Cost of all stages over the images that were scored, that is in the manifest and gated."""
    scored = gate.join(images.select("image_id"), "image_id", "left_semi").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("scored_images")
    )
    spent = calls.groupBy("run_id").agg(F.sum("usd").alias("usd"))
    return spent.join(scored, "run_id", "left").select(
        "run_id",
        F.coalesce("scored_images", F.lit(0)).alias("scored_images"),
        F.round(ratio(F.col("usd"), F.coalesce("scored_images", F.lit(0))), 5).alias("usd_per_image"),
    )


def call_totals(calls: DataFrame) -> DataFrame:
    def stage_seconds(stage: str) -> Column:
        return F.sum(F.when(F.col("stage") == stage, F.col("seconds")).otherwise(0.0)).alias(f"seconds_{stage}")

    return calls.groupBy("run_id").agg(
        F.sum("usd").alias("usd"),
        F.sum("seconds").alias("seconds"),
        stage_seconds("gate"),
        stage_seconds("grade"),
        F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"),
    )


def _join_runs(parts: list[DataFrame]) -> DataFrame:
    """Full outer join of small per-run tables."""
    return reduce(lambda left, right: left.join(right, "run_id", "full_outer"), parts)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def summarise(images: DataFrame, routed_gate: DataFrame, findings: DataFrame, calls: DataFrame) -> DataFrame:
    """The run summary: one row per run over the persisted logs, so a resumed run reports its whole cost."""
    parts = [
        images.groupBy("run_id").agg(F.count(F.lit(1)).alias("images")),
        gate_counts(routed_gate),
        finding_counts(findings),
        call_totals(calls),
    ]
    images_n = F.coalesce(F.col("images"), F.lit(0))
    return _join_runs(parts).select(
        "run_id",
        _zero("images"),
        _zero("gated"),
        F.coalesce(F.col("routed"), F.lit(0)).alias("routed_to_grader"),
        ratio(F.col("routed"), F.col("gated")).alias("routing_fraction"),
        _zero("unusable"),
        _zero("findings"),
        *[_zero(name) for name in LEVELS],
        F.round(F.coalesce("usd", F.lit(0.0)), 4).alias("usd_total"),
        F.round(ratio(F.coalesce("usd", F.lit(0.0)), images_n), 5).alias("usd_per_image"),
        F.round(F.coalesce("seconds", F.lit(0.0)), 1).alias("seconds_total"),
    )


def summary_details(images: DataFrame, findings: DataFrame, calls: DataFrame, configs: DataFrame) -> DataFrame:
    """What a run's summary says beside its totals: native values, asset classes, cost by stage and stored settings.

    Maps hold fixed vocabularies only: a value that no rubric allows counts as `other`. value_counts has them all.
    """
    known = sorted({value for values in ALLOWED_VALUES.values() for value in values})

    def as_map(counted: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(F.col(key), value)))
        return counted.groupBy("run_id").agg(F.map_from_entries(entries).alias(name))

    value = F.col("native_scale.value")
    named = F.when(value.isin(known), value).otherwise("other").alias("native_value")
    values = findings.groupBy("run_id", named).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("asset_class").isin(ASSET_CLASSES), F.col("asset_class")).otherwise("other").alias("asset_class")
    classes = images.groupBy("run_id", kind).agg(F.count(F.lit(1)).alias("n"))
    totals = F.struct("calls", "usd", "seconds", "input_tokens", "output_tokens")
    parts = [
        as_map(values, "native_value", F.col("n"), "native_values"),
        as_map(classes, "asset_class", F.col("n"), "asset_classes"),
        as_map(cost_by_stage(calls), "stage", totals, "cost_by_stage"),
        configs.select("run_id", F.col("settings").alias("config")),
    ]
    return _join_runs(parts)


def progress(images: DataFrame, routed_gate: DataFrame, findings: DataFrame, calls: DataFrame) -> DataFrame:
    """The live counters of a run, from what it has logged so far."""
    parts = [
        images.groupBy("run_id").agg(F.count(F.lit(1)).alias("images")),
        gate_counts(routed_gate),
        finding_counts(findings),
        call_totals(calls),
    ]
    return _join_runs(parts).select(
        "run_id",
        _zero("images"),
        _zero("gated"),
        _zero("routed"),
        _zero("unusable"),
        F.coalesce("graded_images", F.lit(0)).alias("graded"),
        _zero("findings"),
        F.round(F.coalesce("usd", F.lit(0.0)), 5).alias("usd"),
        F.round(F.coalesce("seconds_gate", F.lit(0.0)), 1).alias("seconds_gate"),
        F.round(F.coalesce("seconds_grade", F.lit(0.0)), 1).alias("seconds_grade"),
        *[_zero(name) for name in LEVELS],
    )


def run_metrics(routed_gate: DataFrame, findings: DataFrame, calls: DataFrame, *,
                images: DataFrame | None = None, disaster_runs: DataFrame | None = None,
                configs: DataFrame | None = None) -> DataFrame:
    """Flat metrics per run. A partial run counts what it has: missing logs are zero.

    `images` gives the size of a run's manifest; without it a run is as large as its gate log. Runs listed in
    `disaster_runs` are marked `surge`, the others `inspect`.
    """
    spark = findings.sparkSession
    parts = [gate_counts(routed_gate), finding_counts(findings), call_totals(calls)]
    if images is None:
        parts.append(routed_gate.groupBy("run_id").agg(F.count(F.lit(1)).alias("images")))
    else:
        parts.append(images.groupBy("run_id").agg(F.count(F.lit(1)).alias("images")))
    disaster = spark.createDataFrame([], "run_id string") if disaster_runs is None else disaster_runs
    parts.append(disaster.select("run_id").distinct().withColumn("mode", F.lit("surge")))
    settings = spark.createDataFrame([], "run_id string, gate string, grader string") if configs is None else configs
    parts.append(settings.select("run_id", "gate", "grader"))
    usd = F.round(F.coalesce("usd", F.lit(0.0)), 4)
    images_n = F.coalesce("images", "gated", F.lit(0))
    return _join_runs(parts).select(
        F.col("run_id").alias("run"),
        F.coalesce("mode", F.lit("inspect")).alias("mode"),
        F.coalesce("gate", F.lit("")).alias("gate"),
        F.coalesce("grader", F.lit("")).alias("grader"),
        images_n.alias("images"),
        _zero("gated"),
        _zero("routed"),
        _zero("unusable"),
        _zero("graded_images"),
        _zero("findings"),
        *[_zero(name) for name in LEVELS],
        usd.alias("usd_total"),
        F.round(ratio(usd, images_n), 5).alias("usd_per_image"),
        F.round(F.coalesce("seconds_gate", F.lit(0.0)), 1).alias("seconds_gate"),
        F.round(F.coalesce("seconds_grade", F.lit(0.0)), 1).alias("seconds_grade"),
        _zero("reviews"),
        F.coalesce("asset_classes", F.lit("")).alias("asset_classes"),
        F.coalesce("models", F.lit("")).alias("models"),
    )


def compare_runs(metrics: DataFrame) -> DataFrame:
    """Runs side by side, with model seconds per image (null without images)."""
    return metrics.select(
        "run",
        *LEVELS,
        "usd_per_image",
        "seconds_gate",
        "seconds_grade",
        "images",
        ratio(F.col("seconds_gate") + F.col("seconds_grade"), F.col("images")).alias("seconds_per_image"),
    )


def levels_long(counts: DataFrame, key: str = "run_id") -> DataFrame:
    """Level columns to one row per level."""
    return counts.unpivot(key, LEVELS, "level", "count")


def disaster_counts(findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Triage counts per run: one column per damage class and level, zero when absent, and mean confidence without U.

    Runs listed in `runs` that have no finding count zeros.
    """
    value, level = F.col("native_scale.value"), F.col("unified.level")
    assessed = F.when(level != "U", F.col("measurements.confidence"))
    counts = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_distinct(first_image()).alias("n_images"),
        *[F.count_if(value == name).alias(name) for name in DISASTER_CLASSES],
        F.count_if(~value.isin(DISASTER_CLASSES)).alias("other_values"),
        *[F.count_if(level == name).alias(name) for name in LEVELS],
        F.avg(assessed).alias("mean_confidence"),
    )
    if runs is not None:
        counts = counts.join(runs.select("run_id").distinct(), "run_id", "full_outer")
        counts = counts.fillna(0, [name for name in counts.columns if name not in ("run_id", "mean_confidence")])
    return counts.withColumn("u_rate", ratio(F.col("U"), F.col("n_findings")))


def disaster_class_counts(findings: DataFrame) -> DataFrame:
    """Counts per run and damage class in long form: every known class appears, unknown ones are appended."""
    counted = findings.groupBy("run_id", F.col("native_scale.value").alias("native_value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    runs = counted.select("run_id").distinct()
    domain = runs.select("run_id", F.explode(F.array(*map(F.lit, DISASTER_CLASSES))).alias("native_value"))
    return domain.join(counted, ["run_id", "native_value"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def ranked_list(queue: DataFrame) -> DataFrame:
    """The triage list in queue order, unranked rows last."""
    return queue.select(
        "run_id",
        F.col("queue_rank").alias("rank"),
        "finding_id",
        first_or_blank(F.col("evidence.image_ids")).alias("image_id"),
        F.col("native_scale.value").alias("native_value"),
        F.col("unified.level").alias("level"),
        F.col("measurements.confidence").alias("confidence"),
        F.col("action.code").alias("action"),
        F.col("action.sla_days").alias("sla_days"),
        "justification",
    ).orderBy("run_id", F.col("rank").asc_nulls_last())


def top_list(queue: DataFrame) -> DataFrame:
    """The rows of a report's top list, with the standard and the score."""
    listed = ["run_id", "rank", "finding_id", "image_id", "level", "native_value", "standard", "action", "sla_days", "score"]
    return queue.select(
        "run_id",
        F.col("queue_rank").alias("rank"),
        "finding_id",
        first_or_blank(F.col("evidence.image_ids")).alias("image_id"),
        F.col("unified.level").alias("level"),
        F.col("native_scale.value").alias("native_value"),
        F.col("native_scale.standard").alias("standard"),
        F.col("action.code").alias("action"),
        F.col("action.sla_days").alias("sla_days"),
        F.col("queue_score").alias("score"),
    ).orderBy(*listed[:2])


def worst_levels(findings: DataFrame) -> DataFrame:
    """The highest level of each image; U only when nothing else was found."""
    severity = F.coalesce(level_ordinal(F.col("level")), F.lit(-1))
    per_image = findings.select(
        "run_id", F.explode("evidence.image_ids").alias("image_id"), F.col("unified.level").alias("level")
    )
    return per_image.groupBy("run_id", "image_id").agg(F.max_by("level", severity).alias("level"))


def batch_status(summary: DataFrame, runs: list[str]) -> DataFrame:
    return summary.filter(F.col("run_id").isin(*runs)).select(
        "run_id", "images", "findings", "usd_total", F.col("routed_to_grader").alias("routed")
    )


def list_runs(gate: DataFrame) -> DataFrame:
    """Runs with gate rows, newest name first; names starting with an underscore are scratch runs."""
    return gate.filter(~F.col("run_id").startswith("_")).select("run_id").distinct().orderBy(F.col("run_id").desc())
