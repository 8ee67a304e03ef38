"""The batch run: gate, route, grade, rank, export, and the review step that re-ranks.

The image records are written once, bucketed by id, and every stage scans that table. Each stage writes its rows before
the next reads them: scorers are slow, paid for and not repeatable, so no two actions share an unwritten scorer result.
Verdicts and findings are saved by each task while the stage runs (sources/store.py) and bucketed alike, so a rerun finds
what is left to score without a shuffle.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.fixed_values import FORCED_CLASSES, MIN_CLEAN_CONFIDENCE
from faultline.functions.columns import lookup
from faultline.functions.routing import pass_through_verdict, with_routing
from faultline.functions.tiles import explode_targets
from faultline.operators.queue import ASSET_COLUMNS, scored_findings
from faultline.operators.records import for_disaster, not_yet_gated, one_row_per
from faultline.operators.review import apply_reviews
from faultline.operators.runs import disaster_counts, priced, progress, ranked_list, summarise, summary_details, tariff
from faultline.operators.scoring import (
    Scorer,
    check_scorer,
    gate_images,
    grade_targets,
    graded_findings,
    scorer_name,
    unusable_findings,
)
from faultline.operators.validation import (
    BUILT_IN,
    RUBRIC_COLUMNS,
    effective_rubric,
    image_rules,
    rubric_rows,
    rubrics_by_standard,
    standard_for,
    with_violations,
)
from faultline.session import materialise
from faultline.sources import ranking, readers, writers
from faultline.sources.store import RunStore, new_job, open_run, run_configs, saved_ids


@dataclass
class RunSettings:
    tiles: bool = False
    min_confidence: float = MIN_CLEAN_CONFIDENCE
    forced_classes: tuple[str, ...] = tuple(FORCED_CLASSES)
    bridge_alternative: bool = False
    limit: int = 0
    scorer_tasks: int = 0  # buckets of a new run, each scored by one task; 0: as many as shuffles have
    calls_at_once: int = 1  # of each task
    commit_rows: int = 500  # rows that a task scores before it saves them
    progress_seconds: float = 10.0  # between two looks at a running stage
    exports: bool = True


#: Models that a price list may name; it is sent to every task.
MAX_PRICED_MODELS = 10_000


def _price_list(prices: DataFrame | None) -> DataFrame | None:
    """The prices, one row a model, checked to be few: a join that moved scored rows would delay their saving."""
    if prices is None:
        return None
    listed = materialise(tariff(prices), "prices")
    if listed.count() > MAX_PRICED_MODELS:
        raise ValueError(f"a price list names at most {MAX_PRICED_MODELS} models")
    return F.broadcast(listed)


def _priced(rows: DataFrame, prices: DataFrame | None) -> DataFrame:
    return rows.withColumn("usd", F.lit(0.0)) if prices is None else priced(rows, prices)


def ungated(store: RunStore) -> DataFrame:
    """The run's images without a verdict; the buckets of both tables meet where they lie."""
    return not_yet_gated(store.images(), store.gate().hint("merge"))


def _gate_stage(store: RunStore, gate: Scorer | None, settings: RunSettings, prices: DataFrame | None) -> None:
    todo, job = ungated(store), new_job()
    if gate is None:
        usage = schemas.struct(schemas.USAGE)
        blank = {f.name: F.lit(None).cast(f.dataType) for f in usage.fields}
        blank |= {"model": F.lit("none"), "input_tokens": F.lit(0).cast("bigint"), "output_tokens": F.lit(0).cast("bigint"),
                  "seconds": F.lit(0.0), "note": F.lit(""), "ts": F.current_timestamp()}
        verdicts = pass_through_verdict(todo.select("image_id", "asset_class")).withColumns(blank)
    else:
        verdicts = gate_images(todo, gate, settings.calls_at_once, saved_ids(store.folder("gate"), job, "image_id"))
    rows = _priced(verdicts, prices).select(*schemas.struct(schemas.GATE_LOG).fieldNames())
    store.append(rows, "gate", job, settings.commit_rows)


def routed_gate(spark: SparkSession, root: str, settings: RunSettings) -> DataFrame:
    return with_routing(readers.load_gate(spark, root), settings.min_confidence, settings.forced_classes)


def grading_targets(images: DataFrame, gate: DataFrame, settings: RunSettings) -> DataFrame:
    """What the grader is asked: one row per tile of a routed, usable image, with the standard to grade on."""
    wanted = gate.filter("routed and usable").select("image_id")
    targets = explode_targets(images.join(wanted, "image_id", "left_semi"), settings.tiles)
    return targets.withColumn("standard", standard_for(F.col("asset_class"), settings.bridge_alternative))


def _run_verdicts(store: RunStore, settings: RunSettings) -> DataFrame:
    verdicts = store.gate().dropDuplicates(["image_id"])
    return with_routing(verdicts, settings.min_confidence, settings.forced_classes)


def _graded(store: RunStore) -> DataFrame:
    """The findings each image has; an image has at most one for each of its tiles."""
    return store.findings().groupBy("image_id").agg(F.collect_set("finding_id").alias("_graded"))


def _without_finding(targets: DataFrame, graded: DataFrame) -> DataFrame:
    joined = targets.join(graded.hint("merge"), "image_id", "left")
    return joined.filter(~F.coalesce(F.array_contains("_graded", F.col("finding_id")), F.lit(False))).drop("_graded")


def ungraded(store: RunStore, settings: RunSettings) -> DataFrame:
    """The run's grading targets without a finding, so a run stopped between tiles resumes at the next tile."""
    targets = grading_targets(store.images(), _run_verdicts(store, settings).hint("merge"), settings)
    return _without_finding(targets, _graded(store))


def _grade_stage(store: RunStore, grade: Scorer, settings: RunSettings, prices: DataFrame | None, exemplars: DataFrame | None,
                 rubric: list[dict]) -> None:
    versions = {row["standard"]: row["version"] for row in rubric}
    version = F.coalesce(lookup(F.col("native_scale.standard"), versions), F.lit(BUILT_IN))
    fields = schemas.struct(schemas.FINDING_LOG).fieldNames()
    unusable = _run_verdicts(store, settings).filter("routed and not usable").select("image_id", "reason", "model")
    whole = unusable_findings(store.images().join(unusable.hint("merge"), "image_id").withColumn("standard", standard_for(F.col("asset_class"), settings.bridge_alternative)))
    blank = {
        f.name: F.lit(None).cast(f.dataType)
        for f in schemas.struct(schemas.FINDING_LOG).fields
        if f.name in ("input_tokens", "output_tokens", "note", "ts", "call_seconds", "call_usd")
    }
    unusable = _without_finding(whole, _graded(store)).withColumns(blank | {"rubric_version": version})
    store.append(unusable.select(*fields), "findings", new_job(), settings.commit_rows)
    job = new_job()
    saved = saved_ids(store.folder("findings"), job, "finding_id")
    answers = _priced(grade_targets(ungraded(store, settings), grade, exemplars, settings.calls_at_once, saved, rubrics_by_standard(rubric)), prices)
    store.append(graded_findings(answers).withColumn("rubric_version", version).select(*fields), "findings", job, settings.commit_rows)


def captured_dates(images: DataFrame, assets: DataFrame | None) -> DataFrame:
    """The asset attributes a queue needs. The capture date stands in where a register has no date for an image."""
    captured = one_row_per(images.select("image_id", "captured_on"), "image_id")
    blank = {name: F.lit(None).cast("double") for name in ("criticality", "production_loss_factor", "occupancy_factor")}
    if assets is None:
        return captured.withColumns(blank).withColumn("found_on", F.col("captured_on"))
    register = one_row_per(assets.select("image_id", *ASSET_COLUMNS), "image_id")
    joined = register.join(captured, "image_id", "full_outer")
    return joined.withColumn("found_on", F.coalesce("found_on", "captured_on"))


def _scored_findings(images: DataFrame, root: str, run_id: str, today: dt.date | str, assets: DataFrame | None, findings: DataFrame,
                     keyed: bool = False, reviewed: bool = True) -> DataFrame:
    """A run's raw `findings` with the reviews so far, scored for its queue. `keyed`: by their image_id; not `reviewed`: there is no review."""
    spark = images.sparkSession
    fields = [*schemas.struct(schemas.FINDINGS).fieldNames(), "run_id", *(["image_id"] if keyed else [])]
    found = findings.select(*fields)
    if reviewed:
        found = apply_reviews(found, readers.load_reviews(spark, root).filter(F.col("run_id") == run_id))
    return scored_findings(found, captured_dates(images, assets), today, keyed=keyed)


#: The last decision of a run without any.
NO_REVIEW = -1


def _last_review(spark: SparkSession, root: str, run_id: str) -> tuple[int, bool]:
    """The last decision on a run, and whether there is one."""
    reviews = readers.load_reviews(spark, root).filter(F.col("run_id") == run_id)
    found = reviews.agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).first()
    return NO_REVIEW if found["last"] is None else found["last"], found["n"] > 0


def _exported(spark: SparkSession, root: str, run_id: str, exports: bool) -> DataFrame:
    if exports:
        queue, folder = ranking.queue_in_order(spark, root, run_id), f"{root.rstrip('/')}/exports/{run_id}"
        writers.write_queue_csv(queue, f"{folder}/queue_csv", in_order=True)
        writers.write_bridge_csv(queue, f"{folder}/bridge_csv", in_order=True)
        writers.write_findings_json(queue, f"{folder}/findings_json", in_order=True)
    return ranking.load_queue(spark, root).filter(F.col("run_id") == run_id)


def save_ranked(images: DataFrame, root: str, run_id: str, today: dt.date | str, *, assets: DataFrame | None = None,
                exports: bool = True) -> DataFrame:
    """Apply the reviews so far, rank a run anew and rewrite its queue and exports. Returns the stored queue."""
    findings = readers.load_raw_findings(images.sparkSession, root).filter(F.col("run_id") == run_id)
    return _rank(images, root, run_id, today, assets, exports, findings)


def _rank(images: DataFrame, root: str, run_id: str, today: dt.date | str, assets: DataFrame | None, exports: bool,
          findings: DataFrame, keyed: bool = False) -> DataFrame:
    spark = images.sparkSession
    last, reviewed = _last_review(spark, root, run_id)
    scored = _scored_findings(images, root, run_id, today, assets, findings, keyed, reviewed)
    ranking.write_ranking(scored, root, run_id, str(today), last)
    return _exported(spark, root, run_id, exports)


def store_findings(store: RunStore) -> DataFrame:
    """A run's findings as its queue is made of them: copies of a finding lie in its image's bucket, so nothing is moved to tell them."""
    return store.findings().dropDuplicates(["image_id", "finding_id"]).withColumn("run_id", F.lit(store.run_id))


def requeue(images: DataFrame, root: str, run_id: str, today: dt.date | str, *, assets: DataFrame | None = None,
            exports: bool = True) -> DataFrame:
    """The queue of `save_ranked` after new decisions: only findings decided since the last ranking are scored and moved.

    Urgency depends on the day, so on another day the run is ranked anew. `images` and `assets` are those of the ranking.
    """
    spark = images.sparkSession
    parts = ranking.read_manifest_rows(spark, root, run_id)
    if not parts or parts[0]["today"] != str(today):
        return save_ranked(images, root, run_id, today, assets=assets, exports=exports)
    last, _ = _last_review(spark, root, run_id)
    decided = readers.load_reviews(spark, root).filter((F.col("run_id") == run_id) & (F.col("id") > parts[0]["reviewed"]))
    logged = readers.logged_findings(spark, root).filter(F.col("run_id") == run_id)
    changed = readers.one_of_each_finding(logged.join(decided.select("finding_id").distinct(), "finding_id", "left_semi"))
    ranking.merge_changes(_scored_findings(images, root, run_id, today, assets, changed), root, run_id, str(today), last)
    return _exported(spark, root, run_id, exports)


def checked_images(images: DataFrame, limit: int = 0) -> DataFrame:
    """The rows of the images, read once from the source. A bad row stops the run before any scorer is called.

    With a limit, of the first rows in manifest order.
    """
    checked = materialise(with_violations(images, image_rules()), "manifest")
    broken = checked.filter(F.size("violations") > 0).select(F.explode("violations").alias("rule"))
    rules = broken.groupBy("rule").count().orderBy("rule").collect()
    if rules:
        raise ValueError("images break their contract: " + ", ".join(f"{r['rule']} {r['count']}" for r in rules))
    if limit:
        checked = checked.orderBy("pos" if "pos" in checked.columns else "image_id").limit(limit)
    return checked.drop("violations")


def _watched(stage: str, work: Callable[[], None], store: RunStore, table: str, seconds: float, seen: Callable[[str, int], None] | None) -> None:
    """Do a stage's work; meanwhile tell `seen` how many rows its tasks have saved. Only names of files are read for that."""
    if seen is None:
        return work()
    ended, problems = threading.Event(), []

    def look() -> None:
        try:
            while not ended.wait(seconds):
                seen(stage, store.saved_rows(table))
        except Exception as problem:  # told when the stage is over: a broken view is no reason to lose paid work
            problems.append(problem)

    watcher = threading.Thread(target=look, daemon=True)
    watcher.start()
    try:
        work()
    finally:
        ended.set()
        watcher.join()
    if problems:
        raise problems[0]
    seen(stage, store.saved_rows(table))


def run_progress(images: DataFrame, root: str, run_id: str, settings: RunSettings | None = None) -> DataFrame:
    """The live counters of a run from what its tables hold now."""
    spark, this_run = images.sparkSession, F.col("run_id") == run_id
    return progress(
        images.withColumn("run_id", F.lit(run_id)),
        routed_gate(spark, root, settings or RunSettings()).filter(this_run),
        readers.load_raw_findings(spark, root).filter(this_run),
        readers.load_calls(spark, root).filter(this_run),
    )


def run_batch(images: DataFrame, root: str, run_id: str, gate: Scorer | None, grade: Scorer | None,
              today: dt.date | str, *, settings: RunSettings | None = None, prices: DataFrame | None = None,
              exemplars: DataFrame | None = None, assets: DataFrame | None = None, rubric: DataFrame | None = None,
              on_stage: Callable[[str, Row], None] | None = None,
              on_progress: Callable[[str, int], None] | None = None) -> DataFrame:
    """Run or resume one run over `images` and return its one-row summary.

    `gate=None` passes every image on; `grade=None` stops after routing. `on_stage` is called with the counters so
    far after each stage, `on_progress` with a stage and the rows of its log every `progress_seconds` while it runs.
    `rubric` (readers.read_rubrics) replaces the built-in rows of the standards it has rows for; every finding keeps the
    version it was graded by, and the run's rubric is stored beside it (store.read_rubric_versions).
    """
    settings = settings or RunSettings()
    for name, scorer in (("gate", gate), ("grade", grade)):
        if scorer is not None:
            check_scorer(name, scorer)
    spark = images.sparkSession
    graded_by = rubric_rows(effective_rubric(rubric, spark))
    checked, listed = checked_images(images, settings.limit), _price_list(prices)
    named = {"gate": scorer_name(gate), "grader": scorer_name(grade)}
    tasks = settings.scorer_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = open_run(spark, root, run_id, asdict(settings) | named, tasks)
    images = store.save_images(checked)
    store.save_rubric(spark.createDataFrame([tuple(row[name] for name in RUBRIC_COLUMNS) for row in graded_by], schemas.RUBRIC))

    def report(stage: str) -> None:
        if on_stage is not None:
            on_stage(stage, run_progress(images, root, run_id, settings).first())

    _watched("gate", lambda: _gate_stage(store, gate, settings, listed), store, "gate", settings.progress_seconds, on_progress)
    report("gate")
    if grade is not None:
        _watched("grade", lambda: _grade_stage(store, grade, settings, listed, exemplars, graded_by), store, "findings", settings.progress_seconds, on_progress)
        report("grade")
    queue = _rank(images, root, run_id, today, assets, settings.exports, store_findings(store), keyed=True)
    this_run = F.col("run_id") == run_id
    of_run, calls = images.withColumn("run_id", F.lit(run_id)), readers.load_calls(spark, root).filter(this_run)
    summary = summarise(of_run, routed_gate(spark, root, settings).filter(this_run), queue, calls)
    if settings.exports:
        told = summary.join(summary_details(of_run, queue, calls, run_configs(spark, root).filter(this_run)), "run_id", "left")
        writers.write_summary(told, f"{root.rstrip('/')}/exports/{run_id}/summary_json")
    report("done")
    return summary


def disaster_images(spark: SparkSession, *, folder: str | None = None, manifest: str | None = None) -> DataFrame:
    """Images of a disaster run: a whole folder, or the building images of a manifest."""
    if (folder is None) == (manifest is None):
        raise ValueError("a disaster run needs either a folder or a manifest")
    if manifest is not None:
        return for_disaster(readers.read_manifest(spark, manifest, position=True))
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return readers.scan_folder(
        spark, folder, "building_disaster", source_dataset=name, split="surge", prefix="surge"
    )


def run_disaster(spark: SparkSession, root: str, run_id: str, gate: Scorer | None, grade: Scorer | None,
                 today: dt.date | str, *, folder: str | None = None, manifest: str | None = None,
                 settings: RunSettings | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """A triage run over whole frames. Returns the counts and the ranked list."""
    images = disaster_images(spark, folder=folder, manifest=manifest)
    settings = replace(settings or RunSettings(), tiles=False)
    run_batch(images, root, run_id, gate, grade, today, settings=settings, **options)
    queue = ranking.load_queue(spark, root).filter(F.col("run_id") == run_id)
    counts = disaster_counts(queue, spark.range(1).select(F.lit(run_id).alias("run_id")))
    if settings.exports:
        writers.write_summary(counts, f"{root.rstrip('/')}/exports/{run_id}/surge_counts_json")
    return counts, ranked_list(queue)


def record_reviews(reviews: DataFrame, root: str) -> None:
    """Append decisions. `prior_level` is derived when they are replayed, not taken from the caller."""
    fields = [name for name in schemas.struct(schemas.REVIEWS).fieldNames() if name != "run_id"]
    writers.append_log(reviews.select(*fields, "run_id"), root, "reviews")
