"""Structured Streaming forms: arriving manifests, live agreement, live counters and cost per time bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline import schemas
from faultline.operators.records import not_yet_gated
from faultline.operators.review import agreement
from faultline.operators.runs import cost_by_stage, priced
from faultline.operators.scoring import Scorer, check_scorer, gate_images, scorer_name
from faultline.sources.store import RunStore, file_system, new_job, open_run


def manifest_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.struct(schemas.IMAGES)).option("mode", "FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


#: Groups that a micro-batch's ids are dealt to, to find each id's least record.
ID_GROUPS = 4096


def _least_records(rows: pa.Table) -> pa.Table:
    """Of each image id of a group its least record, and none where the run has logged the id."""
    found = rows.group_by("image_id").aggregate([("record", "min"), ("logged", "max")])
    record = pc.if_else(found["logged_max"], pa.scalar(None, pa.string()), found["record_min"])
    return pa.table({"image_id": found["image_id"], "record": record})


def new_arrivals(images: DataFrame, store: RunStore, expiry: str | None = None) -> DataFrame:
    """The images of a stream that their run has not gated, each once, by state kept for every image id.

    The run's own log is a second stream: an id in it, whoever wrote it, is done. Each of its files is read once, so what a
    micro-batch costs depends on what is new and not on the length of the run. A micro-batch's rows are first reduced to one an
    id, many ids at a time; Spark's own state then drops the ids seen before. State is kept for good, or, with `expiry`
    (such as `30 days`), for that long after an id was seen last, by a Python function for each id; an id that comes back
    later counts as new. A checkpoint goes on with the kind of state it began with.
    """
    system, folder = file_system(store.folder("gate"))
    system.create_dir(folder, recursive=True)
    log = images.sparkSession.readStream.schema("image_id string").parquet(store.folder("gate"))
    known = log.select("image_id", F.lit(None).cast("string").alias("record"))
    arriving = images.select("image_id", F.to_json(F.struct(*images.columns)).alias("record"))
    rows = arriving.union(known)
    if expiry is None:
        dealt = rows.withColumn("logged", F.col("record").isNull()).groupBy(F.pmod(F.xxhash64("image_id"), F.lit(ID_GROUPS)).alias("part"))
        found = dealt.applyInArrow(_least_records, "image_id string, record string").dropDuplicates(["image_id"]).filter("record is not null")
    else:
        found = _seen_lately(rows, int(pd.Timedelta(expiry).total_seconds() * 1000))
    return found.select(F.from_json("record", images.schema).alias("image")).select("image.*")


def _seen_lately(rows: DataFrame, wait: int) -> DataFrame:
    """The least record of each id that has no row without a record and was not seen in the last `wait` milliseconds."""

    def first_seen(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, records, done = state.exists, [], False
        for part in rows:
            records += [record for record in part["record"] if record is not None]
            done = done or part["record"].isna().any()
        state.update((True,))
        state.setTimeoutDuration(wait)
        if records and not seen and not done:
            yield pd.DataFrame({"image_id": [key[0]], "record": [min(records)]})

    return rows.groupBy("image_id").applyInPandasWithState(
        first_seen, "image_id string, record string", "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def gate_arrivals(images: DataFrame, root: str, run_id: str, gate: Scorer, checkpoint: str, prices: DataFrame | None = None,
                  expiry: str | None = None, commit_rows: int = 500) -> StreamingQuery:
    """Gate each arriving image of a run once; its call costs what `prices` say.

    The checkpoint skips files already taken and holds the ids seen; ids that the run gated otherwise come from its log. A batch
    that is replayed after it had saved some of its rows skips those: their files are named by the batch.
    """
    check_scorer("gate", gate)
    spark = images.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = open_run(spark, root, run_id, {"gate": scorer_name(gate)}, tasks)
    stream_key = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def gate_batch(batch: DataFrame, number: int) -> None:
        of_batch = f"{stream_key}.{number}."
        saved = store.files("gate", f"part-{of_batch}")
        todo = batch if not saved else not_yet_gated(batch, batch.sparkSession.read.schema("image_id string").parquet(*saved))
        scored = gate_images(todo, gate)
        costed = scored.withColumn("usd", F.lit(0.0)) if prices is None else priced(scored, prices)
        store.append(costed.select(*schemas.struct(schemas.GATE_LOG).fieldNames()), "gate", f"{of_batch}{new_job()}", commit_rows)

    return (
        new_arrivals(images, store, expiry)
        .writeStream.foreachBatch(gate_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_agreement(reviews: DataFrame) -> DataFrame:
    """Agreement per run over a stream of decisions."""
    return agreement(reviews)


def live_costs(calls: DataFrame) -> DataFrame:
    """Calls, cost, seconds and tokens per run and stage over the stream of call rows."""
    return cost_by_stage(calls)


def cost_per_bucket(calls: DataFrame, bucket: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Live costs per time bucket of the call's own timestamp, for a sink in update mode.

    A bucket comes out whenever it changes, so the newest ones are there before they close; rows later than
    `lateness` are left out, which bounds the state.
    """
    timed = calls.withWatermark("ts", lateness)
    return timed.groupBy("run_id", "stage", F.window("ts", bucket)).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("usd").alias("usd"), F.max("ts").alias("last_ts")
    )


def latest_buckets(updates: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The last state of each bucket from its updates (with `batch`, their number), and whether it can still change."""
    facts = F.struct("calls", "usd", "last_ts")
    latest = updates.groupBy("run_id", "stage", "window").agg(F.max_by(facts, "batch").alias("_last"))
    newest = updates.agg(F.max("last_ts").alias("_newest"))  # one row
    closed = F.col("window.end") <= F.col("_newest") - F.expr(f"interval {lateness}")
    return latest.join(F.broadcast(newest)).select("run_id", "stage", "window", "_last.calls", "_last.usd", closed.alias("closed"))
