import os
import random
import statistics
import sys
import time
from collections import Counter

import builders
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from faultline.operators.runs import cost_by_stage, median_seconds
from faultline.plans.batch import RunSettings, run_batch
from faultline.sources import readers, writers
from faultline.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_each_arriving_image_is_gated_once(spark, tmp_path):
    root, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "inbox", "checkpoint"))

    def arrive(name, ids):
        writers.write_manifest(builders.images(spark, [{"image_id": f"img_{at}"} for at in ids]), f"{inbox}/{name}")
        stream = live.manifest_stream(spark, f"{inbox}/*", files_per_trigger=1)
        live.gate_arrivals(stream, root, "run", builders.fake_gate, checkpoint).awaitTermination()
        return sorted(r.image_id for r in readers.load_gate(spark, root).collect())

    assert arrive("one", [0, 1, 2, 2]) == ["img_0", "img_1", "img_2"]
    assert arrive("two", [2, 3]) == ["img_0", "img_1", "img_2", "img_3"]
    raw = spark.read.parquet(f"{root}/gate")
    assert raw.count() == 4


def test_images_gated_by_a_batch_job_are_not_gated_again(spark, tmp_path):
    root, inbox = str(tmp_path / "store"), str(tmp_path / "inbox")
    images = builders.images(spark, [{"image_id": f"img_{at}"} for at in range(6)])
    run_batch(images.limit(4), root, "run", builders.fake_gate, None, "2026-09-25", settings=RunSettings(exports=False))
    writers.write_manifest(images, f"{inbox}/one")
    told = live.manifest_stream(spark, f"{inbox}/*")
    live.gate_arrivals(told, root, "run", builders.fake_gate, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{root}/gate").count() == 6
    # The stream's verdicts are bucketed like those of a batch run, which can go on with them.
    got = run_batch(images, root, "run", builders.fake_gate, builders.fake_grade, "2026-09-25", settings=RunSettings(exports=False)).first()
    assert (got.gated, got.findings) == (6, 5) and spark.read.parquet(f"{root}/gate").count() == 6


def test_a_batch_that_failed_half_way_skips_what_it_saved(spark, tmp_path):
    root, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "inbox", "checkpoint"))
    writers.write_manifest(builders.images(spark, [{"image_id": f"img_{at}"} for at in range(30)]), f"{inbox}/one")
    calls, fuse = tmp_path / "calls", tmp_path / "fuse"
    calls.mkdir()
    fuse.touch()

    def gate(image):
        (calls / f"{image['image_id']}.{time.time_ns()}").touch()
        if fuse.exists() and len(list(calls.iterdir())) > 20:
            time.sleep(2)
            os._exit(1)
        return builders.fake_gate(image)

    def start():
        return live.gate_arrivals(live.manifest_stream(spark, f"{inbox}/*"), root, "run", gate, checkpoint, commit_rows=2)

    with pytest.raises(Exception, match="worker|crashed|exit|terminated"):
        start().awaitTermination()
    saved = {r.image_id for r in spark.read.parquet(f"{root}/gate").collect()}
    fuse.unlink()
    start().awaitTermination()
    raw = [r.image_id for r in spark.read.parquet(f"{root}/gate").collect()]
    assert len(raw) == len(set(raw)) == 30
    times = Counter(path.name.split(".")[0] for path in calls.iterdir())
    assert saved and all(times[name] == 1 for name in saved)


def test_the_plan_of_a_batch_does_not_read_the_run(spark, tmp_path):
    """Each file of the run's log is read by one micro-batch only."""
    root, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "inbox", "checkpoint"))
    read = []
    for number in range(4):
        writers.write_manifest(builders.images(spark, [{"image_id": f"img_{number}_{at}"} for at in range(10)]), f"{inbox}/{number}")
        query = live.gate_arrivals(live.manifest_stream(spark, f"{inbox}/*"), root, "run", builders.fake_gate, checkpoint)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert read[1:] == [20, 20, 20]  # ten arrivals and ten rows that the batch before had logged


def test_ids_are_told_apart_by_sparks_own_state(spark, tmp_path):
    """No Python function is called for each image id; an id that the log told first is known when it arrives later."""
    root, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "inbox", "checkpoint"))
    images = builders.images(spark, [{"image_id": f"img_{at}", "path": f"{at}.jpg"} for at in range(6)])
    run_batch(images.limit(4), root, "run", builders.fake_gate, None, "2026-09-25", settings=RunSettings(exports=False))
    again = images.filter("image_id = 'img_5'").withColumn("path", F.lit("0.jpg"))
    stream = live.manifest_stream(spark, f"{inbox}/*")
    for name, arrival in (("one", images.filter("image_id = 'img_5'").union(again)), ("two", images)):
        writers.write_manifest(arrival, f"{inbox}/{name}")
        live.gate_arrivals(stream, root, "run", builders.fake_gate, checkpoint).awaitTermination()
    assert sorted(r.image_id for r in spark.read.parquet(f"{root}/gate").collect()) == [f"img_{at}" for at in range(6)]
    plan = live.new_arrivals(stream, live.RunStore(spark, root, "run", 8))._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" not in plan and "Deduplicate" in plan
    lasting = live.new_arrivals(stream, live.RunStore(spark, root, "run", 8), "30 days")._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" in lasting


def test_live_costs_equal_batch(spark, tmp_path):
    rows = [(f"run{at % 2}", "gate" if at % 3 else "grade", at * 10, at, at / 8, at / 16, f"2026-09-25 0{at % 9}:30:00") for at in range(60)]
    calls = spark.createDataFrame(
        rows, "run_id string, stage string, input_tokens bigint, output_tokens bigint, seconds double, usd double, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    calls.repartition(5).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    seen = {}

    def keep(batch, number):
        seen[number] = sorted(map(tuple, batch.collect()))

    live.live_costs(stream).writeStream.foreachBatch(keep).outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    assert seen[max(seen)] == sorted(map(tuple, cost_by_stage(calls).collect()))


def test_arrivals_cost_what_the_prices_say(spark, tmp_path):
    root, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "inbox", "checkpoint"))
    writers.write_manifest(builders.images(spark, [{"image_id": "img_0"}]), f"{inbox}/one")
    prices = spark.createDataFrame([("fake-gate", 1000.0, 2000.0)] * 2, "model string, usd_per_mtok_in double, usd_per_mtok_out double")
    live.gate_arrivals(live.manifest_stream(spark, f"{inbox}/*"), root, "run", builders.fake_gate, checkpoint, prices).awaitTermination()
    assert readers.load_gate(spark, root).first().usd == (16 * 1000 + 4 * 2000) / 1e6


def test_every_bucket_is_there_in_its_last_state(spark, tmp_path):
    rows = [("run", "gate", at / 8, f"2026-09-25 0{at % 9}:30:00") for at in range(60)]
    calls = spark.createDataFrame(rows, "run_id string, stage string, usd double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    calls.repartition(4).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.parquet(str(tmp_path / "updates"), mode="append")

    live.cost_per_bucket(stream, lateness="12 hours").writeStream.foreachBatch(keep).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    got = live.latest_buckets(spark.read.parquet(str(tmp_path / "updates"))).orderBy("window").collect()
    assert [r.calls for r in got] == [7, 7, 7, 7, 7, 7, 6, 6, 6] and sum(r.usd for r in got) == sum(r[2] for r in rows)
    assert [r.closed for r in got] == [True] * 6 + [False] * 3


def test_median_of_the_seconds_as_logged(spark):
    rows = [("a", 0.00049)] * 3 + [("b", 1.0), ("b", 0.25), ("b", 4.0), ("b", 0.5), ("c", None)]
    got = median_seconds(spark.createDataFrame(rows, "run_id string, seconds double"), ["run_id"]).collect()
    assert {r.run_id: r.median_seconds for r in got} == {"a": 0.00049, "b": 0.75}


def test_medians_of_skewed_and_close_values(spark):
    choose = random.Random(4)
    groups = {
        "one": [3.5],
        None: [1.0, 2.0, 8.0],
        "close": [1.0 + at * 2.0**-52 for at in range(8)],  # all but the last bits are equal
        "signs": [-1.5, -0.0, 0.0, 2.0, -1e300, 1e-310],
        "hot": [0.125] * 900 + [choose.random() for _ in range(1101)],
        "wide": [10.0 ** choose.uniform(-20, 20) * choose.choice([-1, 1]) for _ in range(400)],
    }
    rows = [(name, "m", value) for name, values in groups.items() for value in values]
    choose.shuffle(rows)
    got = median_seconds(spark.createDataFrame(rows, "run_id string, model string, seconds double").repartition(5), ["run_id", "model"])
    assert {r.run_id: r.median_seconds for r in got.collect()} == {name: statistics.median(values) for name, values in groups.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [seconds" not in plan
    assert median_seconds(spark.createDataFrame([], "run_id string, seconds double"), ["run_id"]).isEmpty()
