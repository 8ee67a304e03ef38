"""The queue in sorted parts: ranks on read, exports in order, and reviews that touch only the parts they change."""

import csv
import json
import pathlib
import random

import builders
import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import ordered
from faultline.operators.queue import rank_queue
from faultline.plans.batch import record_reviews, requeue, save_ranked
from faultline.sources import ranking, readers, writers

TODAY = "2026-09-25"
LEVELS = ["S0", "S1", "S2", "S3", "S4", "U"]


def stored_findings(spark, root, n, run_id="run", seed=1):
    choose = random.Random(seed)
    rows = [builders.finding(f"img_{at}/full", choose.choice(LEVELS), run_id=run_id, asset_class=choose.choice(["steel_coating", "bridge_element"])) for at in range(n)]
    choose.shuffle(rows)
    writers.append_log(builders.findings(spark, rows).repartition(3), root, "findings")
    return builders.images(spark, [{"image_id": f"img_{at}", "captured_on": f"2026-0{1 + at % 9}-11"} for at in range(n)])


def decide(spark, root, decisions, run_id="run"):
    rows = [(number, run_id, f"img_{at}/full", action, None, level, "alice") for number, at, action, level in decisions]
    reviews = spark.createDataFrame(rows, "id bigint, run_id string, finding_id string, action string, prior_level string, new_level string, reviewer string")
    record_reviews(reviews.withColumn("reviewed_at", F.lit("2026-09-25 12:00:00").cast("timestamp")), root)


def plain_order(rows):
    return sorted(rows, key=lambda r: (r.unified.level != "S4", r.unified.level == "U", -(r.queue_score or 0.0), r.finding_id))


def check_queue(queue, n):
    rows = sorted(queue.collect(), key=lambda r: r.queue_rank)
    assert [r.queue_rank for r in rows] == list(range(1, n + 1))
    assert [r.finding_id for r in rows] == [r.finding_id for r in plain_order(rows)]
    return rows


def exported(folder):
    """The ids of an export, in the order of its part files and of their rows."""
    out = []
    for path in sorted(pathlib.Path(folder).glob("part-*")):
        with open(path, newline="") as file:
            out += [row["finding_id"] for row in csv.DictReader(file)] if path.suffix == ".csv" else [json.loads(line)["finding_id"] for line in file]
    return out


@pytest.fixture
def small_parts(spark):
    """Many parts, so that a change touches few of them."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_ranks_and_exports_follow_the_order(spark, tmp_path, small_parts):
    root = str(tmp_path / "a store")
    images = stored_findings(spark, root, 200)
    rows = check_queue(save_ranked(images, root, "run", TODAY), 200)
    ids = [r.finding_id for r in rows]
    folder = tmp_path / "a store" / "exports" / "run"
    assert exported(folder / "queue_csv") == ids and exported(folder / "findings_json") == ids
    assert exported(folder / "bridge_csv") == [r.finding_id for r in rows if r.asset_class == "bridge_element"]
    parts = ranking.read_manifest_rows(spark, root, "run")
    assert len(parts) > 4 and sum(p["n"] for p in parts) == 200
    assert all(ranking._order(a["last"]) < ranking._order(b["first"]) for a, b in zip(parts, parts[1:], strict=False))
    # The exports read the stored order: nothing is sorted again.
    plan = ranking.queue_in_order(spark, root, "run")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan


def test_a_review_moves_findings_between_parts(spark, tmp_path, small_parts):
    root, other = str(tmp_path / "store"), str(tmp_path / "other")
    for folder in (root, other):
        images = stored_findings(spark, folder, 200)
        stored_findings(spark, folder, 30, run_id="second", seed=2)
    save_ranked(images, root, "run", TODAY, exports=False)
    save_ranked(images, root, "second", TODAY, exports=False)
    before = {p["file"] for p in ranking.read_manifest_rows(spark, root, "run")}
    rounds = [
        [(1, 7, "overridden", "S4"), (2, 8, "accepted", None)],
        [(3, 7, "overridden", "S0"), (4, 9, "marked_u", None), (5, 7, "marked_u", None)],
        [],
        [(6 + at, at, "overridden", "S4") for at in range(60)],
    ]
    for decisions in rounds:
        for folder in (root, other):
            if decisions:
                decide(spark, folder, decisions)
        got = check_queue(requeue(images, root, "run", TODAY, exports=False), 200)
        want = check_queue(save_ranked(images, other, "run", TODAY, exports=False), 200)
        assert got == want
        after = {p["file"] for p in ranking.read_manifest_rows(spark, root, "run")}
        if 0 < len(decisions) < 10:
            assert before & after and after - before
        elif not decisions:
            assert before == after
        before = after
    assert len(check_queue(ranking.load_queue(spark, root).filter("run_id = 'second'"), 30)) == 30


def test_another_day_ranks_anew(spark, tmp_path):
    root = str(tmp_path / "store")
    images = stored_findings(spark, root, 20)
    save_ranked(images, root, "run", TODAY, exports=False)
    later = check_queue(requeue(images, root, "run", "2026-10-25", exports=False), 20)
    assert later == check_queue(save_ranked(images, root, "run", "2026-10-25", exports=False), 20)


def test_a_run_without_findings_has_an_empty_queue(spark, tmp_path):
    root = str(tmp_path / "store")
    images = builders.images(spark, [{"image_id": "img_0"}])
    assert save_ranked(images, root, "run", TODAY).isEmpty() and requeue(images, root, "run", TODAY).isEmpty()
    assert readers.load_findings(spark, root).columns == [*schemas.struct(schemas.QUEUE).fieldNames(), "run_id"]


def test_changed_findings_alone_are_shuffled(spark, tmp_path, small_parts):
    """Ids of unchanged findings are read in place; a merge reads whole rows of the touched parts only."""
    root = str(tmp_path / "store")
    images = stored_findings(spark, root, 100)
    save_ranked(images, root, "run", TODAY, exports=False)
    decide(spark, root, [(1, 3, "overridden", "S4")])
    raw = readers.load_raw_findings(spark, root).filter("run_id = 'run' and finding_id = 'img_3/full'")
    from faultline.plans.batch import _scored_findings

    parts = len(ranking.read_manifest_rows(spark, root, "run"))
    written = ranking.merge_changes(_scored_findings(images, root, "run", TODAY, None, raw), root, "run", TODAY, 1)
    assert 1 <= written <= 2 < parts
    assert check_queue(ranking.load_queue(spark, root), 100)[0].unified.level == "S4"


def test_the_part_of_a_key_is_found_without_python(spark):
    choose = random.Random(5)

    def key():
        return (choose.choice([None, False, True]), choose.random() < 0.5, float(choose.randrange(-3, 1)), f"img_{choose.randrange(99)}")

    for n in (1, 2, 3, 37):
        fences = sorted({key() for _ in range(n)}, key=ranking._order)
        keys = [key() for _ in range(100)] + fences
        given = spark.createDataFrame([(k, fences) for k in keys], f"key {schemas.QUEUE_KEY}, fences array<{schemas.QUEUE_KEY}>")
        got = given.select("key", ranking.part_of(F.col("key"), F.col("fences"), len(fences)).alias("part"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        for row in got.collect():
            want = max(0, sum(ranking._order(fence) <= ranking._order(tuple(row.key)) for fence in fences) - 1)
            assert row.part == want


def test_a_queue_is_read_without_the_findings_behind_it(spark, tmp_path):
    root = str(tmp_path / "store")
    images = stored_findings(spark, root, 20)
    stored_findings(spark, root, 10, run_id="unranked", seed=2)
    save_ranked(images, root, "run", TODAY, exports=False)
    found = readers.load_findings(spark, root)
    assert {r.run_id: r["count"] for r in found.groupBy("run_id").count().collect()} == {"run": 20, "unranked": 10}
    text = found._jdf.queryExecution().executedPlan().toString()
    # The name of a row's file is cut from its path, and the folder of the ranked run is not read for what has no rank.
    assert "regexp_extract" not in text and "NOT (run_id" in text


@pytest.mark.parametrize("few", [ordered.FEW_TOTALS, 0])
def test_an_export_of_all_runs_is_sorted_once(spark, tmp_path, small_parts, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_TOTALS", few)
    choose = random.Random(3)
    rows = [builders.finding(f"img_{at}/full", choose.choice(LEVELS), run_id=choose.choice(["a", "b", "c"])) for at in range(90)]
    found = builders.findings(spark, rows).repartition(4)
    want = rank_queue(found, None, TODAY).orderBy("run_id", "queue_rank").collect()
    queue = rank_queue(found, None, TODAY, in_order=True)
    assert queue.select(*want[0].__fields__).collect() == want
    text = queue._jdf.queryExecution().executedPlan().toString()
    assert ("rangepartitioning" in text) == (few == 0)
    writers.write_findings_json(queue, str(tmp_path / "plain"), in_order=True)
    assert exported(tmp_path / "plain") == [r.finding_id for r in want]
    writers.write_findings_json(queue, str(tmp_path / "small"), in_order=True, compression="gzip")
    assert all(path.name.endswith(".json.gz") for path in (tmp_path / "small").glob("part-*"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "small")).collect()) == sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect())
