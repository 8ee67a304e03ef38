import builders
from pyspark.sql import functions as F

from faultline.operators import records, sampling


def graded(image_id, grade, asset_class="steel_coating", split="dev", source="dataset"):
    labels = {"grade_native": grade, "grade_source": source} if grade else {}
    return {"image_id": image_id, "asset_class": asset_class, "split": split, "labels": labels}


def chosen(spark, rows, **options):
    table = sampling.select_exemplars(builders.images(spark, rows), **options)
    return [(r.native_value, r.image_id) for r in table.orderBy("asset_class", "place").collect()]


def test_exemplars_spread_over_grades_and_stop_at_five(spark):
    rows = [graded(f"p{at}", "Poor") for at in range(6)] + [graded("f1", "Fair"), graded("s1", "Severe")]
    assert [g for g, _ in chosen(spark, rows, k=3)] == ["Fair", "Poor", "Severe"]
    assert len(chosen(spark, rows, k=9)) == 5 and chosen(spark, rows, k=0) == []
    assert [i for _, i in chosen(spark, rows, k=5)] == ["f1", "p0", "s1", "p1", "p2"]


def test_exemplars_skip_eval_splits_and_unlabelled(spark):
    rows = [
        graded("b", "Poor", split="eval"), graded("b2", "Poor", split="eval_v1"), graded("c", None),
        graded("d", "Fair", source=None), graded("d2", "Fair", source=""), graded("e", "Severe"),
    ]
    assert chosen(spark, rows, k=5) == [("Severe", "e")]
    assert chosen(spark, rows, k=5, exclude_ids=["e"]) == []


def test_a_target_never_sees_its_own_label(spark):
    images = builders.images(spark, [graded("a", "Poor"), graded("b", "Fair"), graded("z", None, asset_class="pv_module")])
    got = sampling.exemplars_for_targets(images, sampling.select_exemplars(images, 3))
    assert {r.image_id: [e.image_id for e in r.exemplars] for r in got.collect()} == {"a": ["b"], "b": ["a"], "z": []}


def test_slices_do_not_depend_on_partitioning(spark):
    rows = spark.range(500).select(F.concat(F.lit("i"), "id").alias("image_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    slices = {"c0": [("eval_v1", 0, 5), ("dev", 5, 8)], "c1": [("eval_v1", 0, 2)]}
    one = sampling.stratified_slices(rows.coalesce(1), "c", "image_id", slices, 7).collect()
    many = sampling.stratified_slices(rows.repartition(9), "c", "image_id", slices, 7).collect()
    assert sorted(one) == sorted(many)
    counts = {}
    for r in one:
        counts[r.c, r.split] = counts.get((r.c, r.split), 0) + 1
    assert counts == {("c0", "eval_v1"): 5, ("c0", "dev"): 3, ("c1", "eval_v1"): 2}


def test_quota_sample_uses_no_image_twice(spark):
    names = ["Crack", "ACrack", "Spalling", "Rust", "ExposedRebars", "Efflorescence", "Wetspot"]
    classes = F.filter(F.array(*[F.when(F.col("id") % (at + 3) == 0, F.lit(n)) for at, n in enumerate(names)]), lambda n: n.isNotNull())
    rows = spark.range(2000).select(F.col("id").alias("name"), classes.alias("classes"))
    got = sampling.quota_sample(rows, "name", "classes", 1).collect()
    ids = [r.name for r in got]
    assert len(ids) == len(set(ids)) == 80
    assert sum(r.split == "eval_v1" for r in got) == 65 and sum(r.split == "dev" for r in got) == 15


def test_mixed_demo_interleaves_datasets(spark):
    rows = [
        graded(f"{ds}{at}", "Poor" if at == 2 else None) | {"source_dataset": ds} for ds in ("b", "a") for at in range(4)
    ]
    got = [r.image_id for r in sampling.mixed_demo(builders.images(spark, rows), 2).collect()]
    assert got == ["a2", "b2", "a0", "b0"]


def test_later_source_wins(spark):
    first = builders.images(spark, [{"image_id": "a", "split": "run"}, {"image_id": "b", "split": "run"}])
    second = builders.images(spark, [{"image_id": "b", "split": "dev"}])
    got = records.latest_by_precedence([first, second]).collect()
    assert {r.image_id: r.split for r in got} == {"a": "run", "b": "dev"}


def test_resume_anti_joins_and_duplicates(spark):
    images = builders.images(spark, [{"image_id": "a"}, {"image_id": "a"}, {"image_id": "b"}])
    assert records.distinct_images(images).count() == 2 and records.duplicate_count(images).first().duplicates == 1
    left = records.not_yet_gated(records.distinct_images(images), builders.gate(spark, [("a", True, True, 0.9)]))
    assert [r.image_id for r in left.collect()] == ["b"]
