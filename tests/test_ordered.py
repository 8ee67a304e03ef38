import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.ordered import sorted_rows, top_per_group, with_rank, with_running


def skewed(spark, n=6000, seed=3):
    """One group holds most rows, one key ties most of those."""
    rng = random.Random(seed)
    rows = [("hot" if at % 10 else f"g{at % 7}", 0 if at % 3 else rng.randrange(50), f"id{at:05d}", rng.randrange(5)) for at in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, k int, id string, v int").repartition(7)


def test_rank_equals_the_window(spark):
    df = skewed(spark)
    order = [F.col("k").desc(), F.col("id")]
    got = with_rank(df, ["g"], order, "r").select("g", "id", "r")
    want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint").alias("r"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rank_without_groups_and_with_null_groups(spark):
    df = skewed(spark, 500).withColumn("g", F.when(F.col("g") != "g1", F.col("g")))
    assert sorted(r.r for r in with_rank(df, [], [F.col("id")], "r").collect()) == list(range(1, 501))
    got = with_rank(df, ["g"], [F.col("id")], "r").filter("g is null")
    assert sorted(r.r for r in got.collect()) == list(range(1, got.count() + 1))


def test_running_values_equal_the_window(spark):
    df = skewed(spark).withColumn("carried", F.when(F.col("v") == 0, F.col("id")))
    got = with_running(
        df, ["g"], [F.col("id")], sums={"total": F.col("v").cast("bigint")}, last_before={"last": F.col("carried")}
    ).select("g", "id", "total", "last")
    w = Window.partitionBy("g").orderBy("id")
    want = df.select(
        "g", "id",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.last("carried", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_large_groups_are_spread_over_partitions(spark):
    """No task holds the hot group: its rows lie in many partitions of the sorted table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted_rows(skewed(spark, 20000), ["g"], [F.col("k"), F.col("id")])
        parts = rows.filter("g = 'hot'").groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 0.25 * 18000


def test_top_per_group_is_limited_before_the_shuffle(spark):
    df = skewed(spark)
    top = top_per_group(df, ["g"], [F.col("k").desc(), F.col("id")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    deep = top_per_group(df, ["g"], [F.col("k").desc(), F.col("id")], 2000)
    want = df.groupBy("g").count().select(F.least(F.col("count"), F.lit(2000)).alias("n")).agg(F.sum("n")).first()[0]
    assert deep.count() == want
    assert dict(top.dtypes)["rn"] == dict(deep.dtypes)["rn"] == "bigint"
