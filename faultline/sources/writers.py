"""Sinks: manifests, append logs, the ranked queue, exports, summaries and the freeze digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators.queue import bridge_rows, queue_rows


def write_manifest(images: DataFrame, path: str) -> None:
    """JSON lines with nulls written out."""
    fields = [name for name in schemas.struct(schemas.IMAGES).fieldNames() if name in images.columns]
    images.select(*fields).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(rows: DataFrame, root: str, name: str) -> None:
    """Append rows to a run table laid out by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")


def _ranked(queue: DataFrame, in_order: bool) -> DataFrame:
    return queue if in_order else queue.orderBy("run_id", "queue_rank")


def write_queue_csv(queue: DataFrame, path: str, in_order: bool = False) -> None:
    """The flat queue in rank order: part files follow the order, and so do the rows in each.

    A queue that comes `in_order` (ranking.queue_in_order, queue.rank_queue) is written as it is, here and below.
    """
    rows = queue_rows(_ranked(queue, in_order))
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_bridge_csv(queue: DataFrame, path: str, in_order: bool = False) -> bool:
    """Element entry rows, only when there is a bridge finding. Returns whether anything was written."""
    bridges = queue.filter(F.col("asset_class") == "bridge_element")
    if bridges.isEmpty():
        return False
    rows = bridge_rows(_ranked(bridges, in_order))
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return True


def write_findings_json(queue: DataFrame, path: str, in_order: bool = False, compression: str = "none") -> None:
    """Findings as JSON lines in rank order, as plain text unless a `compression` that Spark knows is named."""
    _ranked(queue, in_order).write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON document per run."""
    document = F.to_json(F.struct(*[F.col(name) for name in summary.columns]), {"ignoreNullFields": "false"})
    summary.select(document.alias("value")).write.mode("overwrite").text(path)


def freeze_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A fingerprint of a set of rows that does not depend on their order or partitioning.

    Row hashes are summed by halves as well as counted, so equal rows do not cancel each other.
    """
    fields: list[Column] = [F.col(name) for name in (columns or df.columns)]
    row_hash = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)

    def word(at: int) -> Column:
        return F.conv(F.substring(row_hash, at, 8), 16, 10).cast("decimal(10,0)")  # sums have 20 digits

    sums = [F.sum(word(1 + 8 * at)).alias(f"w{at}") for at in range(4)]
    return df.select(row_hash.alias("h"), *fields).agg(F.count(F.lit(1)).alias("rows"), *sums).select(
        "rows", F.sha2(F.concat_ws("/", "rows", *[f"w{at}" for at in range(4)]), 256).alias("digest")
    )
