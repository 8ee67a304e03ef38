"""Bootstrap intervals from counted cells.

A statistic that only counts categories sees a resample as one count per category. A resample of a group of n rows draws n
rows with replacement, so its counts are multinomial: they are drawn by conditional binomials down a binary tree over the
group's categories in their order, at each node how many of the rows that came there go to its left half. A draw inverts the
binomial distribution at a hash numbered by group, node and resample, so any SQL engine can repeat it. Every resample holds
exactly n rows; the same law holds at every n, and no row is drawn by itself.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from faultline.session import materialise

#: Standard deviation from which a quantile is taken from its expansion, which is then off by less than a thousandth of
#: a count, and not from the sum of the distribution's terms.
WIDE = 2000.0


def binomial_at(n: np.ndarray, p: float, uniforms: np.ndarray) -> np.ndarray:
    """The least counts whose distribution function, of n rows with a chance of p each, reaches the uniforms."""
    out = np.zeros(len(n), np.int64)
    for rows in np.unique(n[n > 0]):
        at = n == rows
        out[at] = _quantiles(int(rows), p, uniforms[at])
    return out


def _quantiles(n: int, p: float, uniforms: np.ndarray) -> np.ndarray:
    q, mean = 1 - p, n * p
    spread = math.sqrt(n * p * q)
    if spread > WIDE:
        z = np.array([NormalDist().inv_cdf(u) for u in uniforms])
        return np.clip(np.ceil(mean + spread * z + (q - p) * (z**2 - 1) / 6 - 0.5), 0, n).astype(np.int64)
    low, high = max(0, math.floor(mean - 10 * spread - 20)), min(n, math.ceil(mean + 10 * spread + 30))
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log(q)
    k = np.arange(low, high)
    steps = np.log(n - k) - np.log(k + 1) + math.log(p) - math.log(q)
    upto = np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)])))
    return low + np.minimum(np.searchsorted(upto, uniforms), high - low)


def tree_nodes(categories: int) -> list[tuple[int, int]]:
    """Start and width of every inner node of the tree over so many categories, the widest first."""
    width, out = 1 << max(1, categories - 1).bit_length(), []
    while width > 1:
        out += [(start, width) for start in range(0, categories, width)]
        width //= 2
    return out


def multinomial(cells: np.ndarray, nodes: list[tuple[int, int]], uniforms: np.ndarray) -> np.ndarray:
    """Counts of every cell in each resample; `uniforms` has a row for each resample and a column for each node."""
    upto = np.concatenate([[0], np.cumsum(cells)])
    weight = lambda start, width: int(upto[min(start + width, len(cells))] - upto[min(start, len(cells))])
    out = np.zeros((len(uniforms), len(cells)), np.int64)
    came = {(0, nodes[0][1]): np.full(len(uniforms), weight(0, nodes[0][1]))}
    for at, (start, width) in enumerate(nodes):
        rows, half = came.pop((start, width), None), width // 2
        if rows is None:
            continue
        whole, left = weight(start, width), weight(start, half)
        drawn = rows if left == whole else np.zeros_like(rows) if not left else binomial_at(rows, left / whole, uniforms[:, at])
        for place, counts in ((start, drawn), (start + half, rows - drawn)):
            if half > 1:
                came[place, half] = counts
            elif place < len(cells):
                out[:, place] = counts
    return out


@F.arrow_udf(ArrayType(LongType()))
def _drawn(cells: pa.Array, uniforms: pa.Array) -> pa.Array:
    out: list = [None] * len(cells)
    alike: dict[tuple, list[int]] = {}
    for at, counts in enumerate(cells.to_pylist()):
        alike.setdefault(tuple(counts), []).append(at)
    drawn_at = np.array(uniforms.to_pylist(), float).reshape(len(cells), -1)
    nodes = tree_nodes(drawn_at.shape[1] + 1)  # as many inner nodes as resampled() numbers
    for counts, rows in alike.items():
        for at, found in zip(rows, multinomial(np.array(counts, np.int64), nodes, drawn_at[rows]).tolist(), strict=True):
            out[at] = found
    return pa.array(out, pa.list_(pa.int64()))


def resampled(cells: DataFrame, by: list[str], categories: list[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Counts per group, category and resample `b`; a category may have a count of 0.

    `cells` (written) has one row for each group and category. A group's categories, a fixed vocabulary, are one array.
    """
    listed = F.array_sort(F.collect_list(F.struct(*categories, F.col("n").cast("bigint").alias("n")))).alias("_cells")
    groups = cells.groupBy(*by).agg(listed)
    most = groups.agg(F.coalesce(F.max(F.size("_cells")), F.lit(1)).alias("most")).first()["most"]
    width = 1 << max(1, most - 1).bit_length()  # a whole tree, so that the number of its nodes tells its width
    nodes = F.array(*[F.lit(f"{start}/{size}") for start, size in tree_nodes(width)])
    numbered = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def uniform(node: Column) -> Column:
        text = F.concat_ws("/", F.lit(str(seed)), *[F.col(name).cast("string") for name in by], node, F.col("b").cast("string"))
        return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)

    drawn = _drawn(F.transform("_cells", lambda cell: cell["n"]), F.transform(nodes, uniform))
    paired = numbered.select(*by, "b", F.explode(F.arrays_zip("_cells", drawn.alias("_n"))).alias("_pair"))
    return paired.select(*by, *[F.col(f"_pair._cells.{name}").alias(name) for name in categories], "b", F.col("_pair._n").alias("n"))


def intervals(cells: DataFrame, by: list[str], categories: list[str], statistics: dict[str, Column],
              resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Point estimate and 95 percent percentile interval of each statistic.

    A statistic is an aggregate over the category columns and the count `n`. The cells are written first, so the
    rows behind them are read once.
    """
    cells = materialise(cells, "cells")
    points = cells.groupBy(*by).agg(F.sum("n").alias("n_rows"), *[s.alias(name) for name, s in statistics.items()])
    draws = resampled(cells, by, categories, resamples, seed)
    per_resample = draws.groupBy(*by, "b").agg(*[s.alias(name) for name, s in statistics.items()])
    bounds = [
        F.percentile(name, share).alias(f"{name}_{side}")
        for name in statistics
        for side, share in (("low", 0.025), ("high", 0.975))
    ]
    return points.join(per_resample.groupBy(*by).agg(*bounds), by)


def gate_statistics() -> dict[str, Column]:
    """Precision, recall and F1 over the categories `truth` and `routed`; 0 where undefined."""

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("double")

    hit = total(F.col("truth") & F.col("routed"))
    precision = F.coalesce(F.try_divide(hit, total(F.col("routed"))), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hit, total(F.col("truth"))), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def grading_statistics() -> dict[str, Column]:
    """Exact and within-one-grade agreement over the categories `truth` and `pred`."""

    def share(where: Column) -> Column:
        hit = F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("double")
        return F.try_divide(hit, F.sum("n").cast("double"))

    gap = F.abs(F.col("truth") - F.col("pred"))
    return {"exact_match": share(gap == 0), "within_one_grade": share(gap <= 1)}
