"""Tile plans and model-ready sizes, from dimensions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import MIN_MODEL_SIDE, TILE_OVERLAP, TILE_SIDE, TOKEN_PATCH_SIDE


def _starts(extent: Column, tile: int, step: int) -> Column:
    last = extent - F.lit(tile)
    stepped = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(stepped, F.array(last))))


def tile_boxes(width: Column, height: Column, tile: int = TILE_SIDE, overlap: float = TILE_OVERLAP) -> Column:
    """Overlapping boxes in row order; the last row and column sit flush with the image edge."""
    step = max(1, int(tile * (1 - overlap)))

    def box(x: Column, y: Column) -> Column:
        return F.struct(
            x.alias("x0"),
            y.alias("y0"),
            F.least(x + F.lit(tile), width).alias("x1"),
            F.least(y + F.lit(tile), height).alias("y1"),
        )

    xs, ys = _starts(width, tile, step), _starts(height, tile, step)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: box(x, y))))


def explode_targets(images, tiled: bool = True, tile: int = TILE_SIDE, overlap: float = TILE_OVERLAP):
    """One row per grading target: `full` for an untiled image, else `t00`, `t01`, ... with its box."""
    whole = F.array(
        F.struct(
            F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")
        )
    )
    plan = tile_boxes(F.col("width"), F.col("height"), tile, overlap) if tiled else whole
    planned = images.withColumn("_boxes", plan)
    name = F.when(F.size("_boxes") == 1, F.lit("full")).otherwise(F.format_string("t%02d", F.col("_at")))
    targets = planned.select("*", F.posexplode("_boxes").alias("_at", "_box"))
    return targets.withColumns(
        {
            "tile": name,
            "finding_id": F.concat(F.col("image_id"), F.lit("/"), name),
            "bbox": F.array("_box.x0", "_box.y0", "_box.x1", "_box.y1"),
        }
    ).drop("_boxes", "_at", "_box")


def enlarged(width: Column, height: Column, min_side: int = MIN_MODEL_SIDE) -> tuple[Column, Column]:
    """Size after a tiny image is scaled up to the smallest side a model reads."""
    short = F.least(width, height)
    scale = F.lit(float(min_side)) / short.cast("double")
    return tuple(
        F.when(short >= min_side, side).otherwise(F.floor(side.cast("double") * scale).cast("int"))
        for side in (width, height)
    )


def fitted(width: Column, height: Column, max_side: int = TILE_SIDE) -> tuple[Column, Column]:
    """Size after a large image is scaled down to the longest side a model reads."""
    long = F.greatest(width, height)
    scale = F.lit(float(max_side)) / long.cast("double")
    return tuple(
        F.when(long <= max_side, side).otherwise(
            F.greatest(F.lit(1), F.floor(side.cast("double") * scale).cast("int"))
        )
        for side in (width, height)
    )


def image_tokens(width: Column, height: Column, patch: int = TOKEN_PATCH_SIDE) -> Column:
    return F.ceil(width / F.lit(float(patch))) * F.ceil(height / F.lit(float(patch)))
