"""Zoomed views: separable resampling with a Lanczos kernel, along the lines, then along the columns, each as a join with a table of weights and an aggregation.

Weights depend on the old and the new length only, so the table has a few rows for each new coordinate, once for all images of one size; pixels meet them by their coordinate. Each pass rounds to
whole numbers within 0..255, as the viewer does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lobes of the kernel, and the least and largest number of pixels of a view.
LOBES, LEAST, MOST = 3, 900, 10_000_000


def zoom_scale(scale: Column, value: float, width: Column, height: Column) -> Column:
    """The new scale of a view; the old one if the new view had too few or too many pixels."""
    size = scale * value * width * scale * value * height
    return F.when((size < LEAST) | (size > MOST), scale).otherwise(scale * value)


def lanczos_weights(lengths: DataFrame) -> DataFrame:
    """lengths: old, new. Returns old, new, at (new coordinate), k (old coordinate) and weight; the weights of a new coordinate add up to 1. Kernels are as wide as a new pixel where the
    view shrinks."""
    ratio = F.col("old") / F.col("new")
    wide = F.greatest(ratio, F.lit(1.0))
    each = lengths.distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.col("new") - 1)))
    each = each.withColumns({"centre": (F.col("at") + 0.5) * ratio, "wide": wide})
    first = F.greatest(F.floor(F.col("centre") - LOBES * F.col("wide") + 0.5), F.lit(0))
    last = F.least(F.floor(F.col("centre") + LOBES * F.col("wide") + 0.5), F.col("old")) - 1
    taps = each.withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("far", (F.col("k") - F.col("centre") + 0.5) / F.col("wide"))
    angle = F.col("far") * F.pi()
    kernel = F.when(F.col("far") == 0, 1.0).when(F.abs("far") < LOBES, LOBES * F.sin(angle) * F.sin(angle / LOBES) / (angle * angle)).otherwise(0.0)
    raw = taps.select("old", "new", "at", "k", kernel.alias("raw"))
    total = raw.groupBy("old", "new", "at").agg(F.sum("raw").alias("total"))
    return raw.join(total, ["old", "new", "at"]).select("old", "new", "at", "k", (F.col("raw") / F.col("total")).alias("weight"))


def _pass(pixels: DataFrame, along: str, across: str, lengths: DataFrame, channels: list[str]) -> DataFrame:
    """lengths: image_id, old, new of the coordinate `along`."""
    weights = lanczos_weights(lengths.select("old", "new")).withColumnRenamed("k", along)
    met = pixels.join(lengths, "image_id").join(weights, ["old", "new", along])
    level = lambda c: F.least(F.greatest(F.floor(F.round(F.sum(F.col(c) * F.col("weight")), 6) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c)
    return met.groupBy("image_id", F.col("at").alias(along), across).agg(*[level(c) for c in channels])


def zoomed(pixels: DataFrame, value: float, scale: float = 1.0, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """pixels: image_id, x, y and channels of 0..255, whole rectangles. Each image at its new scale (see zoom_scale), of the whole part of the scaled width and height. Empty tables give empty tables."""
    if value <= 0 or scale <= 0:
        raise ValueError("scales must be positive")
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    size = size.withColumn("scale", zoom_scale(F.lit(scale), value, F.col("width"), F.col("height")))
    length = lambda c: size.select("image_id", F.col(c).alias("old"), F.greatest(F.floor(F.col(c) * F.col("scale")), F.lit(1)).cast("int").alias("new"))
    names = list(channels)
    lines = _pass(pixels.select("image_id", "x", "y", *names), "x", "y", length("width"), names)
    return _pass(lines, "y", "x", length("height"), names).select("image_id", "x", "y", *names)
