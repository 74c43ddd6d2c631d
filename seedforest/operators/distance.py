"""Exact Euclidean distance of every pixel to the nearest marked one, in two passes: along the lines, then along the columns.

The first pass takes, by windows along a line, the nearest marked pixel to the left and to the right. The second takes for each pixel of a column the least of (y - y')^2 plus the square
of the first distance at y', which is the lower envelope of as many parabolas as the column has pixels with a first distance; it is found in one sweep. So a pixel is handled twice, whatever the number of marked
pixels, and images are dealt out by line and by column. All is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def envelope(y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """y: ascending. height: of the parabola that stands at each y; negative where there is none. The least (y - y')^2 + height[y'] for each y; -1 if there is none at all."""
    at = np.flatnonzero(height >= 0)
    if not len(at):
        return np.full(len(y), -1, np.int64)
    foot, own = y[at].tolist(), height[at].tolist()
    kept, start = [0], [-np.inf]  # parabolas of the envelope, and from where on each is the lowest
    for k in range(1, len(foot)):
        while kept:
            j = kept[-1]
            cross = (own[k] + foot[k] ** 2 - own[j] - foot[j] ** 2) / (2 * (foot[k] - foot[j]))
            if cross > start[-1]:
                break
            kept.pop()
            start.pop()
        kept.append(k)
        start.append(cross if len(kept) > 1 else -np.inf)
    lowest = np.array(kept)[np.searchsorted(start, y, "right") - 1]
    return (y - np.array(foot)[lowest]) ** 2 + np.array(own)[lowest]


def distance_squared(pixels: DataFrame, marked: DataFrame, outside: bool = False) -> DataFrame:
    """pixels, marked: image_id, x, y. Returns image_id, x, y, d2 for each pixel (once): the squared distance to the nearest marked pixel of its image; null where there is none. Marked
    points that aren't pixels are left out; with outside=True they count, within the rectangle of pixels and marked points."""
    once = pixels.select("image_id", "x", "y").distinct()
    marked = marked.select("image_id", "x", "y").distinct()
    spread = once.withColumn("pixel", F.lit(1))
    if outside:
        spread = spread.unionByName(marked.join(once.select("image_id").distinct(), "image_id", "left_semi").withColumn("pixel", F.lit(0)))
    # an image with holes is filled up to its rectangle: distances go across the holes
    size = spread.groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("pixel").alias("n"))
    open_images = size.where("n < (x1 - x0 + 1L) * (y1 - y0 + 1L)").withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    holes = open_images.select("image_id", "x", "y").join(once, ["image_id", "x", "y"], "left_anti")
    once = once.withColumn("hole", F.lit(False)).unionByName(holes.withColumn("hole", F.lit(True))).join(marked.withColumn("on", F.lit(True)), ["image_id", "x", "y"], "left")
    line = Window.partitionBy("image_id", "y").orderBy("x")
    here = F.when(F.col("on") if outside else F.col("on") & ~F.col("hole"), F.col("x"))
    before, behind = F.last(here, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first(here, True).over(line.rowsBetween(0, Window.unboundedFollowing))
    beside = F.least(F.col("x") - before, behind - F.col("x")).cast("long")
    swept = once.withColumn("beside", F.coalesce(beside * beside, F.lit(-1).cast("long")))

    @F.pandas_udf("array<bigint>")
    def least(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for y, height in columns:
            yield pd.Series([envelope(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(y, height, strict=True)])

    whole = swept.groupBy("image_id", "x").agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("long").alias("y"), "beside", "hole"))).alias("c"))
    found = whole.select("image_id", "x", F.col("c.y").alias("y"), least("c.y", "c.beside").alias("d2"), F.col("c.hole").alias("hole"))
    flat = found.select("image_id", "x", F.explode(F.arrays_zip("y", "d2", "hole")).alias("p")).where("not p.hole")
    return flat.select("image_id", "x", F.col("p.y").cast("int").alias("y"), F.when(F.col("p.d2") >= 0, F.col("p.d2")).alias("d2"))
