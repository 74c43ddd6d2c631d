"""Seed sampling: scribble pixels, grid candidates, suppression near scribbles, and the move to the smallest gradient."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EIGHT


def grid_geometry(n_pixels: int, samples: int) -> tuple[int, int, int]:
    """First lattice coordinate, lattice step and suppression radius for a number of samples."""
    if samples <= 0:
        raise ValueError("the number of samples must be positive")
    stride = math.sqrt(0.5 + n_pixels / samples) + 0.5
    if stride / 2 < 1:
        raise ValueError("the number of samples is too high")
    return int(stride / 2), int(stride), int(stride / 2)


def lattice(images: DataFrame, samples: int) -> DataFrame:
    """images: image_id, n_rows, n_cols. Returns the grid candidates image_id, x, y, idx."""
    size = F.lit(0.5) + F.col("n_rows") * F.col("n_cols") / F.lit(float(samples))
    stride = F.sqrt(size) + 0.5
    shaped = images.select("image_id", "n_rows", "n_cols", F.floor(stride / 2).cast("int").alias("start"), F.floor(stride).cast("int").alias("step"))
    shaped = shaped.withColumn("start", F.when(F.col("start") < 1, F.raise_error(F.lit("the number of samples is too high"))).otherwise(F.col("start")))
    ys = shaped.where("start < n_rows and start < n_cols").withColumn("y", F.explode(F.sequence("start", F.col("n_rows") - 1, "step")))
    out = ys.withColumn("x", F.explode(F.sequence("start", F.col("n_cols") - 1, "step")))
    return out.select("image_id", "x", "y", (F.col("y") * F.col("n_cols") + F.col("x")).cast("long").alias("idx"), F.col("start").alias("radius"))


def distinct_scribbles(scribbles: DataFrame) -> DataFrame:
    """The first point of each pixel, by marker and order."""
    first = F.row_number().over(Window.partitionBy("image_id", "x", "y").orderBy("marker_id", "ord"))
    return scribbles.withColumn("_n", first).where("_n = 1").drop("_n")


def suppressed(candidates: DataFrame, scribbles: DataFrame) -> DataFrame:
    """Candidates without a scribble pixel within their radius (Chebyshev). Scribble pixels are few beside the pixels of the
    images, so they meet the candidates by cells of the lattice's own spacing: a range join as an equi-join on neighbouring cells."""
    cell = lambda c: F.floor(F.col(c) / F.col("radius"))
    radius = candidates.select("image_id", "radius").distinct()
    near = scribbles.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy")).distinct().join(radius, "image_id")
    near = near.withColumn("cx", F.explode(F.sequence(F.floor(F.col("sx") / F.col("radius")) - 1, F.floor(F.col("sx") / F.col("radius")) + 1)))
    near = near.withColumn("cy", F.explode(F.sequence(F.floor(F.col("sy") / F.col("radius")) - 1, F.floor(F.col("sy") / F.col("radius")) + 1))).drop("radius")
    celled = candidates.withColumns({"cx": cell("x"), "cy": cell("y")})
    close = (F.abs(F.col("x") - F.col("sx")) <= F.col("radius")) & (F.abs(F.col("y") - F.col("sy")) <= F.col("radius"))
    on = (celled["image_id"] == near["image_id"]) & (celled["cx"] == near["cx"]) & (celled["cy"] == near["cy"]) & close
    return celled.join(near, on, "left_anti").drop("cx", "cy")


def to_smallest_gradient(candidates: DataFrame, graded: DataFrame) -> DataFrame:
    """Moves each candidate to the pixel of the smallest gradient among itself and its eight neighbours; the first in order wins a tie."""
    order = ((0, 0), *EIGHT)
    tries = candidates.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(order)])))
    tries = tries.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("idx").alias("at"), F.col("o.k").alias("k"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    met = tries.join(graded.select("image_id", "x", "y", "idx", "grad"), ["image_id", "x", "y"])
    best = met.groupBy("image_id", "at").agg(F.min(F.struct("grad", "k", "idx", "x", "y")).alias("m"))
    return best.select("image_id", "at", F.col("m.idx").alias("idx"), F.col("m.x").alias("x"), F.col("m.y").alias("y"))


def seed_table(scribbles: DataFrame, grid: DataFrame, n_cols: str = "n_cols") -> DataFrame:
    """Scribble pixels first, then grid seeds, numbered in this order. Labels: the marker's number from 1, grid seeds one above the largest marker."""
    marks = distinct_scribbles(scribbles).select("image_id", F.lit(0).alias("kind"), "marker_id", F.col("ord").cast("long").alias("ord"), "x", "y")
    extra = grid.select("image_id", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("marker_id"), F.col("at").alias("ord"), "x", "y")
    both = marks.unionByName(extra)
    label = F.coalesce(F.col("marker_id") + 1, F.coalesce(F.max("marker_id").over(Window.partitionBy("image_id")), F.lit(-1)) + 2)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("kind", "marker_id", "ord")) - 1
    return both.select("image_id", number.alias("tree_id"), "x", "y", label.alias("label"), (F.col("kind") == 1).alias("is_grid"))


def seeds_to_save(grid: DataFrame, scribbles: DataFrame) -> DataFrame:
    """Grid seeds that no scribble covers."""
    return grid.join(scribbles.select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_anti")
