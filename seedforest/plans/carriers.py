"""Rasters, scribbles and label maps made from the given tables, which hold no images: each embedding is a line of pixels, 50 lines an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import with_lab
from ..operators.scribble import disc
from ..operators.seeds import lattice
from ..operators.stencil import gradient

ROWS, COLS, SAMPLES = 50, 64, 12
#: Of an image; the last one has fewer where the embeddings end within it.
PIXELS = ROWS * COLS
#: (marker, centre x, centre y); marker 0 is the object. Marker 3 overlaps marker 2.
MARKERS = ((0, 16, 25), (1, 48, 12), (2, 50, 40), (3, 49, 41))
RADIUS = 2


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _level(value):
    return F.round(F.greatest(F.least((value.cast("double") + 1) * 127.5, F.lit(255.0)), F.lit(0.0))).cast("int")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / ROWS).cast("int").alias("image_id"), (F.col("vec_id") % ROWS).cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return lines.select("image_id", "x", "y", (F.col("y") * COLS + F.col("x")).cast("long").alias("idx"), _level(F.col("e")).alias("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.floor(F.col("vec_id") / 3)
    channel = {c: F.max(F.when(F.col("vec_id") % 3 == k, F.col("embedding"))).alias(c) for k, c in enumerate("rgb")}
    lines = embeddings(spark, sf_dir).groupBy(line.alias("line")).agg(*channel.values()).where("r is not null")
    lines = lines.select("line", "r", F.coalesce("g", "r").alias("g"), F.coalesce("b", "g", "r").alias("b"))  # of the last line's channels some may be missing
    flat = lines.select("line", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p"))
    out = flat.select(F.floor(F.col("line") / ROWS).cast("int").alias("image_id"), "x", (F.col("line") % ROWS).cast("int").alias("y"), *[_level(F.col(f"p.{c}")).alias(c) for c in "rgb"])
    return out.withColumn("idx", (F.col("y") * COLS + F.col("x")).cast("long"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / ROWS).cast("int").alias("image_id")).distinct()
    return ids.select("image_id", F.lit(ROWS).alias("n_rows"), F.lit(COLS).alias("n_cols"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = with_lab(gray(spark, sf_dir).withColumn("norm", F.lit(255)), "v", "v", "v").drop("norm")
    return gradient(lab).withColumn("grad", F.round("grad", 9))


def scribbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [(m, k, cx + dx, cy + dy) for m, cx, cy in MARKERS for k, (dx, dy) in enumerate(disc(RADIUS))]
    table = F.explode(F.array(*[F.struct(F.lit(m).alias("marker_id"), F.lit(k).alias("ord"), F.lit(x).alias("x"), F.lit(y).alias("y")) for m, k, x, y in points]))
    return images(spark, sf_dir).select("image_id", table.alias("p")).select("image_id", "p.*", (F.col("p.marker_id") == 0).alias("is_object"))


def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graded with tree_id: the nearest lattice point, the first in (y, x) order on ties. The lattice is the same in all images, a few points."""
    from ..operators.seeds import grid_geometry

    start, step, _ = grid_geometry(ROWS * COLS, SAMPLES)
    seeds = [(x, y) for y in range(start, ROWS, step) for x in range(start, COLS, step)]
    nearest = F.least(*[F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d"), F.lit(k).alias("k")) for k, (x, y) in enumerate(seeds)])
    return graded(spark, sf_dir).withColumn("tree_id", nearest["k"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(images(spark, sf_dir), SAMPLES)
