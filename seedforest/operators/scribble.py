"""Scribble operators: ranks and prefix sums, lines, brushes, shapes, components, erasing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import components


def marker_sizes(scribbles: DataFrame) -> DataFrame:
    """Points of each marker and the number before it in its image."""
    sizes = scribbles.groupBy("image_id", "marker_id").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("image_id").orderBy("marker_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))


def lines(segments: DataFrame) -> DataFrame:
    """segments with x0, y0, x1, y1: one row per pixel of the line, k from 0 in drawing order. Each step along the longer axis takes the nearest pixel of the
    other axis, halves towards the start of the axis' order."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    steps = F.greatest(dx, dy)
    out = segments.withColumns({"_n": steps, "_k": F.explode(F.sequence(F.lit(0), steps))})

    def at(a: str, b: str):
        """a + round-half-down of k (b - a) / n."""
        move = 2 * F.col("_k") * F.abs(F.col(b) - F.col(a)) + F.col("_n") - 1
        whole = F.when(F.col("_n") > 0, F.floor(move / (2 * F.col("_n")))).otherwise(F.lit(0))
        return (F.col(a) + F.signum((F.col(b) - F.col(a)).cast("double")) * whole).cast("int")

    return out.select(*segments.columns, F.col("_k").alias("k"), at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))


def connected(scribbles: DataFrame) -> DataFrame:
    """Each marker's points joined by lines, without repeats: image_id, marker_id, ord, x, y."""
    w = Window.partitionBy("image_id", "marker_id").orderBy("ord")
    linked = scribbles.select("image_id", "marker_id", "ord", F.coalesce(F.lag("x").over(w), "x").alias("x0"), F.coalesce(F.lag("y").over(w), "y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    points = lines(linked).groupBy("image_id", "marker_id", "x", "y").agg(F.min(F.struct("ord", "k")).alias("at"))
    return points.select("image_id", "marker_id", (F.row_number().over(Window.partitionBy("image_id", "marker_id").orderBy("at")) - 1).alias("ord"), "x", "y")


def disc(radius: float) -> list[tuple[int, int]]:
    whole = int(radius)
    return [(dx, dy) for dy in range(-whole, whole + 1) for dx in range(-whole, whole + 1) if dx * dx + dy * dy <= radius * radius]


def brushed(points: DataFrame, radius: float, n_cols: int | None = None, n_rows: int | None = None) -> DataFrame:
    """The distinct pixels of discs around points; `points` has x, y and other columns, which stay."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc(radius)]))
    out = points.withColumn("_o", offsets).withColumns({"x": F.col("x") + F.col("_o.dx"), "y": F.col("y") + F.col("_o.dy")}).drop("_o")
    if n_cols is not None:
        out = out.where((F.col("x") >= 0) & (F.col("x") < n_cols) & (F.col("y") >= 0) & (F.col("y") < n_rows))
    return out.distinct()


def rectangle_outline(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of a rectangle's outline, without repeats."""
    left, right, top, bottom = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    return sorted({(x, y) for x in range(left, right + 1) for y in (top, bottom)} | {(x, y) for y in range(top, bottom + 1) for x in (left, right)})


def ellipse(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels inside the ellipse of a box."""
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2 or 0.5, abs(y1 - y0) / 2 or 0.5
    return [(x, y) for y in range(min(y0, y1), max(y0, y1) + 1) for x in range(min(x0, x1), max(x0, x1) + 1) if ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1]


def box_scribble(x0: int, y0: int, x1: int, y1: int) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """The outline of a box, and the centre dot that belongs to the opposite class."""
    return rectangle_outline(x0, y0, x1, y1), ((x0 + x1) // 2, (y0 + y1) // 2)


def erased(scribbles: DataFrame, pixels: DataFrame) -> DataFrame:
    """Scribble points that no erased pixel covers."""
    return scribbles.join(pixels.select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_anti")


def object_first(objects: DataFrame, background: DataFrame) -> DataFrame:
    """Object markers ahead of background markers, numbered anew in each image."""
    both = objects.withColumn("_b", F.lit(0)).unionByName(background.withColumn("_b", F.lit(1)))
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("_b", "marker_id")) - 1
    return both.withColumns({"marker_id": number, "is_object": F.col("_b") == 0}).drop("_b")


def connected_components(points: DataFrame) -> DataFrame:
    """points: grp, x, y. Adds component: the smallest (y, x) order number reachable through 4-neighbours of the group. Points of a line that follow one another
    make up a run; runs that touch are linked, and only these links are contracted, however long or wound a component is. Windows see one line or column at a time."""
    line, column = Window.partitionBy("grp", "y").orderBy("x"), Window.partitionBy("grp", "x").orderBy("y")
    seen = points.select("grp", "x", "y").distinct()
    per_line = seen.groupBy("grp", "y").agg(F.count(F.lit(1)).alias("_n"))
    before = per_line.select("grp", "y", F.coalesce(F.sum("_n").over(Window.partitionBy("grp").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = seen.join(before, ["grp", "y"]).withColumn("n", F.col("_before") + F.row_number().over(line) - 1)
    first = F.coalesce(F.lag("x").over(line) != F.col("x") - 1, F.lit(True))
    runs = numbered.withColumn("_first", F.when(first, F.col("n"))).withColumn("run", F.last("_first", True).over(line)).select("grp", "x", "y", "run")
    runs = cut(runs)
    touching = runs.withColumn("above", F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag("run").over(column))).where("above is not null")
    node = lambda n: F.struct("grp", F.col(n).alias("n"))
    found = components(touching.select(node("above").alias("a"), node("run").alias("b")))
    named = found.select(F.col("node.grp").alias("grp"), F.col("node.n").alias("run"), F.col("component.n").alias("component"))
    return runs.join(named, ["grp", "run"], "left").select("grp", "x", "y", F.coalesce("component", "run").alias("component"))
