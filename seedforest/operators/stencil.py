"""Neighbourhood operators on pixel tables.

Neighbours come from two windows: along the rows of an image, then along its columns. Both deal pixels by image and line, so a single large image is spread
over many tasks, and no pixel is copied once per neighbour as in a join with the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EIGHT, FOUR


def with_neighbours(pixels: DataFrame, what: Column, diagonal: bool = True) -> DataFrame:
    """Adds struct column `near` with fields n0.. in the order of EIGHT (or FOUR): `what` of each neighbour, null outside the image."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    pixels = pixels.withColumn("_self", what)

    def beside(c: str, line: str, window: Window, step: int) -> Column:
        f = F.lag if step < 0 else F.lead
        return F.when(f(line).over(window) == F.col(line) + step, f(c).over(window))

    across = pixels.withColumns({"_left": beside("_self", "x", row, -1), "_right": beside("_self", "x", row, 1)})
    across = across.withColumn("_three", F.struct("_left", "_self", "_right") if diagonal else F.struct("_self"))
    both = across.withColumns({"_up": beside("_three", "y", column, -1), "_down": beside("_three", "y", column, 1)})
    name = {-1: "_left", 0: "_self", 1: "_right"}
    at = lambda dx, dy: F.col(name[dx]) if not dy else F.col("_up" if dy < 0 else "_down")[name[dx]]
    near = F.struct(*[at(dx, dy).alias(f"n{k}") for k, (dx, dy) in enumerate(EIGHT if diagonal else FOUR)])
    return both.withColumn("near", near).drop("_self", "_left", "_right", "_three", "_up", "_down")


def weights() -> list[float]:
    """Of the eight neighbours: the inverse of their distance, adding up to 1."""
    raw = [1.0 if not (dx and dy) else 0.5**0.5 for dx, dy in EIGHT]
    return [w / sum(raw) for w in raw]


def gradient(pixels: DataFrame) -> DataFrame:
    """pixels with l, a, b_. Adds grad: the weighted sum of L1 colour distances to the neighbours; those outside the image add nothing and weights stay as they are."""
    out = with_neighbours(pixels, F.struct("l", "a", "b_"))
    terms = []
    for k, w in enumerate(weights()):
        n = F.col("near")[f"n{k}"]
        terms.append(F.coalesce((F.abs(n["l"] - F.col("l")) + F.abs(n["a"] - F.col("a")) + F.abs(n["b_"] - F.col("b_"))) * w, F.lit(0.0)))
    return out.withColumn("grad", sum(terms[1:], terms[0])).drop("near")


def image_variation(graded: DataFrame) -> DataFrame:
    """Coefficient of variation of the gradients of each image."""
    spread = F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("grad") * F.col("grad")) - F.avg("grad") * F.avg("grad")))
    return graded.groupBy("image_id").agg((spread / F.greatest(F.lit(0.001), F.avg("grad"))).alias("cv"))


def borders(labels: DataFrame, label: str = "label", diagonal: bool = False) -> DataFrame:
    """Adds border: 255 where a neighbour has another label, else 0."""
    out = with_neighbours(labels, F.col(label), diagonal)
    other = [F.coalesce(F.col("near")[f"n{k}"] != F.col(label), F.lit(False)) for k in range(8 if diagonal else 4)]
    different = other[0]
    for o in other[1:]:
        different = different | o
    return out.withColumn("border", F.when(different, 255).otherwise(0)).drop("near")


def edge_graph(pixels: DataFrame, value: str) -> DataFrame:
    """The 4-adjacency graph: image_id, a, b (pixel indices), va, vb (their values); each edge once."""
    out = with_neighbours(pixels, F.struct(F.col("idx"), F.col(value).alias("v")), diagonal=False)
    ends = F.explode(F.array(F.col("near")["n1"], F.col("near")["n3"]))  # right and down
    out = out.select("image_id", F.col("idx").alias("a"), F.col(value).alias("va"), ends.alias("e")).where("e is not null")
    return out.select("image_id", "a", F.col("e.idx").alias("b"), "va", F.col("e.v").alias("vb"))


EDGE_WEIGHTS = {
    "l0": "CASE WHEN va <> vb THEN 1 ELSE 0 END", "l1": "abs(va - vb)", "l2": "sqrt((va - vb) * (va - vb))", "l2_squared": "(va - vb) * (va - vb)", "l_infinity": "abs(va - vb)",
    "max": "greatest(va, vb)", "min": "least(va, vb)", "mean": "(va + vb) / CAST(2 AS DOUBLE)",
}


def edge_weights(edges: DataFrame, kind: str) -> DataFrame:
    """Adds weight to edges with va and vb."""
    return edges.withColumn("weight", F.expr(EDGE_WEIGHTS[kind]).cast("double"))
