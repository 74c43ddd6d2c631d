"""Watershed hierarchies by area, volume or dynamics, their saliency maps, and labels from markers, as tables (see hierarchy.py): an image of any size is spread over many tasks.

The edges of the 4-adjacency graph, from light to heavy, make regions meet; the smaller of their attributes is the height at which the boundary between them vanishes. The
saliency of any edge of the graph is the largest height on the way between its pixels in the spanning tree. Edges of one weight or height come in the order of their pixels.

The reference takes its edge response from a trained detector and its hierarchies from a library, neither of
which ships with it; here the response is the pixel gradient, so results are approximate by nature.

Pixels that come twice count once (the smaller value); a null value makes infinitely heavy edges; parts of an image that no edge joins have hierarchies of their own. Pixels
of an image without object markers are all background; without background markers all that can be reached is object. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop
from .hierarchy import ATTRIBUTES, Regions, boruvka, bottlenecks, heights, marker_reach
from .stencil import EDGE_WEIGHTS, edge_graph, edge_weights

OBJECT, BACKGROUND = 1, 2


def graph(pixels: DataFrame, weight: str = "l1") -> DataFrame:
    """pixels: image_id, x, y, v. Returns the 4-adjacency graph: image_id, a, b, weight, and x, y of a and whether b is to its right. Pixels are numbered along the lines."""
    if weight not in EDGE_WEIGHTS:
        raise ValueError("unknown weight")
    once = pixels.groupBy("image_id", "x", "y").agg(F.min(F.col("v").cast("double")).alias("v"))
    wide = once.groupBy("image_id").agg((F.max("x") + 1).alias("cols"))
    placed = once.join(wide, "image_id").withColumn("idx", (F.col("y") * F.col("cols") + F.col("x")).cast("long"))
    edges = edge_graph(placed.withColumn("v", F.struct("v", "x", "y", "cols")), "v")
    weighed = edge_weights(edges.select("image_id", "a", "b", F.col("va.v").alias("va"), F.col("vb.v").alias("vb"), F.col("va.x").alias("x"), F.col("va.y").alias("y"), (F.col("va.y") == F.col("vb.y")).alias("right")), weight)
    return weighed.select("image_id", "a", "b", F.coalesce("weight", F.lit(float("inf"))).alias("weight"), "x", "y", "right")


def watershed_tree(pixels: DataFrame, attribute: str = "area", weight: str = "l1") -> DataFrame:
    """The hierarchy: image_id, a, b, weight, height of the minimum spanning forest's edges."""
    regions = boruvka(graph(pixels, weight).select("image_id", "a", "b", "weight"))
    out = heights(regions, attribute)
    regions.drop()
    return out


def cut_regions(tree: DataFrame) -> Regions:
    """Regions that the heights of a watershed_tree() join, for saliency and marker cuts."""
    return boruvka(tree.select("image_id", "a", "b", F.col("height").alias("weight")))


def edge_saliency(tree: DataFrame, edges: DataFrame, regions: Regions | None = None) -> DataFrame:
    """tree: watershed_tree(). edges with image_id, a, b. Adds saliency: the height at which the two pixels become one region. regions: cut_regions(tree), if the caller has (and drops) them."""
    own = regions or cut_regions(tree)
    found = bottlenecks(own, edges.select("image_id", "a", "b").distinct())
    if regions is None:
        own.drop()
    return edges.join(found.select("image_id", "a", "b", F.col("edge.weight").alias("saliency")), ["image_id", "a", "b"])


def saliency_map(tree: DataFrame, edges: DataFrame, pixels: DataFrame, regions: Regions | None = None) -> DataFrame:
    """image_id, x, y, saliency: of the four pixels around the lower right corner of each pixel the largest edge saliency, as 255 (1 - sqrt(s / largest of the image)); the last line and
    column repeat the ones before. 255 everywhere where nothing stands out."""
    salient = edge_saliency(tree, edges, regions)
    beside = F.when(F.col("right"), F.struct("x", (F.col("y") - 1).alias("y"))).otherwise(F.struct((F.col("x") - 1).alias("x"), "y"))
    corners = salient.select("image_id", F.explode(F.array(F.struct("x", "y"), beside)).alias("c"), "saliency").where("c.x >= 0 and c.y >= 0")
    corners = cut(corners.groupBy("image_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")).agg(F.max("saliency").alias("s")))
    size = pixels.groupBy("image_id").agg(F.max("x").alias("last_x"), F.max("y").alias("last_y"))
    inner = corners.join(size, "image_id").where((F.col("cx") <= F.greatest(F.col("last_x") - 1, F.lit(0))) & (F.col("cy") <= F.greatest(F.col("last_y") - 1, F.lit(0))))
    most = inner.groupBy("image_id").agg(F.max("s").alias("most"))
    at = lambda c: F.least(F.col(c), F.greatest(F.col(f"last_{c}") - 1, F.lit(0))).alias(f"c{c}")
    placed = pixels.select("image_id", "x", "y").distinct().join(size, "image_id").select("image_id", "x", "y", at("x"), at("y"))
    met = placed.join(corners, ["image_id", "cx", "cy"], "left").join(most, "image_id", "left")
    return met.select("image_id", "x", "y", (255 * (1 - F.when(F.col("most") > 0, F.sqrt(F.col("s") / F.col("most"))).otherwise(0.0))).alias("saliency"))


def stamped(scribbles: DataFrame) -> DataFrame:
    """image_id, x, y, is_object: the 2 by 2 block up and left of each scribble pixel; none where it would leave the image."""
    block = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for dy in (1, 0) for dx in (1, 0)]))
    return scribbles.where("x > 0 and y > 0").select("image_id", block.alias("p"), "is_object").select("image_id", "p.x", "p.y", "is_object").distinct()


def marker_labels(tree: DataFrame, pixels: DataFrame, scribbles: DataFrame, regions: Regions | None = None) -> DataFrame:
    """image_id, x, y, label. A pixel is object (1) if the smallest region of the hierarchy that holds it and object marks holds no background mark; else background (2)."""
    wide = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("cols"))
    placed = cut(pixels.select("image_id", "x", "y").distinct().join(wide, "image_id").withColumn("node", (F.col("y") * F.col("cols") + F.col("x")).cast("long")))
    marked = placed.join(stamped(scribbles), ["image_id", "x", "y"]).select("image_id", "node", F.col("is_object").alias("kind"))
    own = regions or cut_regions(tree)
    reach = marker_reach(own, placed.select("image_id", "node"), marked)
    if regions is None:
        own.drop()
    sides = reach.groupBy("image_id", "node").agg(F.max(F.when(F.col("kind"), F.col("reach"))).alias("o"), F.max(F.when(~F.col("kind"), F.col("reach"))).alias("b"))
    inside = F.col("o").isNotNull() & (F.col("b").isNull() | (F.col("o") < F.col("b")))
    return placed.join(sides, ["image_id", "node"], "left").select("image_id", "x", "y", F.when(inside, OBJECT).otherwise(BACKGROUND).alias("label"))


def watershed(pixels: DataFrame, scribbles: DataFrame, attribute: str = "area", weight: str = "l1") -> DataFrame:
    """pixels: image_id, x, y, v (edge response). scribbles with is_object. Returns image_id, idx, label, saliency."""
    if attribute not in ATTRIBUTES:
        raise ValueError("unknown attribute")
    pixels = cut(pixels.select("image_id", "x", "y", "v"))
    edges = cut(graph(pixels, weight))
    regions = boruvka(edges.select("image_id", "a", "b", "weight"))
    tree = heights(regions, attribute)
    regions.drop()
    regions = cut_regions(tree)
    labels, seen = marker_labels(tree, pixels, scribbles, regions), saliency_map(tree, edges, pixels, regions)
    regions.drop()
    wide = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("cols"))
    out = cut(labels.join(seen, ["image_id", "x", "y"]).join(wide, "image_id").select("image_id", (F.col("y") * F.col("cols") + F.col("x")).cast("long").alias("idx"), "label", "saliency"))
    drop(pixels, edges, tree)
    return out
