"""Segmentation by class as tables, for images larger than a task: every step is a join, a window along a line or an aggregation, and one image is many tasks.

It differs from plans/segment.py in the growth: there the colour of a tree changes with each pixel that joins it, which depends on one global order. Here the cost of a step is the
colour distance of the two pixels, which is fixed, so the forest is the minimum spanning forest of the seeds (hierarchy.flood) and has no order. The spanning tree
of an image is made once; later rounds flood along it only. All else (seeds, classes, thresholds, removal, stop rule) is the same.

Images stop one by one: those that are finished leave the tables of the next round, and the driver only asks whether any is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import with_lab
from ..operators.hierarchy import boruvka, flood
from ..operators.seeds import lattice, seed_table, suppressed, to_smallest_gradient
from ..operators.selection import LAST, STOP, kept_by_class, removal_state
from ..operators.stencil import borders, edge_graph, gradient
from ..operators.trees import tree_adjacency, tree_stats
from .lineage import cut, drop


def colour_edges(pixels: DataFrame) -> DataFrame:
    """pixels with idx, l, a, b_. The 4-adjacency graph: image_id, a, b, weight (the colour distance, to nine digits)."""
    edges = edge_graph(pixels.withColumn("v", F.struct("l", "a", "b_")), "v")
    square = lambda c: (F.col(f"va.{c}") - F.col(f"vb.{c}")) * (F.col(f"va.{c}") - F.col(f"vb.{c}"))
    return edges.select("image_id", "a", "b", F.round(F.sqrt(square("l") + square("a") + square("b_")), 9).alias("weight"))


def segment_tables(pixels: DataFrame, scribbles: DataFrame, samples: int, iterations: int, obj_markers: int = 1, compat: bool = True) -> DataFrame:
    """pixels: image_id, x, y, val (1 to 4 channels of 0..255, or 0..65535). scribbles: image_id, marker_id, ord, x, y, object markers first. Returns image_id, idx, x, y, label
    (1 object, 2 background), tree_id, border. Images without a scribble are left out; scribbles outside their image are dropped. Empty tables give an empty table."""
    if samples < 1 or iterations < 1 or obj_markers < 1:
        raise ValueError("samples, iterations and obj_markers must be positive")
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("n_rows"), (F.max("x") + 1).alias("n_cols"), F.when(F.max(F.array_max("val")) > 255, 65535).otherwise(255).alias("norm"))
    channel = lambda k: F.when(F.size("val") < 3, F.col("val")[0]).otherwise(F.get("val", F.lit(k)))
    marked = scribbles.select("image_id").distinct()
    wide = pixels.join(size, "image_id").join(marked, "image_id", "left_semi").withColumn("idx", (F.col("y") * F.col("n_cols") + F.col("x")).cast("long"))
    lab = with_lab(wide.select("image_id", "x", "y", "idx", "norm", *[channel(k).alias(c) for k, c in enumerate("rgb")])).select("image_id", "x", "y", "idx", "l", "a", "b_")
    graded = cut(gradient(lab).withColumn("grad", F.round("grad", 9)))
    inside = cut(scribbles.join(size, "image_id").where("x >= 0 and y >= 0 and x < n_cols and y < n_rows").select("image_id", "marker_id", "ord", "x", "y"))
    grid = to_smallest_gradient(suppressed(lattice(size.join(inside.select("image_id").distinct(), "image_id"), samples), inside), graded)
    seeds = seed_table(inside, grid).join(graded.select("image_id", "x", "y", F.col("idx").alias("node")), ["image_id", "x", "y"])
    # of grid seeds that move to one pixel the first counts
    seeds = cut(seeds.groupBy("image_id", "node").agg(F.min(F.struct("tree_id", "label", "is_grid")).alias("m")).select("image_id", "node", "m.*", F.lit(False).alias("last")))
    regions = boruvka(colour_edges(graded))
    ways = cut(regions.edges())
    regions.drop()
    finished, turn = [], 1
    while not seeds.isEmpty():
        living = seeds.select("image_id", "last").distinct()
        grown = flood(ways.join(living, "image_id", "left_semi"), seeds.select("image_id", "node", "tree_id"))
        named = seeds.select("image_id", "tree_id", "label", "is_grid", "last")
        labelled = cut(graded.join(grown.withColumnRenamed("node", "idx"), ["image_id", "idx"]).join(named, ["image_id", "tree_id"]))
        if turn >= iterations:
            finished.append(labelled)
            drop(grown, seeds)
            break
        going = labelled.where("not last")
        trees = cut(tree_stats(going).join(named.drop("last"), ["image_id", "tree_id"]))
        kept = kept_by_class(trees, cut(tree_adjacency(going)), obj_markers, compat)
        states = cut(removal_state(trees, kept, obj_markers))
        goes_on = states.where(F.col("state") != STOP)
        finished.append(cut(labelled.join(goes_on, "image_id", "left_anti")))
        following = kept.select("image_id", "tree_id", "new_id").join(goes_on, "image_id").join(seeds.drop("last"), ["image_id", "tree_id"])
        following = cut(following.select("image_id", "node", F.col("new_id").alias("tree_id"), "label", "is_grid", (F.col("state") == LAST).alias("last")))
        drop(grown, labelled, seeds, trees, kept, states)
        seeds, turn = following, turn + 1
    drop(ways, graded, inside)
    if not finished:
        return pixels.select("image_id", F.lit(0).cast("long").alias("idx"), "x", "y", F.lit(0).alias("label"), F.lit(0).alias("tree_id"), F.lit(0).alias("border")).where("false")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    judged = out.select("image_id", "idx", "x", "y", F.when(F.col("label") <= obj_markers, 1).otherwise(2).alias("label"), "tree_id")
    return borders(judged).select("image_id", "idx", "x", "y", "label", "tree_id", "border")
