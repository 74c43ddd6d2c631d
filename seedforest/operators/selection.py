"""Which trees stay: removal in the order of priority, removal by class, and the stop rule, as tables of trees.

Ties of priority go by the tree's number; a missing priority comes last. Repeated adjacencies change nothing. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop
from .trees import both_ways, class_thresholds, tree_classes

GO_ON, STOP, LAST = 0, 1, 2


def removed_in_order(trees: DataFrame, adjacency: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """trees: image_id, tree_id, priority. adjacency: image_id, tree_a, tree_b. protected: image_id, tree_id. Returns image_id, tree_id, removed.

    In ascending order of priority a tree goes unless a neighbour is protected or has gone before. No tree waits for another one's turn: in each round those go that have no
    undecided neighbour ahead of them, which saves their neighbours; the others decide in later rounds. Rounds end when nothing is undecided."""
    order = F.struct(F.coalesce("priority", F.lit(float("inf"))).alias("priority"), "tree_id")
    every = trees.select("image_id", "tree_id", order.alias("turn"))
    beside = both_ways(adjacency).distinct()
    safe = None
    if protected is not None:
        safe = cut(beside.join(protected.select("image_id", F.col("tree_id").alias("other")).distinct(), ["image_id", "other"]).select("image_id", "tree_id").distinct())
        every = every.join(safe, ["image_id", "tree_id"], "left_anti")
    open_trees = cut(every)
    theirs = open_trees.select("image_id", F.col("tree_id").alias("other"), F.col("turn").alias("their_turn"))
    ahead = beside.join(open_trees, ["image_id", "tree_id"]).join(theirs, ["image_id", "other"]).where("their_turn < turn").select("image_id", F.col("other").alias("first"), F.col("tree_id").alias("then"))
    ahead = cut(ahead)
    open_trees, gone = cut(open_trees.select("image_id", "tree_id")), []
    while not open_trees.isEmpty():
        now = cut(open_trees.join(ahead.select("image_id", F.col("then").alias("tree_id")), ["image_id", "tree_id"], "left_anti"))
        saved = ahead.join(now.withColumnRenamed("tree_id", "first"), ["image_id", "first"]).select("image_id", F.col("then").alias("tree_id")).distinct()
        decided = cut(now.unionByName(saved))
        on = lambda c: decided.withColumnRenamed("tree_id", c)  # noqa: B023, E731
        left = cut(open_trees.join(decided, ["image_id", "tree_id"], "left_anti"))
        fewer = cut(ahead.join(on("first"), ["image_id", "first"], "left_anti").join(on("then"), ["image_id", "then"], "left_anti").select("image_id", "first", "then"))
        gone.append(now)
        drop(open_trees, ahead, decided)
        open_trees, ahead = left, fewer
    out = trees.select("image_id", "tree_id")
    if not gone:
        return out.withColumn("removed", F.lit(False))
    went = gone[0]
    for g in gone[1:]:
        went = went.unionByName(g)
    found = cut(out.join(went.withColumn("removed", F.lit(True)), ["image_id", "tree_id"], "left").fillna(False, ["removed"]))
    drop(open_trees, ahead, *gone, *([safe] if safe is not None else []))
    return found


def kept_by_class(trees: DataFrame, adjacency: DataFrame, obj_markers: int = 1, compat: bool = True, pixels: int | None = None) -> DataFrame:
    """trees: tree_stats() with label and is_grid. The trees that stay: image_id, tree_id, label, is_grid and new_id, their number from now on.

    Scribbled trees stay if they have a neighbour. Grid trees among background only go in order of priority (removed_in_order) as far as their class's threshold; grid trees beside the
    object stay from the threshold of theirs up, cut to an integer with compat=True. Scribbled trees come first, then the former by priority, then the latter from the largest down."""
    judged = tree_classes(trees.withColumn("is_object", F.col("label") <= obj_markers), adjacency, pixels).join(trees.select("image_id", "tree_id", "label", "is_grid"), ["image_id", "tree_id"])
    judged = cut(judged)
    limits = class_thresholds(judged.drop("label", "is_grid"), compat)
    limit = lambda group, name: limits.where(F.col("group") == group).select("image_id", F.col("threshold").alias(name))
    judged_with = cut(judged.join(limit("13", "inner"), "image_id", "left").join(limit("24", "outer"), "image_id", "left").fillna(float("inf"), ["inner", "outer"]))
    low = judged_with.where("is_grid and class = 1 and priority < inner")
    objects = judged_with.where(F.col("label") <= obj_markers).select("image_id", "tree_id")
    gone = removed_in_order(low.select("image_id", "tree_id", "priority"), adjacency, objects).where("removed").drop("removed")
    outer = F.col("outer")
    if compat:
        whole = F.when(outer < float("inf"), F.floor(outer).cast("double")).otherwise(0.0)
        far = ((outer <= 0) | (whole >= outer)) & (F.floor("priority") >= outer)
    else:
        far = F.col("priority") >= outer
    place = F.when(~F.col("is_grid") & (F.col("class") != 0), 0).when(F.col("is_grid") & (F.col("class") == 1), 1).when(F.col("is_grid") & (F.col("class") == 2) & far, 2)
    placed = judged_with.withColumn("place", place).where("place is not null").join(gone, ["image_id", "tree_id"], "left_anti")
    by = F.when(F.col("place") == 1, F.col("priority")).when(F.col("place") == 2, -F.col("priority")).otherwise(0.0)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("place", by, "tree_id")) - 1
    out = cut(placed.select("image_id", "tree_id", "label", "is_grid", number.alias("new_id")))
    drop(judged, judged_with)
    return out


def removal_state(trees: DataFrame, kept: DataFrame, obj_markers: int = 1) -> DataFrame:
    """image_id and state of each image of trees: STOP if no object tree is left or nothing else, LAST (one more pass) if no grid tree is, else GO_ON."""
    kinds = kept.groupBy("image_id").agg(F.bool_or(F.col("label") <= obj_markers).alias("front"), F.bool_or((F.col("label") > obj_markers) & ~F.col("is_grid")).alias("back"), F.bool_or("is_grid").alias("grid"))
    each = trees.select("image_id").distinct().join(kinds, "image_id", "left").fillna(False, ["front", "back", "grid"])
    state = F.when(~F.col("front") | ~(F.col("back") | F.col("grid")), STOP).when(~F.col("grid"), LAST).otherwise(GO_ON)
    return each.select("image_id", state.alias("state"))
