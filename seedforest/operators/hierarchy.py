"""Hierarchies of an image's edge graph as tables: minimum spanning trees, the attribute heights of their edges, bottlenecks between nodes and cuts by markers.

All of it rests on one table per round of Borůvka's algorithm. In each round every region takes its least edge (by weight, then by the pixels it joins), regions that are
joined this way become one, and the round's table keeps node, parent and that edge. Regions at least halve in number, so there are as many tables as the logarithm of the largest
image's pixels; a node's ancestors are found by joining upwards through them. Images of any size are rows of the same tables, dealt out by image and region.

What makes this tree useful: the largest edge on the way between two pixels in the spanning tree is the largest edge on their way through the tree of regions, whose depth is logarithmic. The
spanning tree itself may be as deep as the image is long.

Heights need the order in which regions meet when edges come from light to heavy. After its own edge comes, a region belongs to the nearest ancestor that has a larger edge
(its host). A host's guests, in the order of their edges, are all that ever joins it: the first two share one edge, each further one meets what the earlier ones have added
up to. So attributes are prefix aggregates over the guests of each host. Hosts with very many guests are summed in blocks of a range partition of the edges first.

Rows with a null weight count as infinitely heavy; repeated edges and loops change nothing; parts that no edge joins stay apart, each with its own tree. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop

ATTRIBUTES = ("area", "volume", "dynamics")
INFINITE = float("inf")
EDGE = "struct<weight:double,a:bigint,b:bigint>"


@dataclass
class Regions:
    """levels[k]: image_id, node, parent, edge (weight, a, b): the regions of round k that have an edge to another one, the node that they become part of
    in round k + 1, and their least edge. Nodes are named after one of their pixels."""

    levels: list[DataFrame]
    made: DataFrame  # the table that the first levels are read from

    def edges(self) -> DataFrame:
        """The minimum spanning forest: image_id, a, b, weight; each edge once."""
        return _union(self.levels).select("image_id", "edge.*").distinct().select("image_id", "a", "b", "weight")

    def drop(self) -> None:
        drop(self.made, *[level for level in self.levels if hasattr(level, "cut_path")])


#: Nodes that agree in all but so many bits are a tile: a band of lines where nodes are pixels.
TILE = 16


def _tile_rounds(a: np.ndarray, b: np.ndarray, inside: np.ndarray) -> tuple[list, np.ndarray]:
    """Rounds within a tile. a, b: the ends of its edges as numbers of nodes, edges from light to heavy; inside: which nodes are the tile's. A list of (regions, their
    parents, their least edges, whether the last round is over for them) and the region of each node at the end.

    A tile has all edges of its nodes, so the least edge of a region is known. One whose least edge leaves the tile waits: it stays its own parent, and what joins it has
    only larger edges to others, so it waits to the end."""
    n, at, rounds = len(inside), np.arange(len(inside)), []
    edge, u, v = np.arange(len(a)), a, b
    while True:
        apart = u != v
        edge, u, v = edge[apart], u[apart], v[apart]
        least = np.full(n, len(a))
        np.minimum.at(least, u, edge)
        np.minimum.at(least, v, edge)
        region = np.flatnonzero((least < len(a)) & inside)
        to, ends = np.arange(n), least[region]
        other = np.where(at[a[ends]] == region, at[b[ends]], at[a[ends]])
        to[region] = np.where(inside[other], other, region)
        mutual = region[(to[to[region]] == region) & (region < to[region])]
        to[mutual] = mutual
        while (to[to] != to).any():
            to = to[to]
        moved = bool((to[region] != region).any())
        rounds.append((region, to[region], ends, moved))
        if not moved:
            return rounds, at
        at, u, v = to[at], to[u], to[v]


def _contract(key, frame: pd.DataFrame, bits: int) -> pd.DataFrame:
    """One tile's rounds (kind 0; 1 for regions that wait from this round on) and, for the edges that are left, the region at an end in this tile (kind 2, level 0 for the end a, 1 for b)."""
    image, tile = key
    frame = frame.sort_values(["weight", "a", "b"], kind="stable").drop_duplicates(["a", "b"])
    nodes, ends = np.unique(np.concatenate([frame["a"].to_numpy(), frame["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: len(frame)], ends[len(frame) :]
    inside = nodes >> bits == tile
    rounds, at = _tile_rounds(a, b, inside)
    made = [np.stack([np.full(len(r), 0 if moved else 1), np.full(len(r), k), nodes[r], nodes[p], e]) for k, (r, p, e, moved) in enumerate(rounds)]
    for level, own in ((0, a), (1, b)):
        e = np.flatnonzero(inside[own] & (at[a] != at[b]))
        made.append(np.stack([np.full(len(e), 2), np.full(len(e), level), nodes[at[own[e]]], nodes[at[own[e]]], e]))
    kind, level, node, parent, e = np.concatenate(made, axis=1)
    out = frame[["weight", "a", "b"]].iloc[e].reset_index(drop=True)
    return out.assign(image_id=image, kind=kind.astype(np.int32), level=level.astype(np.int32), node=node, parent=parent)


def _contracted(edges: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """edges: image_id, edge. The levels of the rounds that need no other tile, the edges that are left, and the table that both are read from. Edges are dealt out once, by tile."""
    kind = edges.schema["image_id"].dataType.simpleString()
    ends = F.array_distinct(F.array(F.shiftright("edge.a", TILE), F.shiftright("edge.b", TILE)))
    tiles = edges.where("image_id IS NOT NULL").select("image_id", F.explode(ends).alias("tile"), "edge.weight", "edge.a", "edge.b")
    bits = TILE
    made = cut(tiles.groupBy("image_id", "tile").applyInPandas(lambda key, frame: _contract(key, frame, bits), f"image_id {kind}, kind int, level int, node bigint, parent bigint, weight double, a bigint, b bigint"))
    edge = F.struct("weight", "a", "b").cast(EDGE).alias("edge")
    last = made.where("kind = 0").agg(F.max("level")).first()[0] or 0
    here = lambda k: ((F.col("kind") == 0) & (F.col("level") == k)) | ((F.col("kind") == 1) & (F.col("level") <= k))
    levels = [made.where(here(k)).select("image_id", "node", "parent", edge) for k in range(last + 1)]
    sides = made.where("kind = 2").groupBy("image_id", "weight", F.col("a").alias("ea"), F.col("b").alias("eb")).agg(F.max(F.when(F.col("level") == 0, F.col("node"))).alias("x"), F.max(F.when(F.col("level") == 1, F.col("node"))).alias("y"))
    left = sides.select("image_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.struct("weight", F.col("ea").alias("a"), F.col("eb").alias("b")).cast(EDGE).alias("edge"))
    return levels, cut(left.groupBy("image_id", "a", "b").agg(F.min("edge").alias("edge"))), made


def boruvka(edges: DataFrame) -> Regions:
    """edges: image_id, a, b, weight. The rounds that stay within a tile of an image run where its edges are; the others are joins of the regions that are left."""
    edge = F.struct(F.coalesce(F.col("weight").cast("double"), F.lit(INFINITE)).alias("weight"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).cast(EDGE)
    levels, left, made = _contracted(edges.where("a <> b").select("image_id", edge.alias("edge")))
    while not left.isEmpty():
        both = left.unionByName(left.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"), "edge"))
        best = cut(both.groupBy("image_id", F.col("a").alias("node")).agg(F.min(F.struct("edge", F.col("b").alias("to"))).alias("m")).select("image_id", "node", "m.to", "m.edge"))
        roots = _roots(best)
        levels.append(cut(best.select("image_id", "node", "edge").join(roots, ["image_id", "node"]).select("image_id", "node", F.col("root").alias("parent"), "edge")))
        on = levels[-1].select("image_id", "node", "parent")
        moved = left.join(on.select("image_id", F.col("node").alias("a"), F.col("parent").alias("x")), ["image_id", "a"]).join(on.select("image_id", F.col("node").alias("b"), F.col("parent").alias("y")), ["image_id", "b"])
        moved = moved.where("x <> y").select("image_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "edge")
        fewer = cut(moved.groupBy("image_id", "a", "b").agg(F.min("edge").alias("edge")))
        drop(left, best, roots)
        left = fewer
    drop(left)
    return Regions(levels, made)


def _roots(best: DataFrame) -> DataFrame:
    """best: image_id, node, to. The last node that `to` leads to: of two that point at each other the smaller, or one that points nowhere. Ways are doubled (twice
    in each table) until none gets longer."""
    on = best.select("image_id", F.col("node").alias("to"), F.col("to").alias("next"))
    jumped = best.select("image_id", "node", "to").join(on, ["image_id", "to"], "left")
    first = F.when((F.col("next") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to"))
    known = cut(jumped.select("image_id", "node", first.alias("root"), F.lit(True).alias("moved")))
    while True:
        on = known.select("image_id", F.col("node").alias("root"), F.col("root").alias("next"))
        twice = known.select("image_id", "node", "root").join(on, ["image_id", "root"], "left").select("image_id", "node", F.col("root").alias("was"), F.coalesce("next", "root").alias("root"))
        on = on.withColumnRenamed("next", "third")
        step = twice.join(on, ["image_id", "root"], "left").select("image_id", "node", "was", F.coalesce("third", "root").alias("root"))
        step = cut(step.select("image_id", "node", "root", (F.col("was") != F.col("root")).alias("moved")))
        drop(known)
        known = step
        if known.where("moved").isEmpty():
            return known


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def hosts(regions: Regions) -> DataFrame:
    """level, image_id, node, edge of every region that has an edge, and its host: the nearest ancestor whose edge is larger or that has none, as host_level and host."""
    steps, climbing = [], None
    for k, level in enumerate(regions.levels):
        fresh = level.select(F.lit(k).alias("level"), "image_id", "node", "edge", F.col("parent").alias("at"))
        climbing = fresh if climbing is None else climbing.unionByName(fresh)
        last = k + 1 == len(regions.levels)
        theirs = F.lit(None).cast(climbing.schema["edge"].dataType) if last else F.col("theirs")
        if not last:
            above = regions.levels[k + 1].select("image_id", F.col("node").alias("at"), F.col("parent").alias("next"), F.col("edge").alias("theirs"))
            climbing = climbing.join(above, ["image_id", "at"], "left")
        stays = theirs.isNull() | (theirs > F.col("edge"))
        steps.append(cut(climbing.select("level", "image_id", "node", "edge", F.lit(k + 1).alias("host_level"), F.col("at").alias("host"), stays.alias("stays"), (F.col("at") if last else F.col("next")).alias("next"))))
        climbing = steps[-1].where("not stays").select("level", "image_id", "node", "edge", F.col("next").alias("at"))
    out = cut(_union(steps).where("stays").drop("stays", "next"))
    drop(*steps)
    return out


def heights(regions: Regions, attribute: str = "area", blocks: int | None = None) -> DataFrame:
    """image_id, a, b, weight, height of the spanning forest's edges: the smaller attribute of the two regions that meet there. Area: pixels. Volume: area below the edge's
    weight. Dynamics: depth below that weight (none for a pixel alone)."""
    if attribute not in ATTRIBUTES:
        raise ValueError(f"attribute must be one of {ATTRIBUTES}")
    guests = hosts(regions)
    spark = guests.sparkSession
    # what regions have gathered when their edge comes, from pixels upwards
    placed, own = [], regions.levels[0].select("image_id", "node", F.lit(1).cast("long").alias("size"), F.lit(INFINITE).alias("low"))
    for k in range(len(regions.levels)):
        placed.append(cut(guests.where(F.col("level") == k).join(own, ["image_id", "node"])))
        joined = _union(placed).where(F.col("host_level") == k + 1).select("image_id", F.col("host").alias("node"), "size", F.least("low", "edge.weight").alias("low"))
        own = joined.groupBy("image_id", "node").agg(F.sum("size").alias("size"), F.min("low").alias("low"))
    every = _union(placed)
    host = ["image_id", "host_level", "host"]
    blocks = blocks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(every.repartitionByRange(blocks, "edge").withColumn("block", F.spark_partition_id()))
    low = F.least("low", "edge.weight")
    order = Window.partitionBy(*host, "block").orderBy("edge", "level", "node").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*host).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*host, "block").agg(F.sum("size").alias("all"), F.min(low).alias("least"))
    totals = totals.select(*host, "block", F.sum("all").over(earlier).alias("before"), F.min("least").over(earlier).alias("before_low"))
    met = dealt.select("*", F.sum("size").over(order).alias("here"), F.min(low).over(order).alias("here_low")).join(totals, [*host, "block"])
    other = F.coalesce("here", F.lit(0)) + F.coalesce("before", F.lit(0))
    other_low = F.least(F.coalesce("here_low", F.lit(INFINITE)), F.coalesce("before_low", F.lit(INFINITE)))
    w = F.col("edge.weight")
    value = {"area": F.least("size", other).cast("double"), "volume": F.least("size", other) * w, "dynamics": F.least(w - F.least("low", w), w - F.least(other_low, w))}[attribute]
    out = cut(met.where(other > 0).select("image_id", "edge.a", "edge.b", "edge.weight", value.alias("height")))
    drop(guests, dealt, *placed)
    return out


def bottlenecks(regions: Regions, pairs: DataFrame) -> DataFrame:
    """pairs: image_id, a, b, different from each other. With edge: the largest on the way from a to b in the spanning forest. Pairs that nothing joins are left out."""
    steps = [pairs.select("image_id", "a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast(EDGE).alias("edge"))]
    for level in regions.levels:
        side = lambda c, e: level.select("image_id", F.col("node").alias(c), F.col("parent").alias(f"{c}_up"), F.col("edge").alias(e))  # noqa: B023, E731
        met = steps[-1].where("x <> y").join(side("x", "x_edge"), ["image_id", "x"]).join(side("y", "y_edge"), ["image_id", "y"])
        steps.append(cut(met.select("image_id", "a", "b", F.col("x_up").alias("x"), F.col("y_up").alias("y"), F.greatest("edge", "x_edge", "y_edge").alias("edge"))))
    out = cut(_union(steps).where("x = y").select("image_id", "a", "b", "edge"))
    drop(*steps[1:])
    return out


def marker_reach(regions: Regions, nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """nodes: image_id, node. marked: image_id, node, kind. For each node and each kind that it can reach: reach, a struct of far (false for a marked node) and edge, the
    smallest edge that is the largest on a way to a marked node. Structs compare as the reaches do."""
    here, by = F.struct(F.lit(False).alias("far"), F.lit(None).cast(EDGE).alias("edge")), lambda e: F.struct(F.lit(True).alias("far"), F.col(e).cast(EDGE).alias("edge"))
    up = [cut(marked.select("image_id", "node", "kind").distinct().withColumn("reach", here))]
    for level in regions.levels:
        rise = up[-1].join(level, ["image_id", "node"])
        up.append(cut(rise.groupBy("image_id", F.col("parent").alias("node"), "kind").agg(F.min(F.greatest("reach", by("edge"))).alias("reach"))))
    steps = [nodes.select("image_id", "node", F.col("node").alias("at"), here.alias("way"))]
    for level in regions.levels:
        above = level.select("image_id", F.col("node").alias("at"), "parent", "edge")
        steps.append(cut(steps[-1].join(above, ["image_id", "at"]).select("image_id", "node", F.col("parent").alias("at"), F.greatest("way", by("edge")).alias("way"))))
    met = [s.join(u.withColumnRenamed("node", "at"), ["image_id", "at"]).select("image_id", "node", "kind", F.greatest("way", "reach").alias("reach")) for s, u in zip(steps, up, strict=True)]
    out = cut(_union(met).groupBy("image_id", "node", "kind").agg(F.min("reach").alias("reach")))
    drop(*up, *steps[1:])
    return out


def flood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges: image_id, a, b, weight. seeds: image_id, node, tree_id. Returns image_id, node, tree_id of all nodes that a seed can reach: the minimum spanning forest in
    which each tree holds one seed, so each node comes to a seed along the way whose largest edge is least. In each round the parts without a seed take their least edge; parts that
    meet a seed's part that way belong to it. Of several trees that start at one node the smallest counts."""
    edge = F.struct(F.coalesce(F.col("weight").cast("double"), F.lit(INFINITE)).alias("weight"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).cast(EDGE)
    roots = cut(seeds.groupBy("image_id", "node").agg(F.min("tree_id").alias("tree_id")))
    seeded = lambda c: roots.select("image_id", F.col("node").alias(c), F.lit(True).alias(f"{c}_seeded"))
    flags = ("a_seeded", "b_seeded")
    left = edges.where("a <> b").select("image_id", edge.alias("edge")).select("image_id", F.col("edge.a").alias("a"), F.col("edge.b").alias("b"), "edge")
    left = left.join(seeded("a"), ["image_id", "a"], "left").join(seeded("b"), ["image_id", "b"], "left").fillna(False, list(flags))
    left = cut(left.where("not (a_seeded and b_seeded)").groupBy("image_id", "a", "b", *flags).agg(F.min("edge").alias("edge")))
    levels = []
    while not levels or not left.isEmpty():
        both = left.where("not a_seeded").select("image_id", F.col("a").alias("node"), F.col("b").alias("to"), "edge").unionByName(left.where("not b_seeded").select("image_id", F.col("b").alias("node"), F.col("a").alias("to"), "edge"))
        best = cut(both.groupBy("image_id", "node").agg(F.min(F.struct("edge", "to")).alias("m")).select("image_id", "node", "m.to"))
        found = _roots(best)
        levels.append(cut(found.select("image_id", "node", F.col("root").alias("parent")).join(roots.select("image_id", F.col("node").alias("parent"), F.lit(True).alias("done")), ["image_id", "parent"], "left").fillna(False, ["done"])))
        up = lambda c: levels[-1].select("image_id", F.col("node").alias(c), F.col("parent").alias(f"{c}_up"), F.col("done").alias(f"{c}_done"))
        moved = left.join(up("a"), ["image_id", "a"], "left").join(up("b"), ["image_id", "b"], "left")
        end = lambda c: (F.coalesce(f"{c}_up", c), F.coalesce(f"{c}_done", f"{c}_seeded"))
        (x, xs), (y, ys) = end("a"), end("b")
        moved = moved.select("image_id", x.alias("a"), y.alias("b"), xs.alias("a_seeded"), ys.alias("b_seeded"), "edge").where("a <> b and not (a_seeded and b_seeded)")
        fewer = cut(moved.groupBy("image_id", "a", "b", *flags).agg(F.min("edge").alias("edge")))
        drop(left, best, found)
        left = fewer
    # every node without a seed is in the first table; parts are named after one of their nodes
    steps = [roots.select("image_id", "node", F.col("node").alias("at"), F.lit(True).alias("done"))]
    climbing = levels[0].select("image_id", "node", F.col("parent").alias("at"), "done")
    for k, level in enumerate(levels):
        if k:
            on = level.select("image_id", F.col("node").alias("at"), "parent", "done")
            climbing = steps[-1].where("not done").drop("done").join(on, ["image_id", "at"]).select("image_id", "node", F.col("parent").alias("at"), "done")
        steps.append(cut(climbing))
    out = _union(steps).where("done").select("image_id", "node", "at").join(roots.withColumnRenamed("node", "at"), ["image_id", "at"])
    out = cut(out.select("image_id", "node", "tree_id"))
    drop(left, roots, *levels, *steps[1:])
    return out
