"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node and component (the smallest node reachable) for every node of a link to another one. Each round contracts
    nodes to the neighbour with the smallest hash of the round, two hops at once, so the numbers of nodes fall geometrically; nothing is collected."""
    steps, edges, turn = [], cut(links.select("a", "b").where("a <> b").distinct()), 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        near = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("from"), F.least("m", rank("a"))["to"].alias("to")))
        on = near.select(F.col("from").alias("to"), F.col("to").alias("next"))
        steps.append(cut(near.join(on, "to").select("from", F.col("next").alias("to"))))
        step = steps[-1]
        far = edges.join(step, edges["a"] == step["from"]).select(F.col("to").alias("x"), "b")
        far = far.join(step, far["b"] == step["from"]).select("x", F.col("to").alias("y")).where("x <> y")
        fewer = cut(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop(edges, near)
        edges = fewer
        turn += 1
        if edges.isEmpty():
            break
    labels = steps[0].select(F.col("from").alias("node"), F.col("to").alias("label"))
    for step in steps[1:]:
        labels = labels.join(step, labels["label"] == step["from"], "left").select("node", F.coalesce("to", "label").alias("label"))
    named = cut(labels)
    least = named.groupBy("label").agg(F.min("node").alias("component"))
    out = cut(named.join(least, "label").select("node", "component"))
    drop(named, edges, *steps)
    return out
