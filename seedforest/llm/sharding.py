"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of RING positions. A key starts at the position its hash names and goes to the next shard
clockwise that still has room; a shard is full at (1 + slack) times the mean load. Large documents are placed first, so that
small ones fill what is left. Where no shard has room for a key, the least loaded shard takes it.

Keys are placed by cell: a cell is one ring position and one size class (power of two), so the placement sees at most RING * 64
cells of counts and bytes, however many documents there are; rows are then looked up by cell. Only JVM expressions touch rows. A cell with more than
1 / PARTS of a shard's share (an id that very many rows have, null among them) is split into parts that are placed one by one, so it overflows like single keys
do and no task numbers all of its rows. Where a row goes depends on the ids and texts of the table only, not on how it is partitioned.

With loads as close to the mean as here (slack), nearly every shard is full and keys overflow along the ring, so one shard more moves 14 to 17 percent of the documents where 4 would do: the balance
has been given preference. A larger slack moves fewer.

Null counts as an empty text with its 8 bytes overhead; a null id is a key like any other; repeated rows get slots of their own. A single text larger than
the room of a shard exceeds the bound: the least loaded shard takes it. Very long texts are only measured. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RING = 8192
VIRTUAL_NODES = 64
OVERHEAD = 8
PARTS = 64


def ring_position(key: str, ring: int = RING) -> int:
    return int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big") % ring


def ring_orders(shards: int, virtual_nodes: int = VIRTUAL_NODES, ring: int = RING) -> tuple[list[int], list[list[int]]]:
    """The virtual nodes' positions, sorted, and for each the distinct shards met clockwise from there."""
    nodes = sorted((ring_position(f"shard {s} node {v}", ring), s) for s in range(shards) for v in range(virtual_nodes))
    orders = []
    for k in range(len(nodes)):
        seen: dict[int, None] = {}
        for j in range(len(nodes)):
            seen[nodes[(k + j) % len(nodes)][1]] = None
            if len(seen) == shards:
                break
        orders.append(list(seen))
    return [p for p, _ in nodes], orders


def place_cells(cells: list[tuple[int, int, int, int, int]], shards: int, slack: float, virtual_nodes: int = VIRTUAL_NODES, ring: int = RING) -> dict[tuple[int, int, int], tuple[int, int]]:
    """cells: (position, size class, part, rows, bytes). Returns the shard of each cell and the slot of its first row."""
    positions, orders = ring_orders(shards, virtual_nodes, ring)
    room = (1 + slack) * sum(c[4] for c in cells) / shards
    load, rows, out = [0] * shards, [0] * shards, {}
    turn = lambda c: hashlib.md5(f"{c[0]},{c[1]},{c[2]}".encode()).digest()
    for position, kind, part, n, size in sorted(cells, key=lambda c: (-c[1], turn(c))):
        order = orders[bisect_left(positions, position) % len(positions)]
        shard = next((s for s in order if load[s] + size <= room), None)
        if shard is None:
            shard = min(order, key=lambda s: load[s])
        out[position, kind, part] = (shard, rows[shard])
        load[shard] += size
        rows[shard] += n
    return out


def shard_documents(docs: DataFrame, shards: int = 24, slack: float = 0.0001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard, slot for every row. The driver holds the cells (at most RING * 64, in practice RING times a dozen) and broadcasts them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = keyed.withColumn("position", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null"))), F.lit(RING)).cast("int"))
    keyed = keyed.withColumn("kind", F.floor(F.log2("size")).cast("int"))
    keyed = cut(keyed.withColumns({"who": F.xxhash64("id", "text_crc32", "size"), "home": F.spark_partition_id()}))
    cell = ["position", "kind"]
    share = (keyed.agg(F.sum("size")).first()[0] or 0) / shards / PARTS
    hot = keyed.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > share) & (F.col("n") > 1))
    # no more than shards * PARTS cells can exceed their share
    hot = cut(hot.select(*cell, F.ceil(F.col("bytes") / share).cast("int").alias("parts")))
    every = keyed.join(F.broadcast(hot), cell, "left")
    # rows that agree in all count 0, 1, .. from one written partition to the next: which row gets which number may change with the partitions, how many there are of each part doesn't
    split = every.where("parts is not null")
    counts = split.groupBy("who", "home").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("who").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("who", "home").orderBy("who")) - 1
    split = split.withColumn("here", number).join(counts.select("who", "home", before.alias("before")), ["who", "home"])
    split = split.withColumn("part", F.pmod(F.col("who") % F.col("parts") + F.col("here") + F.col("before"), "parts").cast("int"))
    names = ["id", "size", "text_crc32", *cell, "part"]
    parted = cut(every.where("parts is null").withColumn("part", F.lit(0)).select(*names).unionByName(split.select(*names)))
    cell.append("part")
    counted = parted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    placed = place_cells([(c["position"], c["kind"], c["part"], c["n"], c["bytes"]) for c in counted], shards, slack)
    rows = [(*c, s, first) for c, (s, first) in placed.items()]
    where = docs.sparkSession.createDataFrame(rows, "position int, kind int, part int, shard int, first long")
    slot = F.row_number().over(Window.partitionBy(*cell).orderBy("id", "text_crc32", "size")) - 1
    out = parted.withColumn("within", slot).join(F.broadcast(where), cell)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("within")).alias("slot"))
