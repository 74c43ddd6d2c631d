"""N-gram Jaccard join with an R-tree of count vectors.

A document's set is its distinct 5-word shingles. Their hashes fall into groups, and the counts of the groups are the document's point. Two sets cannot have
more in common than the sum, over the groups, of the smaller count; a link asks for overlap (100 + p) >= p (n_a + n_b). The same sum with the upper corner
of a box bounds the overlap with all points below a node of an R-tree, so whole boxes are left out before any two points meet, and any two points before
their sets do. What survives is verified on the words.

Groups are ranges of hashes, about one for each shingle (GROUPS at least, a power of two), so that points of different fineness fold into one another. The trees of all cells of a task are built and searched together, as array operations.

The points of unrelated documents lie as close together as those of a group, dimension by dimension, and a tree over all points would have to look at nearly all of its
leaves. Its top level is therefore split by the contents of wide segments (ranges of hashes, some three or four shingles each): sets that are linked differ in
r = floor((n_a + n_b) (100 - p) / (100 + p)) shingles at most, hence in r segments at most, so among the first r + 1 segments of a set that aren't empty one has the very same
shingles in the other set. A point stands in the subtrees (cells) of these segments, and a link shows in one of them. Sizes fall into bands of a ratio of 1.5 that
fix how many segments there are; a set also stands in the next band if a larger partner can lie there. Small sets whose shingles crowd into too few segments
stand in all of theirs and, to meet one another, under their r + 1 first shingles themselves. A cell that only one text has is dropped.

1. Rounds of stars: each text of a component is held against one text in one of its cells (by their points, then by their words), and components grow by verified links; cells
   inside a component go.
2. In cells that still hold several components, packed trees search for pairs of different components. Cells of more than PAGE points are
   cut into pages of near sizes, and pairs of pages whose sizes can be linked are searched as tasks of their own. First each text asks for its nearest
   point in a few of its cells only, until this links little any more; then all pairs that the bound leaves over, in all cells, are verified.
No cell, page or partner is capped: the work in a cell of many different components that the bound can't tell apart is quadratic, spread over pages, and
only pairs that pass the bound are ever written.

Texts without words (null, empty, blank) have an empty set and are linked with nothing, as are rows with a null id (their component is null). Rows that repeat an id are
one node. Copies of a text are represented by the smallest id. Very long texts are read whole, one at a time. Other columns aren't read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from . import vec
from .common import cut, drop, map_arrow, release, with_keys
from .minhash import confirm, sets_of

SHINGLE, PERCENT = 5, 80
GROUPS, PAGE, FAN, FEW = 64, 512, 16, 3
#: Sums of the sizes of points that a task searches together; segments for each shingle of a band's largest set.
PACK, SEGMENTS = 4_000_000, 0.25
_U = np.uint64


def band_bounds(most: int = 1 << 40) -> np.ndarray:
    """The smallest set of each band of sizes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


BANDS = band_bounds()


def differing(n_a: int, n_b: int, percent: int = PERCENT) -> int:
    """Most shingles that only one of two linked sets has."""
    return (n_a + n_b) * (100 - percent) // (100 + percent)


def cell_keys(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the cells of a set, given as sorted distinct hashes."""
    n = len(own)
    largest = n * 100 // percent
    out = []
    crowded = False
    for band in range(int(np.searchsorted(BANDS, n, "right")) - 1, int(np.searchsorted(BANDS, largest, "right"))):
        end = int(BANDS[band + 1])
        segments = max(1, -(-end * int(SEGMENTS * 100) // 100))
        at = ((own >> _U(32)) * _U(segments)) >> _U(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        asked = differing(n, min(largest, end - 1), percent) + 1
        keys = vec.mix(np.add.reduceat(vec.mix(own), first) + vec.mix(at[first] + _U(band << 40)))
        out.append(keys[:asked])
        crowded |= len(first) < asked
    if crowded:
        out.append(vec.mix(own[: differing(n, largest, percent) + 1] ^ _U(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(out))


def groups_of(n: int) -> int:
    return max(GROUPS, 1 << (int(n).bit_length() - 1))


def point(own: np.ndarray) -> bytes:
    """Counts of the groups, in the narrowest of 1, 2, 4 or 8 bytes that holds them."""
    groups = groups_of(len(own))
    counts = np.bincount((own >> _U(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups)
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(t).max)).tobytes()


def unpacked(raw: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """Points as rows, folded to so many groups."""
    out = np.zeros((len(raw), groups), np.int32)
    own = np.array([groups_of(n) for n in sizes.tolist()], np.int64)
    width = np.array([len(r) for r in raw], np.int64) // np.maximum(own, 1)
    for n, w in set(zip(own.tolist(), width.tolist(), strict=True)):
        rows = np.flatnonzero((own == n) & (width == w))
        counts = np.frombuffer(b"".join([raw[r] for r in rows]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[w])
        out[rows] = counts.reshape(len(rows), groups, n // groups).sum(2, dtype=np.int32)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, digest, point and the keys of its cells for every row."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)).alias("digest"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in sets_of(batch.column(1), shingle):
                keys = [cell_keys(s, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys)))
                points = pa.array([point(s) if len(s) else None for s in sets], pa.binary())
                rows = [batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), batch.column(2).slice(a, len(sets)), points, lists]
                yield pa.RecordBatch.from_arrays(rows, names=["id", "n_shingles", "digest", "point", "keys"])

    return map_arrow(narrow, run, f"id {kind}, n_shingles long, digest binary, point binary, keys array<long>")


class Trees:
    """Packed R-trees, one for each cell, built and searched together. Rows come by cell, then by size: FAN points of a cell make a leaf and FAN nodes a node. Of each node the
    upper corner, the smallest and largest size, the label if all points below have the same one (else -1), and its first child."""

    def __init__(self, cells: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.levels = [(points, sizes, sizes, labels, None)]
        high, low_n, high_n, label = points, sizes, sizes, labels
        while len(cells):
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            place = np.arange(len(cells)) - np.repeat(starts, np.diff(np.append(starts, len(cells))))
            at = np.flatnonzero(place % FAN == 0)
            done = len(at) == len(starts)
            high, low_n, high_n = np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            least, most = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            label = np.where(least == most, least, -1)
            self.levels.append((high, low_n, high_n, label, np.append(at, len(cells))))
            cells = cells[at]
            if done:
                break
        self.roots = cells

    def near(self, cells: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """asking row, row of the trees, bound of the overlap: all of other labels in the asking row's cell that can be linked."""
        asking = np.flatnonzero(np.isin(cells, self.roots))
        node = np.searchsorted(self.roots, cells[asking])
        bound = np.zeros(0, np.int64)
        for high, low_n, high_n, label, children in self.levels[::-1]:
            n = sizes[asking]
            may = (label[node] != labels[asking]) & (high_n[node] * 100 >= n * percent) & (n * 100 >= low_n[node] * percent)
            asking, node = asking[may], node[may]
            bound = np.zeros(len(node), np.int64)
            step = max(1, (1 << 21) // max(1, points.shape[1]))
            for k in range(0, len(node), step):
                bound[k : k + step] = np.minimum(points[asking[k : k + step]], high[node[k : k + step]]).sum(1, dtype=np.int64)
            may = bound * (100 + percent) >= percent * (sizes[asking] + np.minimum(low_n[node], sizes[asking] * 100 // percent))
            asking, node, bound = asking[may], node[may], bound[may]
            if children is not None:
                first, many = children[node], children[node + 1] - children[node]
                asking = np.repeat(asking, many)
                node = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(asking))
        return asking, node, bound


def _search(percent: int, nearest: bool):
    """For each cell of a pack (rows of side 0 ask; those of side 1, or the same rows where there are none, make up the tree): pairs that can be linked."""

    def run(table: pa.Table) -> pa.Table:
        cell = np.unique(table.column("cell").to_numpy(), return_inverse=True)[1]
        side, sizes = table.column("side").to_numpy(), table.column("n").to_numpy()
        labels = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        raw = table.column("point").to_pylist()
        order = np.lexsort((sizes, cell))
        starts = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        groups = np.array([groups_of(n) for n in sizes[order[starts]].tolist()], np.int64)[cell] if len(order) else cell  # of the smallest set of the cell
        two = np.maximum.reduceat(side[order], starts)[cell] if len(order) else cell
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        for g in np.unique(groups).tolist():
            rows = order[groups[order] == g]
            points = unpacked([raw[r] for r in rows], sizes[rows], g)
            ask, there = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == two[rows])
            trees = Trees(cell[rows[there]], points[there], sizes[rows[there]], labels[rows[there]])
            i, j, common = trees.near(cell[rows[ask]], points[ask], sizes[rows[ask]], labels[rows[ask]], percent)
            i, j = ask[i], there[j]
            if not nearest:  # where a cell's own rows make up its tree, each pair is met twice
                once = (two[rows[i]] == 1) | (i < j)
                i, j, common = i[once], j[once], common[once]
            found.append((rows[i], rows[j], common))
        a, b, common = (np.concatenate(x) for x in zip(*found, strict=True))
        share = common / np.maximum(1, sizes[a] + sizes[b])
        if nearest and len(a):
            nodes = np.unique(table.column("node").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            best = np.lexsort((-share, nodes[a]))
            best = best[np.concatenate([[True], nodes[a[best]][1:] != nodes[a[best]][:-1]])]
            a, b, share = a[best], b[best], share[best]
        elif len(a):  # a pair that meets in several cells counts once
            names, nodes = np.unique(table.column("node").to_numpy(zero_copy_only=False), return_inverse=True)
            pairs = np.minimum(nodes[a], nodes[b]) * len(names) + np.maximum(nodes[a], nodes[b])
            once = np.unique(pairs, return_index=True)[1]
            a, b, share = a[once], b[once], share[once]
        nodes = table.column("node").combine_chunks() if table.num_rows else pa.array([], table.schema.field("node").type)
        out = pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b)), "n_a": pa.array(sizes[a]), "n_b": pa.array(sizes[b]), "share": pa.array(share)})
        release()
        return out

    return run


def open_cells(held: DataFrame, labels: DataFrame) -> DataFrame:
    """held: key, node, n. The rows of cells with several labels, with label and the cell's number of rows; written."""
    named = held.select("key", "node", "n").join(labels, "node")
    mixed = cut(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y").select("key", "rows"))
    out = cut(named.join(mixed, "key").select("key", "node", "n", "label", "rows"))
    drop(mixed)
    return out


def stars(cells: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each node of open cells one text of another label in one of them: a (the same for many, by a hash of the round), b, n_a, n_b. Sizes too far apart go."""
    rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("own"))
    hubs = cells.groupBy("key").agg(F.min(rank).alias("m"))
    met = cells.join(hubs, "key").where("label <> m.own").groupBy("node", "n").agg(F.min("m").alias("m"))
    return met.select("m.a", F.col("node").alias("b"), "m.n_a", F.col("n").alias("n_b")).where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)


def bounded(asked: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b, n_a, n_b whose points can be linked."""
    kind = asked.schema["a"].dataType.simpleString()
    of = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))
    met = asked.join(of("a"), ["a", "n_a"]).join(of("b"), ["b", "n_b"]).select("a", "b", "n_a", "n_b", "point_a", "point_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(k).to_numpy() for k in (2, 3)]
            raw = [batch.column(k).to_pylist() for k in (4, 5)]
            groups = np.array([groups_of(n) for n in np.minimum(*sizes).tolist()], np.int64)
            keep = np.zeros(batch.num_rows, bool)
            for g in np.unique(groups).tolist():
                every = np.flatnonzero(groups == g)
                for k in range(0, len(every), max(1, (1 << 21) // g)):
                    rows = every[k : k + max(1, (1 << 21) // g)]
                    x, y = (unpacked([raw[side][r] for r in rows], sizes[side][rows], g) for side in (0, 1))
                    keep[rows] = np.minimum(x, y).sum(1, dtype=np.int64) * (100 + percent) >= percent * (sizes[0][rows] + sizes[1][rows])
            yield batch.filter(pa.array(keep)).select(["a", "b", "n_a", "n_b"])

    return map_arrow(met, run, f"a {kind}, b {kind}, n_a long, n_b long").distinct()


def candidates(members: DataFrame, points: DataFrame, percent: int, nearest: bool, page: int = PAGE) -> DataFrame:
    """members: open_cells(). Pairs of nodes with different labels that share a cell and whose points can be linked: a, b, n_a, n_b. nearest: for each node its nearest one
    only, in the FEW of its cells that come first by a hash (which texts that have much in common choose alike)."""
    kind = members.schema["node"].dataType.simpleString()
    if nearest:
        few = members.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key"), "key"))).where(F.col("turn") <= FEW).drop("turn", "rows")
        members = few.join(few.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    # pages of large cells: sizes within a tenth of one another, dealt out evenly
    members = members.withColumn("size", F.when(F.col("rows") > page, F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.1)))).otherwise(0).cast("int"))
    counts = cut(members.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / page).cast("int").alias("pages"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("node").alias("lead")))
    part = F.struct("size", F.pmod(F.xxhash64("node"), "pages").cast("int").alias("part")).alias("page")
    paged = members.join(counts.select("key", "size", "pages"), ["key", "size"]).select("key", "node", "n", "label", part)
    pages = counts.select("key", "low", "high", "lead", F.explode(F.transform(F.sequence(F.lit(0), F.col("pages") - 1), lambda p: F.struct("size", p.cast("int").alias("part")))).alias("page"))
    one = pages.select("key", "lead", F.col("page").alias("p"), F.col("low").alias("l"), F.col("high").alias("h"))
    two = pages.select(F.col("key").alias("k"), F.col("page").alias("q"), "low", "high")
    met = one.join(two, (F.col("key") == F.col("k")) & (F.col("p") <= F.col("q")) & (F.col("low") * percent <= F.col("h") * 100) & (F.col("l") * percent <= F.col("high") * 100))
    # cells of one first node hold much the same texts: they go to the same packs, a quarter each, where a pair that they share counts once
    met = cut(met.select("key", "p", "q", F.xxhash64("key", "p", "q").alias("cell"), F.xxhash64("lead", "p", "q", F.pmod("key", F.lit(4))).alias("beside")))
    sides = met.select("key", F.col("p").alias("page"), "cell", "beside", F.lit(0).alias("side")).unionByName(met.where("p <> q").select("key", F.col("q").alias("page"), "cell", "beside", F.lit(1).alias("side")))
    placed = cut(paged.join(sides, ["key", "page"]).select("cell", "beside", "side", "node", "n", "label"))
    packs = max(64, int((placed.agg(F.sum("n")).first()[0] or 0) // PACK))
    where = points.select(F.col("node").alias("of"), F.col("n").alias("size"), "point")
    rows = placed.join(where, (F.col("node") == F.col("of")) & (F.col("n") == F.col("size"))).select(F.pmod("beside", F.lit(packs)).alias("pack"), "cell", "side", "node", "n", "label", "point")
    found = rows.groupBy("pack").applyInArrow(_search(percent, nearest), f"a {kind}, b {kind}, n_a long, n_b long, share double")
    if nearest:  # of both sides of a pair of pages, and of all cells
        found = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "share"))
        found = found.groupBy("a", "n_a").agg(F.max(F.struct("share", "b", "n_b")).alias("m")).select("a", "m.b", "n_a", "m.n_b")
    turned = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    out = cut(found.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b")).distinct())
    drop(counts, met, placed)
    return out


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, page: int = PAGE) -> DataFrame:
    """id_col, n_shingles, component_id for every row."""
    every = cut(sketch(docs, id_col, text_col, shingle, percent))
    slim = cut(every.select("id", "n_shingles", "digest"))
    real, found = slim.where("n_shingles > 0 and id is not null"), every.where("n_shingles > 0 and id is not null")
    classes = cut(real.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    copied = cut(real.join(classes.where("rows > 1").select("digest", "rep"), "digest").where("id <> rep").select("id", "digest").distinct())
    apart = with_keys(found, [found["id"], found["digest"]], copied, "left_anti")

    # texts of one id: all of them are the same node
    twice = cut(real.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"))
    named = real.join(twice, "id").select("id", "digest").join(classes.select("digest", "rep"), "digest")
    own = cut(named.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())

    keyed = apart.select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"))
    met = cut(with_keys(keyed, [keyed["key"]], shared, "left_semi"))
    # of cells that hold the very same texts (by 128 bits of hash over them, and their number) one is enough
    mark = [F.bit_xor(F.xxhash64("node", "n", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    cells = met.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), *mark, F.count(F.lit(1)).alias("rows")).where("x <> y")
    chosen = cut(cells.groupBy("mark0", "mark1", "rows").agg(F.min("key").alias("key")).select("key"))
    held = cut(met.join(chosen, "key", "left_semi"))
    nodes = cut(held.select(F.col("node").alias("id")).distinct())
    points = with_keys(apart, [apart["id"]], nodes, "left_semi")
    points = cut(points.select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "point"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    drop(every, copied, twice, shared, met, chosen)

    links, label, cells, turn = own, None, None, 0
    kinds = ["star", "nearest", "all"]
    while True:
        known = components(links)
        named = cut(nodes.join(known, nodes["id"] == known["node"], "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("label")))
        parts = named.select("label").distinct().count()
        if label is not None:
            if (before - parts) * 20 < before - done:  # this kind of round links little any more
                kinds.pop(0)
            drop(label)
        label, before = named, parts
        opened = open_cells(held if cells is None else cells, label)
        drop(held if cells is None else cells)
        cells = opened
        done = parts - cells.select("label").distinct().count()
        if not kinds or done == parts:
            break
        asked = cut(bounded(stars(cells, turn, percent), points, percent)) if kinds[0] == "star" else candidates(cells, points, percent, kinds[0] == "nearest", page)
        ends = cut(asked.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = cut(with_keys(text, [text["id"]], ends, "left_semi"))
        new = confirm(asked, texts, percent)
        grown = cut(links.unionByName(new))
        drop(asked, ends, texts, new, links)
        links, turn = grown, turn + 1
        if kinds[0] == "all":
            known = components(links)
            break
    final = cut(classes.select("digest", "rep").join(known, classes["rep"] == known["node"], "left").select("digest", F.coalesce("component", "rep").alias("component")))
    drop(classes, nodes, points, links, label, cells, known)
    out = slim.join(final, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL"""
