"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set is its distinct 5-word shingles. One hash of each shingle falls into one of BANDS * ROWS bins, the smallest of a
bin is its value, and an empty bin copies a bin that a hash of (bin, attempt) picks among the filled ones. Documents of one text (by half of its SHA-256) form one class
and only its smallest id goes on. ROWS bins make a band's key; classes that share a key are candidates.

At the threshold 0.75 a pair shares a given key with probability 0.75^3 = 0.42, so all 42 keys miss it with probability 1e-10.
A bucket's candidate edges form a star: the class whose hash is smallest is the hub, so edges are linear in the members of buckets. Classes that share
buckets, directly or through others, make up a cluster; no link leaves it.

Links are confirmed on words: hub and members of a star are brought together as texts, a large star in several blocks of bounded size with a copy of the hub
each. Hashes of words and shingles are computed anew there and held against the bytes that they stand for, so two documents are linked only if their sets have 0.75 of their union in common.

Where the confirmed links leave a cluster in several components, more of its members may be linked with one another. Two sets of that similarity share one of
their first n - ceil(0.75 n) + 1 shingles in any common order; the order here is the rarest first, by a count sketch of fixed size over such clusters. Only members of different
components that share such a shingle can be linked, so what many documents have in common (a template) brings nobody together. Members meet in a shingle's cell by bands
of sizes near enough to be linked (each member is in two). Cells of at most LIGHT members name their pairs, as ids, and a pair's cells are counted: sets that are linked
share not one but alpha - ceil(0.75 n) + 1 of these shingles (alpha: what both must have in common, n: the larger size), so only pairs with so many are held against each other as texts.
Larger cells make groups, directly or through others, whose members are held against each other, those outside a group's largest component against all, in blocks of bounded
size. So shingles that few share chain no members together whose texts would then go to all blocks of a large group; no partner is capped, no link
between different texts is lost, and a large group that its hubs already hold together costs no more. The work within a group of large cells is still quadratic.

Components come from contracting links to the neighbour with the smallest hash of the round (the numbers of nodes fall geometrically); nothing is collected but the sketch.

Texts without words (null, empty, blank) have an empty set, are linked with nothing and kept. Rows with a null id are returned, linked with nothing,
with a null component, and kept. Rows that repeat an id are one node: they share its component, through whichever of their texts it comes. A very long text is
read whole, in one piece (its task needs some 60 times its bytes). Other columns aren't read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from . import vec
from .common import cut, drop, map_arrow, may_meet, release, spans_of_texts, text_buffer, unused, with_keys

BANDS, ROWS = 42, 3
BINS = BANDS * ROWS
SHINGLE = 5
#: Most shingles and most members that a block should have (one member at least), and the shingles that a task gets together.
BLOCK, BLOCK_MEMBERS = 300_000, 1024
PACK = 400_000
#: Members of a rare shingle's cell up to which its pairs are named one by one.
LIGHT = 32
SKETCH_BITS = 20
PERCENT = 75
CHUNK = 1 << 20


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row's index and the sorted distinct shingle hashes of each text, chunk by chunk."""
    buffer, offsets = text_buffer(column)
    for a, b in spans_of_texts(offsets, CHUNK):
        part = vec.lower_table()[buffer[offsets[a] : offsets[b]]]
        words, at = vec.word_hashes(part, offsets[a : b + 1] - offsets[a], vec.space_table())
        hashes, at = vec.shingle_hashes(words, at, shingle)
        yield a, [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)]


@lru_cache(2)
def _probes(bins: int, attempts: int = 512) -> np.ndarray:
    """[attempt, bin]: which bin an empty bin looks at."""
    return np.random.default_rng(42).integers(0, bins, (attempts, bins))


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """[set, bin] smallest hash of each bin, densified. Rows of empty sets are zero."""
    bounds = np.array([(k << 64) // bins for k in range(bins)], np.uint64)
    values, filled = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):  # sorted, so the first hash at or after a bound is its bin's smallest
        if len(s):
            at = np.searchsorted(s, bounds)
            filled[i] = at < np.append(at[1:], len(s))
            values[i] = s[np.minimum(at, len(s) - 1)]
    out, done = values.copy(), filled.copy()
    open_rows = np.flatnonzero(filled.any(1) & ~filled.all(1))
    for probe in _probes(bins):
        if not len(open_rows):
            break
        take = ~done[open_rows] & filled[open_rows][:, probe]
        r, c = np.nonzero(take)
        out[open_rows[r], c] = values[open_rows[r], probe[c]]
        done[open_rows[r], c] = True
        open_rows = open_rows[~done[open_rows].all(1)]
    for i in open_rows:
        out[i][~done[i]] = sets[i][0]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[set, band] keys."""
    rows = signature.shape[1] // bands
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        total = vec.mix(total * np.uint64(vec.BASE) + signature[:, j::rows])
    return total.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, digest (of the text) and the band keys of the set."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)).alias("digest"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in sets_of(batch.column(1), shingle):
                n = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(signatures(sets, bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(n), batch.column(2).slice(a, len(sets)), lists], names=["id", "n_shingles", "digest", "keys"])

    return map_arrow(narrow, run, f"id {kind}, n_shingles long, digest binary, keys array<long>")


def exact_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted codes of its distinct shingles. Within the column equal codes mean equal words: hashes are held against the bytes, and
    numbered anew from the bytes in the case that they don't tell all apart."""
    buffer, offsets = text_buffer(column)
    buffer = vec.lower_table()[buffer]
    starts, ends = vec.word_spans(buffer, offsets, vec.space_table())
    at = np.searchsorted(starts, offsets)
    parts = [vec.word_hashes(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vec.space_table())[0] for a, b in spans_of_texts(offsets, CHUNK)]
    words = np.concatenate([np.zeros(0, np.uint64), *parts])
    sizes = ends - starts
    order = np.argsort(words, kind="stable")
    pairs = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    x, y = order[pairs], order[pairs + 1]
    same = bool((sizes[x] == sizes[y]).all())
    for k in range(0, len(x) if same else 0, 1 << 16):
        p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        step = np.arange(sizes[p].sum()) - np.repeat(np.cumsum(sizes[p]) - sizes[p], sizes[p])
        same &= bool((buffer[np.repeat(starts[p], sizes[p]) + step] == buffer[np.repeat(starts[q], sizes[p]) + step]).all())
    if not same:
        known: dict[bytes, int] = {}
        words = np.array([known.setdefault(buffer[s:e].tobytes(), len(known)) for s, e in zip(starts, ends, strict=True)], np.uint64)
    hashes, to = vec.shingle_hashes(words, at, shingle)
    # the words of each shingle; what is missing in a short text is a word of its own number
    first = np.repeat(at[:-1] - to[:-1], np.diff(to)) + np.arange(len(hashes))
    left = np.minimum(np.repeat(np.diff(at), np.diff(to)), shingle)
    padded = np.append(words, np.zeros(shingle, np.uint64))
    order = np.argsort(hashes, kind="stable")
    pairs = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    x, y = order[pairs], order[pairs + 1]
    same = bool((left[x] == left[y]).all()) and all(bool(((padded[first[x] + j] == padded[first[y] + j]) | (left[x] <= j)).all()) for j in range(shingle))
    if not same:
        tuples: dict[tuple, int] = {}
        hashes = np.array([tuples.setdefault(tuple(words[f : f + n].tolist()), len(tuples)) for f, n in zip(first, left, strict=True)], np.uint64)
    return [np.unique(hashes[to[i] : to[i + 1]]) for i in range(len(offsets) - 1)]


def _cells(table: pa.Table):
    """The rows of each cell of a pack, and their sets. Cells are hashed together up to CHUNK bytes (one at least)."""
    cell = table.column("cell").to_numpy()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    order = np.argsort(cell, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]])) if len(order) else order
    bounds = np.append(new, len(order))
    before = np.append(0, np.cumsum(sizes[order]))[bounds]
    for x, y in spans_of_texts(before, CHUNK):
        rows = order[bounds[x] : bounds[y]]
        sets = exact_sets(texts.take(pa.array(rows)))
        for k in range(x, y):
            yield order[bounds[k] : bounds[k + 1]], sets[bounds[k] - bounds[x] : bounds[k + 1] - bounds[x]]


def _links(table: pa.Table, a: list[int], b: list[int]) -> pa.Table:
    nodes = table.column("node").combine_chunks() if table.num_rows else pa.array([], table.schema.field("node").type)
    release()
    return pa.table({"a": nodes.take(pa.array(a, pa.int64())), "b": nodes.take(pa.array(b, pa.int64()))})


def _match_stars(percent: int):
    """For each cell of a pack: links of its hub with its members."""

    def run(table: pa.Table) -> pa.Table:
        hub = table.column("hub").to_numpy(zero_copy_only=False)
        a, b = [], []
        for rows, sets in _cells(table):
            members = [k for k in range(len(rows)) if not hub[rows[k]] and len(sets[k])]
            if not members:
                continue
            flat, sizes = np.concatenate([sets[k] for k in members]), np.array([len(sets[k]) for k in members])
            for h in np.flatnonzero(hub[rows]).tolist():
                own = sets[h]
                if not len(own):
                    continue
                found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
                linked = np.flatnonzero(common * 100 >= (sizes + len(own) - common) * percent)
                a += [int(rows[h])] * len(linked)
                b += [int(rows[members[k]]) for k in linked]
        return _links(table, a, b)

    return run


def _match_blocks(percent: int):
    """For each cell of a pack: one link from each asking member to each other component that it reaches."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        labels = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        a, b = [], []
        for rows, sets in _cells(table):
            live = [k for k in range(len(rows)) if len(sets[k])]
            rows, sets = rows[live], [sets[k] for k in live]
            if not len(rows):
                continue
            sizes, label = np.array([len(s) for s in sets]), labels[rows]
            # the rarest shingles of the cell first: members that can be linked share one of the first of each
            codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
            rank = np.empty(len(counts), np.int64)
            rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
            ends = np.cumsum(sizes)
            flat = rank[codes]
            own = [np.sort(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
            first = [r[: n - -(-n * percent // 100) + 1] for r, n in zip(own, sizes.tolist(), strict=True)]
            of = np.repeat(np.arange(len(rows)), [len(f) for f in first])
            tokens = np.concatenate(first)
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            marks = np.zeros(len(counts), np.int64)
            for k in np.flatnonzero(asks[rows]).tolist():
                low, high = np.searchsorted(tokens, first[k], "left"), np.searchsorted(tokens, first[k], "right")
                near = np.unique(np.concatenate([of[x:y] for x, y in zip(low, high, strict=True)]))
                near = near[(label[near] != label[k]) & (np.minimum(sizes[near], sizes[k]) * 100 >= np.maximum(sizes[near], sizes[k]) * percent)]
                if not len(near):
                    continue
                marks[own[k]] = 1
                common = np.array([marks[own[x]].sum() for x in near.tolist()])
                marks[own[k]] = 0
                linked = near[common * 100 >= (sizes[near] + sizes[k] - common) * percent]
                heads = linked[np.unique(label[linked], return_index=True)[1]]
                a += [int(rows[k])] * len(heads)
                b += [int(rows[x]) for x in heads]
        return _links(table, a, b)

    return run


def _packs(placed: DataFrame, n: str = "n") -> int:
    return max(64, int((placed.agg(F.sum(n)).first()[0] or 0) // PACK))


def confirm(stars: DataFrame, texts: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """stars: a (hub), b, n_a, n_b (the sizes of their sets). Those with percent or more of their union in common, decided on their words. Sizes too far apart can't be linked."""
    return _compared(stars.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)), texts, percent, block)


def _compared(near: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    hubs = near.groupBy("a").agg(F.max("n_a").alias("n_a"), F.ceil(F.greatest(F.sum("n_b") / block, F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    members = near.join(hubs.drop("n_a"), "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "blocks").cast("int")).alias("cell"), F.col("b").alias("node"), F.col("n_b").alias("n"), F.lit(False).alias("hub"))
    copies = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("a", "block").alias("cell"), F.col("a").alias("node"), F.col("n_a").alias("n"), F.lit(True).alias("hub"))
    placed = cut(members.unionByName(copies))
    rows = placed.withColumn("pack", F.pmod("cell", F.lit(_packs(placed)))).join(texts, placed["node"] == texts["id"]).select("pack", "cell", "node", "hub", "text")
    kind = near.schema["b"].dataType.simpleString()
    links = cut(rows.groupBy("pack").applyInArrow(_match_stars(percent), f"a {kind}, b {kind}"))
    drop(placed)
    return links


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def rare_tokens(held: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bits: int = SKETCH_BITS) -> DataFrame:
    """held: node, label, text. Returns node, label, n (the size of the text's set) and token, once for each of the rare shingles of which texts that are linked have one in common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, sets in sets_of(batch.column(0), shingle):
                total += np.bincount(_slots(np.concatenate(sets), bits), minlength=1 << bits)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(total[filled])], names=["slot", "n"])

    # 2^bits counts at most, whatever the input
    found = map_arrow(held.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << bits, np.int64)
    often[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    kind, label_kind = held.schema["node"].dataType.simpleString(), held.schema["label"].dataType.simpleString()
    shared = held.sparkSession.sparkContext.broadcast(often)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in sets_of(batch.column(2), shingle):
                rare = []
                for s in sets:
                    take = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                    rare.append(s[np.lexsort((s, shared.value[_slots(s, bits)]))[:take]])
                of = pa.array(np.repeat(np.arange(a, a + len(sets)), [len(r) for r in rare]))
                n = pa.array(np.repeat(np.array([len(s) for s in sets], np.int64), [len(r) for r in rare]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), n, pa.array(np.concatenate(rare).view(np.int64))], names=["node", "label", "n", "token"])

    tokens = cut(map_arrow(held.select("node", "label", "text"), prefix, f"node {kind}, label {label_kind}, n long, token long"))
    shared.destroy()
    return tokens


def rare_cells(tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """tokens: rare_tokens(). Its rows whose token and band have several labels, with class, band, members (of the cell) and hub (one of them). Sizes of one link are in
    one class or in neighbouring ones (the width has a margin for rounding); band k holds the classes k and k + 1."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * max(math.log(100 / percent), 1e-6))).cast("int")
    mixed = tokens.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    banded = tokens.join(mixed, "token").withColumn("class", size_class).withColumn("band", F.explode(F.array(F.col("class") - 1, F.col("class"))))
    cell = Window.partitionBy("token", "band")
    seen = banded.withColumns({"x": F.min("label").over(cell), "y": F.max("label").over(cell), "members": F.count(F.lit(1)).over(cell), "hub": F.min(F.struct("node", "n", "band")).over(cell)})
    return seen.where("x <> y").drop("x", "y")


def light_pairs(cells: DataFrame, percent: int = PERCENT, light: int = LIGHT) -> DataFrame:
    """cells: rare_cells(). a, b, n_a, n_b: pairs of different labels that may be linked, as far as they share no cell of more than `light` members. Pairs are counted in one of their bands."""
    one = cells.where(F.col("members") <= light).select("token", "band", F.col("node").alias("a"), F.col("n").alias("n_a"), "label", "class")
    two = one.select("token", "band", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("label").alias("other"), F.col("class").alias("beside"))
    met = one.join(two, ["token", "band"]).where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & (F.col("band") == F.greatest("class", "beside") - 1))
    met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    least = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent} - ({percent} * greatest(n_a, n_b) + 99) div 100 + 1")
    return met.where(F.col("common") >= least).drop("common")


def rest_links(members: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE, block: int = BLOCK, light: int = LIGHT) -> DataFrame:
    """members: node, n, cluster, label. Links between different labels of a cluster that are not known yet, as many as join all that belong together."""
    several = members.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cluster")
    split = cut(members.join(several, "cluster").select("node", "label"))
    held = cut(split.join(texts, split["node"] == texts["id"]).select("node", "label", "text"))
    own = held.select(F.col("node").alias("id"), "text")
    tokens = rare_tokens(held, percent, shingle)
    cells = cut(rare_cells(tokens, percent))
    drop(tokens)
    pairs = cut(light_pairs(cells, percent, light))
    links = _compared(pairs, own, percent, block)
    heavy = cells.where(F.col("members") > light)
    edges = cut(heavy.select(F.col("hub").alias("a"), F.struct("node", "n", "band").alias("b")).distinct())
    drop(cells, pairs)
    if not edges.isEmpty():
        parts = links, _group_links(edges, split, own, percent, block)
        links = cut(parts[0].unionByName(parts[1]))
        drop(*parts)
    drop(split, held, edges)
    return links


def _group_links(edges: DataFrame, split: DataFrame, own: DataFrame, percent: int, block: int) -> DataFrame:
    """edges: a and b, members (node, n, band) that share a cell. Links within the groups that these make."""
    kind = split.schema["node"].dataType.simpleString()
    groups = components(edges)
    grouped = cut(groups.select("node.*", F.col("component").alias("group")).join(split, "node"))
    drop(groups)
    near = grouped
    blocks = lambda n, rows: F.ceil(F.greatest(n / block, rows / BLOCK_MEMBERS)).cast("int")
    key = ["group", "band"]
    sizes = near.groupBy(*key, "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    whole = sizes.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max(F.struct("n", "rows", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    plan = cut(whole.select(*key, F.col("most.label").alias("main"), blocks(F.col("n"), F.col("rows")).alias("blocks"), blocks(F.col("n") - F.col("most.n"), F.col("rows") - F.col("most.rows")).alias("ask_blocks")))
    near = near.join(plan, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    near = cut(near.withColumn("ask_block", F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("node", F.lit(1)), "ask_blocks").cast("int"))))
    # a member goes to the blocks of all asking blocks, and one that asks to all other blocks as well
    there = near.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1))).select("node", "n", *key, "label", F.col("block").alias("b"), "q", F.coalesce(F.col("ask_block") == F.col("q"), F.lit(False)).alias("asks"))
    asking = near.where("ask_block is not null and blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("b") != F.col("block"))
    placed = cut(there.unionByName(asking.select("node", "n", *key, "label", "b", F.col("ask_block").alias("q"), F.lit(True).alias("asks"))))
    rows = placed.withColumn("cell", F.xxhash64("group", "band", "b", "q")).withColumn("pack", F.pmod("cell", F.lit(_packs(placed)))).join(own, placed["node"] == own["id"]).select("pack", "cell", "node", "label", "asks", "text")
    links = cut(rows.groupBy("pack").applyInArrow(_match_blocks(percent), f"a {kind}, b {kind}"))
    drop(grouped, plan, near, placed)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row."""
    real = lambda t: t.where("n_shingles > 0 and id is not null")
    sketched = cut(sketch(docs, id_col, text_col, shingle, bands, rows))
    with_bands = cut(real(sketched).groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    every = cut(sketched.drop("keys"))
    drop(sketched)
    # a bucket's hub is known by its hash; of all keys only those that may have several members are dealt out with what belongs to them
    keyed = with_bands.select(F.xxhash64("rep", F.lit(0)).alias("h"), "rep", "n", F.explode("keys").alias("key"))
    hubs = cut(keyed.groupBy("key").agg(F.min("h").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "hub"))
    shared = may_meet(keyed, [keyed["key"]], hubs, "may").where("may")
    met = cut(shared.join(hubs, "key").select("hub", "h", "rep", "n").distinct())
    heads = met.where("h = hub").select("hub", F.col("rep").alias("a"), F.col("n").alias("n_a"))
    stars = cut(met.join(heads, "hub").select("a", F.col("rep").alias("b"), "n_a", F.col("n").alias("n_b")).where("a <> b"))
    classes = cut(with_bands.drop("keys"))
    drop(with_bands, hubs, met)

    # texts of one id: all of them are the same node
    twice = cut(real(every).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"))
    named = real(every).join(twice, "id").select("id", "digest").join(classes.select("digest", "rep"), "digest")
    own = cut(named.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())

    cluster = components(stars.unionByName(own, allowMissingColumns=True))
    ids = cut(cluster.select(F.col("node").alias("key")))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = cut(may_meet(text, [text["id"]], ids, "may").where("may").drop("may"))  # and few others, which no join asks for
    links = confirm(stars, texts, percent, block)
    known = components(links.unionByName(own))
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"))
    members = cluster.withColumnRenamed("component", "cluster").join(known, "node", "left").join(sizes, "node").select("node", "n", "cluster", F.coalesce("component", "node").alias("label"))
    rest = rest_links(members, texts, percent, shingle, block)
    label = components(links.unionByName(own).unionByName(rest))
    final = cut(classes.select("digest", "rep").join(label, classes["rep"] == label["node"], "left").select("digest", F.coalesce("component", "rep").alias("component")))
    drop(classes, stars, twice, own, cluster, ids, texts, links, known, rest, label)

    out = every.join(final, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group of near copies the document with the smallest id."""
    (key,) = unused(docs.columns, "_id")
    gone = cut(near_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(key)).distinct())
    return with_keys(docs, [docs[id_col]], gone, "left_anti")


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.node = n.doc_id"""
