"""Repeated-substring removal by a hash-compared suffix sort, made sparse so that it can be dealt out.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller id, or earlier in the same text).

Every window of LENGTH bytes names an anchor in itself: its rightmost smallest GRAM-gram by hash. Equal windows have the same anchor at the same place,
so only windows of one anchor hash need comparing, and there is about one anchor in 40 bytes. The windows of one anchor start in a row and make up its region.

1. Regions are keyed by anchor hash and region hash; among regions of one anchor only the latter tells them apart (62 bits modulo a prime with random bases, and the region's shape), and their bytes aren't compared. All but the first of equal regions go whole. Chunks send only their own first region of a key,
   so a passage that very many documents share reaches a bucket once a chunk at most.
2. Where an anchor hash has different regions (the edges of shared passages), the first of each is cut into blocks of OFFSETS window starts. Blocks meet by the hash of
   the bytes that all windows of a block have in common, so a common line among varied text falls apart into many groups.
3. In a bucket the windows are suffixes, at depth LENGTH, of the joined fragments. A mergesort orders them; comparing two takes a binary search
   for their common extension over prefix polynomial hashes, and the next byte. Neighbours that agree to the full depth are verified byte by
   byte. The earliest of each class stays.
4. The ranges found are joined with the texts, which are dealt out by id once for steps 2 and 4 together.

Null counts as empty; texts under LENGTH bytes lose nothing; a very long text is read in one piece (its task needs some 100 times its bytes). Ids are integers (null sorts first). Rows that repeat an id and a text count as
one document and get the same result; rows of one id and different texts are ordered by the checksum of the text. Other columns aren't read. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut, map_arrow, spans_of_texts, text_buffer

LENGTH = 100
GRAM = 20
OFFSETS = 27
REGION_BYTES = 8
CHUNK = 1 << 21
BUCKET_BYTES = 1 << 22
NO_ID = -(1 << 63)
_U = np.uint64
LOW = _U(0xFFFFFFFF)


def regions(buffer: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor position, anchor hash and region hash of each region, in order of position."""
    n = len(buffer)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    prefix = vec.Prefix(buffer, 11)
    grams = vec.mix((prefix.sums[gram:] - prefix.sums[:-gram]) * prefix.back[: n - gram + 1])
    low = (grams & ~LOW) | (LOW - np.arange(len(grams), dtype=_U))
    width, full = 1, length - gram + 1
    while 2 * width <= full:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < full:
        low = np.minimum(low[: width - full], low[full - width :])
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= np.repeat(offsets[1:], np.diff(offsets))[: n - length + 1])
    anchors = (LOW - (low[starts] & LOW)).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    first, last, anchor = starts[new], starts[np.append(new[1:], len(starts)) - 1], anchors[new]
    shape = (anchor - first).astype(_U) << _U(32) | (last - first).astype(_U)
    return first, last, anchor, grams[anchor], vec.mix(vec.Fingerprint(buffer, 12).of(first, last + length) ^ vec.mix(shape + _U(1)))


def firsts(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Along an order: True where any of the keys differs from the one before."""
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = False
        for k in keys:
            o = k[order]
            new[1:] |= o[1:] != o[:-1]
    return new


class Suffixes:
    """Suffixes of a buffer, compared to a depth by prefix hashes."""

    def __init__(self, buffer: np.ndarray, depth: int = LENGTH, seed: int = 21):
        self.buffer, self.depth, self.prefix = buffer, depth, vec.Prefix(buffer, seed)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, depth at most."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.depth + 1)
        for _ in range(int(self.depth).bit_length()):
            middle = np.minimum((low + high) // 2, self.depth)
            same = self.prefix.of(x, x + middle) == self.prefix.of(y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
            high = np.maximum(high, low + 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        at = self.common(x, y)
        whole = at >= self.depth
        step = np.where(whole, 0, at)
        return np.where(whole, or_equal, self.buffer[x + step] < self.buffer[y + step])

    def sort(self, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The order of the suffixes within their groups (already together), equal ones as they come: a bottom-up mergesort of all groups at once."""
        order = np.arange(len(starts))
        new = np.flatnonzero(firsts(order, [groups]))
        sizes = np.diff(np.append(new, len(starts)))
        base, size = np.repeat(new, sizes), np.repeat(sizes, sizes)
        place = order - base
        width = 1
        while len(sizes) and width < sizes.max():
            live = np.flatnonzero(size > width)
            b, s, p = base[live], size[live], place[live]
            mine, right = p // width * width, (p // width) % 2 == 1
            other = np.where(right, mine - width, mine + width)
            low, high = np.minimum(other, s), np.minimum(other + width, s)
            begin = low.copy()
            me = starts[order[live]]
            while True:  # how many of the sibling run come before each
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) // 2
                before = self.less(starts[order[b[todo] + middle]], me[todo], right[todo])
                low[todo], high[todo] = np.where(before, middle + 1, low[todo]), np.where(before, high[todo], middle)
            target = b + np.minimum(mine, np.where(right, other, mine)) + (p - mine) + (low - begin)
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), bool)
        reach = np.arange(self.depth)
        for a in range(0, len(x), 1 << 15):
            b = slice(a, a + (1 << 15))
            out[b] = (self.buffer[x[b, None] + reach] == self.buffer[y[b, None] + reach]).all(1)
        return out

    def classes(self, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """A number for each suffix, the same where group and bytes to the depth are the same; verified byte by byte."""
        order = self.sort(starts, groups)
        x, y, same = starts[order[:-1]], starts[order[1:]], ~firsts(order, [groups])[1:]
        near = np.flatnonzero(same)
        same[near] = self.common(x[near], y[near]) >= self.depth
        near = np.flatnonzero(same)
        wrong = near[~self.equal_bytes(x[near], y[near])]
        if len(wrong):  # two strings share a hash: those groups are told apart by their bytes
            out = np.empty(len(starts), np.int64)
            seen: dict = {}
            for i in range(len(starts)):
                out[i] = seen.setdefault((int(groups[i]), self.buffer[starts[i] : starts[i] + self.depth].tobytes()), len(seen))
            return out
        out = np.empty(len(starts), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(~same)])
        return out


def _column(table, name: str) -> np.ndarray:
    """The values of all rows, from the byte planes that _deal wrote."""
    counts = [len(x) // 8 for x in table.column("doc").to_pylist()]
    out = np.zeros((sum(counts), 8), np.uint8)
    at = 0
    for n, blob in zip(counts, table.column(name).to_pylist(), strict=True):
        planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
        out[at : at + n, : len(planes)] = planes.T
        at += n
    return out.reshape(-1).view(_U)


def _kinds(table) -> np.ndarray:
    return np.repeat(table.column("kind").to_numpy(), [len(x) // 8 for x in table.column("doc").to_pylist()])


def _deal(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, int]], kind: int, cells: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with its part of each column as byte planes (the lowest bytes of all values, then the next ones: the upper planes of small numbers compress to nothing)."""
    order = np.argsort(bucket, kind="stable")
    new = np.flatnonzero(firsts(order, [bucket]))
    ends = np.append(new[1:], len(order))
    out = [pa.array(bucket[order[new]].astype(np.int64)), pa.array(np.full(len(new), kind, np.int32))]
    for values, planes in columns.values():
        wide = values.astype(np.int64, copy=False) if values.dtype != _U else values
        raw = np.ascontiguousarray(wide[order]).view(np.uint8).reshape(-1, 8)[:, :planes]
        out.append(pa.array([raw[a:b].T.tobytes() for a, b in zip(new, ends, strict=True)], pa.binary()))
    names = ["bucket", "kind", *columns]
    if cells is not None:
        cells = cells[order]
        out.append(pa.array([cells[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary()))
        names.append("bytes")
    return pa.RecordBatch.from_arrays(out, names=names)


ANCHORS = "bucket long, kind int, hash binary, region binary, doc binary, crc binary, start binary, size binary, anchor binary"
RANGES = "doc long, crc long, start int, end int, anchor int"


def _anchors(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(2))
            docs, crcs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in spans_of_texts(offsets, CHUNK):
                part, at = buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                first, last, anchor, grams, hashes = regions(part, at, length, gram)
                hashes &= _U((1 << 8 * REGION_BYTES) - 1)
                of = np.searchsorted(at, first, "right") - 1
                doc, crc, base = docs[a:b][of], crcs[a:b][of], at[of]
                first, end, anchor = first - base, last + length - base, anchor - base
                order = np.lexsort((first, crc, doc, hashes, grams))
                new = firsts(order, [grams, hashes])
                # a row that repeats the first one's document is the same place, not a later one
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                again = (doc[lead] == doc[order]) & (crc[lead] == crc[order]) & (first[lead] == first[order]) & ~new
                for kind, rows in ((0, order[new]), (1, order[~new & ~again])):
                    if len(rows):
                        to = grams[rows] % _U(buckets) if kind == 0 else vec.mix(doc[rows].view(_U) + first[rows].astype(_U)) % _U(buckets)
                        # anchors that are known to repeat need no hashes
                        yield _deal(to, {"hash": (grams[rows], 0 if kind else 8), "region": (hashes[rows], 0 if kind else REGION_BYTES), "doc": (doc[rows], 8), "crc": (crc[rows], 4), "start": (first[rows], 4), "size": (end[rows] - first[rows], 2), "anchor": (anchor[rows] - first[rows], 2)}, kind)

    return run


def _ranges(doc, crc, start, end, anchor=None) -> pa.Table:
    anchor = np.full(len(doc), -1, np.int32) if anchor is None else anchor.astype(np.int32)
    return pa.table({"doc": doc.astype(np.int64), "crc": crc.astype(np.int64), "start": start.astype(np.int32), "end": end.astype(np.int32), "anchor": anchor})


def _match_regions(table: pa.Table) -> pa.Table:
    """Ranges to remove (anchor -1), and regions that need a closer look (anchor set)."""
    kind = _kinds(table)
    grams, hashes, doc = _column(table, "hash"), _column(table, "region"), _column(table, "doc").view(np.int64)
    crc, start, size, anchor = (_column(table, c).view(np.int64) for c in ("crc", "start", "size", "anchor"))
    end, anchor = start + size, start + anchor
    known = np.flatnonzero(kind == 1)
    look = np.flatnonzero(kind == 0)
    order = look[np.lexsort((start[look], crc[look], doc[look], hashes[look], grams[look]))]
    new = firsts(order, [grams, hashes])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    gone = order[~new & ((doc[lead] != doc[order]) | (crc[lead] != crc[order]) | (start[lead] != start[order]))]
    heads = order[new]
    group = np.cumsum(firsts(heads, [grams])) - 1
    several = heads[np.bincount(group)[group] > 1] if len(heads) else heads
    gone = np.concatenate([known, gone])
    return pa.concat_tables([_ranges(doc[gone], crc[gone], start[gone], end[gone]), _ranges(doc[several], crc[several], start[several], end[several], anchor[several])])


FRAGMENTS = "bucket long, kind int, core binary, offset binary, n binary, doc binary, crc binary, start binary, bytes binary"


def _fragments(length: int, buckets: int):
    core_length = length - OFFSETS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(2))
            docs, crcs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3)
            for a, b in spans_of_texts(offsets, CHUNK):
                lists = wanted.slice(a, b - a)
                flat, counts = lists.flatten(), lists.value_lengths().to_numpy()
                of = np.repeat(np.arange(a, b), counts)
                base = offsets[of] - offsets[a]
                first, end, anchor = (flat.field(k).to_numpy().astype(np.int64) + base for k in range(3))
                part = buffer[offsets[a] : offsets[b]]
                prefix, whole_prefix = vec.Prefix(part, 13), vec.Fingerprint(part, 14)
                low, high = anchor - (end - length), anchor - first  # window offsets before the anchor
                pieces = []
                for t in range(int(high.max(initial=-1)) // OFFSETS + 1):
                    s0, s1 = np.maximum(low, OFFSETS * t), np.minimum(high, OFFSETS * t + OFFSETS - 1)
                    k = np.flatnonzero(s0 <= s1)
                    at = anchor[k] - OFFSETS * t
                    core = vec.mix(prefix.of(at, at + core_length) + _U(t))
                    pieces.append((core, anchor[k] - s1[k], s1[k] - s0[k] + 1, s1[k], of[k], base[k]))
                if not pieces:
                    continue
                core, start, n, offset, of, base = (np.concatenate(x) for x in zip(*pieces, strict=True))
                whole = vec.mix(whole_prefix.of(start, start + n + length - 1) + vec.mix(n.astype(_U)))
                doc, crc, place = docs[of], crcs[of], start - base
                order = np.lexsort((place, crc, doc, offset, whole, core))
                new = firsts(order, [core, whole, offset])
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                again = (doc[lead] == doc[order]) & (crc[lead] == crc[order]) & (place[lead] == place[order]) & ~new
                for kind, rows in ((0, order[new]), (1, order[~new & ~again])):
                    if not len(rows):
                        continue
                    # a fixed width for every fragment: the bytes of OFFSETS windows, filled up with zeros
                    reach = start[rows, None] + np.arange(length + OFFSETS - 1)
                    cells = np.where(np.arange(length + OFFSETS - 1) < n[rows, None] + length - 1, part[np.minimum(reach, len(part) - 1)], 0).astype(np.uint8) if not kind else np.zeros((len(rows), 0), np.uint8)
                    to = core[rows] % _U(buckets) if not kind else vec.mix(doc[rows].view(_U) + place[rows].astype(_U)) % _U(buckets)
                    columns = {"core": (core[rows], 0 if kind else 8), "offset": (offset[rows], 2), "n": (n[rows], 2), "doc": (doc[rows], 8), "crc": (crc[rows], 4), "start": (place[rows], 4)}
                    yield _deal(to, columns, kind, cells)

    return run


def _match_windows(length: int):
    wide = length + OFFSETS - 1

    def run(table: pa.Table) -> pa.Table:
        kind, core = _kinds(table), _column(table, "core")
        doc, crc, start, offset, n = (_column(table, c).view(np.int64) for c in ("doc", "crc", "start", "offset", "n"))
        known = np.flatnonzero(kind == 1)
        rows = np.flatnonzero(kind == 0)
        cells = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        slot = np.zeros(len(kind), np.int64)
        slot[rows] = np.arange(len(rows))
        # a core that only one fragment has can't repeat
        order = rows[np.argsort(core[rows], kind="stable")]
        group = np.cumsum(firsts(order, [core])) - 1
        order = order[np.bincount(group)[group] > 1] if len(order) else order
        each = np.repeat(order, n[order])
        step = np.arange(len(each)) - np.repeat(np.cumsum(n[order]) - n[order], n[order])
        place, at = start[each] + step, slot[each] * wide + step
        sort = np.lexsort((place, crc[each], doc[each], offset[each] - step, core[each]))
        each, step, place, at = each[sort], step[sort], place[sort], at[sort]
        groups = np.cumsum(firsts(np.arange(len(each)), [core[each], offset[each] - step]))
        kinds = Suffixes(cells, length).classes(at, groups) if len(each) else np.zeros(0, np.int64)
        # within a class the earliest comes first, as the windows are in that order
        order = np.argsort(kinds, kind="stable")
        new = firsts(order, [kinds])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        later = order[~new & ((doc[each[lead]] != doc[each[order]]) | (crc[each[lead]] != crc[each[order]]) | (place[lead] != place[order]))]
        # windows of a document that follow one another become one range
        later = later[np.lexsort((place[later], crc[each[later]], doc[each[later]]))]
        d, c, p = doc[each[later]], crc[each[later]], place[later]
        new = np.flatnonzero(firsts(np.arange(len(later)), [d, c, p - np.arange(len(later))]))
        last = np.append(new[1:], len(later)) - 1 if len(new) else new
        return pa.concat_tables([_ranges(doc[known], crc[known], start[known], start[known] + n[known] + length - 1), _ranges(d[new], c[new], p[new], p[last] + length)])

    return run


def _cut_ranges(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(1))
            lists, rows, spans_out, kept_out = batch.column(2), [], [], []
            flat, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            starts, ends = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            at = np.concatenate([[0], np.cumsum(lengths)])
            for i in range(len(lists)):
                text = buffer[offsets[i] : offsets[i + 1]]
                spans = []
                if lengths[i]:
                    s, e = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
                    o = np.argsort(s, kind="stable")
                    s, reach = s[o], np.maximum.accumulate(e[o])
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
                    spans = list(zip(s[new].tolist(), reach[np.append(new[1:], len(s)) - 1].tolist(), strict=True))
                    keep = np.ones(len(text), bool)
                    for a, b in spans:
                        keep[a:b] = False
                    rest = text[keep].tobytes()
                else:
                    rest = text.tobytes()
                rows.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                if texts:
                    spans_out.append([{"start": a, "end": b} for a, b in spans])
                    kept_out.append(rest)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            made = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                made += [pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept_out, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_texts: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, and with_texts also spans (start and end of each removed run) and kept (the remaining bytes), for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # the checksum tells texts of one id apart; where no id repeats it is nothing but weight
    repeated = not docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    texts = docs.select(doc.alias("doc"), (F.crc32(text.cast("binary")) if repeated else F.lit(0).cast("long")).alias("crc"), text.alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(64, int(n_bytes * 40 / ((length - gram) / 2) / BUCKET_BYTES))

    dealt = map_arrow(texts, _anchors(length, gram, buckets), ANCHORS)
    found = cut(dealt.groupBy("bucket").applyInArrow(_match_regions, RANGES))

    closer = found.where("anchor >= 0").groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("wanted"))
    look = texts.join(closer.hint("shuffle_hash"), ["doc", "crc"]).select("doc", "crc", "text", "wanted")
    windows = map_arrow(look, _fragments(length, buckets), FRAGMENTS).groupBy("bucket").applyInArrow(_match_windows(length), RANGES)
    ranges = found.where("anchor < 0").unionByName(windows).groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = texts.join(ranges.hint("shuffle_hash"), ["doc", "crc"], "left").select("doc", "text", "ranges")
    out = map_arrow(joined, _cut_ranges(with_texts), f"doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>, kept binary" * with_texts)
    own = F.when(F.col("doc") != NO_ID, F.col("doc")).cast(kind)
    return out.select(own.alias(id_col), *out.columns[1:])


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """What substring_dedup gives, by looking every window up; for tests."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(texts):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            window = text[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        rest = bytes(np.frombuffer(text, np.uint8)[~gone])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((doc, len(text), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out
