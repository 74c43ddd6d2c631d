"""SentencePiece encoding and decoding by N-best segmentation of the piece lattice.

Forward Viterbi gives the best score of every prefix, and its back-pointers the best segmentation. The scores are exact heuristics for an A* search from the end
backwards, which pops the best segmentation first, then the second best, and so on; it gives the other N - 1.

The vocabulary file is read on the driver and shipped (its size is fixed). The public vocabulary used here is a merge list, whose stored scores are ranks and
don't add up to anything along a path. So a piece of rank r gets the log-probability of Zipf's law, -ln(r + 1) - ln(sum of 1 / (k + 1)); `scores="stored"` takes the
file's own, for vocabularies that have log-probabilities. A character without a piece costs the lowest score less 10 and is spelled in byte pieces.

As in the library, a space is put before the text and spaces become U+2581. That character itself is spelled in bytes, so every text decodes to itself.

No piece has a space behind another character, so texts fall apart before such spaces and each different word is searched once and kept (up to a bound). For every word the
best segmentation is kept, and what the second best loses, which follows from the best scores before and behind each piece. The N best of
a text differ from the best one in no more than N - 1 words, those that lose least; only for these the A* search lists the word's N best, and they are combined.

The A* search orders paths by what they lose against the best: each piece's loss, best[end] - (best[start] + score), is exactly 0 along the best path, however long, so rounding never makes
it look worse than its siblings. Each open path ends in a segmentation of its own that loses no more, so no more than the N least paths are kept open.

Null counts as empty and has no pieces. Very long texts are encoded whole, one at a time, and so are very long words (texts without spaces); the lattice of a word of more than LONG
characters isn't held but looked up piece by piece, so that it needs some 50 bytes a character. Words kept are bounded by their number and by their characters. Repeated rows are encoded alike; an empty table gives an empty table; other columns are not read. Unknown ids decode to nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spans_of_texts, text_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = "\ud800"  # stands for U+2581 of the text: no UTF-8 text holds a lone surrogate
UNKNOWN_PENALTY = 10.0
NBEST = 4
SPAN = 1 << 21  # bytes of text whose words are searched together
LONG = 4096  # characters of a word whose lattice is held
KEPT = 4 << 20  # characters of the words that are kept, twice
CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))


@lru_cache(4)
def load(path: str = MODEL, scores: str = "zipf") -> tuple:
    """(normal pieces, their ids, their scores, byte ids) of a vocabulary file. Control and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
    skip = set(special)
    ids = tuple(i for i in range(n) if i not in skip)
    pieces = tuple(model.id_to_piece(i) for i in ids)
    by_name = {model.id_to_piece(i): i for i in special}
    if scores == "zipf":
        norm = math.log(sum(1 / (k + 1) for k in range(len(ids))))
        values = tuple(-math.log(k + 1) - norm for k in range(len(ids)))
    else:
        values = tuple(model.get_score(i) for i in ids)
    return pieces, ids, values, tuple(by_name[f"<0x{b:02X}>"] for b in range(256))


_BASE = 0x9E3779B97F4A7C15


def _key(piece: str) -> int:
    """The polynomial hash of a piece's characters."""
    h = 0
    for c in piece:
        h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Ends:
    """What Lattice.arcs() gives, for a long word: looked up when asked for."""

    def __init__(self, lattice: Lattice, word: str):
        self.lattice, self.word = lattice, word

    def __len__(self) -> int:
        return len(self.word) + 1

    def __getitem__(self, j: int) -> list[tuple[int, bytes, float]]:
        word, pieces, out = self.word, self.lattice.pieces, []
        for i in range(max(0, j - self.lattice.longest), j):
            found = pieces.get(word[i:j])
            if found is not None:
                out.append((i, *found))
            elif i == j - 1:
                out.append((i, self.lattice.spelled(word[i]), self.lattice.unknown))
        return out


class Lattice:
    """A vocabulary ready for searching."""

    def __init__(self, vocabulary: tuple, nbest: int = NBEST, most: int = 100_000):
        pieces, ids, scores, self.bytes = vocabulary
        self.nbest, self.most = nbest, most
        packed = [int(i).to_bytes(4, "little") for i in range(max([*ids, *self.bytes]) + 1)]
        self.pieces = {p: (packed[i], s) for p, i, s in zip(pieces, ids, scores, strict=True)}
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.raw = [packed[i] for i in self.bytes]
        inside = any(q[0] != SPACE and q[1] == SPACE for p in pieces for q in zip(p, p[1:]))
        self.word = re.compile("(?s).+") if inside else re.compile(" *[^ ]+| +")
        self.text = [b""] * len(packed)
        for p, i in zip(pieces, ids, strict=True):
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.words: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.lists: dict[str, list] = {}
        self.letters = self.listed = 0
        self.longest = max(map(len, pieces))
        keys = np.array([_key(p) for p in pieces], np.uint64)
        if len(set(keys.tolist())) < len(keys):
            raise ValueError("two pieces share a hash")
        order, sizes = np.argsort(keys), np.array([len(p) for p in pieces])
        self.by_size = {n: (keys[k], np.array(ids, np.int32)[k], np.array(scores)[k]) for n in sorted(set(sizes.tolist())) for k in [order[sizes[order] == n]]}

    @staticmethod
    def inner(word: str) -> str:
        return (word.replace(SPACE, LITERAL) if SPACE in word else word).replace(" ", SPACE)

    def arcs(self, word: str):
        """For each end position: (start, id bytes, score), by start."""
        n, out = len(word), [[] for _ in range(len(word) + 1)] if len(word) <= LONG else Ends(self, word)
        if n > LONG:
            return out
        pieces, prefixes = self.pieces, self.prefixes
        for i in range(n):
            text = word[i]
            found = pieces.get(text)
            if found is None:
                out[i + 1].append((i, self.spelled(text), self.unknown))
                if text not in prefixes:
                    continue
            else:
                out[i + 1].append((i, *found))
            for j in range(i + 2, n + 1):
                text = word[i:j]
                if text not in prefixes:
                    break
                found = pieces.get(text)
                if found is not None:
                    out[j].append((i, *found))
        return out

    def spelled(self, character: str) -> bytes:
        """The byte pieces of a character without a piece."""
        return b"".join([self.raw[b] for b in (SPACE if character == LITERAL else character).encode()])

    @staticmethod
    def forward(arcs) -> tuple[array, array]:
        """Viterbi: the best score of each prefix and where the piece that ends it starts."""
        best, start = array("d", [0.0]), array("q", [0])
        for j in range(1, len(arcs)):
            top, at = -math.inf, 0
            for i, _, score in arcs[j]:
                s = best[i] + score
                if s > top:
                    top, at = s, i
            best.append(top)
            start.append(at)
        return best, start

    def word_entry(self, word: str) -> tuple[bytes, float, float]:
        """Id bytes and score of the best segmentation of a word, and what the second best loses (infinite if there is none)."""
        arcs = self.arcs(self.inner(word))
        best, start = self.forward(arcs)
        path, on, at = [], array("b", bytes(len(arcs))), len(arcs) - 1
        while at:
            path.append(next(own for i, own, _ in arcs[at] if i == start[at]))
            on[at] = 1
            at = start[at]
        path.reverse()
        total, loss = best[-1], math.inf
        ahead = array("d", [-math.inf]) * (len(arcs) - 1) + array("d", [0.0])
        for j in range(len(arcs) - 1, 0, -1):
            behind = ahead[j]
            for i, _, s in arcs[j]:
                s += behind
                if s > ahead[i]:
                    ahead[i] = s
                if total - best[i] - s < loss and not (on[j] and start[j] == i):
                    loss = total - best[i] - s
        return b"".join(path), total, max(0.0, loss)

    def entries(self, words: list[str]) -> None:
        """Makes word_entry known for many words at once: those of one length are searched together, position by position, as array operations."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            if n > 48 or len(own) < 8 or 1 not in self.by_size:
                for w in own:
                    self.words[w] = self.word_entry(w)
            else:
                for k in range(0, len(own), 2048):
                    self._together(own[k : k + 2048], n)

    def _together(self, words: list[str], n: int) -> None:
        inner = [self.inner(w) for w in words]
        chars = np.array([w.replace(LITERAL, SPACE) for w in inner], f"U{n}").view(np.uint32).reshape(-1, n)
        if chars.shape[0] != len(words) or any(LITERAL in w or "\0" in w for w in inner):
            for w in words:
                self.words[w] = self.word_entry(w)
            return
        m, codes = len(words), chars.T.astype(np.uint64) + np.uint64(1)
        best, start, piece = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        best[0] = 0.0
        arcs, rare = [], np.zeros(m, bool)
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * np.uint64(_BASE) + codes[j - 1]
                if j - i not in self.by_size:
                    continue
                keys, key_ids, key_scores = self.by_size[j - i]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if j == i + 1 and not hit.all():  # a character without a piece: its byte, if it is one
                    score = np.where(hit, key_scores[at], self.unknown)
                    single = chars[:, i] < 128
                    ids = np.where(hit, key_ids[at], np.array(self.bytes, np.int32)[np.minimum(chars[:, i], 255)])
                    rare |= ~hit & ~single
                elif hit.any():
                    score, ids = np.where(hit, key_scores[at], -np.inf), key_ids[at]
                else:
                    continue
                arcs.append((i, j, score))
                total = best[i] + score
                better = total > best[j]
                best[j] = np.where(better, total, best[j])
                start[j] = np.where(better, i, start[j])
                piece[j] = np.where(better, ids, piece[j])
        ahead = np.full((n + 1, m), -np.inf)
        ahead[n] = 0.0
        at, every = np.full(m, n), np.arange(m)
        path, count, on = np.zeros((m, n), np.int32), np.zeros(m, np.int64), np.zeros((n + 1, m), bool)
        while at.any():
            live = at > 0
            count += live
            path[every[live], n - count[live]] = piece[at[live], every[live]]
            on[at[live], every[live]] = True
            at = np.where(live, start[at, every], 0)
        loss = np.full(m, np.inf)
        for i, j, score in reversed(arcs):
            behind = score + ahead[j]
            ahead[i] = np.maximum(ahead[i], behind)
            lost = np.where(on[j] & (start[j] == i), np.inf, best[n] - best[i] - behind)
            loss = np.minimum(loss, lost)
        loss = np.maximum(loss, 0.0)
        raw, total, loss, first = path.astype("<i4").tobytes(), best[n].tolist(), loss.tolist(), (n - count).tolist()
        for k, w in enumerate(words):
            self.words[w] = (raw[4 * (k * n + first[k]) : 4 * (k + 1) * n], total[k], loss[k])
        for k in np.flatnonzero(rare):
            self.words[words[k]] = self.word_entry(words[k])

    def forget(self) -> None:
        """Drops the words learnt: most words of one task are not met in the next, and the worker may serve other stages in between."""
        self.words, self.older, self.lists = {}, {}, {}
        self.letters = self.listed = 0

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Splits texts into words and makes all of them known. When there are too many, those not met lately are forgotten."""
        split = [self.word.findall(" " + t) if t else [] for t in texts]
        if len(self.words) > self.most or self.letters > KEPT:
            self.words, self.older = {}, self.words
            self.letters = 0
        words, older = self.words, self.older
        new = set().union(*map(set, split)) - words.keys() if split else set()
        self.letters += sum(map(len, new))
        for w in new & older.keys():
            words[w] = older[w]
        self.entries(sorted(new - older.keys()))
        return split

    def search(self, word: str) -> list[tuple[float, bytes]]:
        """The N best segmentations of a word, best first: score and id bytes. A* from the end, guided by the exact scores of what is still to come.
        Of equal losses (but for rounding) the path met last goes on, so that ties are finished one by one and not all at once."""
        arcs = self.arcs(self.inner(word))
        best, _ = self.forward(arcs)
        waiting, out, turn = [(0.0, 0, len(arcs) - 1, 0.0, None)], [], 0
        while waiting and len(out) < self.nbest:
            _, _, at, lost, path = waiting.pop(0)
            if not at:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((best[-1] - lost, b"".join(ids)))
                continue
            room, here = self.nbest - len(out), best[at]
            for i, own, s in arcs[at]:
                turn += 1
                more = lost + (here - (best[i] + s))
                if len(waiting) < room or round(more, 7) <= waiting[-1][0]:
                    insort(waiting, (round(more, 7), -turn, i, more, (own, path)))
                    del waiting[room:]
        return out

    def word_nbest(self, word: str) -> list[tuple[float, bytes]]:
        found = self.lists.get(word)
        if found is None:
            if len(self.lists) > self.most // 8 or self.listed > KEPT // 8:
                self.lists.clear()
                self.listed = 0
            found = self.lists[word] = self.search(word)
            self.listed += len(word)
        return found

    def encode(self, text: str | None, words: list[str] | None = None) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Id bytes and score of the best segmentation; for each of the N best its score and the words in which it differs: where the word's ids start
        in the best segmentation and how many they are there, and the id bytes in their place."""
        if not text:
            return b"", 0.0, [(0.0, [])]
        if words is None:
            words = self.learn([text])[0]
        known = self.words
        packed, scores, losses = zip(*[known[w] for w in words], strict=True)
        score = math.fsum(scores)
        # only the words that lose least can differ in the N best; they are combined in order of the loss
        losses = np.array(losses)
        some = min(self.nbest - 1, len(losses))
        least = np.partition(losses, some - 1)[some - 1] if some else -1.0
        chosen = [*np.flatnonzero(losses < least).tolist(), *np.flatnonzero(losses == least).tolist()][:some] if math.isfinite(least) else np.flatnonzero(np.isfinite(losses)).tolist()[:some]
        total = [(0.0, ())]
        for k in chosen:
            found = self.word_nbest(words[k])
            # of equal scores the search may put another one first than Viterbi took
            others = [x for x in found if x[1] != packed[k]][: self.nbest - 1]
            options = [(0.0, ())] + [(found[0][0] - s, ((k, p),)) for s, p in others]
            total = sorted(((a + b, x + y) for a, x in total for b, y in options), key=lambda t: (t[0], t[1]))[: self.nbest]
        places = {k: (sum(map(len, packed[:k])) // 4, len(packed[k]) // 4) for k in chosen}
        return b"".join(packed), score, [(score - d, [(*places[k], p) for k, p in sorted(x)]) for d, x in total]

    @staticmethod
    def changed(packed: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
        """The id bytes of one of the N best, from those of the best."""
        out, at = [], 0
        for start, n, own in changes:
            out += [packed[at : 4 * start], own]
            at = 4 * (start + n)
        return b"".join([*out, packed[at:]])

    def nbest_ids(self, text: str | None) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text in full."""
        best, _, found = self.encode(text)
        return [(score, np.frombuffer(self.changed(best, changes), "<i4").tolist()) for score, changes in found]

    def decode(self, ids) -> str:
        text, size = self.text, len(self.text)
        try:
            raw = b"".join([text[i] for i in ids])
        except IndexError:
            raw = b"".join([text[i] for i in ids if 0 <= i < size])
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


_lattices: dict = {}


def lattice(vocabulary: tuple, nbest: int) -> Lattice:
    """One lattice per Python worker, so that the vocabulary is read in once."""
    key = (len(vocabulary[0]), hash(vocabulary[2]), nbest)
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(vocabulary, nbest)
    return _lattices[key]


def _changes(edits: list[list[list[tuple[int, int, bytes]]]]) -> pa.Array:
    """The changes of each of the N best of each text, as an array of type CHANGES."""
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    every = [c for e in edits for c in e]
    flat = [x for c in every for x in c]
    ids = pa.ListArray.from_arrays(ends([len(own) // 4 for *_, own in flat]), pa.array(np.frombuffer(b"".join(own for *_, own in flat), "<i4")))
    one = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)] + [ids], fields=list(CHANGES.value_type.value_type))
    return pa.ListArray.from_arrays(ends([len(e) for e in edits]), pa.ListArray.from_arrays(ends([len(c) for c in every]), one))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nbest: int = NBEST, vocabulary: tuple | None = None, tokens: bool = True) -> DataFrame:
    """id_col, n_tokens, tokens_sha256 (of little-endian 32-bit ids), score, nbest_scores, nbest_sha256 (of the ids of each of the N best), round_trip (whether
    decoding the ids gives the text back) and, with tokens=True, tokens and nbest_changes (for each of the N best where it differs from tokens: `n` ids from
    position `at`, counted from 0, become `ids`): one pass over the two columns, no shuffle."""
    own = vocabulary or load()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(own, nbest)
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(1))
            for a, b in spans_of_texts(offsets, SPAN):
                rows, lists, edits = [], [], []
                texts = [buffer[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(a, b)]
                for text, words in zip(texts, model.learn(texts), strict=True):
                    packed, score, found = model.encode(text, words)
                    ids = np.frombuffer(packed, "<i4")
                    digests = [hashlib.sha256(model.changed(packed, c)).hexdigest() for _, c in found]
                    rows.append((len(ids), digests[0], score, [s for s, _ in found], digests, model.decode(ids.tolist()) == text))
                    lists.append(ids)
                    if tokens:
                        edits.append([c for _, c in found])
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_()]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                names = ["id", "n_tokens", "tokens_sha256", "score", "nbest_scores", "nbest_sha256", "round_trip"]
                if tokens:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists), pa.int32())))
                    made.append(_changes(edits))
                    names += ["tokens", "nbest_changes"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], names=names)
        model.forget()

    schema = f"id {kind}, n_tokens long, tokens_sha256 string, score double, nbest_scores array<double>, nbest_sha256 array<string>, round_trip boolean" + ", tokens array<int>, nbest_changes array<array<struct<at: int, n: int, ids: array<int>>>>" * tokens
    return map_arrow(narrow, run, schema).withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: tuple | None = None) -> DataFrame:
    """id_col and text for every row of token ids; null tokens give null."""
    own = vocabulary or load()
    narrow = encoded.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(own, NBEST)
        for batch in batches:
            texts = [None if t is None else model.decode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return map_arrow(narrow, run, f"id {kind}, text string").withColumnRenamed("id", id_col)
