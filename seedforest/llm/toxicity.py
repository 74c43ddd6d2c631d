"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and scores of the context windows around hits.

The lexicon has whole words and stems (all words that start so). It holds a small seed list of English insults and terms learnt from labelled
texts: words and prefixes that are far more common in texts labelled toxic than chance explains. The trie's nodes times the
number of edits spent are the states of a nondeterministic automaton; it is made deterministic as words are read and its transitions are kept, so a word
costs one look-up a character and most words die after a few. Words may miss whole-word terms of five letters or more by one edit (a letter more, less or
changed, or two neighbours swapped), those of ten or more by two; shorter terms and stems must be met exactly. Look-alike digits and signs count as their letters,
also where a word begins or ends with them.

The words within WINDOW of a hit decide whether it is quoted (quotation marks around it, reporting words near) or aimed at someone. A logistic
regression over the hits' weights, density and context gives the score. Terms and regression are fitted on at most `sample` labelled rows (the first in order of
a hash of the id). Texts alone are scored: id, language, source and labels aren't inputs.

Null and empty texts have no hits and get the score of a text without any; very long texts are scored whole, one at a time. Repeated rows are scored alike. Of several labels of an id the
largest counts, of several texts of a labelled id the smallest is learnt from, so no repetition brings more than `sample` rows together; labels of unknown ids do nothing; without any labels the seed lexicon's prior model scores. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

SAMPLE = 20_000
STEMS = range(3, 9)
WINDOW = 6
THRESHOLD = 0.3
#: Own seed list.
SEED = ("bastard", "clown", "disgusting", "dumb", "filthy", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "useless", "vermin", "worthless")
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
REPORTING = frozenset("said says wrote writes quoted quote called stated replied according termed phrase word".split())
AIMED = frozenset("you your youre u he she they them are is such all".split())
TOKEN = re.compile(r"[\w@$!*]+")
QUOTES = frozenset("\"“”«»„‘")
#: Coefficients used where there is nothing to fit on: intercept and FEATURES.
FEATURES = 6
PRIOR = (-5.0, 0.9, 0.4, 0.8, -0.8, 0.3, 0.0)


class Automaton:
    """terms: (text, is_stem, weight). `look` gives (term, edits) of the best term for a word, or None."""

    def __init__(self, terms: list[tuple[str, bool, float]], fuzzy: int = 5, most_states: int = 20_000, twice: int = 10):
        self.terms, self.fuzzy, self.twice, self.most = terms, fuzzy, twice, most_states
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int | None] = [None]
        self.reach = [0]  # how many edits a term below allows
        for k, (text, stem, _) in enumerate(terms):
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                path.append(node)
            if self.end[node] is None or stem:
                self.end[node] = k
            for n in path:
                self.reach[n] = max(self.reach[n], self._edits(k))
        self._reset()

    def _edits(self, k: int) -> int:
        text, stem, _ = self.terms[k]
        return 0 if stem else (len(text) >= self.fuzzy) + (len(text) >= self.twice)

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.stem_hit: list[int | None] = []
        self.word_hit: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, states: set) -> int:
        states, todo = set(states), list(states)
        while todo:  # a letter left out
            node, spent, owed = todo.pop()
            if not owed and self.reach[node] > spent:
                more = {(n, spent + 1, "") for n in self.children[node].values() if self.reach[n] > spent} - states
                states |= more
                todo += more
        key = frozenset(states)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(spent, self.end[node]) for node, spent, owed in key if not owed and self.end[node] is not None]
            stems = [k for spent, k in ends if not spent and self.terms[k][1]]
            words = [(spent, k) for spent, k in ends if not self.terms[k][1] and spent <= self._edits(k)]
            self.stem_hit.append(max(stems, key=lambda k: self.terms[k][2], default=None))
            best = min(words, key=lambda x: (x[0], -self.terms[x[1]][2], x[1]), default=None)
            self.word_hit.append(best and (best[1], best[0]))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        letters = {c, LOOKALIKE.get(c, c)}
        for node, spent, owed in self.sets[state]:
            if owed:  # the second of two swapped letters
                if owed in letters:
                    out.add((node, spent, ""))
                continue
            for letter in letters:
                if letter in self.children[node]:
                    n = self.children[node][letter]
                    if self.reach[n] >= spent:
                        out.add((n, spent, ""))
            if self.reach[node] > spent:
                out.add((node, spent + 1, ""))  # a letter too many
                for first, n in self.children[node].items():
                    if self.reach[n] > spent:
                        out.add((n, spent + 1, ""))  # another letter
                        out.update((self.children[n][x], spent + 1, first) for x in letters if x in self.children[n] and self.reach[self.children[n][x]] > spent)
        to = self._state(out) if out else -1
        self.next[state][c] = to
        return to

    def look(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > self.most:
            self._reset()
        state, stem = self.start, None
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return None if stem is None else (stem, 0)
            state = to
            if self.stem_hit[state] is not None:
                stem = self.stem_hit[state]
        whole = self.word_hit[state]
        if stem is not None and (whole is None or whole[1]):
            return stem, 0
        return whole


class Scorer:
    """Features and scores of texts. Words looked up before are kept, up to a bound."""

    def __init__(self, terms: list[tuple[str, bool, float]], coefficients=PRIOR, most_words: int = 100_000):
        self.automaton, self.terms, self.coefficients, self.most = Automaton(terms), terms, coefficients, most_words
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        known, out = self.known, {}
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w in known:
                hit = known[w]
            else:
                # signs at the ends are letters or not: the reading with the fewest edits counts
                found = [self.automaton.look(x) for x in sorted({w, w.strip("*!@$"), w.lstrip("*!@$"), w.rstrip("*!@$")}) if x]
                hit = known[w] = min((x for x in found if x), key=lambda x: (x[1], -self.terms[x[0]][2], x[0]), default=None)
            if hit is not None:
                out[w] = hit
        return out

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Weights of exact and of near hits, density, quoted share, aimed share, size; and the number of distinct hits."""
        lower = (text or "").lower()
        words = TOKEN.findall(lower)
        hits = self.hits(set(words))
        if not hits:
            return [0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(words)) / 10], 0
        exact, near = {}, {}
        for k, edits in hits.values():
            (near if edits else exact)[k] = self.terms[k][2]
        near = {k: w for k, w in near.items() if k not in exact}
        places = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(lower)]
        count = quoted = aimed = 0
        for i, (start, end, word) in enumerate(places):
            if word not in hits:
                continue
            count += 1
            around = places[max(0, i - WINDOW) : i] + places[i + 1 : i + 1 + WINDOW]
            first = around[0][0] if around else start
            last = max(end, around[-1][1]) if around else end
            marks = any(c in QUOTES for c in lower[min(first, start) : start]) and any(c in QUOTES for c in lower[end:last])
            quoted += marks or any(w in REPORTING for _, _, w in around)
            aimed += any(w in AIMED for _, _, w in around)
        return [min(sum(exact.values()), 30.0), min(sum(near.values()), 30.0), 10 * math.log1p(100 * count / len(words)) / 5, quoted / count, aimed / count, math.log1p(len(words)) / 10], len(hits)

    def score(self, features: list[float]) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def forms(text: str | None) -> set[str]:
    """The distinct words of a text, and their prefixes marked with a trailing *."""
    words = {w.strip("*!@$") for w in TOKEN.findall((text or "").lower())}
    words = {w for w in words if w and not w.isdigit()}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def counted(sample: DataFrame, least: int = 1) -> DataFrame:
    """form, n: in how many texts each form is, summed up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(forms(text))
            if len(found) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["form", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["form", "n"])

    return map_arrow(sample.select("text"), run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def candidates(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, forms_seen: int) -> DataFrame:
    """form, a, b: in how many toxic and clean texts each form is that passes the tests of choose_terms (which makes them again: logarithms differ in the last bit)."""
    both = toxic.withColumnRenamed("n", "a").join(clean.withColumnRenamed("n", "b"), "form", "left").select("form", "a", F.coalesce("b", F.lit(0)).alias("b"))
    base, a, b = n_toxic / (n_toxic + n_clean), F.col("a"), F.col("b")
    share = a / (a + b)
    lift = (a / n_toxic) / ((b + 0.5) / n_clean)
    evidence = a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return both.where((share > base - 1e-9) & (lift >= 8 - 1e-6) & (evidence >= math.log(max(2, forms_seen)) + 2 - 1e-6))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, forms_seen: int) -> list[tuple[str, bool, float]]:
    """Forms that are more common in toxic texts than chance explains among so many forms; stems only where they gather several words."""
    strong = {}
    base = n_toxic / max(1, n_toxic + n_clean)
    for form, a in toxic.items():
        b = clean.get(form, 0)
        share = a / (a + b)
        lift = (a / max(1, n_toxic)) / ((b + 0.5) / max(1, n_clean))
        evidence = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0)
        if share > base and lift >= 8 and evidence >= math.log(max(2, forms_seen)) + 2:
            strong[form] = (a, min(6.0, math.log(lift)))
    best_below: dict[str, int] = {}  # the most that a longer form of each prefix has
    for form, (a, _) in strong.items():
        whole = form.rstrip("*")
        for n in STEMS:
            if n < len(whole) or (n == len(whole) and not form.endswith("*")):
                best_below[whole[:n]] = max(best_below.get(whole[:n], 0), a)
    stems = {f[:-1]: (a, w) for f, (a, w) in strong.items() if f.endswith("*") and best_below.get(f[:-1], 0) < 0.9 * a}
    out = [(s, True, w, a) for s, (a, w) in stems.items() if not any(s[:n] in stems for n in STEMS if n < len(s))]
    for form, (a, w) in strong.items():
        if not form.endswith("*") and not any(form[:n] in stems for n in STEMS if n <= len(form)):
            out.append((form, False, w, a))
    out.sort(key=lambda t: (-t[3] * t[2], t[0]))
    return [(t, stem, w) for t, stem, w, _ in out]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Newton's method with a ridge on all but the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col: str):
    """Rows whose labels are for judging only."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[list, tuple]:
    """Terms and coefficients. The driver gets at most `sample` rows of features, and the counts of the forms that pass."""
    seeds = [(w, False, 3.0) for w in SEED]
    chosen = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("y")).where("y is not null and label_id is not null").where(~held_out("label_id"))
    chosen = chosen.groupBy("label_id").agg(F.max("y").alias("y"))
    chosen = cut(chosen.orderBy(F.md5(F.col("label_id").cast("string").cast("binary")), "label_id").limit(sample))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    texts = cut(own.groupBy("label_id").agg(F.min("text").alias("text"), F.first("y").cast("int").alias("y")).select("text", "y"))
    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return seeds, PRIOR
    toxic, clean = texts.where("y = 1"), texts.where("y = 0")
    found = cut(counted(toxic, least=2))
    seen = found.count()
    passed = candidates(found, counted(clean), n_toxic, n_clean, seen).collect()
    terms = choose_terms({r["form"]: r["a"] for r in passed}, {r["form"]: r["b"] for r in passed if r["b"]}, n_toxic, n_clean, seen)
    known = {t for t, _, _ in terms}
    terms += [s for s in seeds if s[0] not in known]
    schema = "y int, " + ", ".join(f"x{k} double" for k in range(FEATURES))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            rows = [scorer.features(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(FEATURES))], names=["y", *(f"x{k}" for k in range(FEATURES))])

    rows = map_arrow(texts, features, schema).collect()
    rows = np.array(sorted(tuple(r) for r in rows), float)
    return terms, fit_logistic(rows[:, 1:], rows[:, 0])


def score_texts(docs: DataFrame, model: tuple[list, tuple], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score, predicted, hits for every row: one pass over the two columns, no shuffle."""
    terms, coefficients = model
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, coefficients)
        for batch in batches:
            found = [scorer.features(t.as_py()) for t in batch.column(1)]
            scores = [scorer.score(f) for f, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int32())], names=["id", "score", "predicted", "hits"])

    return map_arrow(narrow, run, f"id {kind}, score double, predicted int, hits int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: tuple[list, tuple], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score below the threshold: one pass, no shuffle."""
    terms, coefficients = model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, coefficients)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(scorer.features(t.as_py())[0]) < threshold for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
