"""op12 against all pairs of words."""

import random
import re
import zlib

from seedforest.llm import spelling


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: o if o and n[o] >= 10 * n[w] else None for w, o in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Word string, n int")
    return [tuple(r[k] for k in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_groups(docs).collect()]


def test_words_equal_all_pairs(spark):
    rng = random.Random(6)
    letters = "abéüÉzAZ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa"]
    for w in list(words):
        for _ in range(8):
            k = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    often = [min(int(2 ** rng.expovariate(0.25)), 400) for _ in words]
    text = [w for w, k in zip(words, often, strict=True) for _ in range(k)]
    rng.shuffle(text)
    rows = [(k % 37 or None, rng.choice(" 1-_\n").join(text[k * 40 : k * 40 + 40])) for k in range(len(text) // 40 + 1)]
    rows += [*rows[:5], (1, None), (2, ""), (3, "x" * 50_000 + " " + "y" * 50_000), (4, "x" * 50_000 + " x×÷")]
    out = found(spark, rows)
    assert len(out) == len(set(out)) and set(out) == plain(rows)
    assert sum(r[1] is not None for r in out) > 20 and any(r[1] != r[2] and r[1] for r in out)


def test_prefix_filter_meets_every_pair_one_edit_apart(spark):
    """Words of two letters have few bigrams, many times over: the hardest case for a filter by the three rarest."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(700)})
    pairs = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    assert {frozenset((r["a"], r["b"])) for r in pairs} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(pairs) == len({frozenset((r["a"], r["b"])) for r in pairs})


def test_roots_of_long_chains(spark):
    chain = [(str(k), str(k + 1)) for k in range(19)] + [("b", "19"), ("c", "d")]
    out = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert out == {**{str(k): "19" for k in range(19)}, "b": "19", "c": "d"}


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short words only")]) == []
