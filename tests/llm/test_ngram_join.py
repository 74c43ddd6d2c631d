"""op13 against all pairs of sets; the parts of its index against their definitions."""

import random

import numpy as np

from seedforest.llm import ngram_join


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if ids[x] is not None and ids[y] is not None and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = top(ids[x]), top(ids[y])
                    parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i) if s and i is not None else i) for i, s in zip(ids, sets, strict=True)) if None not in ids else sorted((repr(i), len(s), top(i) if s and i is not None else i) for i, s in zip(ids, sets, strict=True))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Key string, label int")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, **options).collect()]
    return sorted(out) if None not in [r[0] for r in rows] else sorted((repr(r[0]), *r[1:]) for r in out)


def edited(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        k = rng.randrange(len(words))
        words[k : k + rng.choice((0, 1))] = [f"w{rng.randrange(10**6)}"] if rng.random() < 0.7 else []
    return words


def family_rows(rng, families=9, members=9):
    rows, next_id = [], 0
    for _ in range(families):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice((3, 5, 8, 12, 30, 60, 200, 700)))]
        template = [f"t{k}" for k in range(40)] if rng.random() < 0.5 else []
        for _ in range(members):
            words = edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.04, 0.05)))
            rows.append((next_id, " ".join(template + words)))
            next_id += 1
            base = words if rng.random() < 0.3 else base
    return rows


def test_components_equal_all_pairs(spark):
    """Families with small changes, a passage that many unrelated texts share, repeated ids and rows, null ids and texts without words."""
    rng = random.Random(1)
    rows = family_rows(rng)
    passage = [f"p{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(passage + [f"w{rng.randrange(10**7)}" for _ in range(rng.choice((15, 18, 40)))])) for k in range(200)]
    rows += [(900, "Same TEXT here"), (901, "same text here"), (902, "same\ttext  here"), (903, None), (904, ""), (905, " \n"), (906, "x"), (907, "X")]
    rows += [(1, rows[40][1]), (1, rows[40][1]), (2, rows[50][1]), rows[3], rows[3], (None, rows[0][1]), (None, None)]
    rng.shuffle(rows)
    assert found(spark, rows, page=16) == plain(rows)


def test_no_links(spark):
    assert found(spark, [(1, None), (2, "a b")]) == [(1, 0, 1), (2, 1, 2)]
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def linked(n_a, n_b, common, percent):
    return 100 * common >= percent * (n_a + n_b - common)


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        n = int(np.exp(rng.uniform(0, 6.5)))
        own = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        if rng.random() < 0.3:  # crowded hashes
            own = np.unique(own >> np.uint64(rng.integers(1, 12)))
        drop, add = int(rng.integers(0, n // 5 + 2)), int(rng.integers(0, n // 4 + 2))
        other = np.unique(np.concatenate([rng.permutation(own)[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        if len(other) and linked(len(own), len(other), len(np.intersect1d(own, other)), 80):
            assert len(np.intersect1d(ngram_join.cell_keys(own), ngram_join.cell_keys(other))), (len(own), len(other))


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 4, 64) for _ in range(6)]
    points = np.array([np.maximum(0, base[rng.integers(6)] + rng.integers(-1, 2, 64) * (rng.random(64) < 0.2)) for _ in range(400)], np.int32)
    sizes, labels = points.sum(1).astype(np.int64), rng.integers(0, 30, 400)
    cells = np.repeat([3, 5, 9], [1, 250, 149])  # points in the order of size within each
    order = np.lexsort((sizes, cells))
    points, sizes, labels = points[order], sizes[order], labels[order]
    i, j, bound = ngram_join.Trees(cells, points, sizes, labels).near(cells, points, sizes, labels, 80)
    common = np.minimum(points[:, None], points[None]).sum(2)
    may = (cells[:, None] == cells[None]) & (labels[:, None] != labels[None]) & (common * 180 >= 80 * (sizes[:, None] + sizes[None])) & (sizes[:, None] * 100 >= sizes[None] * 80) & (sizes[None] * 100 >= sizes[:, None] * 80)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(may)), strict=True)) and len(i) == may.sum() > 0
    assert (common[i, j] == bound).all()


def test_points_fold_and_bound_the_overlap():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:1500], rng.integers(0, 1 << 64, 900, dtype=np.uint64)]))
    for groups in (64, 512, 2048):
        x, y = ngram_join.unpacked([ngram_join.point(s) for s in (a, b)], np.array([len(a), len(b)]), groups).astype(int)
        assert x.sum() == len(a) and np.minimum(x, y).sum() >= 1500
    many = np.arange(70_000, dtype=np.uint64)  # all in one group
    assert ngram_join.unpacked([ngram_join.point(many)], np.array([len(many)]), 64)[0, 0] == 70_000
