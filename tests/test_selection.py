"""Removal in order, removal by class, flooding and the segmentation made of them, against plain loops."""

import math
import random

import pytest

from seedforest.operators import hierarchy, selection
from seedforest.plans import tables


def plain_order(trees, edges, protected):
    gone = set()
    for _, t in sorted((math.inf if p is None else p, t) for t, p in trees.items()):
        beside = {b for a, b in edges if a == t} | {a for a, b in edges if b == t}
        if not beside & protected and not beside & gone:
            gone.add(t)
    return gone


def test_removal_equals_one_tree_after_the_other(spark):
    rng = random.Random(1)
    images = {}
    for k in range(6):
        n = rng.choice((1, 5, 30, 60))
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * rng.choice((1, 2, 3)))} if n > 1 else set()
        images[k] = ({t: rng.choice([None, *range(6)]) for t in range(n)}, edges, {t for t in range(n) if rng.random() < 0.1})
    images[9] = ({t: t for t in range(80)}, {(t, t + 1) for t in range(79)}, set())  # one long chain
    trees = spark.createDataFrame([(k, t, None if p is None else float(p)) for k, (ts, _, _) in images.items() for t, p in ts.items()], "image_id int, tree_id int, priority double")
    beside = [(k, a, b) for k, (_, es, _) in images.items() for a, b in es]
    adjacency = spark.createDataFrame(beside + beside[:5], "image_id int, tree_a int, tree_b int")
    protected = spark.createDataFrame([(k, t) for k, (_, _, ps) in images.items() for t in ps], "image_id int, tree_id int")
    found = selection.removed_in_order(trees, adjacency, protected).collect()
    assert len(found) == sum(len(ts) for ts, _, _ in images.values())
    for k, (ts, es, ps) in images.items():
        assert {r["tree_id"] for r in found if r["image_id"] == k and r["removed"]} == plain_order(ts, es, ps), k
    assert selection.removed_in_order(trees.where("false"), adjacency).count() == 0


def plain_kept(trees, edges, obj_markers, compat):
    """trees: number -> (label, is_grid, size, colour). The numbers that stay, in order, and the state."""
    total = sum(t[2] for t in trees.values())
    front = {t: v[0] <= obj_markers for t, v in trees.items()}
    beside = {t: {b for a, b in edges if a == t} | {a for a, b in edges if b == t} for t in trees}
    kind, priority = {}, {}
    for t, (_, _, size, colour) in trees.items():
        far = {o: math.dist(colour, trees[o][3]) for o in beside[t]}
        across = [d for o, d in far.items() if front[o] != front[t]]
        kind[t] = (0 if not far else (3 if front[t] else 1) + bool(across))
        priority[t] = 0 if not far else min(across) if across else size / total * min(far.values())

    def limit(one, two):
        own = [priority[t] for t in trees if kind[t] in (one, two)]
        n1, n2, s, s2 = sum(k == one for k in kind.values()), sum(k == two for k in kind.values()), sum(own), sum(p * p for p in own)
        if not own or (compat and not n1):
            return math.inf
        return s / len(own) + (math.sqrt(abs(s2 - 2 * s + s * s / n1 + n2) / n1 + n2) if compat else math.sqrt(max(0, s2 / len(own) - (s / len(own)) ** 2)))

    inner, outer = limit(1, 3), limit(2, 4)
    stay = [t for t in sorted(trees) if not trees[t][1] and kind[t]]
    lines = sorted((priority[t], t) for t in trees if trees[t][1] and kind[t] == 1)
    gone = plain_order({t: p for p, t in lines if p < inner}, edges, {t for t in trees if front[t]})
    stay += [t for _, t in lines if t not in gone]
    if not compat or outer <= 0 or (outer < math.inf and int(outer) >= outer):
        stay += [t for p, t in sorted((-priority[t], t) for t in trees if trees[t][1] and kind[t] == 2) if (int(-p) if compat else -p) >= outer]
    object_left, grid_left, back_left = any(front[t] for t in stay), any(trees[t][1] for t in stay), any(not front[t] and not trees[t][1] for t in stay)
    return stay, selection.STOP if not object_left or not (back_left or grid_left) else selection.GO_ON if grid_left else selection.LAST


@pytest.mark.parametrize("compat", [True, False])
def test_removal_by_class_and_the_stop_rule(spark, compat):
    rng = random.Random(2)
    images = {}
    for k in range(8):
        n = rng.choice((3, 8, 25))
        trees = {t: (1 if t < 2 else 2 if t < 3 else 3, t >= 3, rng.randint(1, 50), tuple(float(rng.randint(0, 9)) for _ in range(3))) for t in range(n)}
        images[k] = (trees, {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
    images[8] = ({0: (2, False, 5, (0.0, 0.0, 0.0)), 1: (3, True, 5, (1.0, 0.0, 0.0))}, {(0, 1)})
    images[9] = ({0: (1, False, 5, (0.0, 0.0, 0.0)), 1: (2, False, 5, (1.0, 0.0, 0.0))}, {(0, 1)})
    rows = [(k, t, label, grid, size, *colour) for k, (ts, _) in images.items() for t, (label, grid, size, colour) in ts.items()]
    trees = spark.createDataFrame(rows, "image_id int, tree_id int, label int, is_grid boolean, size long, mean_l double, mean_a double, mean_b double")
    adjacency = spark.createDataFrame([(k, a, b) for k, (_, es) in images.items() for a, b in es], "image_id int, tree_a int, tree_b int")
    kept = selection.kept_by_class(trees, adjacency, 1, compat)
    states = {r["image_id"]: r["state"] for r in selection.removal_state(trees, kept).collect()}
    for k, (ts, es) in images.items():
        stay, state = plain_kept(ts, es, 1, compat)
        assert [r["tree_id"] for r in kept.where(f"image_id = {k}").orderBy("new_id").collect()] == stay, k
        assert states[k] == state, k
    assert {selection.STOP, selection.LAST, selection.GO_ON} == set(states.values())


def plain_flood(edges, seeds):
    """edges in order; seeds: node -> tree. Parts that both have a seed stay apart."""
    part = {}
    for _, a, b in edges:
        pa, pb = part.setdefault(a, [{a}, seeds.get(a)]), part.setdefault(b, [{b}, seeds.get(b)])
        if pa is not pb and (pa[1] is None or pb[1] is None):
            both = [pa[0] | pb[0], pb[1] if pa[1] is None else pa[1]]
            part.update(dict.fromkeys(both[0], both))
    return {n: p[1] for n, p in part.items() if p[1] is not None} | seeds


def test_flooding_equals_merging_edge_by_edge(spark):
    rng = random.Random(3)
    images = {}
    for k in range(8):
        n = rng.choice((2, 20, 70))
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * 2)}
        images[k] = (sorted((float(rng.choice((0, 1, 2, 50))), a, b) for a, b in edges), {rng.randrange(n): t for t in range(rng.choice((1, 3, 9)))})
    images[20] = ([(1.0, 0, 1), (1.0, 2, 3)], {0: 5})
    edges = spark.createDataFrame([(k, b, a, w) for k, (es, _) in images.items() for w, a, b in es], "image_id int, a long, b long, weight double")
    seeds = spark.createDataFrame([(k, n, t + more) for k, (_, ss) in images.items() for n, t in ss.items() for more in (0, 7)], "image_id int, node long, tree_id int")
    found = hierarchy.flood(edges, seeds).collect()
    along = hierarchy.flood(hierarchy.boruvka(edges).edges(), seeds).collect()
    assert sorted(found) == sorted(along)
    for k, (es, ss) in images.items():
        assert {r["node"]: r["tree_id"] for r in found if r["image_id"] == k} == plain_flood(es, ss), k
    assert hierarchy.flood(edges.where("false"), seeds).count() == sum(len(ss) for _, ss in images.values())


def test_segmentation_finds_the_square_and_equals_plain_rounds(spark):
    rng = random.Random(4)
    rows = cols = 24
    inside = lambda x, y: 7 <= x < 17 and 7 <= y < 17
    images = {k: {(x, y): [(200 if inside(x, y) else 60) + rng.randint(-20, 20)] * 1 for y in range(rows) for x in range(cols)} for k in ("one", "two")}
    pixels = spark.createDataFrame([(k, x, y, v) for k, im in images.items() for (x, y), v in im.items()], "image_id string, x int, y int, val array<int>")
    marks = [("one", 0, k, 11 + k % 2, 11 + k // 2) for k in range(4)] + [("one", 1, k, 2 + k, 2) for k in range(3)] + [("two", 0, 0, 12, 12), ("two", 1, 0, 90, 1), ("none", 0, 0, 1, 1)]
    scribbles = spark.createDataFrame(marks, "image_id string, marker_id int, ord int, x int, y int")
    found = tables.segment_tables(pixels, scribbles, 12, 3).collect()
    assert len(found) == 2 * rows * cols
    one = {(r["x"], r["y"]): r for r in found if r["image_id"] == "one"}
    assert sum((one[p]["label"] == 1) == inside(*p) for p in one) > 0.97 * rows * cols
    assert all((r["border"] == 255) == any(one.get((x + dx, y + dy), r)["label"] != r["label"] for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))) for (x, y), r in one.items())
    single = {(r["x"], r["y"]): r["tree_id"] for r in tables.segment_tables(pixels, scribbles, 12, 1).where("image_id = 'one'").collect()}
    assert len(set(single.values())) > len({r["tree_id"] for r in one.values()}) > 1
    assert tables.segment_tables(pixels, scribbles.where("false"), 12, 3).count() == 0
    with pytest.raises(ValueError):
        tables.segment_tables(pixels, scribbles, 0, 3)
