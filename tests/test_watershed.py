"""Hierarchies as tables against merging edge by edge on random images with ties, holes and repeated pixels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seedforest.operators import hierarchy, watershed

IMAGES = [(5, 7, [0, 1, 2, 3, 9]), (6, 4, range(100)), (3, 3, [5]), (1, 6, [1, 2]), (9, 8, [0.5, 0.25, 7]), (1, 1, [4]), (10, 10, range(4))]


def made(seed, holes=0.0):
    rng = random.Random(seed)
    return {k: {(x, y): float(rng.choice(list(values))) for y in range(rows) for x in range(cols) if rng.random() >= holes or (x, y) == (cols - 1, rows - 1)} for k, (rows, cols, values) in enumerate(IMAGES)}


def edges_of(image):
    cols = max(x for x, _ in image) + 1
    number = lambda p: p[1] * cols + p[0]
    return sorted((abs(v - image[q]), number(p), number(q)) for p, v in image.items() for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in image)


def merged(edges):
    """(edge, members of one side, of the other) for each edge, in order, that joins two parts."""
    part = {}
    for w, a, b in edges:
        pa, pb = part.setdefault(a, {a}), part.setdefault(b, {b})
        if pa is not pb:
            yield (w, a, b), pa, pb
            both = pa | pb
            part.update(dict.fromkeys(both, both))


def plain_tree(image, attribute):
    inside, out = {}, []
    for (w, a, b), pa, pb in merged(edges_of(image)):
        low = [min(inside.get(frozenset(p), math.inf), w) for p in (pa, pb)]
        out.append((w, a, b, {"area": min(len(pa), len(pb)), "volume": min(len(pa), len(pb)) * w, "dynamics": min(w - low[0], w - low[1])}[attribute]))
        inside[frozenset(pa | pb)] = min(*low, w)
    return out


def table(spark, images, twice=False):
    rows = [(k, x, y, v) for k, image in images.items() for (x, y), v in image.items()]
    return spark.createDataFrame(rows + [(k, x, y, v + 1) for k, x, y, v in rows[::3]] * twice, "image_id int, x int, y int, v double")


@pytest.mark.parametrize("attribute", watershed.ATTRIBUTES)
def test_heights_equal_merging_edge_by_edge(spark, attribute):
    images = made(1) | {100 + k: v for k, v in made(2, 0.25).items()}
    found = {}
    for r in watershed.watershed_tree(table(spark, images, True), attribute).collect():
        found.setdefault(r["image_id"], []).append((r["weight"], r["a"], r["b"], round(r["height"], 9)))
    for k, image in images.items():
        assert sorted(found.get(k, [])) == sorted((w, a, b, round(h, 9)) for w, a, b, h in plain_tree(image, attribute)), k


def joined_at(tree):
    """For each pair of pixels the (height, a, b) at which they become one region."""
    at = {}
    for e, pa, pb in merged(sorted((h, a, b) for _, a, b, h in tree)):
        at |= {pair: e for x in pa for y in pb for pair in ((x, y), (y, x))}
    return at


def test_saliency_and_labels_equal_all_pairs(spark, attribute="area"):
    rng = random.Random(9)
    images = made(3)
    marks = {k: [(x, y, rng.random() < 0.5) for x, y in image if rng.random() < 0.15] + [(0, 0, True)] for k, image in images.items()}
    marks[0] = [m for m in marks[0] if not m[2]]
    marks[1] = [(2, 3, True), (2, 3, False), (1, 1, True)]
    scribbles = spark.createDataFrame([(k, x, y, o) for k, ms in marks.items() for x, y, o in [*ms, *ms[:2]]], "image_id int, x int, y int, is_object boolean")
    found = {(r["image_id"], r["idx"]): r for r in watershed.watershed(table(spark, images, True), scribbles, attribute).collect()}
    assert len(found) == sum(map(len, images.values()))
    objects = 0
    for k, image in images.items():
        cols, last_x, last_y = max(x for x, _ in image) + 1, max(x for x, _ in image), max(y for _, y in image)
        at = joined_at(plain_tree(image, attribute))
        number = lambda p: p[1] * cols + p[0]  # noqa: B023, E731
        corner = {}
        for x, y in image:
            square = [(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)]
            sides = [(square[i], square[j]) for i, j in ((0, 1), (0, 2), (1, 3), (2, 3)) if square[i] in image and square[j] in image]
            if x <= max(last_x - 1, 0) and y <= max(last_y - 1, 0) and sides:
                corner[x, y] = max(at[number(p), number(q)][0] for p, q in sides)
        most = max(corner.values(), default=0)
        stamp = {(x + dx, y + dy, o) for x, y, o in marks[k] if x and y for dx in (-1, 0) for dy in (-1, 0)}
        for p in image:
            s = corner.get((min(p[0], max(last_x - 1, 0)), min(p[1], max(last_y - 1, 0))), 0)
            row = found[k, number(p)]
            assert abs(row["saliency"] - 255 * (1 - (math.sqrt(s / most) if most else 0))) < 1e-9, (k, p)
            reach = {o: min(((0,) if (x, y) == p else (1, *at[number(p), number((x, y))]) for x, y, kind in stamp if kind == o and (x, y) in image), default=(2,)) for o in (True, False)}
            assert row["label"] == (1 if reach[True] < reach[False] else 2), (k, p, reach)
            objects += row["label"] == 1
    assert objects


def test_prefixes_do_not_depend_on_blocks(spark):
    pixels = table(spark, made(5))
    regions = hierarchy.boruvka(watershed.graph(pixels))
    one, many = (sorted(map(tuple, hierarchy.heights(regions, "area", n).collect())) for n in (1, 13))
    assert one == many


@pytest.mark.parametrize("bits", [1, 4])
def test_tiles_change_nothing(spark, monkeypatch, bits):
    """Images over many tiles have the spanning trees and heights of those within one, and those need no round of joins."""
    graph = watershed.graph(table(spark, made(6)))
    rounds, roots = [], hierarchy._roots
    monkeypatch.setattr(hierarchy, "_roots", lambda best: rounds.append(1) or roots(best))
    whole = sorted(map(tuple, hierarchy.heights(hierarchy.boruvka(graph)).collect()))
    assert whole and not rounds
    monkeypatch.setattr(hierarchy, "TILE", bits)
    assert sorted(map(tuple, hierarchy.heights(hierarchy.boruvka(graph)).collect())) == whole
    assert rounds


def test_missing_values_parts_and_empty_tables(spark):
    edges = spark.createDataFrame([(1, 5, 6, 2.0), (1, 6, 5, 1.0), (1, 6, 6, 0.0), (1, 7, 8, None), (2, 5, 6, 3.0)], "image_id int, a long, b long, weight double")
    found = sorted(map(tuple, hierarchy.heights(hierarchy.boruvka(edges)).collect()))
    assert found == [(1, 5, 6, 1.0, 1.0), (1, 7, 8, math.inf, 1.0), (2, 5, 6, 3.0, 1.0)]
    none = table(spark, {})
    assert watershed.watershed(none, spark.createDataFrame([], "image_id int, x int, y int, is_object boolean")).count() == 0
    with pytest.raises(ValueError):
        watershed.watershed(none, none, "depth")


def test_stamps(spark):
    marks = spark.createDataFrame([(1, 0, 3, True), (1, 2, 2, True), (1, 2, 2, True)], "image_id int, x int, y int, is_object boolean")
    assert sorted((r["x"], r["y"]) for r in watershed.stamped(marks).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_reach_of_one_long_line(spark):
    """Weights that fall along a line of 300 pixels make one round of a single long chain."""
    line = spark.range(299).select(F.lit(1).alias("image_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (400.0 - F.col("id")).alias("weight"))
    regions = hierarchy.boruvka(line)
    assert len(regions.levels) == 1 and regions.edges().count() == 299
    pairs = spark.createDataFrame([(1, 3, 200), (1, 299, 0)], "image_id int, a long, b long")
    assert {(r["a"], r["b"]): r["edge"]["weight"] for r in hierarchy.bottlenecks(regions, pairs).collect()} == {(3, 200): 397.0, (299, 0): 400.0}
