"""Distance transforms and clusterings of all groups at once, against plain versions."""

import random

import numpy as np

from seedforest.operators import cluster
from seedforest.operators.distance import distance_squared, envelope


def test_envelopes_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        y = np.sort(rng.choice(200, rng.integers(1, 40), replace=False))
        height = np.where(rng.random(len(y)) < 0.5, rng.integers(0, 300, len(y)) ** 2, -1)
        least = [min(((a - b) ** 2 + h for b, h in zip(y, height, strict=True) if h >= 0), default=-1) for a in y]
        assert envelope(y, height).tolist() == least


def test_distances_equal_all_pairs(spark):
    rng = random.Random(2)
    images = {1: (30, 17, 0.02), 2: (8, 40, 0.3), 3: (5, 5, 0.0), 4: (1, 9, 0.2)}
    pixels = [(k, x, y) for k, (cols, rows, _) in images.items() for x in range(cols) for y in range(rows) if rng.random() < 0.9]
    there = set(pixels)
    marked = [p for p in pixels if rng.random() < images[p[0]][2]]
    found = distance_squared(spark.createDataFrame(pixels + pixels[:20], "image_id int, x int, y int"), spark.createDataFrame(marked + marked[:3] + [(1, 500, 500)], "image_id int, x int, y int")).collect()
    assert len(found) == len(there)
    for r in found:
        assert r["d2"] == min(((x - r["x"]) ** 2 + (y - r["y"]) ** 2 for k, x, y in marked if k == r["image_id"]), default=None), r


def test_all_groups_at_once_equal_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    groups = {k: np.concatenate([rng.normal(c, 0.4, (n, 3)) for c in rng.normal(0, 4, (m, 3))]) for k, (n, m) in enumerate([(6, 2), (9, 3), (1, 1), (2, 1), (3, 1), (15, 2), (1, 4)])}
    groups[20] = np.repeat([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]], 4, axis=0)  # ties
    points = spark.createDataFrame([(k, i, v.tolist()) for k, g in groups.items() for i, v in enumerate(g)], "grp int, ord int, v array<double>")
    for all_at_once, one in ((cluster.elbow_clusters, cluster.kmeans_elbow), (cluster.silhouette_clusters, cluster.kmeans_silhouette)):
        found = {(r["grp"], r["ord"]): r["cluster"] for r in all_at_once(points).collect()}
        assert len(found) == sum(map(len, groups.values()))
        for k, g in groups.items():
            assert [found[k, i] for i in range(len(g))] == one(g.astype(float)).tolist(), (one, k)
        assert all_at_once(points.where("false")).count() == 0
