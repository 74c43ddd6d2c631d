"""Zoomed views against a plain Lanczos resampling."""

import math
import random

import pytest

from seedforest.operators import resize


def kernel(x):
    return 1.0 if x == 0 else 0.0 if abs(x) >= 3 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def plain(line, new):
    old, out = len(line), []
    ratio, wide = old / new, max(old / new, 1.0)
    for i in range(new):
        centre = (i + 0.5) * ratio
        taps = range(max(0, math.floor(centre - 3 * wide + 0.5)), min(old, math.floor(centre + 3 * wide + 0.5)))
        w = [kernel((t - centre + 0.5) / wide) for t in taps]
        out.append(min(255, max(0, math.floor(round(sum(a * line[t] for a, t in zip(w, taps, strict=True)) / sum(w), 6) + 0.5))))
    return out


@pytest.mark.parametrize("value", [1.7, 0.7])
def test_views_equal_a_plain_resampling(spark, value):
    rng = random.Random(1)
    images = {1: (50, 40), 2: (31, 64), 3: (20, 20), 4: (50, 40)}
    data = {k: [[rng.choice((0, 255, rng.randint(0, 255))) for _ in range(w)] for _ in range(h)] for k, (w, h) in images.items()}
    rows = [(k, x, y, v, 255 - v) for k, im in data.items() for y, line in enumerate(im) for x, v in enumerate(line)]
    found = resize.zoomed(spark.createDataFrame(rows, "image_id int, x int, y int, a int, b int"), value, channels=("a", "b")).collect()
    for k, im in data.items():
        w, h = images[k]
        s = value if 900 <= value * w * value * h <= 10_000_000 else 1.0
        lines = [plain(line, int(w * s)) for line in im]
        columns = [plain(c, int(h * s)) for c in zip(*lines, strict=True)]
        own = {(r["x"], r["y"]): r["a"] for r in found if r["image_id"] == k}
        assert own == {(x, y): v for x, c in enumerate(columns) for y, v in enumerate(c)}, k
    assert resize.zoomed(spark.createDataFrame([], "image_id int, x int, y int, r int, g int, b int"), 2.0).count() == 0
    with pytest.raises(ValueError):
        resize.zoomed(spark.createDataFrame(rows[:1], "image_id int, x int, y int, a int, b int"), 0)
