"""Raster operators on hand-made images, sources and sinks, kernels and the segmentation methods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedforest.functions import color, cost
from seedforest.operators import cluster, scribble, seeds, stencil, trees, watershed
from seedforest.plans import grow, segment
from seedforest.schema import EIGHT, FOUR
from seedforest.sources import images, scribbles

TWO_HALVES = np.array([[10] * 4 + [200] * 4] * 8)


def pixel_table(spark, values, image_id="i"):
    return images.pixels(images.image_from_array(spark, values, image_id))


def noisy_square(size=20, seed=1):
    rng = np.random.default_rng(seed)
    v = np.full((size, size, 3), 40)
    v[size // 4 : 3 * size // 4, size // 4 : 3 * size // 4] = 200
    return np.clip(v + rng.integers(0, 12, v.shape), 0, 255)


def test_images_survive_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name, values in {"a.pgm": rng.integers(0, 256, (3, 5)), "b.ppm": rng.integers(0, 65536, (4, 2, 3)), "c.png": rng.integers(0, 256, (6, 7, 3))}.items():
        raw = images.png(values) if name.endswith("png") else images.netpbm(values, images.norm_of(int(values.max())))
        (tmp_path / name).write_bytes(raw)
        assert (images.parse_image(raw).reshape(values.shape) == values).all()
    (tmp_path / "bad.pgm").write_bytes(b"P5\n9 9\n255\nxx")
    rows = {r["image_id"][-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.pgm", "b.ppm", "c.png"] and (rows["b.ppm"]["norm"], rows["b.ppm"]["n_channels"], rows["a.pgm"]["n_rows"]) == (65535, 3, 3)
    with pytest.raises(Exception, match="decoded"):
        images.read_images(spark, str(tmp_path), drop_invalid=False).collect()


def test_image_from_array(spark):
    with pytest.raises(ValueError):
        images.image_from_array(spark, np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        images.image_from_array(spark, np.array([[70000]]))
    assert images.blank_image(spark, 2, 3).where("val = array(0)").count() == 6
    got = pixel_table(spark, TWO_HALVES)
    assert (images.to_array(got.withColumn("v", F.col("val")[0]), "v") == TWO_HALVES).all()


def test_written_images(spark, tmp_path):
    labels = pixel_table(spark, TWO_HALVES).select("image_id", "x", "y", F.col("val")[0].alias("v"))
    row = images.write_images(labels, str(tmp_path)).collect()[0]
    assert (images.parse_image(open(row["path"], "rb").read())[:, :, 0] == TWO_HALVES).all()
    colour = labels.select("image_id", "x", "y", F.col("v").alias("r"), F.lit(0).alias("g"), F.lit(9).alias("b"))
    assert images.parse_image(bytes(images.encoded(colour, "png").first()["content"]))[0, 7].tolist() == [200, 0, 9]
    assert images.output_name("x", "labels.pgm", n0=50, f=2) == "x_f2_n050_labels.pgm"


def test_scribble_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("3\n2\n1;2\n3;4\n1\n5;6\n3\n7;8\n9;10\n11;12\n2\n")
    got = scribbles.read_scribbles(spark, str(tmp_path / "s.txt"))
    rows = sorted(tuple(r)[1:] for r in got.collect())
    assert rows == [(0, 0, 1, 2, True), (0, 1, 3, 4, True), (1, 0, 5, 6, True), (2, 0, 7, 8, False), (2, 1, 9, 10, False), (2, 2, 11, 12, False)]
    assert scribbles.scribble_text(got).first()["text"] == (tmp_path / "s.txt").read_text()
    grid = spark.createDataFrame([("x", 1, 1)], "image_id string, x int, y int").withColumn("image_id", F.lit(got.first()["image_id"]))
    assert scribbles.scribble_text(got, head="50", grid=grid).first()["text"].splitlines()[0] == "3;50" and scribbles.scribble_text(got, head="50", grid=grid).first()["text"].endswith("\n1;1\n")
    swapped = sorted(tuple(r)[1:5] for r in scribbles.read_scribbles(spark, str(tmp_path / "s.txt"), max_markers=1, inverse=True).collect())
    assert swapped == [(0, 0, 2, 1), (0, 1, 4, 3)]
    (tmp_path / "n.txt").write_text("1\n1\n-1;2\n")
    with pytest.raises(Exception, match="negative"):
        scribbles.read_scribbles(spark, str(tmp_path / "n.txt")).collect()
    assert tuple(scribbles.point_scribble(spark, 3, 4).first())[3:5] == (3, 4)


def test_lab_of_known_colours(spark):
    rows = spark.createDataFrame([(255, 255, 255, 255), (0, 0, 0, 255), (255, 0, 0, 255)], "r int, g int, b int, norm int")
    white, black, red = [tuple(r)[4:] for r in color.with_lab(rows).collect()]
    assert white[0] == pytest.approx(100, abs=0.01) and black[0] == pytest.approx(0, abs=1e-3) and red == pytest.approx((53.24, 80.09, 67.20), abs=0.05)
    kernel = grow.lab_of(np.array([[255, 0, 0]]), 255)[0]
    assert kernel.tolist() == pytest.approx(list(red), abs=1e-3)


def test_gradient_forms_agree(spark):
    values = noisy_square()
    pix = pixel_table(spark, values).select("image_id", "x", "y", "idx", "norm", *[F.col("val")[k].alias(c) for k, c in enumerate("rgb")])
    graded = stencil.gradient(color.with_lab(pix)).orderBy("idx").toPandas()
    lab = grow.lab_of(values.reshape(-1, 3), 255)
    assert np.allclose(graded["grad"], grow.gradient_of(lab, 20, 20), atol=1e-3)
    flat = stencil.gradient(color.with_lab(pixel_table(spark, np.full((1, 1), 7)).withColumns({c: F.col("val")[0] for c in "rgb"})))
    assert flat.first()["grad"] == 0
    assert sum(stencil.weights()) == pytest.approx(1) and stencil.weights()[0] == pytest.approx(0.146447, abs=1e-6)


def test_path_costs_agree(spark):
    row = dict(c=0.5, d=3.0, g=4.0, n=7.0, cv=1.4, al=0.9)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    for f in range(1, 8):
        got = df.select(F.expr(cost.path_cost_sql(f, "c", "d", "g", "n", "cv", "al"))).first()[0]
        assert got == pytest.approx(cost.cost_kernel(f, 0.9, 0.8)(0.5, 3.0, 4.0 ** (1 / 0.9), 7.0, 1.4)), f


def test_grid_forms_agree(spark):
    values, rows, cols = noisy_square(30), 30, 30
    lab = grow.lab_of(values.reshape(-1, 3), 255)
    grad = np.round(grow.gradient_of(lab, rows, cols), 6)
    marks = spark.createDataFrame([("i", 0, k, 14 + k, 15) for k in range(3)], "image_id string, marker_id int, ord int, x int, y int")
    taken = np.zeros(rows * cols, bool)
    taken[[15 * cols + 14 + k for k in range(3)]] = True
    graded = spark.createDataFrame([("i", p % cols, p // cols, p, float(g)) for p, g in enumerate(grad)], "image_id string, x int, y int, idx long, grad double")
    frame = spark.createDataFrame([("i", rows, cols)], "image_id string, n_rows int, n_cols int")
    moved = seeds.to_smallest_gradient(seeds.suppressed(seeds.lattice(frame, 20), marks), graded)
    assert sorted(r["idx"] for r in moved.collect()) == sorted(segment.grid_seeds(rows, cols, 20, grad, taken))
    with pytest.raises(ValueError):
        seeds.grid_geometry(100, 90)


def test_growth_invariants():
    values = noisy_square(24, 3)
    lab = grow.lab_of(values.reshape(-1, 3), 255)
    grad = grow.gradient_of(lab, 24, 24)
    for offsets, plain in ((FOUR, False), (EIGHT, True)):
        near = grow.neighbour_table(24, 24, offsets)
        for f in range(1, 7):
            forest = grow.grow(lab, grad, near, [[0], [300], [575]], f, 0.9, 0.8, plain=plain)
            assert forest.size.sum() == 576 and (forest.tree[[0, 300, 575]] == [0, 1, 2]).all() and np.isfinite(forest.cost).all()
            for t in range(3):
                if offsets is FOUR:
                    assert len(segment.components_of(np.flatnonzero(forest.tree == t).tolist(), [0] * int(forest.size[t]), 24)) == 1


def markers():
    return [[(9, 9), (10, 9), (10, 10), (9, 10)], [(1, 1), (2, 1), (18, 18), (1, 2)]]


@pytest.mark.parametrize(("method", "iterations"), [("class", 1), ("class", 5), ("class_clustered", 4), ("relevance", 2), ("superpixel", 2)])
@pytest.mark.parametrize("function", [1, 2, 5])
def test_methods_find_the_square(method, iterations, function):
    out = segment.segment_image(noisy_square().reshape(-1, 3), 20, 20, markers(), 12, iterations, 1, function, method=method)
    image = out["label"].reshape(20, 20)
    assert set(np.unique(image)) == {1, 2} and (image[5:15, 5:15] == 1).mean() > 0.95 and (image == 1).sum() < 130
    assert (out["border"] == grow.border_of(out["label"], 20, 20, EIGHT if method == "superpixel" else FOUR)).all()
    if method != "superpixel":
        assert all(image[y, x] == 1 for x, y in markers()[0]) and all(image[y, x] == 2 for x, y in markers()[1])


def test_segment_table(spark):
    pix = pixel_table(spark, noisy_square(), "a").unionByName(pixel_table(spark, noisy_square(seed=5), "b"))
    marks = spark.createDataFrame([(i, m, k, x, y) for i in "ab" for m, points in enumerate(markers()) for k, (x, y) in enumerate(points)], "image_id string, marker_id int, ord int, x int, y int")
    out = segment.segment(pix, marks, 12, 3, method="class").toPandas()
    for i, seed in (("a", 1), ("b", 5)):
        alone = segment.segment_image(noisy_square(seed=seed).reshape(-1, 3), 20, 20, markers(), 12, 3)
        assert (out[out["image_id"] == i].sort_values("idx")["label"].to_numpy() == alone["label"]).all()


@pytest.mark.parametrize("change", [{"samples": -1}, {"iterations": 0}, {"function": 7}, {"c1": 0}, {"c2": 1.1}, {"all_borders": 2}, {"obj_markers": 0}, {"obj_markers": 3}, {"method": "other"}, {"method": "relevance", "iterations": 99}])
def test_parameters_are_checked(change):
    good = dict(samples=10, iterations=2, function=1, c1=0.7, c2=0.8, method="class", obj_markers=1, all_borders=0, markers=2)
    segment.check(**good)
    with pytest.raises(ValueError):
        segment.check(**good | change)


def test_thresholds_of_the_formula_and_the_deviation():
    forest = grow.Forest(np.array([0, 1]), np.zeros(2), np.array([1, 1]), np.array([[0.0, 0, 0], [3.0, 4, 0]]), np.zeros(2), [{1}, {0}])
    assert segment.remove_by_class(forest, [1, 2], 2, 2, 1) == ([0, 1], 2) and segment.remove_by_class(forest, [1, 3], 2, 2, 1) == ([0], 1)
    assert segment.remove_by_class(forest, [1, 3], 2, 2, 1, compat=False) == ([0, 1], 0)


def test_tree_operators_on_halves(spark):
    pix = color.with_lab(pixel_table(spark, TWO_HALVES).withColumns({c: F.col("val")[0] for c in "rgb"})).withColumn("tree_id", (F.col("x") >= 4).cast("int")).withColumn("grad", F.lit(1.0))
    assert [tuple(r) for r in trees.tree_adjacency(pix).collect()] == [("i", 0, 1)]
    border = stencil.borders(pix, "tree_id").where("border = 255").select("x").distinct().collect()
    assert sorted(r["x"] for r in border) == [3, 4]
    stats = trees.tree_stats(pix).withColumn("is_object", F.col("tree_id") == 1)
    assert {r["tree_id"]: r["class"] for r in trees.tree_classes(stats, trees.tree_adjacency(pix)).collect()} == {0: 2, 1: 4}


def test_lines_and_brushes(spark):
    ends = spark.createDataFrame([(0, 0, 5, 2), (3, 3, 3, 3), (4, 0, 0, 4)], "x0 int, y0 int, x1 int, y1 int")
    got = {}
    for r in scribble.lines(ends).orderBy("k").collect():
        got.setdefault((r["x0"], r["y0"]), []).append((r["x"], r["y"]))
    assert got[3, 3] == [(3, 3)] and got[4, 0] == [(4, 0), (3, 1), (2, 2), (1, 3), (0, 4)] and got[0, 0] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert len(scribble.disc(2)) == 13 and len(scribble.rectangle_outline(0, 0, 3, 2)) == 10 and (5, 5) in scribble.ellipse(0, 0, 10, 10) and scribble.box_scribble(0, 0, 4, 4)[1] == (2, 2)
    marks = spark.createDataFrame([("i", 0, 0, 0, 0), ("i", 0, 1, 3, 0), ("i", 0, 2, 1, 0)], "image_id string, marker_id int, ord int, x int, y int")
    assert [r["x"] for r in scribble.connected(marks).orderBy("ord").collect()] == [0, 1, 2, 3]
    both = scribble.object_first(marks, marks.withColumn("y", F.lit(5))).select("marker_id", "is_object").distinct().collect()
    assert sorted(map(tuple, both)) == [(0, True), (1, False)]


def test_components_of_a_snake(spark):
    shape = ["#######", "......#", "#######", "#......", "#####.#"]
    points = spark.createDataFrame([("g", x, y) for y, line in enumerate(shape) for x, c in enumerate(line) if c == "#"], "grp string, x int, y int")
    found = scribble.connected_components(points).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [1, 21]


def test_clusterers():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    for name, f in cluster.METHODS.items():
        groups = f(data)
        assert len(set(groups[:20]) & set(groups[20:])) == 0, name
    assert cluster.spectral_clusters(data[:3]).tolist() == [0, 0, 0]
    a = np.array([[0.0], [0.2], [4.0]])
    assert cluster.mean_silhouette(a, np.array([0, 0, 1])) == pytest.approx(((4 - 0.2) / 4 + (3.8 - 0.2) / 3.8) / 3)
    for mode in (0, 1, 2):
        assert cluster.spectral_vectors(data, mode).shape == (40, 10)


def test_watershed_finds_the_square(spark):
    values = noisy_square()[:, :, 0]
    pix = pixel_table(spark, values).select("image_id", "x", "y", F.col("val")[0].alias("v"))
    marks = spark.createDataFrame([("i", x, y, m == 0) for m, points in enumerate(markers()) for x, y in points], "image_id string, x int, y int, is_object boolean")
    for attribute in watershed.ATTRIBUTES:
        image = images.to_array(watershed.watershed(pix, marks, attribute).withColumns({"x": F.col("idx") % 20, "y": F.floor(F.col("idx") / 20)}))
        assert (image[6:14, 6:14] == 1).all() and image[0, 0] == 2, attribute


def test_streamed_segmentation(spark, tmp_path):
    from seedforest.streaming.arrivals import segment_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.ppm").write_bytes(images.netpbm(noisy_square()))
    marks = spark.createDataFrame([("q.ppm", m, k, x, y) for m, points in enumerate(markers()) for k, (x, y) in enumerate(points)], "image_id string, marker_id int, ord int, x int, y int")
    segment_stream(spark, str(tmp_path / "in"), marks, str(tmp_path / "out"), str(tmp_path / "cp"), samples=12, iterations=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(entry.queries()["image_cv"](spark, "/root/testdata/sf0.001").first()["cv"])
