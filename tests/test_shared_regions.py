"""Labels and saliency of a watershed come from one forest of heights."""

from seedforest.operators import watershed


def test_regions_are_made_once(spark, monkeypatch):
    calls, made = [], watershed.boruvka
    monkeypatch.setattr(watershed, "boruvka", lambda edges: calls.append(1) or made(edges))
    image = spark.createDataFrame([(0, x, y, float(3 * (x > 1) + y)) for x in range(4) for y in range(2)], "image_id int, x int, y int, v double")
    marks = spark.createDataFrame([(0, 1, 1, True), (0, 3, 1, False)], "image_id int, x int, y int, is_object boolean")
    rows = {r["idx"]: (r["label"], r["saliency"]) for r in watershed.watershed(image, marks).collect()}
    assert len(rows) == 8 and len(calls) == 2
    assert [rows[i][0] for i in range(8)] == [1, 1, 2, 2] * 2
    assert rows[1][1] == 0 and rows[0][1] > 0
