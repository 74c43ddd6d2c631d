"""Files that can't be decoded leave a trace."""

import numpy as np

from seedforest.sources import images
from seedforest.streaming.arrivals import segment_stream

from .test_raster import markers, noisy_square


def test_undecodable_files_are_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0 not built")
    (folder / "a.pgm").write_bytes(images.netpbm(np.full((6, 5), 9)))
    rows = {r["image_id"].split("/")[-1]: r for r in images.read_images(spark, str(folder), keep_invalid=True).collect()}
    assert sorted(rows) == ["a.pgm", "photo.jpg"] and list(rows["a.pgm"])[1:] == [6, 5, 1, 255, [9] * 30]
    assert list(rows["photo.jpg"])[1:] == [None] * 5
    (folder / "a.pgm").write_bytes(images.netpbm(noisy_square()[:, :, 0]))
    marks = spark.createDataFrame([("a.pgm", m, k, x, y) for m, points in enumerate(markers()) for k, (x, y) in enumerate(points)], "image_id string, marker_id int, ord int, x int, y int")
    segment_stream(spark, str(folder), marks, str(tmp_path / "out"), str(tmp_path / "cp"), samples=12, iterations=2).awaitTermination()
    assert [r["image_id"] for r in spark.read.parquet(str(tmp_path / "out_undecodable")).collect()] == ["photo.jpg"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
