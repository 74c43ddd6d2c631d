"""Segmentation of images as their files arrive: each micro-batch decodes its new images and segments those that have scribbles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.segment import segment
from ..sources.images import RASTER, pixels, raster_frame


def arriving_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of RASTER rows, one for each new file; with nulls besides image_id where it can't be decoded."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)

    def run(frames):
        for frame in frames:
            yield raster_frame(frame)

    return files.select("path", "content").mapInPandas(run, RASTER)


def segment_stream(spark: SparkSession, folder: str, scribbles: DataFrame, out: str, checkpoint: str, **parameters):
    """Starts a query that appends label tables to `out`. scribbles: a table whose image_id is the file's name. Files of a batch are written by batch number, so a batch that runs again overwrites its own.
    The names of files that can't be decoded go to `<out>_undecodable` in the same way."""

    def batch(raster: DataFrame, number: int) -> None:
        named = raster.withColumn("image_id", F.regexp_extract("image_id", "([^/]+)$", 1))
        named.where("val is null").select("image_id").write.mode("overwrite").parquet(f"{out}_undecodable/batch={number}")
        segment(pixels(named.where("val is not null")), scribbles, **parameters).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving_images(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
