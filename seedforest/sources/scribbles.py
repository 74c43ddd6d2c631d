"""Scribble files: the number of markers, then each marker's size and its x;y lines, then perhaps the number of object markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scribbles(spark: SparkSession, path: str, max_markers: int = 0, inverse: bool = False, default_objects: int | None = None) -> DataFrame:
    """Scribbles of each file: image_id (its path), marker_id, ord, x, y, is_object. max_markers below 1 means all; inverse swaps x and y.
    The first markers are objects, as many as the last line says, else default_objects, else all. Negative coordinates are an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.split(F.trim(F.regexp_replace("value", "\r", "")), r"\s*\n\s*").alias("lines"))
    return parse_scribbles(files, max_markers, inverse, default_objects)


def parse_scribbles(files: DataFrame, max_markers: int = 0, inverse: bool = False, default_objects: int | None = None) -> DataFrame:
    """files: image_id, lines. Where each marker starts follows from the sizes before it, folded over the lines."""
    size = F.filter(F.transform("lines", lambda v, i: F.struct(i.alias("at"), F.instr(v, ";").alias("point"), v.try_cast("int").alias("n"))), lambda s: (s["point"] == 0) & (s["at"] > 0))
    out = files.select("image_id", "lines", F.get("lines", F.lit(0)).try_cast("int").alias("markers"), size.alias("sizes"))
    out = out.withColumn("trailer", F.when(F.size("sizes") > F.col("markers"), F.get(F.col("sizes"), F.col("markers"))["n"]))
    take = F.least(F.col("markers"), F.lit(max_markers)) if max_markers >= 1 else F.col("markers")
    marks = out.select("image_id", "lines", "markers", "trailer", F.posexplode(F.slice("sizes", 1, take)).alias("marker_id", "s"))
    points = marks.select("image_id", "marker_id", "markers", "trailer", F.posexplode(F.slice("lines", F.col("s.at") + 2, F.col("s.n"))).alias("ord", "line"))
    number = lambda k: F.get(F.split("line", ";"), F.lit(k)).try_cast("int")
    x, y = (number(1), number(0)) if inverse else (number(0), number(1))
    checked = lambda v: F.when(v < 0, F.raise_error(F.lit("negative coordinates in a scribble file"))).otherwise(v)
    objects = F.coalesce("trailer", F.lit(default_objects)) if default_objects is not None else F.coalesce("trailer", "markers")
    return points.select("image_id", "marker_id", "ord", checked(x).cast("int").alias("x"), checked(y).cast("int").alias("y"), (F.col("marker_id") < objects).alias("is_object"))


def point_scribble(spark: SparkSession, x: int, y: int, image_id: str = "image") -> DataFrame:
    """One marker of one pixel."""
    if x < 0 or y < 0:
        raise ValueError("negative coordinates")
    return spark.createDataFrame([(image_id, 0, 0, x, y, True)], "image_id string, marker_id int, ord int, x int, y int, is_object boolean")


def scribble_text(scribbles: DataFrame, trailer: bool = True, head: str = "", grid: DataFrame | None = None) -> DataFrame:
    """image_id and the text of its scribble file. With grid (image_id, x, y), the seed file: <markers>;<head>, markers, grid points."""
    marks = scribbles.groupBy("image_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(";", "x", "y").alias("t")))).alias("p"), F.bool_or("is_object").alias("is_object"))
    block = F.concat_ws("\n", F.size("p").cast("string"), F.col("p.t"))
    files = marks.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("marker_id", block.alias("t")))).alias("b"), F.sum(F.col("is_object").cast("int")).alias("objects"))
    first = F.concat_ws(";", F.size("b").cast("string"), F.lit(head)) if head else F.size("b").cast("string")
    parts = [first, F.col("b.t")]
    if grid is not None:
        extra = grid.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.concat_ws(";", "x", "y").alias("t")))).alias("g"))
        files = files.join(extra, "image_id", "left")
        parts.append(F.col("g.t"))
    elif trailer:
        parts.append(F.col("objects").cast("string"))
    return files.select("image_id", F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("text"))


def write_scribbles(scribbles: DataFrame, folder: str, trailer: bool = True) -> None:
    """One text row per image under <folder>/image_id=<image>, as .txt files."""
    text = scribble_text(scribbles, trailer).select("image_id", F.regexp_replace("text", "\n$", "").alias("value"))
    text.write.partitionBy("image_id").text(folder)
