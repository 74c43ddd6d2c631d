"""Images in and out: Netpbm and PNG files, JPEG, BMP and GIF files to read, arrays, blank images. One row per image file; pixels explode from there."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "image_id string, n_rows int, n_cols int, n_channels int, norm int, val array<int>"


def parse_netpbm(raw: bytes) -> np.ndarray | None:
    """P5 or P6 with 8- or 16-bit samples, high byte first: [rows, cols, channels]."""
    head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", raw)
    if not head:
        return None
    channels, cols, rows, most = 1 if head[1] == b"5" else 3, *map(int, head.groups()[1:])
    kind = np.dtype(">u2") if most > 255 else np.dtype("u1")
    if len(raw) - head.end() < rows * cols * channels * kind.itemsize:
        return None
    return np.frombuffer(raw, kind, rows * cols * channels, head.end()).astype(np.int32).reshape(rows, cols, channels)


#: Fixed values of the PNG format: first column and line of each interlaced pass, and its steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(flat: np.ndarray, step: int) -> np.ndarray:
    """The bytes of the lines, from lines that each begin with the number of their filter."""
    out = np.zeros((flat.shape[0], flat.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, (how, line) in enumerate(zip(flat[:, 0].tolist(), flat[:, 1:], strict=True)):
        if how == 1:
            line = np.cumsum(line.reshape(-1, step), 0, np.uint8).reshape(-1)
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            own, top = [0] * step + line.tolist(), [0] * step + above.tolist()
            for x in range(step, len(own)):
                left, over, corner = own[x - step], top[x], top[x - step]
                if how == 3:
                    guess = (left + over) // 2
                else:
                    whole = left + over - corner
                    guess = min((left, over, corner), key=lambda c: abs(whole - c))
                own[x] = (own[x] + guess) & 255
            line = np.array(own[step:], np.uint8)
        elif how:
            raise ValueError("no such filter")
        out[y] = above = line
    return out


def _samples(data: np.ndarray, rows: int, cols: int, channels: int, depth: int) -> np.ndarray:
    width = (cols * channels * depth + 7) // 8
    lines = _unfiltered(data[: rows * (width + 1)].reshape(rows, width + 1), max(1, channels * depth // 8))
    if depth == 16:
        lines = lines.reshape(-1).view(">u2")
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
        lines = (bits @ (1 << np.arange(depth)[::-1]))[:, : cols * channels]
    return lines.astype(np.int32).reshape(rows, cols, channels)


def parse_png(raw: bytes) -> np.ndarray | None:
    """All kinds of PNG: gray (under 8 bits stretched to 0..255), palette (as RGB, or RGBA if it has transparent colours), RGB, and alpha, also interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, chunks = 8, [], {}
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"IDAT":
            data.append(body)
        else:
            chunks[name] = body
        at += 12 + size
    if b"IHDR" not in chunks:
        return None
    cols, rows, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", chunks[b"IHDR"])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or depth not in (1, 2, 4, 8, 16) or (depth < 8 and kind not in (0, 3)) or (kind == 3 and (depth == 16 or b"PLTE" not in chunks)):
        return None
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if interlaced:
        out, used = np.zeros((rows, cols, channels), np.int32), 0
        for x, y, dx, dy in PASSES:
            n_rows, n_cols = -((y - rows) // dy), -((x - cols) // dx)
            if n_rows > 0 and n_cols > 0:
                out[y::dy, x::dx] = _samples(flat[used:], n_rows, n_cols, channels, depth)
                used += n_rows * ((n_cols * channels * depth + 7) // 8 + 1)
    else:
        out = _samples(flat, rows, cols, channels, depth)
    if kind == 3:
        colours = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
        if b"tRNS" in chunks:
            alpha = np.full(len(colours), 255, np.uint8)
            clear = np.frombuffer(chunks[b"tRNS"], np.uint8)[: len(colours)]
            alpha[: len(clear)] = clear
            colours = np.column_stack([colours, alpha])
        if out.max(initial=0) >= len(colours):
            return None
        return colours[out[:, :, 0]].astype(np.int32)
    return out * (255 // ((1 << depth) - 1)) if depth < 8 else out


def parse_image(raw: bytes) -> np.ndarray | None:
    try:
        found = parse_netpbm(raw)
        return parse_png(raw) if found is None else found
    except (ValueError, zlib.error, struct.error):
        return None


def norm_of(most: int) -> int:
    if most > 65535:
        raise ValueError("pixel values above 65535")
    return 255 if most <= 255 else 65535


def netpbm(values: np.ndarray, norm: int = 255) -> bytes:
    """[rows, cols] to P5, [rows, cols, 3] to P6; two bytes a sample, high byte first, where norm needs them."""
    if values.min(initial=0) < 0 or values.max(initial=0) > 65535:
        raise ValueError("pixel values must be within 0..65535")
    wide = max(norm, int(values.max(initial=0))) > 255
    head = f"P{6 if values.ndim == 3 else 5}\n{values.shape[1]} {values.shape[0]}\n{65535 if wide else 255}\n".encode()
    return head + values.astype(">u2" if wide else "u1").tobytes()


def png(values: np.ndarray) -> bytes:
    """[rows, cols] or [rows, cols, 3], 8 bits."""
    rows, cols = values.shape[:2]
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), values.astype(np.uint8).reshape(rows, -1)], 1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2 if values.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def raster_frame(files: pd.DataFrame) -> pd.DataFrame:
    """path and content to rows of RASTER, with nulls besides image_id where the content can't be decoded."""
    rows = []
    for name, raw in zip(files["path"], files["content"], strict=True):
        values = parse_image(raw)
        rows.append((name, *[None] * 5) if values is None else (name, *values.shape, norm_of(int(values.max(initial=0))), values.reshape(-1)))
    out = pd.DataFrame(rows, columns=["image_id", "n_rows", "n_cols", "n_channels", "norm", "val"])
    return out.astype({c: "Int32" for c in ("n_rows", "n_cols", "n_channels", "norm")})


#: Formats that Spark's own image source decodes.
PHOTOS = ("jpg", "jpeg", "bmp", "gif")


def read_photos(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """JPEG, BMP and GIF files below a path by Spark's image source: rows of RASTER, with nulls besides image_id where one can't be decoded."""
    glob = pattern or "*.{" + ",".join([*PHOTOS, *map(str.upper, PHOTOS)]) + "}"
    found = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    photo = F.lower(F.regexp_extract("image.origin", r"([^.]*)$", 1)).isin(*PHOTOS)
    narrow = found.where(photo).select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("n_rows"), F.col("image.width").alias("n_cols"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, n_rows, n_cols, channels, data in frame.itertuples(index=False):
                if n_rows <= 0:
                    rows.append((name, *[None] * 5))
                    continue
                values = np.frombuffer(data, np.uint8).reshape(n_rows, n_cols, channels).astype(np.int32)
                values[:, :, :3] = values[:, :, 2::-1] if channels > 1 else values  # stored blue first
                rows.append((name, n_rows, n_cols, channels, 255, values.reshape(-1)))
            out = pd.DataFrame(rows, columns=["image_id", "n_rows", "n_cols", "n_channels", "norm", "val"])
            yield out.astype({c: "Int32" for c in ("n_rows", "n_cols", "n_channels", "norm")})

    return narrow.mapInPandas(run, RASTER)


def read_images(spark: SparkSession, path: str, pattern: str = "*", drop_invalid: bool = True, keep_invalid: bool = False) -> DataFrame:
    """Image files below a path as rows of RASTER. Undecodable files are dropped, an error, or (keep_invalid) rows with nulls besides image_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    photo = F.lower(F.regexp_extract("path", r"([^.]*)$", 1)).isin(*PHOTOS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield raster_frame(frame)

    made = files.where(~photo).mapInPandas(run, RASTER).unionByName(read_photos(spark, path, None if pattern == "*" else pattern))
    if keep_invalid:
        return made
    if drop_invalid:
        return made.where("val IS NOT NULL")
    return made.withColumn("val", F.when(F.col("val").isNull(), F.raise_error(F.concat("image_id", F.lit(" can't be decoded"))).cast("array<int>")).otherwise(F.col("val")))


def image_from_array(spark: SparkSession, values: np.ndarray, image_id: str = "image") -> DataFrame:
    """A 2-D array, or one of rows by columns by 3, as a row of RASTER."""
    values = np.asarray(values)
    if values.ndim == 2:
        values = values[:, :, None]
    elif values.ndim != 3 or values.shape[2] != 3:
        raise ValueError("an image has two dimensions, or three of which the last is 3")
    if values.min(initial=0) < 0:
        raise ValueError("pixel values can't be negative")
    row = (image_id, *map(int, values.shape), norm_of(int(values.max(initial=0))), [int(v) for v in values.reshape(-1)])
    return spark.createDataFrame([row], RASTER)


def blank_image(spark: SparkSession, n_rows: int, n_cols: int, n_channels: int = 1, image_id: str = "image") -> DataFrame:
    """A pixel table of zeros."""
    return spark.range(n_rows * n_cols).select(F.lit(image_id).alias("image_id"), (F.col("id") % n_cols).cast("int").alias("x"), F.floor(F.col("id") / n_cols).cast("int").alias("y"), F.col("id").alias("idx"), F.array_repeat(F.lit(0), n_channels).alias("val"))


def pixels(raster: DataFrame) -> DataFrame:
    """Rows of RASTER as pixels; image columns other than val stay."""
    flat = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rows").cast("long") * F.col("n_cols") - 1), lambda i: F.slice("val", (i * F.col("n_channels")).cast("int") + 1, F.col("n_channels")))
    out = raster.select("image_id", "n_rows", "n_cols", "n_channels", "norm", F.posexplode(flat).alias("idx", "val"))
    return out.select("image_id", "n_rows", "n_cols", "norm", (F.col("idx") % F.col("n_cols")).cast("int").alias("x"), F.floor(F.col("idx") / F.col("n_cols")).cast("int").alias("y"), F.col("idx").cast("long").alias("idx"), "val")


def encoded(values: DataFrame, form: str = "pgm") -> DataFrame:
    """image_id, x, y and v (gray) or r, g, b: one row per image with the file's bytes. Lines are gathered first, so a task holds one image."""
    if form not in ("pgm", "ppm", "png"):
        raise ValueError("form must be pgm, ppm or png")
    channels = ["r", "g", "b"] if "r" in values.columns else ["v"]
    lines = values.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *channels))).alias("line"))
    lines = lines.select("image_id", "y", *[F.col(f"line.{c}").alias(c) for c in channels])
    kind = values.schema["image_id"].dataType.simpleString()

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("y")
        planes = [np.stack(frame[c]) for c in channels]
        image = np.stack(planes, -1) if len(planes) == 3 else planes[0]
        if form == "pgm" and image.ndim == 3:
            image = image[:, :, 0]
        if form == "ppm" and image.ndim == 2:
            image = image[:, :, None].repeat(3, 2)
        raw = png(image) if form == "png" else netpbm(image, norm_of(int(image.max(initial=0))))
        return pd.DataFrame({"image_id": [key[0]], "content": [raw]})

    return lines.groupBy("image_id").applyInPandas(run, f"image_id {kind}, content binary")


def output_name(image_id: str, suffix: str, **parameters) -> str:
    """<image>_<suffix>, with the parameters between where there are any."""
    return "_".join([image_id, *(f"{k}{v}" for k, v in sorted(parameters.items())), suffix])


def write_images(values: DataFrame, folder: str, form: str = "pgm", suffix: str = "labels") -> DataFrame:
    """Writes <folder>/<image>_<suffix>.<form> from the tasks, by Hadoop-independent file names; returns image_id, path and size. The folder must be one that all executors share."""
    import os

    files = encoded(values, form)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for name, raw in zip(frame["image_id"], frame["content"], strict=True):
                path = os.path.join(folder, output_name(re.sub(r"[^\w.-]", "_", str(name)), f"{suffix}.{form}"))
                with open(f"{path}.part", "wb") as f:
                    f.write(raw)
                os.replace(f"{path}.part", path)  # a task that runs again writes the same file
                rows.append((str(name), path, len(raw)))
            yield pd.DataFrame(rows, columns=["image_id", "path", "size"])

    return files.mapInPandas(run, "image_id string, path string, size long")


def to_array(pixels_of_one: DataFrame, value: str = "label") -> np.ndarray:
    """One image's column as an int32 array of rows by columns, on the driver."""
    frame = pixels_of_one.select("x", "y", value).toPandas()
    out = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1), np.int32)
    out[frame["y"], frame["x"]] = frame[value]
    return out
