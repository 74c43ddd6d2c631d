"""Kinds of PNG, and the formats of Spark's image source."""

import struct
import zlib

import numpy as np
import pytest

from seedforest.sources import images


def png_file(width: int, height: int, depth: int, kind: int, interlaced: int, data: bytes, **more: bytes) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(k.encode(), v) for k, v in more.items()) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def packed(values: np.ndarray, depth: int) -> bytes:
    """Lines with filter 0."""
    bits = (values[:, :, None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(len(values), -1)
    return b"".join(b"\0" + line.tobytes() for line in np.packbits(bits, axis=1))


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_low_depths_and_palettes(depth):
    rng = np.random.default_rng(depth)
    values = rng.integers(0, 1 << depth, (5, 11))
    gray = images.parse_image(png_file(11, 5, depth, 0, 0, packed(values, depth)))
    assert gray[:, :, 0].tolist() == (values * 255 // ((1 << depth) - 1)).tolist()
    colours = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    assert images.parse_image(png_file(11, 5, depth, 3, 0, packed(values, depth), PLTE=colours.tobytes())).tolist() == colours[values].tolist()
    clear = images.parse_image(png_file(11, 5, depth, 3, 0, packed(values, depth), PLTE=colours.tobytes(), tRNS=b"\7"))
    assert clear.shape == (5, 11, 4) and clear[:, :, 3].tolist() == np.where(values == 0, 7, 255).tolist()
    assert images.parse_image(png_file(11, 5, depth, 3, 0, packed(values, depth))) is None


@pytest.mark.parametrize(("width", "height"), [(1, 1), (3, 2), (8, 8), (13, 9)])
def test_interlaced(width, height):
    values = np.random.default_rng(width).integers(0, 256, (height, width))
    order = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    data = b"".join(packed(values[y::dy, x::dx], 8) for x, y, dx, dy in order if values[y::dy, x::dx].size)
    assert images.parse_image(png_file(width, height, 8, 0, 1, data))[:, :, 0].tolist() == values.tolist()


@pytest.mark.parametrize("how", [0, 1, 2, 3, 4])
def test_filters(how):
    rng = np.random.default_rng(how)
    values = rng.integers(0, 256, (4, 6, 3))
    lines = values.reshape(4, -1).tolist()
    data = b""
    for y, line in enumerate(lines):
        above, out = lines[y - 1] if y else [0] * 18, []
        for x, v in enumerate(line):
            a, b, c = (line[x - 3] if x >= 3 else 0), above[x], (above[x - 3] if x >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        data += bytes([how, *out])
    assert images.parse_image(png_file(6, 4, 8, 2, 0, data)).tolist() == values.tolist()


def test_photos(spark, tmp_path):
    colour = np.zeros((6, 9, 3), int)
    colour[:, :4], colour[:, 4:] = (250, 10, 30), (20, 40, 200)
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(9, 6, 1)
    for y in range(6):
        for x in range(9):
            r, g, b = colour[y, x].tolist()
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    for form in ("bmp", "gif", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(picture, form, jvm.java.io.File(f"{tmp_path}/a.{form}"))
    (tmp_path / "broken.JPG").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "b.pgm").write_bytes(images.netpbm(np.full((2, 3), 7)))
    rows = {r["image_id"].split("/")[-1]: r for r in images.read_images(spark, str(tmp_path), keep_invalid=True).collect()}
    assert sorted(rows) == ["a.bmp", "a.gif", "a.jpg", "b.pgm", "broken.JPG"] and rows["broken.JPG"]["val"] is None
    for form, tolerance in (("bmp", 0), ("gif", 0), ("jpg", 120)):
        r = rows[f"a.{form}"]
        assert (r["n_rows"], r["n_cols"], r["n_channels"]) == (6, 9, 3) and np.abs(np.array(r["val"]).reshape(6, 9, 3) - colour)[:, [0, 1, 7, 8]].max() <= tolerance
    assert sorted(r["image_id"].split("/")[-1] for r in images.read_images(spark, str(tmp_path), "*.{bmp,pgm}").collect()) == ["a.bmp", "b.pgm"]
    with pytest.raises(Exception, match="can't be decoded"):
        images.read_images(spark, str(tmp_path), drop_invalid=False).collect()
