"""Colour conversions as SQL expressions over double columns: sRGB to CIE L*a*b*, hex strings, palettes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ, row by row, and the D65 white point.
XYZ = (
    (0.4123955889674142161, 0.3575834307637148171, 0.1804926473817015735),
    (0.2125862307855955516, 0.7151703037034108499, 0.07220049864333622685),
    (0.01929721549174694484, 0.1191838645808485318, 0.9504971251315797660),
)
WHITE = (0.950456, 1.0, 1.088754)
#: The ten colours of labels, red, green and blue.
COLORS = ((0, 0, 255), (255, 0, 0), (0, 255, 0), (255, 0, 255), (255, 255, 0), (0, 255, 255), (128, 255, 0), (128, 0, 255), (255, 0, 128), (255, 128, 0))
PALETTE = tuple("#{:02x}{:02x}{:02x}".format(*c) for c in COLORS)


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def gamma_sql(v: str) -> str:
    return f"(CASE WHEN {v} > {_number(0.04045)} THEN pow(({v} + {_number(0.055)}) / {_number(1.055)}, {_number(2.4)}) ELSE {v} / {_number(12.92)} END)"


def response_sql(v: str) -> str:
    """The cube root with its linear foot. The exponent is 0.333333333333333, not a third."""
    return f"(CASE WHEN {v} >= {_number(8.85645167903563082e-3)} THEN pow({v}, {_number(0.333333333333333)}) ELSE {v} * {_number(841.0 / 108.0)} + {_number(4.0 / 29.0)} END)"


def lab_sql(r: str, g: str, b: str, norm: str = "255") -> tuple[str, str, str]:
    """SQL for L, a and b of channel values 0..norm."""
    linear = [gamma_sql(f"(CAST({c} AS DOUBLE) / {norm})") for c in (r, g, b)]
    x, y, z = (response_sql("((" + " + ".join(f"{v} * {_number(m)}" for v, m in zip(linear, row, strict=True)) + f") / {_number(w)})") for row, w in zip(XYZ, WHITE, strict=True))
    return f"(116 * {y} - 16)", f"(500 * ({x} - {y}))", f"(200 * ({y} - {z}))"


def with_lab(pixels, r: str = "r", g: str = "g", b: str = "b", norm: str = "norm"):
    """pixels with columns l, a, b. Gray rasters name one column three times. The linear channels are columns of their own, so that each is computed once."""
    step = pixels.withColumns({f"_c{k}": F.expr(gamma_sql(f"(CAST({c} AS DOUBLE) / {norm})")) for k, c in enumerate((r, g, b))})
    step = step.withColumns({f"_x{k}": F.expr(response_sql("((" + " + ".join(f"_c{j} * {_number(m)}" for j, m in enumerate(row)) + f") / {_number(WHITE[k])})")) for k, row in enumerate(XYZ)})
    return step.select(*pixels.columns, (116 * F.col("_x1") - 16).alias("l"), (500 * (F.col("_x0") - F.col("_x1"))).alias("a"), (200 * (F.col("_x1") - F.col("_x2"))).alias("b_"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def palette_color(label: Column) -> Column:
    """One of ten colours, by label from 1."""
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(label - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def scattered_color(key: Column, norm: int = 255) -> tuple[Column, Column, Column]:
    """A colour for each key that looks random but is the same in every run."""
    return tuple(F.pmod(F.crc32(F.concat_ws(",", F.lit(c), key.cast("string")).cast("binary")), F.lit(norm)).cast("int") for c in "rgb")
