"""Views of a segmentation: masks, tints, overlays. Column expressions over one pixel row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_masks(labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds bg, fg and grey level (0 to 255) of each label, scaled by the image's largest; truncated as bytes are."""
    labels = labels.join(labels.groupBy("image_id").agg(F.max(label).alias("_most")), "image_id")
    most = F.col("_most")
    bg = F.when(most > 1, F.floor((F.col(label) - 1) * 255 / (most - 1))).otherwise(F.lit(0)).cast("int")
    return labels.withColumns({"bg_mask": bg, "fg_mask": 255 - bg, "level": F.floor(F.col(label) * 255 / most).cast("int")}).drop("_most")


def tint(value: dict[str, Column], keep: str, mask: Column, factor: float = 0.2) -> dict[str, Column]:
    """Channels other than `keep` are dimmed, then all are masked."""
    return {c: (v if c == keep else F.floor(v * factor).cast("int")).cast("int").bitwiseAND(mask) for c, v in value.items()}


def segmentation_view(value: dict[str, Column], fg_mask: Column, bg_mask: Column) -> dict[str, Column]:
    """Object pixels keep their blue, background pixels their red."""
    fg, bg = tint(value, "b", fg_mask), tint(value, "r", bg_mask)
    return {c: fg[c].bitwiseOR(bg[c]) for c in value}


def chosen_view(blue: bool, red: bool, value: dict[str, Column], fg_mask: Column, bg_mask: Column) -> dict[str, Column]:
    """Both: the segmentation; one: that side's tint; none: the image."""
    if blue and red:
        return segmentation_view(value, fg_mask, bg_mask)
    if blue:
        return tint(value, "b", fg_mask)
    if red:
        return tint(value, "r", bg_mask)
    return {c: v.cast("int") for c, v in value.items()}


def overlay(value: dict[str, Column], border: Column, norm: Column) -> dict[str, Column]:
    """Border pixels become cyan."""
    return {c: F.when(border != 0, F.lit(0) if c == "r" else norm).otherwise(v).cast("int") for c, v in value.items()}


def scribble_overlay(value: dict[str, Column], is_object: Column) -> dict[str, Column]:
    """Pixels under an object scribble become blue, under a background one red; is_object is null elsewhere."""
    lit = {"r": ~is_object, "g": F.lit(False), "b": is_object}
    return {c: F.when(is_object.isNull(), v).when(lit[c], F.lit(255)).otherwise(F.lit(0)).cast("int") for c, v in value.items()}


def safe_int(text: Column | str, default: int) -> Column:
    """The whole number that a column, or the column of a name, spells, else the default."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).try_cast("int"), F.lit(default))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def canvas_to_image(at: Column, scale: float) -> Column:
    return (at / F.lit(scale)).cast("int")
