"""Distances and the six path costs of forest growth, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C1, C2 = 0.7, 0.8


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def taxicab(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def squared(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v)


def alpha_sql(cv_image: str, c1: float = C1) -> str:
    return f"greatest(CAST({c1 if c1 > 0 else C1} AS DOUBLE), {cv_image})"


def variation_sql(mean: str, spread: str) -> str:
    """Coefficient of variation of a tree's gradients."""
    return f"({spread} / greatest({mean}, CAST(0.00001 AS DOUBLE)))"


def path_cost_sql(function: int, cost: str, distance: str, gradient: str, size: str, cv: str, alpha: str, c2: float = C2) -> str:
    """Cost of reaching a pixel from a tree: cost is that of the pixel before, distance that of the tree's mean colour to the pixel,
    gradient the pixel's, size and cv the tree's. Functions: 1 colour; 2 gradient over variation; 3 and 4 with the tree's size; 5 and 6 add instead of
    multiplying. Any other number means 6."""
    c2 = c2 if c2 > 0 else C2
    least = f"greatest(CAST(1.0 AS DOUBLE), {alpha} * CAST({c2} AS DOUBLE))"
    beta = {4: f"greatest({least}, {cv} / {size})"}.get(function, f"greatest({least}, {cv})")
    if function not in (2, 4, 5):
        beta = f"({beta} / {size})"
    edge = f"pow({gradient}, 1 / {alpha})"
    if function == 1:
        return f"greatest({cost}, {distance})"
    if function in (2, 3, 4):
        return f"greatest({cost}, {distance} * {edge} / {beta})"
    return f"greatest({cost}, {distance} + {edge} / {beta})"


def cost_kernel(function: int, alpha: float, c2: float):
    """The same for the growth kernel, on numbers: (cost, distance, gradient, size, cv) -> cost. power gives gradient to 1 / alpha beforehand."""
    least = max(1.0, alpha * (c2 if c2 > 0 else C2))
    if function == 1:
        return lambda cost, d, e, n, cv: d if d > cost else cost
    if function == 2:
        return lambda cost, d, e, n, cv: max(cost, d * e / max(least, cv))
    if function == 3:
        return lambda cost, d, e, n, cv: max(cost, d * e * n / max(least, cv))
    if function == 4:
        return lambda cost, d, e, n, cv: max(cost, d * e / max(least, cv / n))
    if function == 5:
        return lambda cost, d, e, n, cv: max(cost, d + e / max(least, cv))
    return lambda cost, d, e, n, cv: max(cost, d + e * n / max(least, cv))
