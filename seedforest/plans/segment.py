"""Segmentation of images by scribbles: four methods, one task per image, all iterations in that task.

class               grid seeds go by the class of their tree and its priority
class_clustered     the same, where each marker's connected pixels of one spectral cluster start one tree
relevance           the least relevant seeds go until none does
superpixel          unsupervised superpixels; that of the first scribble pixel is the object

Images are independent, so work scales with their number; an image (its pixels and two arrays per pixel) must fit in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import METHODS as CLUSTERERS
from ..operators.seeds import grid_geometry
from ..schema import EIGHT, FOUR
from .grow import Forest, border_of, gradient_of, grow, lab_of, neighbour_table, norm_of, variation_of

METHODS = ("class", "class_clustered", "relevance", "superpixel")


def check(samples: int, iterations: int, function: int, c1: float, c2: float, method: str, obj_markers: int, all_borders: int, markers: int | None = None) -> None:
    """Raises ValueError for parameters out of range. iterations is the number of trees left over for relevance and superpixel."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if samples < 0:
        raise ValueError("the number of samples can't be negative")
    if iterations < (0 if method == "relevance" else 1):
        raise ValueError("too few iterations")
    if method == "relevance" and iterations > samples:
        raise ValueError("more trees are to be left than there are samples")
    if function not in range(1, 7):
        raise ValueError("function must be 1 to 6")
    if not (0 < c1 <= 1 and 0 < c2 <= 1):
        raise ValueError("c1 and c2 must be above 0 and at most 1")
    if all_borders not in (0, 1):
        raise ValueError("all_borders must be 0 or 1")
    if obj_markers < 1 or (markers is not None and obj_markers > markers):
        raise ValueError("obj_markers must be between 1 and the number of markers")


def grid_seeds(rows: int, cols: int, samples: int, grad: np.ndarray, taken: np.ndarray, moving: bool = True) -> list[int]:
    """Lattice points with no scribble pixel within the radius, moved to the smallest gradient nearby. taken: bool per pixel."""
    if samples <= 0:
        return []
    start, step, radius = grid_geometry(rows * cols, samples)
    if start < 1:
        raise ValueError("the number of samples is too high")
    image, out = taken.reshape(rows, cols).copy(), []
    for y in range(start, rows, step):
        for x in range(start, cols, step):
            if image[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].any():
                continue
            best = y * cols + x
            for dx, dy in EIGHT:
                if 0 <= x + dx < cols and 0 <= y + dy < rows and grad[(y + dy) * cols + x + dx] < grad[best]:
                    best = (y + dy) * cols + x + dx
            if moving and step < 3:  # seeds of so fine a lattice can come within the next window
                image.reshape(-1)[best] = True
            out.append(best)
    return out


def components_of(pixels: list[int], cluster: list[int], cols: int) -> list[list[int]]:
    """4-connected pixels of one cluster, in the order in which they are met."""
    place, out, seen = {p: c for p, c in zip(pixels, cluster, strict=True)}, [], set()
    for p in pixels:
        if p in seen:
            continue
        seen.add(p)
        group, at = [p], 0
        while at < len(group):
            q = group[at]
            at += 1
            x = q % cols
            for dx, dy in FOUR:
                r = q + dy * cols + dx
                if 0 <= x + dx < cols and r not in seen and place.get(r) == place[q]:
                    seen.add(r)
                    group.append(r)
        out.append(group)
    return out


def remove_by_class(forest: Forest, labels: list[int], n: int, markers: int, obj_markers: int, compat: bool = True) -> tuple[list[int], int]:
    """Which trees stay, in their new order, and how to go on: 0 as before, 2 one last time, 1 stop."""
    trees = len(labels)
    behind = [lab > obj_markers for lab in labels]
    kind, priority = [0] * trees, [0.0] * trees
    for t in range(trees):
        same = far = math.inf
        for o in forest.neighbours[t]:
            d = float(np.float32(np.sqrt(((forest.colour[t] - forest.colour[o]) ** 2).sum())))
            if behind[o] == behind[t]:
                same = min(same, d)
            else:
                far = min(far, d)
        if forest.neighbours[t]:
            kind[t] = (1 if behind[t] else 3) + (far < math.inf)
            priority[t] = far if kind[t] in (2, 4) else forest.size[t] / n * same

    def threshold(first: int, second: int) -> float:
        own = [priority[t] for t in range(trees) if kind[t] in (first, second)]
        n1, n2 = kind.count(first), kind.count(second)
        s, s2 = sum(own), sum(p * p for p in own)
        if not own:
            return math.inf
        if not compat:
            return s / len(own) + math.sqrt(max(0.0, s2 / len(own) - (s / len(own)) ** 2))
        if not n1:
            return math.inf
        return s / (n1 + n2) + math.sqrt(abs(s2 - 2 * s + s * s / n1 + n2) / n1 + n2)

    inner, outer = threshold(1, 3), threshold(2, 4)
    stay = [t for t in range(trees) if kind[t] and labels[t] <= markers]
    removed = [lab <= obj_markers for lab in labels]  # an object neighbour protects a seed, and so does one removed in this round
    keeping = False
    for t in sorted((t for t in range(trees) if kind[t] == 1 and labels[t] > markers), key=lambda t: (priority[t], t)):
        keeping = keeping or priority[t] >= inner
        if keeping or any(removed[o] for o in forest.neighbours[t]):
            stay.append(t)
        else:
            removed[t] = True
    if not compat or (outer <= 0 or float(int(outer) if outer < math.inf else 0) >= outer):
        for t in sorted((t for t in range(trees) if kind[t] == 2 and labels[t] > markers), key=lambda t: (-priority[t], t)):
            if (int(priority[t]) if compat else priority[t]) < outer:
                break
            stay.append(t)
    left = [labels[t] for t in stay]
    grid, front = any(lab > markers for lab in left), any(lab <= obj_markers for lab in left)
    back = any(obj_markers < lab <= markers for lab in left)
    return stay, 1 if not front or not (back or grid) else 0 if grid else 2


def most_relevant(forest: Forest, n: int, keep: int, scribbled: bool) -> list[int]:
    """The `keep` most relevant trees; those that touch the first marker come first."""

    def of(t: int) -> float:
        if scribbled and forest.nearest[t] == 0:
            return math.inf
        least = min((float(np.float32(np.sqrt(((forest.colour[t] - forest.colour[o]) ** 2).sum()))) for o in forest.neighbours[t]), default=math.inf)
        return forest.size[t] / n * (forest.nearest[t] if scribbled else 1.0) * least

    return sorted(range(len(forest.size)), key=lambda t: (-of(t), t))[: max(0, keep)]


def segment_image(values: np.ndarray, rows: int, cols: int, markers: list[list[tuple[int, int]]], samples: int, iterations: int, obj_markers: int = 1, function: int = 1, c1: float = 0.7, c2: float = 0.8, method: str = "class", all_borders: int = 0, compat: bool = True, clusterer: str = "spectral") -> dict[str, np.ndarray]:
    """values: [rows * cols, channels]. markers: (x, y) points of each, object markers first. Returns label, tree_id, cost and border of each pixel."""
    check(samples, iterations, function, c1, c2, method, obj_markers, all_borders, len(markers) or None)
    if not any(markers):
        raise ValueError("there is no scribble")
    lab = lab_of(values, norm_of(values))
    n = rows * cols
    grad = gradient_of(lab, rows, cols)
    alpha = max(c1, variation_of(grad))
    points = [[y * cols + x for x, y in m if 0 <= x < cols and 0 <= y < rows] for m in markers]
    taken, roots, labels = np.zeros(n, bool), [], []
    coords = (np.arange(n) % cols, np.arange(n) // cols)
    if method == "superpixel":
        near, plain = neighbour_table(rows, cols, EIGHT), True
        roots = [[p] for p in sorted(set(grid_seeds(rows, cols, samples, grad, taken, False)))] or [[n // 2]]
    else:
        near, plain = neighbour_table(rows, cols, FOUR), False
        for k, marker in enumerate(points):
            fresh = [p for p in dict.fromkeys(marker) if not taken[p]]
            taken[fresh] = True
            if method == "class_clustered" and len(fresh) >= 3:
                data = values[fresh].astype(float) if clusterer == "spectral" else lab[fresh].astype(float)
                groups = components_of(fresh, CLUSTERERS[clusterer](data).tolist() if clusterer != "single" else [0] * len(fresh), cols)
            else:
                groups = [[p] for p in fresh]
            roots += groups
            labels += [k + 1] * len(groups)
        base = samples + len(roots) if method == "relevance" and samples > 0 else samples
        extra = grid_seeds(rows, cols, base, grad, taken, method != "class_clustered")
        extra = list(dict.fromkeys(extra))
        roots += [[p] for p in extra]
        labels += [len(markers) + 1] * len(extra)
    marker = [(p % cols, p // cols) for p in points[0]]
    scribbled = sum(map(len, points))
    first = len(roots) if method == "superpixel" else len(extra) + scribbled
    turn, state = 1, 0
    while True:
        forest = grow(lab, grad, near, roots, function, alpha, c2, coords, marker if method == "relevance" else None, plain)
        shown = list(labels)
        if method in ("class", "class_clustered"):
            if state == 2 or turn >= iterations:
                break
            stay, state = remove_by_class(forest, labels, n, len(markers), obj_markers, compat)
            if state == 1:
                break
            roots, labels = [roots[t] for t in stay], [labels[t] for t in stay]
        else:
            least = iterations if method == "superpixel" else iterations + scribbled
            keep = int(max(first * math.exp(-turn), least))
            stay = most_relevant(forest, n, keep, method == "relevance")
            if len(stay) == len(roots):
                break
            roots = [roots[t] for t in stay]
            labels = [labels[t] for t in stay] if labels else labels
        turn += 1
    if method == "superpixel":
        label = np.where(forest.tree == forest.tree[points[0][0]], 1, 2)
        border = border_of(label, rows, cols, EIGHT)
    else:
        label = np.where(np.array(shown)[forest.tree] > obj_markers, 2, 1)
        border = border_of(forest.tree if all_borders else label, rows, cols)
    return {"label": label.astype(np.int32), "tree_id": forest.tree.astype(np.int32), "cost": forest.cost, "border": border.astype(np.int32)}


def segment(pixels: DataFrame, scribbles: DataFrame, samples: int, iterations: int, obj_markers: int = 1, function: int = 1, c1: float = 0.7, c2: float = 0.8, method: str = "class", all_borders: int = 0, compat: bool = True, clusterer: str = "spectral") -> DataFrame:
    """pixels: image_id, x, y, val. scribbles: image_id, marker_id, ord, x, y. Returns image_id, idx, x, y, label (1 object, 2 background), tree_id, cost, border."""
    check(samples, iterations, function, c1, c2, method, obj_markers, all_borders)
    kind = pixels.schema["image_id"].dataType.simpleString()
    lines = pixels.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "val"))).alias("line")).select("image_id", F.lit(0).alias("marker_id"), "y", "line.val")
    marks = scribbles.groupBy("image_id", "marker_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    marks = marks.select("image_id", "marker_id", F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("points"))

    def run(key, image: pd.DataFrame, marker: pd.DataFrame) -> pd.DataFrame:
        columns = ["image_id", "idx", "x", "y", "label", "tree_id", "cost", "border"]
        if image.empty or marker.empty:
            return pd.DataFrame({c: [] for c in columns})
        image = image.sort_values("y")
        rows, cols = len(image), len(image["val"].iloc[0])
        values = np.array([list(v) for line in image["val"] for v in line])
        points = [[tuple(map(int, p)) for p in m] for m in marker.sort_values("marker_id")["points"]]
        out = segment_image(values, rows, cols, points, samples, iterations, obj_markers, function, c1, c2, method, all_borders, compat, clusterer)
        idx = np.arange(rows * cols)
        return pd.DataFrame({"image_id": key[0], "idx": idx, "x": (idx % cols).astype(np.int32), "y": (idx // cols).astype(np.int32), **out})[columns]

    schema = f"image_id {kind}, idx long, x int, y int, label int, tree_id int, cost double, border int"
    return lines.groupBy("image_id").cogroup(marks.groupBy("image_id")).applyInPandas(run, schema)
