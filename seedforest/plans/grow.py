"""Forest growth: the one step whose result depends on the global order in which pixels are conquered, so it runs per image.

Each seed starts a tree at cost 0. The pixel of smallest cost joins its tree, which changes the tree's mean colour; then its neighbours are offered the cost of
being reached from there. Costs are compared as 32-bit floats; of equal costs the one offered first goes first.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

from ..functions.cost import cost_kernel
from ..schema import EIGHT, FOUR


@dataclass
class Forest:
    tree: np.ndarray  # of each pixel
    cost: np.ndarray
    size: np.ndarray  # of each tree
    colour: np.ndarray  # mean of each tree
    nearest: np.ndarray  # smallest distance of each tree to the first marker
    neighbours: list[set[int]] = field(default_factory=list)


def lab_of(values: np.ndarray, norm: int) -> np.ndarray:
    """[n, channels] integers to [n, 3] float32 L, a, b; one or two channels are gray, more are cut to three."""
    from ..functions.color import WHITE, XYZ

    rgb = values[:, :1].repeat(3, 1) if values.shape[1] < 3 else values[:, :3]
    v = rgb.astype(np.float64) / norm
    linear = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    x = linear @ np.array(XYZ).T / np.array(WHITE)
    f = np.where(x >= 8.85645167903563082e-3, np.maximum(x, 0) ** 0.333333333333333, x * (841.0 / 108.0) + 4.0 / 29.0)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1).astype(np.float32)


def norm_of(values: np.ndarray) -> int:
    most = int(values.max(initial=0))
    if most > 65535 or values.min(initial=0) < 0:
        raise ValueError("pixel values must be within 0..65535")
    return 255 if most <= 255 else 65535


def gradient_of(lab: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """As operators.stencil.gradient."""
    from ..operators.stencil import weights

    image, out = lab.reshape(rows, cols, 3).astype(np.float64), np.zeros((rows, cols))
    for (dx, dy), w in zip(EIGHT, weights(), strict=True):
        here = (slice(max(0, -dy), rows - max(0, dy)), slice(max(0, -dx), cols - max(0, dx)))
        there = (slice(max(0, dy), rows - max(0, -dy)), slice(max(0, dx), cols - max(0, -dx)))
        out[here] += w * np.abs(image[there] - image[here]).sum(2)
    return out.reshape(-1)


def variation_of(grad: np.ndarray) -> float:
    return float(np.sqrt(max(0.0, (grad * grad).mean() - grad.mean() ** 2)) / max(0.001, grad.mean()))


def neighbour_table(rows: int, cols: int, offsets) -> list[list[int]]:
    out = []
    for y in range(rows):
        for x in range(cols):
            out.append([(y + dy) * cols + x + dx for dx, dy in offsets if 0 <= x + dx < cols and 0 <= y + dy < rows])
    return out


def grow(lab: np.ndarray, grad: np.ndarray, near: list[list[int]], roots: list[list[int]], function: int, alpha: float, c2: float, coords=None, marker=None, plain: bool = False) -> Forest:
    """roots: the pixels each tree starts with, one or more. plain: colour costs only, whatever the function.
    Trees of several pixels own them all from the start, and spread from each before the free growth begins."""
    n, trees = len(lab), len(roots)
    colours = lab.astype(np.float64).tolist()
    edge = (np.maximum(grad, 0) ** (1 / alpha)).tolist() if not plain else [0.0] * n
    gradients = grad.tolist()
    cost, tree = [math.inf] * n, [-1] * n
    done = bytearray(n)
    sums, counts = [[0.0, 0.0, 0.0] for _ in roots], [0] * trees
    g1, g2 = [0.0] * trees, [0.0] * trees
    closest = [math.inf] * trees
    price = cost_kernel(1 if plain else function, alpha, c2)
    marks = None if marker is None or not len(marker) else np.asarray(marker, float)
    to_mark = None if marks is None else np.sqrt(((np.stack(coords, 1)[:, None, :] - marks[None]) ** 2).sum(2).min(1)).tolist()
    single = np.float32
    heap: list = []
    turn = 0

    def join(p: int, t: int) -> None:
        s, c = sums[t], colours[p]
        s[0] += c[0]
        s[1] += c[1]
        s[2] += c[2]
        counts[t] += 1
        g1[t] += gradients[p]
        g2[t] += gradients[p] * gradients[p]
        if to_mark is not None and to_mark[p] < closest[t]:
            closest[t] = to_mark[p]

    def spread(p: int, t: int) -> None:
        nonlocal turn
        k, s, base = counts[t], sums[t], cost[p]
        m0, m1, m2 = s[0] / k, s[1] / k, s[2] / k
        mean = g1[t] / k
        cv = math.sqrt(max(0.0, g2[t] / k - mean * mean)) / max(0.00001, mean)
        for q in near[p]:
            if done[q]:
                continue
            c = colours[q]
            d = math.sqrt((c[0] - m0) ** 2 + (c[1] - m1) ** 2 + (c[2] - m2) ** 2)
            new = price(base, d, edge[q], k, cv)
            if new < cost[q]:
                cost[q], tree[q] = new, t
                heapq.heappush(heap, (float(single(new)), turn, q, new))
                turn += 1

    several = [t for t in range(trees) if len(roots[t]) > 1]
    for t, pixels in enumerate(roots):
        for p in pixels:
            cost[p], tree[p] = 0.0, t
    for t in several:
        for p in roots[t]:
            done[p] = 1
            join(p, t)
    for t in several:
        for p in roots[t]:
            spread(p, t)
    for t, pixels in enumerate(roots):
        if len(pixels) == 1:
            heapq.heappush(heap, (0.0, turn - n - trees, pixels[0], 0.0))  # seeds go before anything offered at cost 0
            turn += 1
    while heap:
        _, _, p, was = heapq.heappop(heap)
        if done[p] or was != cost[p]:
            continue
        done[p] = 1
        join(p, tree[p])
        spread(p, tree[p])
    out = Forest(np.array(tree), np.array(cost), np.array(counts), np.array(sums) / np.maximum(np.array(counts), 1)[:, None], np.array(closest), [set() for _ in roots])
    labels = out.tree
    for a in range(n):
        for b in near[a]:
            if a < b and labels[a] != labels[b]:
                out.neighbours[labels[a]].add(int(labels[b]))
                out.neighbours[labels[b]].add(int(labels[a]))
    return out


def border_of(labels: np.ndarray, rows: int, cols: int, offsets=FOUR) -> np.ndarray:
    image, out = labels.reshape(rows, cols), np.zeros((rows, cols), np.int32)
    for dx, dy in offsets:
        here = (slice(max(0, -dy), rows - max(0, dy)), slice(max(0, -dx), cols - max(0, dx)))
        there = (slice(max(0, dy), rows - max(0, -dy)), slice(max(0, dx), cols - max(0, -dx)))
        out[here][image[here] != image[there]] = 255
    return out.reshape(-1)
