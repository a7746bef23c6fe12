"""Which boxes of a page are seen from a box on each side, and how many stand in a row before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import geometry as g
from .detections import PAGE
from .kernels import Page, by_page

#: The neighbours of direct(), in its columns' order.
SIDES = ("left", "right", "top", "bottom", "top_from_left", "top_from_right", "bottom_from_left", "bottom_from_right", "left_line", "right_line")


def faces(b: np.ndarray, low: int) -> np.ndarray:
    """Whether each box faces each other one along an axis: an end of one lies strictly within the other, or both ends are the same."""
    a0, a1, b0, b1 = b[:, None, low], b[:, None, low + 2], b[:, low], b[:, low + 2]
    return ((a0 < b1) & (b0 < a1)) | ((a0 == b0) & (a1 == b1))


def _first(rule: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the column with the least keys among those for which rule holds, the first of equal ones; -1 for none."""
    for key in keys:
        k = np.where(rule, key, np.inf)
        rule = rule & (k == k.min(axis=1, keepdims=True))
    return np.where(rule.any(axis=1), rule.argmax(axis=1), -1)


def direct(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, and the ord of a neighbour for each of SIDES, null for none) of boxes.

    On the left and right stand boxes that face the box along y, on top and at the
    bottom those that face it along x, all of them wholly beyond its edge; on the left
    also a box that crosses its left edge and holds one of its y ends, on the right
    also one that ends within it and has a y end in it. The nearest by its edge is
    taken, by the extended edges x1_ext, x0_ext and y1_ext on the left, right and top
    where boxes have them, and of equally near ones the first; in the columns `from` a
    side, of equally near ones the farthest out on that side. The columns `line` take
    the nearest beyond the edge at any height. A page's boxes meet in its task; a box without a page has no neighbours.
    """
    drawn = {edge: f"{edge}_ext" in boxes.columns for edge in ("x0", "x1", "y1")}

    def kernel(page: Page) -> list:
        b, n = page.boxes, len(page["ord"])
        if not page.keyed or n == 1:
            return [page["ord"], *[[None] * n for _ in SIDES]]

        def edge(side: str, of: np.ndarray) -> np.ndarray:
            extended = page[f"{side}_ext"].astype(float) if drawn[side] else np.zeros(n)
            return np.where(np.isnan(extended) | (extended == 0), of, extended)

        other = page["ord"][:, None] != page["ord"]
        x0, y0, x1, y1 = b.T
        ax0, ay0, ax1, ay1 = (c[:, None] for c in b.T)
        beside, upright = faces(b, 1), faces(b, 0)
        holds_end = ((ay0 >= y0) & (ay0 <= y1)) | ((ay1 >= y0) & (ay1 <= y1))
        held_end = ((y0 >= ay0) & (y0 <= ay1)) | ((y1 >= ay0) & (y1 <= ay1))
        left, right = other & (x1 <= ax0), other & (x0 >= ax1)
        above, below = other & (y1 <= ay0) & upright, other & (y0 >= ay1) & upright
        chosen = [
            _first((left & beside) | (other & (x1 > ax0) & (x0 < ax0) & holds_end), -edge("x1", x1)),
            _first((right & beside) | (other & (ax0 < x1) & (ax1 > x1) & held_end), edge("x0", x0)),
            _first(above, -edge("y1", y1)),
            _first(below, y0),
            _first(above, -y1, x0),
            _first(above, -y1, -x1),
            _first(below, y0, x0),
            _first(below, y0, -x1),
            _first(left, -x1),
            _first(right, x0),
        ]
        ords = [*page["ord"].tolist(), None]
        return [page["ord"], *[[ords[k] for k in c.tolist()] for c in chosen]]

    columns = [*PAGE, "ord", *g.Box._fields, *[f"{e}_ext" for e, known in drawn.items() if known]]
    return by_page(boxes.select(*columns), kernel, ", ".join(["doc_id long, page_idx int, ord int", *[f"{side} int" for side in SIDES]]))


def depths(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, idx_x, idx_y): how many boxes stand in a row to the left of each and above it.

    A box comes one after the nearest that faces it wholly beyond its left edge (idx_x)
    or upper edge (idx_y), of equally near ones the first; without one it is 0. Boxes
    are folded in the order of their edges, by which what is beyond comes before; a
    box without width (height) is beyond none that comes after it in that order.
    """

    def depth(b: np.ndarray, ords: np.ndarray, low: int) -> list[int]:
        # boxes come by ord, so that a stable sort by the edges is one by edges, then ord
        order = np.lexsort((b[:, low + 2], b[:, low]))
        rank = np.empty(len(b), dtype=int)
        rank[order] = np.arange(len(b))
        rule = (b[:, low + 2] <= b[:, None, low]) & faces(b, 1 - low) & (rank < rank[:, None]) & (ords[:, None] != ords)
        parent, out = _first(rule, -b[:, low + 2]).tolist(), [0] * len(b)
        for i in order.tolist():
            if parent[i] >= 0:
                out[i] = out[parent[i]] + 1
        return out

    def kernel(page: Page) -> list:
        b, ords = page.boxes, page["ord"]
        if not page.keyed:
            return [ords, [0] * len(b), [0] * len(b)]
        return [ords, depth(b, ords, 0), depth(b, ords, 1)]

    return by_page(boxes.select(*PAGE, "ord", *g.Box._fields), kernel, "doc_id long, page_idx int, ord int, idx_x int, idx_y int")
