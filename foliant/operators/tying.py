"""Bodies with their captions and notes, and boxes that make room for one another.

Each box that is placed changes what is left for the next, so a page's boxes are
looked at in order, in kernels that get whole pages, many to a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detections as d
from .kernels import BOX, Page, by_page

#: The share of a caption that must lie on a side of its body, and the distance up to which two count as equal.
ON_SIDE, CLOSE = 0.6, 0.0001
#: How far one box may stick out over another that holds it across, and the gap that is left when a box is pushed back.
STICK_OUT, GAP = 2, 1

KEYS = "doc_id long, page_idx int"


def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each box of a lies in each one of b, edges included."""
    low = (a[:, None, :2] >= b[None, :, :2]).all(axis=2)
    return low & (a[:, None, 2:] <= b[None, :, 2:]).all(axis=2)


def outermost(boxes: np.ndarray) -> np.ndarray:
    """Which boxes lie in no other one; equal boxes lie in one another."""
    within = inside(boxes, boxes)
    np.fill_diagonal(within, False)
    return ~within.any(axis=1)


def gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each box of a is from each one of b along x and along y, 0 where they share some."""
    along = lambda low, high: np.maximum(0, np.maximum(b[None, :, low] - a[:, None, high], a[:, None, low] - b[None, :, high]))
    return along(0, 2), along(1, 3)


def union(boxes: np.ndarray) -> np.ndarray:
    return np.concatenate((boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0)))


def area(boxes: np.ndarray) -> np.ndarray:
    return np.abs(boxes[..., 2] - boxes[..., 0]) * np.abs(boxes[..., 3] - boxes[..., 1])


def share_on(boxes: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The share of each box's area that lies on side; 0 for boxes without any."""
    low, high = np.maximum(boxes[:, :2], side[:2]), np.minimum(boxes[:, 2:], side[2:])
    common = np.where((high < low).any(axis=1), 0.0, (high - low).prod(axis=1))
    whole = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    return np.divide(common, whole, out=np.zeros(len(boxes)), where=whole != 0)


def tie(subjects: np.ndarray, objects: np.ndarray) -> list[list[int]]:
    """For each subject, which come in order, the places of the objects tied to it; see tied()."""
    xs, ys = gaps(subjects, objects)
    far, diagonal = np.hypot(xs, ys), (xs > 0) & (ys > 0)
    xo, yo = gaps(objects, objects)
    between, diagonal_o = np.hypot(xo, yo), (xo > 0) & (yo > 0)
    sizes, sides = area(subjects), subjects[:, 2:] - subjects[:, :2]
    free, ties = np.ones(len(objects), dtype=bool), []
    for i, subject in enumerate(subjects):
        reach = np.where(xs[i] > 0, sides[i, 0], sides[i, 1])
        near = np.flatnonzero(free & ~diagonal[i] & (far[i] <= reach))
        chosen: list[int] = []
        if len(near):
            seed = int(near[np.argmin(far[i, near])])
            if _rival(subjects, sizes, i, objects[seed], far[:, seed]) >= far[i, seed]:
                chosen = _chain(i, seed, subject, objects, far, between, diagonal_o, free)
        kept = _largest_side(subject, objects, chosen)
        free[kept] = False
        ties.append(kept)
    return ties


def _rival(subjects: np.ndarray, sizes: np.ndarray, i: int, box: np.ndarray, far: np.ndarray) -> float:
    """The distance of an object from the last other subject, no smaller than it, that the box around it and subject i meets; infinite if there is none."""
    around = union(np.stack((subjects[i], box)))
    meets = (subjects[:, :2] <= around[2:]).all(axis=1) & (subjects[:, 2:] >= around[:2]).all(axis=1)
    holds = (subjects[:, :2] <= around[:2]).all(axis=1) & (subjects[:, 2:] >= around[2:]).all(axis=1)
    contained = (subjects[:, :2] >= around[:2]).all(axis=1) & (subjects[:, 2:] <= around[2:]).all(axis=1)
    rivals = ((meets & ~holds) | contained) & (sizes >= area(box))
    rivals[i] = False
    return float(far[np.flatnonzero(rivals)[-1]]) if rivals.any() else float("inf")


def _chain(i, seed, subject, objects, far, between, diagonal, free) -> list[int]:
    """The seed and the objects that go with it: no farther from it than it is from the subject, nearest to it of all that is left, and on the way outwards."""
    chosen, limit = [seed], far[i, seed]
    left = free.copy()
    left[seed] = False
    for k in np.flatnonzero(free):
        if k == seed or diagonal[seed, k] or between[seed, k] > limit:
            continue
        others = left.copy()
        others[k] = False
        rest = np.concatenate((far[i + 1 :, k], between[others, k]))
        if (rest <= between[seed, k] + CLOSE).any():
            continue
        grown = union(objects[[*chosen, k]])
        x, y = gaps(subject[None], grown[None])
        if limit - np.hypot(x, y)[0, 0] > CLOSE:
            continue
        chosen.append(int(k))
        left[k] = False
    return chosen


def _largest_side(subject: np.ndarray, objects: np.ndarray, chosen: list[int]) -> list[int]:
    """The chosen objects on the side of the subject - left, above, below, right - where they take most room together; of equal ones the first."""
    if not chosen:
        return []
    own = objects[chosen]
    around = union(np.vstack((own, subject)))
    corners = [(0, 1, None, 3), (0, 1, 2, None), (0, None, 2, 3), (None, 1, 2, 3)]
    best, kept = 0, []
    for side, ends in zip(("left", "above", "below", "right"), corners):
        edge = {"left": subject[0], "above": subject[1], "below": subject[3], "right": subject[2]}[side]
        on = share_on(own, np.array([edge if e is None else around[e] for e in ends])) > ON_SIDE
        room = int(area(union(own[on]))) if on.any() else 0
        if room > best:
            best, kept = room, [c for c, o in zip(chosen, on) if o]
    return kept


def tied(dets: DataFrame, subject: int, kind: int) -> DataFrame:
    """(page keys, ord, place, score, body, objects, object_box, box): each body of a category with the objects of another that belong to it.

    Boxes in another of their category are left out, and so are equal ones. Bodies
    come by the distance of their upper left corner from the page's; place counts
    them from 0. A body's first object is the nearest free one straight to a side of
    it, no farther than the body is long on that axis, unless another body, no
    smaller than the object, stands in the box around both and is nearer to it; of
    several such bodies the last decides. Objects next to the first one join it, if
    nothing else that is left is as near to them. Those on the side where they take
    most room are tied to the body, and are free no more. objects has their ord,
    object_box the box around them (null without any), box the one around all.
    """
    return _tied(dets, subject, [kind]).select(*d.PAGE, "ord", "place", "score", "body", F.col("objects0").alias("objects"), F.col("object_box0").alias("object_box"), F.col("box0").alias("box"))


def _tied(dets: DataFrame, subject: int, kinds: list[int]) -> DataFrame:
    """tied() to each of kinds, all in one pass: (page keys, ord, place, score, body, and objects, object_box and box with each kind's number)."""
    boxes = d.by_category(dets, subject, *kinds).select(*d.PAGE, "ord", "category_id", "score", *BOX)
    schema = f"{KEYS}, ord int, place int, score double, body array<double>" + "".join(f", objects{n} array<int>, object_box{n} array<double>, box{n} array<double>" for n in range(len(kinds)))

    def kernel(page: Page) -> list | None:
        category, ords, scores, all_boxes = page["category_id"], page["ord"], page["score"], page.boxes
        s = np.flatnonzero(category == subject)
        if not len(s):
            return None
        s = s[outermost(all_boxes[s])]
        s = s[np.argsort((all_boxes[s, :2] ** 2).sum(axis=1), kind="stable")]
        if not len(s):
            return None
        bodies = all_boxes[s]
        columns = [ords[s].tolist(), list(range(len(s))), scores[s].tolist(), bodies.tolist()]
        for kind in kinds:
            o = np.flatnonzero(category == kind)
            o = o[outermost(all_boxes[o])]
            objects, around, whole = [], [], []
            for body, kept in zip(bodies, tie(bodies, all_boxes[o]) if len(o) else [[]] * len(s)):
                own = all_boxes[o[kept]] if kept else None
                objects.append(ords[o[kept]].tolist() if kept else [])
                around.append(union(own).tolist() if kept else None)
                whole.append(union(np.vstack((own, body))).tolist() if kept else body.tolist())
            columns += [objects, around, whole]
        return columns

    return by_page(boxes, kernel, schema)


def images_with_captions(dets: DataFrame) -> DataFrame:
    """(page keys, ord, score, body, caption_box, box) of each image."""
    return tied(dets, 3, 4).select(*d.PAGE, "ord", "score", "body", F.col("object_box").alias("caption_box"), "box")


def tables_with_captions(dets: DataFrame) -> DataFrame:
    """(page keys, ord, score, body, caption_box, note_box, box) of each table, with its caption and its footnotes."""
    end = lambda i: (F.least if i < 2 else F.greatest)(F.col("box0")[i], F.col("box1")[i])
    return _tied(dets, 5, [6, 7]).select(*d.PAGE, "ord", "score", "body", F.col("object_box0").alias("caption_box"), F.col("object_box1").alias("note_box"), F.array(*[end(i) for i in range(4)]).alias("box"))


_BOXES = f"{KEYS}, ord int, x0 double, y0 double, x1 double, y1 double"


def pushed_apart(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, box): layout boxes of which, pair by pair in order, the larger one draws back from the smaller.

    Boxes in another one are left out first, equal ones too. Of two that overlap, the
    larger (of equal ones the later) gets an edge just beyond the other's, on the axis
    on which their centres are farther apart (of equal distances, upright); later pairs
    see it as it is then. Its two edges may cross when others took all its room.
    """

    def kernel(page: Page) -> list:
        left = outermost(page.boxes)
        b = page.boxes[left].tolist()
        for i, p in enumerate(b):
            for q in b[i + 1 :]:
                apart = p[0] > q[2] or p[1] > q[3] or p[2] < q[0] or p[3] < q[1]
                if apart or (p[0] >= q[0] and p[1] >= q[1] and p[2] <= q[2] and p[3] <= q[3]):
                    continue
                large, small = (p, q) if (p[2] - p[0]) * (p[3] - p[1]) > (q[2] - q[0]) * (q[3] - q[1]) else (q, p)
                off = [(large[k] + large[k + 2] - small[k] - small[k + 2]) / 2 for k in (0, 1)]
                axis = 0 if abs(off[0]) > abs(off[1]) else 1
                if off[axis] > 0 and large[axis] < small[axis + 2]:
                    large[axis] = small[axis + 2] + GAP
                elif off[axis] < 0 and large[axis + 2] > small[axis]:
                    large[axis + 2] = small[axis] - GAP
        return [page["ord"][left], *np.array(b).reshape(-1, 4).T]

    return by_page(boxes.select(*d.PAGE, "ord", *BOX), kernel, _BOXES)


def grown_over_overlaps(boxes: DataFrame) -> DataFrame:
    """(page keys, place, box): boxes of which two that overlap upright, one holding the other across, are one box around both, until none do.

    Boxes in another one are left out first, equal ones too. In a round boxes are met
    in order; one that was merged with an earlier box starts no pair and ends none,
    but a box that starts one may start several. What was merged comes first, then
    the rest. A round with a merger leaves one box less at least, so rounds end.
    """

    def kernel(page: Page) -> list | None:
        b = page.boxes
        b = b[outermost(b)]
        while len(b):
            across = (b[:, None, 0] - STICK_OUT <= b[None, :, 0]) & (b[:, None, 2] + STICK_OUT >= b[None, :, 2])
            upright = (b[:, None, 3] >= b[None, :, 1]) & (b[:, None, 1] <= b[None, :, 3])
            meet = np.triu((across | across.T) & upright, 1)
            if not meet.any():
                break
            gone, merged = np.zeros(len(b), dtype=bool), []
            for i in np.flatnonzero(meet.any(axis=1)):
                partners = [] if gone[i] else np.flatnonzero(meet[i] & ~gone)
                merged += [union(b[[i, j]]) for j in partners]
                if len(partners):
                    gone[[i, *partners]] = True
            b = np.vstack((*merged, b[~gone]))
        return [np.arange(len(b)), *b.T] if len(b) else None

    return by_page(boxes.select(*d.PAGE, "ord", *BOX), kernel, f"{KEYS}, place int, x0 double, y0 double, x1 double, y1 double")
