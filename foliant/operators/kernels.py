"""Page-local algorithms that go step by step: each sees the boxes of one page.

A page holds some hundred boxes, so a group is small whatever the corpus. Where a
step depends on what earlier ones removed, pairs are found by a join and folded in
order; where boxes move or are cut up on the way, pages go through an Arrow kernel,
many to a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as g
from .detections import PAGE, pairs

BOX = ["x0", "y0", "x1", "y1"]


class Page(dict):
    """The columns of one page's rows as arrays; keyed tells whether it has both its keys."""

    keyed = True

    @property
    def boxes(self) -> np.ndarray:
        return np.stack([self[c] for c in BOX], axis=1).astype(float)


def by_page(boxes: DataFrame, kernel: Callable[[Page], list | None], schema: str, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """schema's rows of what kernel makes of each page's boxes in some columns' order: schema's columns behind the page
    keys, as arrays or lists of one length, or None for no rows. Null page keys are a page like others, one that is not keyed.

    Pages are dealt out and sorted once, and cut from whole batches without a data
    frame of their own; the last one of a batch is held until the next shows that it
    has ended.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def absent(batch: pa.RecordBatch, key: str) -> np.ndarray:
        return batch.column(key).is_null().to_numpy(zero_copy_only=False)

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in PAGE:
            v, null = batch.column(k).fill_null(0).to_numpy(), absent(batch, k)
            change[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
        change[:1] = True
        return np.append(np.flatnonzero(change), batch.num_rows)

    def results(batch: pa.RecordBatch, at: np.ndarray):
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        keyed = (~(absent(batch, PAGE[0]) | absent(batch, PAGE[1])))[at[:-1]].tolist()
        found, sizes = [], np.zeros(len(at) - 1, dtype=np.int64)
        for n, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            page = Page((c, v[a:b]) for c, v in columns.items())
            page.keyed = keyed[n]
            rows = kernel(page)
            if rows is not None and len(rows[0]):
                found.append(rows)
                sizes[n] = len(rows[0])
        if found:
            keys = [batch.column(k).take(pa.array(np.repeat(at[:-1], sizes))).cast(types.field(k).type) for k in PAGE]
            joined = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for part in c for v in part] for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, f.type, from_pandas=True) for c, f in zip(joined, list(types)[len(PAGE) :])]], schema=types)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            at = changes(batch)
            held = batch.slice(at[-2])
            if len(at) > 2:
                yield from results(batch, at[:-1])
        if held is not None:
            yield from results(held, np.array([0, held.num_rows]))

    return boxes.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def _losers(found: DataFrame) -> DataFrame:
    """(page keys, ord): of pairs (page keys, i, j, loser) of boxes, the losers of those that meet.

    Pairs meet in the order of i, then j, unless one of the two has lost before.
    """
    met = F.array_sort(F.collect_list(F.struct("i", "j", "loser")))
    none = F.array().cast("array<struct<i:int,j:int,loser:int>>")
    out = lambda lost, p: F.exists(lost, lambda x: (x["loser"] == p["i"]) | (x["loser"] == p["j"]))
    fold = F.aggregate("met", none, lambda lost, p: F.when(out(lost, p), lost).otherwise(F.concat(lost, F.array(p))))
    return found.groupBy(*PAGE).agg(met.alias("met")).select(*PAGE, F.explode(fold).alias("p")).select(*PAGE, F.col("p.loser").alias("ord"))


def _meeting(boxes: DataFrame, rule: Column, loser: Column) -> DataFrame:
    found = pairs(boxes, boxes, (F.col("a.ord") < F.col("b.ord")) & rule)
    return found.select(*[F.col(f"a.{k}").alias(k) for k in PAGE], F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), loser.alias("loser"))


def drop_repeated_spans(spans: DataFrame, share: float = 0.9) -> DataFrame:
    """(page keys, ord): spans left after, pair by pair in their order, the less certain of two that nearly coincide goes.

    A span that went takes part in no further pair; of equal certainty the first stays.
    """
    loser = F.when(F.col("a.score") < F.col("b.score"), F.col("a.ord")).otherwise(F.col("b.ord"))
    lost = _losers(_meeting(spans, g.iou(g.box("a."), g.box("b.")) > share, loser))
    return spans.select(*PAGE, "ord").join(lost, [*PAGE, "ord"], "left_anti")


def drop_until_apart(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """(page keys, ord): boxes left after the smaller of the first pair side by side on one height goes, until none is.

    Two boxes are side by side if one starts within the other's x range and they
    share at least `share` of either height. What goes takes only pairs with it, so
    that the pairs left meet in the order in which all stood at first.
    """
    a, b = g.box("a."), g.box("b.")
    loser = F.when(g.smaller_is_first(a, b), F.col("a.ord")).otherwise(F.col("b.ord"))
    lost = _losers(_meeting(boxes, g.beside_from_left(a, b, share) | g.beside_from_left(b, a, share), loser))
    return boxes.select(*PAGE, "ord").join(lost, [*PAGE, "ord"], "left_anti")


def separate(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, box): boxes drawn back from one another, in order.

    First what lies inside another goes, of equal boxes the later one; then two that
    overlap part at the middle of the shorter side of what they share, a quarter
    point to either side; a box left without area goes.
    """
    inner, outer = g.box("a."), g.box("b.")
    beaten = (F.col("a.ord") != F.col("b.ord")) & g.contained(inner, outer) & (~g.contained(outer, inner) | (F.col("a.ord") > F.col("b.ord")))
    boxes = pairs(boxes, boxes, beaten, "left_anti")

    def kernel(page: Page) -> list:
        b = page.boxes.tolist()
        alive, known = [True] * len(b), (~np.isnan(page.boxes).any(axis=1)).tolist()
        for i, p in enumerate(b):
            for j in range(i + 1, len(b)):
                if not (alive[i] and known[i]):
                    break
                q = b[j]
                if not (alive[j] and known[j]):
                    continue
                w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
                if w <= 0 or h <= 0:
                    continue
                for inner, x, y in ((i, p, q), (j, q, p)):
                    if x[0] >= y[0] and x[1] >= y[1] and x[2] <= y[2] and x[3] <= y[3]:
                        alive[inner] = False
                        break
                else:
                    low, high = (0, 2) if w < h else (1, 3)
                    first, second = (p, q) if p[low] <= q[low] else (q, p)
                    middle = math.floor((second[low] + first[high]) / 2)
                    first[high], second[low] = middle - 0.25, middle + 0.25
                    for k in (i, j):
                        alive[k] = alive[k] and b[k][2] > b[k][0] and b[k][3] > b[k][1]
        keep = np.array(alive, dtype=bool)
        return [page["ord"][keep], *np.array(b).reshape(-1, 4)[keep].T]

    return by_page(boxes.select(*PAGE, "ord", *BOX), kernel, "doc_id long, page_idx int, ord int, x0 double, y0 double, x1 double, y1 double")


def assign_captions(candidates: DataFrame) -> DataFrame:
    """(page keys, ord, object): of the candidates (page keys, ord, object, distance) the nearest pairs first, each box once."""
    met = F.array_sort(F.collect_list(F.struct("distance", "ord", "object")))
    none = F.array().cast("array<struct<distance:double,ord:int,object:int>>")
    taken = lambda held, c: F.exists(held, lambda x: (x["ord"] == c["ord"]) | (x["object"] == c["object"]))
    fold = F.aggregate("met", none, lambda held, c: F.when(taken(held, c), held).otherwise(F.concat(held, F.array(c))))
    return candidates.groupBy(*PAGE).agg(met.alias("met")).select(*PAGE, F.explode(fold).alias("c")).select(*PAGE, "c.ord", "c.object")


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, depth_x, depth_y, place): reading order by how many boxes stand to the left of one, then above it.

    A box's depth is one more than that of the nearest box that hides it from the
    page's left, or upper, edge.
    """

    def depth(b: np.ndarray, near: int, far: int, low: int, high: int) -> np.ndarray:
        hides = (b[:, far] <= b[:, None, near]) & (np.minimum(b[:, high], b[:, None, high]) > np.maximum(b[:, low], b[:, None, low]))
        behind, last = hides.any(axis=1).tolist(), np.where(hides, b[:, far], -np.inf).argmax(axis=1).tolist()
        out = [0] * len(b)
        for i in np.argsort(b[:, near], kind="stable").tolist():
            if behind[i]:
                out[i] = out[last[i]] + 1
        return np.array(out)

    def kernel(page: Page) -> list:
        b = page.boxes
        x, y = depth(b, 0, 2, 1, 3), depth(b, 1, 3, 0, 2)
        order = np.lexsort((y, x))
        return [page["ord"][order], x[order], y[order], np.arange(1, len(b) + 1)]

    return by_page(boxes.select(*PAGE, "ord", *BOX), kernel, "doc_id long, page_idx int, ord int, depth_x int, depth_y int, place int")


def xy_cut(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, layout, label): the part of the page's layout that each box is in, in reading order.

    A page is cut where no box stands: across it first, then down each part, and
    so on within each. label says how the innermost part is ordered: V for boxes
    below one another, H beside one another, U where they cannot be told apart.
    """

    def gaps(b: list, idx: list[int], low: int, high: int) -> list[list[int]]:
        order = sorted(idx, key=lambda i: b[i][low])
        cut, end = [[order[0]]], b[order[0]][high]
        for i in order[1:]:
            if b[i][low] >= end:
                cut.append([])
            cut[-1].append(i)
            end = max(end, b[i][high])
        return cut

    def parts(b: list, idx: list[int]) -> list[tuple[list[int], str]]:
        if len(idx) == 1:
            return [(idx, "V")]
        for low, high, label in ((1, 3, "V"), (0, 2, "H")):
            cut = gaps(b, idx, low, high)
            if len(cut) > 1:
                if all(len(c) == 1 for c in cut):
                    return [([i for c in cut for i in c], label)]
                return [p for c in cut for p in parts(b, c)]
        return [(idx, "U")]

    def kernel(page: Page) -> list:
        b = page.boxes.tolist()
        rows = [(i, n, label) for n, (idx, label) in enumerate(parts(b, list(range(len(b))))) for i in idx]
        place, layout, label = zip(*rows)
        return [page["ord"][list(place)], list(layout), list(label)]

    return by_page(boxes.select(*PAGE, "ord", *BOX), kernel, "doc_id long, page_idx int, ord int, layout int, label string")


def sort_text_boxes(boxes: DataFrame, band: float = 10.0) -> DataFrame:
    """(page keys, ord, place): boxes down the page, those of nearly one height from left to right.

    Boxes are taken by y0, x0 and ord, and each is put into the list of those before
    it: behind the last one that is not to its right at nearly the same height.
    """
    rows = F.array_sort(F.collect_list(F.struct("y0", "x0", "ord")))
    none = F.array().cast("array<struct<y0:double,x0:double,ord:int>>")

    def put(held, box):
        stays = lambda i: ~((F.abs(box["y0"] - F.get(held, i - 1)["y0"]) < band) & (box["x0"] < F.get(held, i - 1)["x0"]))
        places = F.filter(F.sequence(F.lit(1), F.size(held)), stays)
        at = F.when(F.size(held) == 0, 0).otherwise(F.coalesce(F.array_max(places), F.lit(0)))
        return F.concat(F.slice(held, F.lit(1), at), F.array(box), F.slice(held, at + 1, F.size(held)))

    listed = boxes.groupBy(*PAGE).agg(rows.alias("rows")).select(*PAGE, F.posexplode(F.aggregate("rows", none, put)).alias("at", "b"))
    return listed.select(*PAGE, "b.ord", (F.col("at") + 1).alias("place"))


def touching_groups(boxes: DataFrame) -> DataFrame:
    """(page keys, ord, grp): boxes that touch, directly or over others, share the least ord among them."""

    def kernel(page: Page) -> list:
        b = page.boxes
        if len(b) == 1:
            return [page["ord"], page["ord"]]
        label = np.arange(len(b))
        touch = (b[:, None, 0] <= b[None, :, 2]) & (b[None, :, 0] <= b[:, None, 2]) & (b[:, None, 1] <= b[None, :, 3]) & (b[None, :, 1] <= b[:, None, 3])
        touch[label, label] = True
        while True:
            new = np.where(touch, label[None, :], len(b)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [page["ord"], page["ord"][label]]

    return by_page(boxes.select(*PAGE, "ord", *BOX), kernel, "doc_id long, page_idx int, ord int, grp int")


def analyse_pages(pages: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Detections of a page model that the caller brings: from a batch of pages to one of detections."""

    def run(batches):
        for batch in batches:
            yield model(batch)

    return pages.mapInPandas(run, schema)
