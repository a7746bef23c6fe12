"""Joins that assign boxes to boxes of the same page: containment, nearest neighbour, intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .detections import PAGE, pairs
from .kernels import Page, by_page

SIDES = ("left", "right", "top", "bottom")


def first_container(items: DataFrame, containers: DataFrame, share: float) -> DataFrame:
    """items with container: the ord of the first container that holds more than share of them. Others go."""
    found = pairs(items, containers, g.overlap_of_first(g.box("a."), g.box("b.")) > share)
    least = found.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(F.min("b.ord").alias("container"))
    return items.join(least, [*PAGE, "ord"])


def unassigned(items: DataFrame, containers: DataFrame, share: float) -> DataFrame:
    return pairs(items, containers, g.overlap_of_first(g.box("a."), g.box("b.")) > share, "left_anti")


def nearest(items: DataFrame, others: DataFrame, side: str, slack: float = 2.0) -> DataFrame:
    """(page keys, ord, neighbour, gap): the nearest of others on one side of each item.

    A neighbour shares some of the cross axis, may reach over the edge by slack, and
    does not lie inside the item or around it. Ties go to the first.
    """
    a, b = g.box("a."), g.box("b.")
    gap = {"left": a.x0 - b.x1, "right": b.x0 - a.x1, "top": a.y0 - b.y1, "bottom": b.y0 - a.y1}[side]
    across = g.common_height(a, b) if side in ("left", "right") else g.common_width(a, b)
    rule = (F.col("a.ord") != F.col("b.ord")) & (gap >= -slack) & (across > 0) & ~g.contained(a, b) & ~g.contained(b, a)
    best = F.min(F.struct(gap.alias("gap"), F.col("b.ord").alias("neighbour"))).alias("best")
    found = pairs(items, others, rule).groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(best)
    return found.select(*PAGE, "ord", "best.neighbour", "best.gap")


def nearest_by_side(boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """(page keys, ord, side, neighbour, gap): nearest() on each of SIDES, of boxes that are an item to those that are not, in one pass over the pages."""

    def kernel(page: Page) -> list | None:
        item, b, ords = page["item"].astype(bool), page.boxes, page["ord"]
        own, others = np.flatnonzero(item), np.flatnonzero(~item)
        if not (page.keyed and len(own) and len(others)):
            return None
        (ax0, ay0, ax1, ay1), (x0, y0, x1, y1) = (c[:, None] for c in b[own].T), b[others].T
        inside = (ax0 >= x0) & (ay0 >= y0) & (ax1 <= x1) & (ay1 <= y1)
        around = (x0 >= ax0) & (y0 >= ay0) & (x1 <= ax1) & (y1 <= ay1)
        free = ~inside & ~around & (ords[own][:, None] != ords[others])
        beside, upright = free & (np.minimum(ay1, y1) > np.maximum(ay0, y0)), free & (np.minimum(ax1, x1) > np.maximum(ax0, x0))
        gaps = {"left": ax0 - x1, "right": x0 - ax1, "top": ay0 - y1, "bottom": y0 - ay1}
        found = []
        for side in SIDES:
            rule = (gaps[side] >= -slack) & (beside if side in ("left", "right") else upright)
            gap = np.where(rule, gaps[side], np.inf)
            rows, nearest = np.flatnonzero(rule.any(axis=1)), gap.argmin(axis=1)
            found.append((ords[own[rows]], [side] * len(rows), ords[others[nearest[rows]]], gap[rows, nearest[rows]]))
        at, sides, neighbours, least = zip(*found)
        return [np.concatenate(at), [x for part in sides for x in part], np.concatenate(neighbours), np.concatenate(least)]

    return by_page(boxes.select(*PAGE, "ord", "item", "x0", "y0", "x1", "y1"), kernel, "doc_id long, page_idx int, ord int, side string, neighbour int, gap double")


def edge_boxes(boxes: DataFrame, side: str) -> DataFrame:
    """Boxes with no other beyond them on a side."""
    a, b = g.box("a."), g.box("b.")
    beyond = {"left": b.x1 <= a.x0, "right": b.x0 >= a.x1, "top": b.y1 <= a.y0, "bottom": b.y0 >= a.y1}[side]
    across = g.common_height(a, b) if side in ("left", "right") else g.common_width(a, b)
    return pairs(boxes, boxes, (F.col("a.ord") != F.col("b.ord")) & beyond & (across > 0), "left_anti")


def caption_candidates(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(page keys, ord, object, distance, rank): objects beside a subject along an axis, no farther than its longer
    side, by distance. The greedy choice among them is made by kernels.assign_captions()."""
    a, b = g.box("a."), g.box("b.")
    along = (g.common_width(a, b) > 0) | (g.common_height(a, b) > 0)
    apart = g.distance(a, b)
    reach = F.greatest(a.x1 - a.x0, a.y1 - a.y0)
    found = pairs(subjects, objects, along & (apart <= reach)).select(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")], F.col("b.ord").alias("object"), apart.alias("distance"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE, "ord").orderBy("distance", "object")))


def first_overlap(boxes: DataFrame) -> DataFrame:
    """(page keys, ord): of the first pair on each page that stands beside one another too closely, the smaller box."""
    a, b = g.box("a."), g.box("b.")
    rule = (F.col("a.ord") < F.col("b.ord")) & (g.beside_from_left(a, b) | g.beside_from_left(b, a))
    smaller = F.when(g.smaller_is_first(a, b), F.col("a.ord")).otherwise(F.col("b.ord"))
    found = pairs(boxes, boxes, rule).groupBy(*[F.col(f"a.{k}").alias(k) for k in PAGE]).agg(F.min_by(smaller, F.struct(F.col("a.ord"), F.col("b.ord"))).alias("ord"))
    return found.select(*PAGE, "ord")


def subtract_intervals(text: DataFrame, holes: DataFrame, share: float = 0.6) -> DataFrame:
    """(page keys, ord, part, x0, x1): what is left of each text box's x range after the holes on its line are cut out.

    Holes on one line are merged where they meet: sorted by their start, one begins
    a new island if it starts beyond all ends so far. The parts lie between islands.
    """
    a, b = g.box("a."), g.box("b.")
    key = [*PAGE, "ord"]
    cut = pairs(text, holes, (g.y_overlap_of_lower(a, b) > share) & (g.common_width(a, b) > 0))
    cut = cut.select(*[F.col(f"a.{k}").alias(k) for k in key], a.x0.alias("t0"), a.x1.alias("t1"), F.greatest(a.x0, b.x0).alias("h0"), F.least(a.x1, b.x1).alias("h1"))
    order = Window.partitionBy(*key).orderBy("h0", "h1")
    furthest = F.max("h1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = cut.withColumn("new", (furthest.isNull() | (F.col("h0") > furthest)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy(*key, "t0", "t1", "island").agg(F.min("h0").alias("h0"), F.max("h1").alias("h1"))
    by_island = Window.partitionBy(*key).orderBy("island")
    before = islands.select(*key, F.coalesce(F.lag("h1").over(by_island), F.col("t0")).alias("x0"), F.col("h0").alias("x1"))
    after = islands.groupBy(*key).agg(F.max("h1").alias("x0"), F.max("t1").alias("x1"))
    whole = pairs(text, holes, (g.y_overlap_of_lower(a, b) > share) & (g.common_width(a, b) > 0), "left_anti").select(*key, "x0", "x1")
    parts = before.unionByName(after).unionByName(whole).where("x1 > x0")
    return parts.withColumn("part", F.row_number().over(Window.partitionBy(*key).orderBy("x0")))


def chars_in_formulas(chars: DataFrame, formulas: DataFrame, share: float = 0.5) -> DataFrame:
    """Characters without those that lie by more than share of themselves on a formula."""
    return pairs(chars, formulas, g.overlap_of_first(g.box("a."), g.box("b.")) > share, "left_anti")


def rows_below(spans: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Spans that lie below a footnote with their middle over it."""
    a, b = g.box("a."), g.box("b.")
    middle = g.center(a)[0]
    return pairs(spans, footnotes, (a.y0 >= b.y1) & middle.between(b.x0, b.x1), "left_semi")


def grown_to_rules(tables: DataFrame, rules: DataFrame, share: float = 0.1) -> DataFrame:
    """Table boxes grown to the outermost horizontal rules within a tenth of their height of them."""
    a, b = g.box("a."), g.box("b.")
    room = (a.y1 - a.y0) * share
    near = (b.y0 >= a.y0 - room) & (b.y1 <= a.y1 + room) & (g.common_width(a, b) > 0)
    found = pairs(tables, rules, near).groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(F.min("b.x0").alias("r0"), F.min("b.y0").alias("r1"), F.max("b.x1").alias("r2"), F.max("b.y1").alias("r3"))
    grown = tables.join(found, [*PAGE, "ord"], "left")
    return grown.select(*PAGE, "ord", F.least("x0", "r0").alias("x0"), F.least("y0", "r1").alias("y0"), F.greatest("x1", "r2").alias("x1"), F.greatest("y1", "r3").alias("y1"))


def trimmed_to_text(images: DataFrame, text: DataFrame) -> DataFrame:
    """Images cut back where text reaches over their upper or lower edge."""
    a, b = g.box("a."), g.box("b.")
    over = pairs(images, text, (g.common_width(a, b) > 0) & (g.common_height(a, b) > 0) & ~g.contained(a, b) & ~g.contained(b, a))
    top = F.max(F.when((b.y0 < a.y0) & (b.y1 < a.y1), b.y1)).alias("t")
    bottom = F.min(F.when((b.y1 > a.y1) & (b.y0 > a.y0), b.y0)).alias("u")
    edges = over.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(top, bottom)
    cut = images.join(edges, [*PAGE, "ord"], "left")
    return cut.select(*PAGE, "ord", "x0", F.greatest("y0", "t").alias("y0"), "x1", F.least("y1", "u").alias("y1")).where("y1 > y0")
