"""Cleaning of layout detections: filters, spatial self joins and removals within a page.

Every removal compares boxes of one page only: the page keys are the equi-join
keys, the spatial rule is the residual condition. Rows are told apart by ord, so
equal boxes never stand for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

PAGE = ["doc_id", "page_idx"]

#: Kinds of detections by their number.
CATEGORIES = {0: "title", 1: "text", 2: "abandon", 3: "image_body", 4: "image_caption", 5: "table_body", 6: "table_caption", 7: "table_footnote", 8: "isolated_formula", 9: "formula_caption", 13: "inline_formula", 14: "display_formula", 15: "ocr_text"}
#: Span type of a detection that is a span.
SPAN_TYPES = {3: "image", 5: "table", 13: "inline_equation", 14: "interline_equation", 15: "text"}
#: Thresholds of the rules below.
MIN_SCORE = 0.05
SAME_BOX = 0.9
SAME_BLOCK = 0.8
SPAN_INSIDE = 0.65
ON_ABANDONED = 0.6


def to_page_scale(dets: DataFrame, x_scale: float, y_scale: float) -> DataFrame:
    """Boxes in page points, truncated to whole ones; boxes without extent go."""
    scaled = {c: F.floor(F.col(c) / s).cast("int") for c, s in (("x0", x_scale), ("y0", y_scale), ("x1", x_scale), ("y1", y_scale))}
    return dets.withColumns(scaled).where("x1 > x0 and y1 > y0")


def confident(dets: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return dets.where(F.col("score") > least)


def category_name(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), category)


def by_category(dets: DataFrame, *categories: int) -> DataFrame:
    return dets.where(F.col("category_id").isin(*categories))


def spans_of(dets: DataFrame) -> DataFrame:
    """Detections that are spans, with their type; of equal ones on a page the first stays."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in SPAN_TYPES.items() for x in kv]), F.col("category_id"))
    spans = dets.where(F.col("category_id").isin(*SPAN_TYPES)).withColumn("type", kind)
    same = [*PAGE, "category_id", "score", "x0", "y0", "x1", "y1", "type"]
    return spans.groupBy(*same).agg(F.min("ord").alias("ord"))


def pairs(a: DataFrame, b: DataFrame, rule: Column, kind: str = "inner") -> DataFrame:
    """a joined to b on their page, as a.* and b.*, where rule holds."""
    on = rule
    for k in PAGE:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, kind)


def without_repeats(dets: DataFrame, share: float = SAME_BOX) -> DataFrame:
    """Of layout detections (kinds 0 to 9) that nearly coincide, the less certain go; of equal score, both.

    A detection that equals another in all but its place in the list is no rival.
    """
    a, b = g.box("a."), g.box("b.")
    twin = g.same_box(a, b) & (F.col("a.score") == F.col("b.score")) & (F.col("a.category_id") == F.col("b.category_id"))
    beaten = (F.col("a.ord") != F.col("b.ord")) & (g.iou(a, b) > share) & ~twin & (F.col("a.score") <= F.col("b.score")) & (F.col("a.category_id") <= 9) & (F.col("b.category_id") <= 9)
    return pairs(dets, dets, beaten, "left_anti")


def without_small_inside(boxes: DataFrame, share: float) -> DataFrame:
    """Boxes without those that lie, by more than share of the smaller, on a larger one; of equal ones the later go."""
    a, b = g.box("a."), g.box("b.")
    smaller = (g.area(a) < g.area(b)) | ((g.area(a) == g.area(b)) & (F.col("a.ord") > F.col("b.ord")))
    return pairs(boxes, boxes, (F.col("a.ord") != F.col("b.ord")) & smaller & (g.overlap_of_smaller(a, b) > share), "left_anti")


def without_those_like(boxes: DataFrame, others: DataFrame, share: float = SAME_BLOCK) -> DataFrame:
    """Boxes without those that nearly coincide with one of others."""
    return pairs(boxes, others, g.iou(g.box("a."), g.box("b.")) > share, "left_anti")


def without_those_on(boxes: DataFrame, others: DataFrame, share: float = ON_ABANDONED) -> DataFrame:
    """Boxes without those that lie on one of others by more than share of themselves."""
    return pairs(boxes, others, g.overlap_of_first(g.box("a."), g.box("b.")) > share, "left_anti")


def those_on(boxes: DataFrame, others: DataFrame, share: float, tag: str) -> DataFrame:
    """What without_those_on() leaves out, with a tag that says why."""
    return pairs(boxes, others, g.overlap_of_first(g.box("a."), g.box("b.")) > share, "left_semi").withColumn("tag", F.lit(tag))


def footnotes_among(abandoned: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Abandoned boxes that look like footnotes: wide, not flat, and in the lower half."""
    b = g.box()
    return abandoned.where((b.x1 - b.x0 > page_w / 3) & (b.y1 - b.y0 > 10) & (b.y0 > page_h / 2))


def with_extent(spans: DataFrame) -> DataFrame:
    """Spans that are equations, or have a width and a height."""
    b = g.box()
    flat = g.almost(b.x0, b.x1) | g.almost(b.y0, b.y1)
    return spans.where(F.col("type").isin("inline_equation", "interline_equation") | ~flat)


def replace_text(spans: DataFrame, text_spans: DataFrame) -> DataFrame:
    """The spans that hold no text, and the text spans that the page itself has."""
    return spans.where("type <> 'text'").unionByName(text_spans)


def all_blocks(dets: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Blocks of a page after all removals: titles over text go, text under display formulas goes, what lies on
    abandoned boxes goes, footnotes come back, and small blocks inside larger ones go."""
    body = by_category(dets, 0, 1, 3, 5, 14)
    text, title, formula = by_category(body, 1), by_category(body, 0), by_category(body, 14)
    text = without_those_like(text, formula)
    title = without_those_like(title, text)
    blocks = title.unionByName(text).unionByName(by_category(body, 3, 5, 14))
    abandoned = by_category(dets, 2)
    blocks = without_those_on(blocks, abandoned)
    blocks = blocks.unionByName(footnotes_among(abandoned, page_w, page_h))
    return without_small_inside(blocks, 0.8)


def in_margin(boxes: DataFrame, page_w: float) -> DataFrame:
    return boxes.where(g.on_side(g.box(), F.lit(page_w)))


def thin(boxes: DataFrame, most: float = 1.0) -> DataFrame:
    b = g.box()
    return boxes.where((F.abs(b.x1 - b.x0) <= most) | (F.abs(b.y1 - b.y0) <= most))


def regions(dets: DataFrame, category: int, least: float = 0.3) -> DataFrame:
    """Detections of one kind that are certain enough, in reading order down the page."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")
    return by_category(dets, category).where(F.col("score") >= least).withColumn("region", F.row_number().over(order))


def coloured_strips(rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Filled rectangles that look like the strip under a page's heading."""
    b = g.box()
    mid = F.lit(page_w / 2)
    near = ((b.x0 < mid) & (b.x1 > mid)) | (F.least(F.abs(b.x0 - mid), F.abs(b.x1 - mid)) <= 0.2 * page_w)
    return rects.where((g.area(b) > 100) & near & (b.y1 < 0.3 * page_h) & (b.x1 - b.x0 > 4 * (b.y1 - b.y0)))


def pages_on_colour(rects: DataFrame, text: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Pages whose largest rectangle that holds text is more than a fifth of the width and a tenth of the height."""
    holding = pairs(rects, text, g.contained(g.box("b."), g.box("a.")), "left_semi")
    b = g.box()
    largest = holding.groupBy(*PAGE).agg(F.max_by(F.struct((b.x1 - b.x0).alias("w"), (b.y1 - b.y0).alias("h")), F.struct(g.area(b), -F.col("ord"))).alias("r"))
    return largest.where((F.col("r.w") > 0.2 * page_w) & (F.col("r.h") > 0.1 * page_h)).select(*PAGE)
