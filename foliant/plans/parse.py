"""The page pipeline: from detections to ordered blocks, with the reason why a page is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import assign, content, kernels, tying
from ..operators import detections as d
from ..operators.settle import settled, steps

BLOCK_TYPES = {0: "title", 1: "text", 2: "text", 3: "image", 5: "table", 14: "interline_equation"}


def parse_pages(dets: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """(page keys, ord, type, layout, label, place, x0, y0, x1, y1): the blocks of each page in reading order.

    Detections are cleaned, blocks of a page drawn apart, cut into a layout, and
    put in the order of layout, then height. What several steps start from is
    computed once and checkpointed.
    """
    kept = settled(d.without_repeats(settled(d.confident(dets))))
    blocks = settled(d.all_blocks(kept, page_w, page_h))
    apart = settled(kernels.separate(blocks))
    kinds = F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() for x in kv])
    typed = apart.join(blocks.select(*d.PAGE, "ord", F.element_at(kinds, F.col("category_id")).alias("type")), [*d.PAGE, "ord"])
    placed = typed.join(kernels.xy_cut(apart), [*d.PAGE, "ord"])
    place = F.row_number().over(Window.partitionBy(*d.PAGE).orderBy("layout", "y0", "x0", "ord"))
    return placed.withColumn("place", place)


def page_status(blocks: DataFrame, columns: int = 2) -> DataFrame:
    """(page keys, n_blocks, need_drop, reason): pages whose layout cannot be told, or that have too many columns, are to be dropped."""
    side_by_side = F.count_if(F.col("label") == "H")
    parts = blocks.groupBy(*d.PAGE, "layout").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("label") == "U").alias("unclear"), side_by_side.alias("columns"))
    df = parts.groupBy(*d.PAGE).agg(F.sum("n").alias("n_blocks"), F.bool_or("unclear").alias("unclear"), F.max("columns").alias("columns"))
    reason = F.when(F.col("unclear"), "complicated_layout").when(F.col("columns") > columns, "too_many_columns")
    return df.select(*d.PAGE, "n_blocks", reason.isNotNull().alias("need_drop"), reason.alias("reason"))


def spans_in_blocks(spans: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans with the block that holds them, and those that none does."""
    return assign.first_container(spans, blocks, 0.6), assign.unassigned(spans, blocks, 0.6)


def blocks_with_parts(dets: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """(page keys, ord, category_id, score, box, type, body, caption_box, note_box): the blocks that all_blocks() keeps, with
    images and tables that reach around their captions and notes. Footnotes count in the layout only; their type is null."""
    none = F.lit(None).cast("array<double>")
    images = tying.images_with_captions(dets).withColumn("note_box", none).withColumn("category_id", F.lit(3))
    tables = tying.tables_with_captions(dets).withColumn("category_id", F.lit(5))
    common = [*d.PAGE, "ord", "category_id", "score"]
    parts = images.unionByName(tables).select(*common, *[F.col("box")[i].alias(c) for i, c in enumerate(content.BOX)], "body", "caption_box", "note_box")
    others = dets.where(~F.col("category_id").isin(3, 5)).select(*common, *content.BOX, *[none.alias(c) for c in ("body", "caption_box", "note_box")])
    kinds = F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() if kv[0] != 2 for x in kv])
    return d.all_blocks(settled(others.unionByName(parts)), page_w, page_h).withColumn("type", F.element_at(kinds, F.col("category_id")))


def by_height(blocks: DataFrame) -> DataFrame:
    """Blocks with their place down the page, for pages of one column."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*d.PAGE).orderBy("y0", "x0", "ord")))


def by_layout(blocks: DataFrame) -> DataFrame:
    """Blocks drawn apart from one another, with their place in the order of the page's layout, then of height."""
    apart = kernels.separate(blocks.select(*d.PAGE, "ord", *content.BOX)).select(*d.PAGE, "ord", *content.BOX)
    layout = kernels.xy_cut(apart).select(*d.PAGE, "ord", "layout")
    drawn = blocks.drop(*content.BOX).join(apart, [*d.PAGE, "ord"]).join(layout, [*d.PAGE, "ord"])
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy(*d.PAGE).orderBy("layout", "y0", "x0", "ord"))).drop("layout")


def page_spans(dets: DataFrame, contents: DataFrame) -> DataFrame:
    """(page keys, ord, type, content, box): detections that are spans, one of those that nearly coincide and none that lies
    on a larger one, with what contents (page keys, ord, content) says of them."""
    spans = settled(d.spans_of(dets))
    certain = spans.join(kernels.drop_repeated_spans(spans), [*d.PAGE, "ord"], "left_semi")
    return d.without_small_inside(settled(certain), d.SPAN_INSIDE).join(contents, [*d.PAGE, "ord"], "left").select(*d.PAGE, "ord", "type", "content", *content.BOX)


def page_contents(dets: DataFrame, contents: DataFrame, path: Callable[[Column, Column], Column], page_w: float, page_h: float, order: Callable[[DataFrame], DataFrame] = by_layout) -> DataFrame:
    """(page keys, place, ord, type, text, caption, note, img_path, latex): what each block of a page says.

    From detections (page keys, ord, category_id, score, box) to content: they are
    cleaned, images and tables take their captions, blocks are drawn up and put in
    order; of two side by side the smaller goes. Spans on abandoned boxes are left
    out, the others go to the first block that holds them. Blocks that hold no span
    have no row; a page without detections has none. What several steps start from is
    computed once and checkpointed, and goes when blocks and spans are done. These stay
    until the driver ends, and so does what order gets, which may keep a frame of it.
    """
    with steps(dets.sparkSession):
        sure = settled(d.confident(dets))
        kept = settled(d.without_repeats(sure))
        with steps(dets.sparkSession):
            placed = settled(order(settled(blocks_with_parts(kept, page_w, page_h), keep=True)))
            blocks = settled(placed.join(kernels.drop_until_apart(placed), [*d.PAGE, "ord"], "left_semi"), keep=True)
        spans = settled(d.without_those_on(page_spans(sure, contents), d.by_category(kept, 2), content.IN_DISCARDED), keep=True)
    held = content.filled(blocks, spans).where("block.type is not null")
    return content.block_texts(content.part_texts(content.in_parts(held)), path)
