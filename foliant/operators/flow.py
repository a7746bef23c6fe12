"""Paragraphs and lists that go on over the end of a page: their lines move to the block they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detections import PAGE

#: Characters after which no paragraph goes on, and the kinds of spans that a paragraph may end and begin with.
STOPS = (".", "!", "?", "。", "！", "？", "：", ":", ")", "）", ";")
FLOWING = ("text", "inline_equation")


def alternating(settled: Column, keys: list[str], order: str) -> Column:
    """A flag along rows: settled where that is known, else the opposite of the row before; the first row of keys must be known.

    Functions of one flag compose to a constant or to its opposite, so a row has that
    of the last one known, turned about once for each row since.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.count(F.lit(1)).over(upto) - F.max(F.when(settled.isNotNull(), F.col("_nth"))).over(upto)
    return F.last(settled, ignorenulls=True).over(upto) != (since % 2 == 1)


def _pages(lines: DataFrame) -> DataFrame:
    """One row per page of lines: its first and last block with their outer lines, and the indented lines that it begins with."""
    page, block = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "block_no").orderBy("line_no")
    indented = F.coalesce(F.col("x0") > F.col("left"), F.lit(False)).cast("int")
    df = lines.select("*", F.min("block_no").over(page).alias("_low"), F.max("block_no").over(page).alias("_high"))
    df = df.withColumn("_lead", (F.min(indented).over(block.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.col("block_no") == F.col("_low")))
    first, last = F.col("block_no") == F.col("_low"), F.col("block_no") == F.col("_high")
    lead_x = F.when(F.col("_lead"), F.col("x0"))
    return df.groupBy(*PAGE).agg(
        F.min("_low").alias("first_block"), F.max("_high").alias("last_block"),
        F.min_by(F.struct("type", "first_kind", "x0", "left"), F.when(first, F.col("line_no"))).alias("first"),
        F.max_by(F.struct("type", "last_kind", "x1", "right", "text"), F.when(last, F.col("line_no"))).alias("last"),
        F.count_if(first).alias("n_first"), F.count_if("_lead").alias("n_lead"), (F.min(lead_x) == F.max(lead_x)).alias("even"),
    )


def page_joints(lines: DataFrame, lists: DataFrame) -> DataFrame:
    """(page keys, first_block, to_page, to_block, whole, n_lead): pages whose first block, whole or its first n_lead lines, goes on with the page before.

    See joined_over_pages(). All lines of a document's page ends pass one window by
    document, one row a page.
    """
    pages = _pages(lines).join(lists.select(*PAGE, "starts_list", "ends_list"), PAGE, "left")
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    before = F.struct("page_idx", "last_block", "last", F.coalesce("ends_list", F.lit(False)).alias("ends_list"), (F.col("first_block") == F.col("last_block")).alias("single"))
    df = pages.select("*", F.lag(before).over(w).alias("b"), F.row_number().over(w).alias("_nth"))
    both_text = F.coalesce((F.col("b.page_idx") == F.col("page_idx") - 1) & (F.col("b.last.type") == "text") & (F.col("first.type") == "text"), F.lit(False))
    tail = F.regexp_replace(F.col("b.last.text"), r"^\s+|\s+$", "")
    full = (F.col("b.last.x1") == F.col("b.last.right")) & (F.col("first.x0") == F.col("first.left"))
    goes_on = both_text & F.col("b.last.last_kind").isin(*FLOWING) & F.col("first.first_kind").isin(*FLOWING) & full & (tail != "") & ~F.substring(tail, -1, 1).isin(*STOPS)
    listed = both_text & F.col("b.ends_list") & ~F.coalesce("starts_list", F.lit(False)) & (F.col("n_lead") > 0) & F.col("even")
    df = df.select("*", F.coalesce(goes_on, F.lit(False)).alias("_goes_on"), F.coalesce(listed, F.lit(False)).alias("_listed"))
    # a page's only block that has lost its lines cannot be gone on with
    all_listed = F.col("_listed") & (F.col("n_lead") == F.col("n_first"))
    settled = F.when(all_listed, True).when(~F.col("_goes_on"), False).when(~F.col("b.single"), True)
    df = df.withColumn("_emptied", alternating(settled, ["doc_id"], "page_idx"))
    blocked = F.coalesce(F.lag("_emptied").over(w) & F.col("b.single"), F.lit(False))
    df = df.withColumn("whole", F.col("_goes_on") & ~blocked).where("whole or _listed")
    return df.select(*PAGE, "first_block", F.col("b.page_idx").alias("to_page"), F.col("b.last_block").alias("to_block"), "whole", "n_lead")


def joined_over_pages(lines: DataFrame, lists: DataFrame) -> DataFrame:
    """lines with to_page and to_block, where each belongs, cross_page, whether that is another page, and lines_deleted, whether its block gave all lines away to a paragraph.

    lines has page keys, block_no and line_no, the type of its block, first_kind and
    last_kind of its outer spans, x0, x1, text, and left and right of the layout it
    stands in (null: in none). lists has starts_list and ends_list of pages.

    Page by page, the first block goes to the end of the last block of the page
    before, if both are text, that one's last line reaches its layout's right edge
    exactly with no stop at its end, and the block's first line begins at the left
    edge. Otherwise, if the page before ends in a list and this one does not begin
    with one, the block's leading lines go that are indented, if all are alike. A
    page's only block that lost its lines cannot be gone on with by a paragraph. A
    page without lines parts its neighbours; a line of no text ends a paragraph.
    """
    joints = page_joints(lines, lists).withColumnRenamed("first_block", "block_no").withColumnRenamed("to_page", "_page").withColumnRenamed("to_block", "_block")
    w = Window.partitionBy(*PAGE, "block_no").orderBy("line_no")
    df = lines.withColumn("_nth", F.row_number().over(w)).join(joints, [*PAGE, "block_no"], "left")
    moves = F.coalesce(F.col("whole") | (F.col("_nth") <= F.col("n_lead")), F.lit(False))
    to = [F.when(moves, F.col(f"_{k}")).otherwise(F.col(own)).alias(f"to_{k}") for k, own in (("page", "page_idx"), ("block", "block_no"))]
    return df.select(*[lines[c] for c in lines.columns if c not in (*PAGE, "block_no")], *PAGE, "block_no", *to, moves.alias("cross_page"), F.coalesce("whole", F.lit(False)).alias("lines_deleted"))
