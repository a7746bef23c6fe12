"""Rendering of blocks to markdown and to a flat list of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Types of blocks that only the full markdown shows.
PICTURES = ("image", "table")


def block_markdown() -> Column:
    """Markdown of a block (type, text, img_path, caption, body, footnote)."""
    kind, text = F.col("type"), F.col("text")
    image = F.concat(F.lit("![]("), F.coalesce("img_path", F.lit("")), F.lit(")"))
    with_caption = lambda c: F.concat_ws("  \n", c, F.nullif(F.col("caption"), F.lit("")), F.nullif(F.col("footnote"), F.lit("")))
    table = F.concat_ws("  \n", F.nullif(F.col("caption"), F.lit("")), F.coalesce(F.nullif(F.col("body"), F.lit("")), image), F.nullif(F.col("footnote"), F.lit("")))
    return (
        F.when(kind == "title", F.concat(F.lit("# "), t.escape_markdown(text)))
        .when(kind == "interline_equation", F.concat(F.lit("\n$$\n"), text, F.lit("\n$$\n")))
        .when(kind == "image", with_caption(image))
        .when(kind == "table", table)
        .otherwise(t.escape_markdown(text))
    )


def _joined(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The markdown of each key's blocks in order; blank ones go, two spaces end each."""
    shown = blocks.withColumn("md", F.btrim(block_markdown(), F.lit(" \t\n"))).where("md <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_ord", F.concat("md", F.lit("  ")).alias("md")))), lambda s: s["md"])
    return shown.groupBy(*keys).agg(F.array_join(parts, "\n\n").alias("markdown"))


def markdown(blocks: DataFrame, pictures: bool = True) -> DataFrame:
    """(doc_id, markdown) of blocks (doc_id, page_idx, block_ord, type, ...); without pictures, text only."""
    return _joined(blocks if pictures else blocks.where(~F.col("type").isin(*PICTURES)), ["doc_id"])


def pages_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown): by page, numbered over those that show anything."""
    pages = _joined(blocks, ["doc_id", "page_idx"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx")) - 1
    return pages.select("doc_id", number.alias("page_no"), "markdown")


def content_list(blocks: DataFrame) -> DataFrame:
    """One row per block, with the columns that its type has; the others are null."""
    kind = F.col("type")
    only = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "block_ord"))
    return blocks.select(
        "doc_id",
        order.alias("ord"),
        "page_idx",
        F.when(kind == "title", "text").when(kind == "interline_equation", "equation").otherwise(kind).alias("type"),
        only("text", "text", "title", "interline_equation").alias("text"),
        F.when(kind == "title", 1).alias("text_level"),
        F.when(kind == "interline_equation", "latex").alias("text_format"),
        only("img_path", "image", "table").alias("img_path"),
        only("caption", "image").alias("img_caption"),
        only("body", "table").alias("table_body"),
        only("caption", "table").alias("table_caption"),
        only("footnote", "table").alias("table_footnote"),
    )


def drop_pages(blocks: DataFrame, mode: str) -> DataFrame:
    """blocks (with need_drop) under a policy: none keeps all, single_page leaves out marked pages, whole_pdf documents
    with any such page; their rows go, and dropped_documents() names them."""
    if mode == "none":
        return blocks
    if mode == "single_page":
        return blocks.where(~F.col("need_drop"))
    if mode == "whole_pdf":
        return blocks.withColumn("_any", F.bool_or("need_drop").over(Window.partitionBy("doc_id"))).where("not _any").drop("_any")
    raise ValueError(f"unknown drop mode {mode}")


def dropped_documents(blocks: DataFrame) -> DataFrame:
    return blocks.where("need_drop").select("doc_id").distinct()


def line_text(spans: DataFrame) -> DataFrame:
    """(doc_id, page_idx, line, text): spans of a line run together; inline formulas between single dollars, display
    formulas on lines of their own, and spaces between words but not between Chinese ones."""
    kind, content = F.col("type"), F.col("content")
    piece = (
        F.when(kind == "inline_equation", F.concat(F.lit(" $"), content, F.lit("$ ")))
        .when(kind == "interline_equation", F.concat(F.lit("\n$$\n"), content, F.lit("\n$$\n")))
        .when(t.chinese_or_english(content) == "zh", content)
        .otherwise(F.concat(content, F.lit(" ")))
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", piece.alias("p")))), lambda s: s["p"])
    return spans.groupBy("doc_id", "page_idx", "line").agg(F.array_join(parts, "").alias("text"))


def draw_boxes(blocks: DataFrame) -> DataFrame:
    """What an annotated page would show: a colour by type, and the place in reading order."""
    colour = F.create_map(*[F.lit(x) for kv in {"title": "blue", "text": "red", "image": "green", "table": "orange", "interline_equation": "purple"}.items() for x in kv])
    return blocks.select("doc_id", "page_idx", "block_ord", F.coalesce(F.element_at(colour, F.col("type")), F.lit("grey")).alias("colour"), F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("block_ord")).alias("number"))


def to_document(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): all pages of a document as one JSON text."""
    pages = blocks.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("block_ord", "type", "text"))).alias("blocks"))
    return pages.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("page_idx", "blocks")))).alias("json"))
