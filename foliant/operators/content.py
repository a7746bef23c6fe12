"""What the blocks of a page say: spans put into blocks, blocks into lines and text, text into markdown.

Spans meet blocks once, in a join on their page; all that follows groups within a
page, so that the page's rows stay where that join has put them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from . import lines
from .detections import PAGE, pairs

#: The share of a span that lies on a block that takes it, on one that is discarded, and on a caption.
IN_BLOCK, IN_DISCARDED, IN_PART = 0.6, 0.4, 0.6

BOX = ["x0", "y0", "x1", "y1"]


def filled(blocks: DataFrame, spans: DataFrame, share: float = IN_BLOCK) -> DataFrame:
    """spans (page keys, ord, type, content, box) with block, a struct: of the blocks that hold more than share of a
    span, the one of least place. Spans that none holds go; blocks have a place that no other of their page has."""
    held = pairs(spans, blocks, g.overlap_of_first(g.box("a."), g.box("b.")) > share)
    span = F.struct(*[F.col(f"a.{c}").alias(c) for c in ("type", "content", *BOX)])
    block = F.struct(F.col("b.place").alias("place"), F.col("b.ord").alias("ord"), F.col("b.type").alias("type"), *[F.col(f"b.{c}").alias(c) for c in ("body", "caption_box", "note_box")])
    best = F.min_by(F.struct(span.alias("span"), block.alias("block")), F.col("b.place"))
    first = held.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(best.alias("f"))
    return first.select(*PAGE, "ord", "f.span.*", "f.block")


def _on(corners: Column) -> Column:
    """The span lies on a box given by its corners; never on a null one."""
    # least and greatest pass over nulls, so that a null box would hold everything
    return corners.isNotNull() & F.coalesce(g.overlap_of_first(g.box(), g.Box(*[corners[i] for i in range(4)])) > IN_PART, F.lit(False))


def in_parts(held: DataFrame) -> DataFrame:
    """filled() spans with part: text for blocks of text, titles and equations; body, caption or note in images and tables.

    The body is the first span of the block's type with the very box of its body.
    Of the others those on the caption belong to it, then those on the note; what is
    on neither goes. In text and titles display equations turn into inline ones.
    """
    kind = F.col("block.type")
    picture = kind.isin("image", "table")
    whole = F.coalesce(F.array(*BOX) == F.col("block.body"), F.lit(False)) & (F.col("type") == kind)
    first = F.min(F.when(picture & whole, F.col("ord"))).over(Window.partitionBy(*PAGE, "block.place"))
    part = F.when(~picture, "text").when(F.col("ord") == first, "body").when(_on(F.col("block.caption_box")), "caption").when(_on(F.col("block.note_box")), "note")
    inline = kind.isin("text", "title") & (F.col("type") == "interline_equation")
    return held.withColumn("part", part).where("part is not null").withColumn("type", F.when(inline, "inline_equation").otherwise(F.col("type")))


def part_texts(spans: DataFrame, words: Callable[[Column], Column] = t.escape_markdown) -> DataFrame:
    """(page keys, block, part, text, content, box) of in_parts() spans: their lines down the part, each from left to right.

    Text goes through words, inline formulas stand between single dollars, display
    ones on lines of their own. A space follows every piece of a line but a Chinese
    one, which its whole text tells. content and box are those of the first span.
    """
    keys = [*PAGE, "place", "part"]
    rows = lines.spans_to_lines(spans.withColumn("place", F.col("block.place")), keys)
    kind, content = F.col("type"), F.coalesce("content", F.lit(""))
    piece = F.when(kind == "text", words(content)).when(kind == "inline_equation", F.concat(F.lit(" $"), content, F.lit("$ "))).when(kind == "interline_equation", F.concat(F.lit("\n$$\n"), content, F.lit("\n$$\n"))).otherwise("")
    plain = F.when(kind == "text", F.btrim(content, F.lit(" \t\n\r"))).otherwise("")
    across = F.array_sort(F.collect_list(F.struct("x0", "y0", "ord", piece.alias("piece"), plain.alias("plain"), F.array(*BOX).alias("box"), "content")))
    by_line = rows.groupBy(*keys, "line").agg(across.alias("s"), F.min("block").alias("block"))
    gap = F.when(t.chinese_or_english(F.array_join(F.col("s.plain"), "")) == "zh", "").otherwise(" ")
    run = F.array_join(F.transform(F.filter(F.col("s.piece"), lambda p: p != ""), lambda p: F.concat(p, gap)), "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", run.alias("run")))), lambda l: l["run"]), "")
    first = F.min_by(F.struct(F.col("s")[0]["box"].alias("box"), F.col("s")[0]["content"].alias("content")), "line")
    return by_line.groupBy(*keys).agg(F.min("block").alias("block"), text.alias("text"), first.alias("first")).select(*PAGE, "block", "part", "text", "first.box", "first.content")


def block_texts(parts: DataFrame, path: Callable[[Column, Column], Column]) -> DataFrame:
    """(page keys, place, ord, type, text, caption, note, img_path, latex): one row per block that has any span.

    path(type, box) names the image that a body is cropped to, as in
    text.crop_name(); latex is what a table model made of a table's body.
    """
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    named = parts.withColumn("path", path(F.col("block.type"), F.col("box")))
    out = named.groupBy(*PAGE, "block").agg(of("text", "text").alias("text"), of("caption", "text").alias("caption"), of("note", "text").alias("note"), of("body", "path").alias("img_path"), of("body", "content").alias("content"))
    latex = F.when(F.col("block.type") == "table", F.nullif("content", F.lit("")))
    return out.select(*PAGE, "block.place", "block.ord", "block.type", "text", "caption", "note", "img_path", latex.alias("latex"))


def block_markdown() -> Column:
    """Markdown of a block_texts() row: an image above its caption, a table as its formula or as an image that its caption
    describes, above its notes."""
    kind, none = F.col("type"), F.lit("")
    link = lambda title: F.concat(F.lit("\n!["), title, F.lit("]("), F.col("img_path"), F.lit(")  \n"))
    caption = F.coalesce("caption", none)
    table = F.when(F.col("latex").isNotNull(), F.concat(F.lit("\n\n$\n "), F.col("latex"), F.lit("\n$\n\n"))).otherwise(F.coalesce(link(caption), none))
    return (
        F.when(kind == "title", F.concat(F.lit("# "), F.coalesce("text", none)))
        .when(kind == "image", F.concat(F.coalesce(link(none), none), caption))
        .when(kind == "table", F.concat(table, F.coalesce("note", none)))
        .otherwise(F.coalesce("text", none))
    )


def pages_markdown(blocks: DataFrame, pictures: bool = True) -> DataFrame:
    """(page keys, n_blocks, markdown): the blocks of each page by place; blank ones go, and so do pictures if told so."""
    shown = blocks if pictures else blocks.where(~F.col("type").isin("image", "table"))
    shown = shown.select(*PAGE, "place", F.btrim(block_markdown(), F.lit(" \t\n\r")).alias("md")).where("md <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "md"))), lambda s: F.concat(s["md"], F.lit("  ")))
    return shown.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(parts, "\n\n").alias("markdown"))
