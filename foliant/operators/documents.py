"""Document statistics and the decision whether a document holds text or scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .detections import PAGE, pairs

#: Limits of the classification rules.
SCAN_AREA, SCAN_PAGES, FIRST_PAGES = 0.5, 0.5, 50
TEXT_ON_PAGE, MEAN_TEXT = 100, 100
GARBLED = 0.05


def page_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text_len, n_lines, n_vert, n_horz, n_garbled): what each page's lines hold."""
    vertical = (F.col("x1") - F.col("x0")) < (F.col("y1") - F.col("y0"))
    return lines.groupBy(*PAGE).agg(
        F.sum(F.char_length("text")).cast("long").alias("text_len"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(vertical).alias("n_vert"),
        F.count_if(~vertical).alias("n_horz"),
        F.sum(F.regexp_count("text", F.lit(r"\(cid:\d+\)"))).cast("long").alias("n_garbled"),
    )


def first_mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value; of equally frequent ones that which comes first by order."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("first"), value)).alias("best"))
    return best.select(key, F.col(f"best.{value}").alias(value), "best.n")


def upper_median(values: Column) -> Column:
    """Of the sorted values that at position n // 2."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def top_share(df: DataFrame, keys: list[str], order: list[Column], share: float) -> DataFrame:
    """The first floor(n * share) rows of each key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).withColumn("_n", n).where(F.col("rank") <= F.floor(F.col("_n") * share)).drop("_n")


def junk_objects(images: DataFrame, pages: DataFrame, share: float = 0.5, least: int = 10) -> DataFrame:
    """(doc_id, objid, n): image objects that come on so many pages that they are no content."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    counts = images.groupBy("doc_id", "objid").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, "doc_id").where(F.col("n") >= F.greatest(F.col("pages") * share, F.lit(least))).select("doc_id", "objid", "n")


def image_area(images: DataFrame, page_area: float) -> DataFrame:
    """(doc_id, page_idx, ratio, n_images): the largest image's share of each page."""
    return images.groupBy(*PAGE).agg((F.max(g.area(g.box())) / page_area).alias("ratio"), F.count(F.lit(1)).alias("n_images"))


def strip_pages(images: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """(doc_id, page_idx): pages with five narrow strips or more that are four fifths of their images."""
    b = g.box()
    w, h = b.x1 - b.x0, b.y1 - b.y0
    strip = ((w >= 0.1 * page_w) & (h * 4 <= w)) | ((h >= 0.1 * page_h) & (w * 4 <= h))
    found = images.groupBy(*PAGE).agg(F.count_if(strip).alias("strips"), F.count(F.lit(1)).alias("n"))
    return found.where((F.col("strips") >= 5) & (F.col("strips") >= 0.8 * F.col("n"))).select(*PAGE)


def merge_strips(images: DataFrame, page_w: float) -> DataFrame:
    """(doc_id, page_idx, strips): images down the page, those of full width folded into the one above if they meet it.

    The fold looks at the merged box, so it is an aggregate over the sorted array.
    """
    box_type = "array<struct<y0:double,x0:double,y1:double,x1:double>>"
    sorted_ = F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "x1")))

    def fold(acc, b):
        last = F.element_at(acc, -1)
        wide = (b["x1"] - b["x0"] >= 0.9 * page_w) & (last["x1"] - last["x0"] >= 0.9 * page_w)
        meets = wide & (F.abs(b["x0"] - last["x0"]) < 5) & (F.abs(b["x1"] - last["x1"]) < 5) & (b["y0"] - last["y1"] <= 2)
        grown = F.struct(last["y0"].alias("y0"), F.least(last["x0"], b["x0"]).alias("x0"), F.greatest(last["y1"], b["y1"]).alias("y1"), F.greatest(last["x1"], b["x1"]).alias("x1"))
        return F.when((F.size(acc) > 0) & meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(b)))

    return images.groupBy(*PAGE).agg(F.aggregate(sorted_, F.array().cast(box_type), fold).alias("strips"))


def classify(pages: DataFrame, images: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """One row per document: the verdict of each rule, the parse mode, and whether the rules disagree.

    A document is parsed as text if all rules speak for it, else as scans. pages is
    from page_stats(); documents without images have none.
    """
    doc = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.bool_or(F.col("text_len") > TEXT_ON_PAGE).alias("by_text_len"),
        (F.bround(F.avg("text_len"), 0) > MEAN_TEXT).alias("by_mean_text"),
        F.sum("n_vert").alias("vert"),
        F.sum("n_horz").alias("horz"),
        (F.sum("n_garbled") / F.greatest(F.sum("text_len"), F.lit(1)) <= GARBLED).alias("by_characters"),
    )
    lone = images.join(images.groupBy("doc_id", "objid").agg(F.count(F.lit(1)).alias("uses")).where("uses < 2").select("doc_id", "objid"), ["doc_id", "objid"], "left_semi")
    large = image_area(lone, page_w * page_h).where((F.col("page_idx") < FIRST_PAGES) & (F.col("ratio") > SCAN_AREA)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("large"))
    per_page = images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    top = top_share(per_page, ["doc_id"], [F.col("n").desc(), F.col("page_idx")], 0.8)
    counts = per_page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("with_images"), F.max("n").alias("most"))
    counts = counts.join(top.groupBy("doc_id").agg((F.min("n") == F.max("n")).alias("equal")), "doc_id", "left")
    strips = strip_pages(images, page_w, page_h).groupBy("doc_id").agg(F.count(F.lit(1)).alias("strip_pages"))
    df = reduce(lambda a, b: a.join(b, "doc_id", "left"), [large, counts, strips], doc)
    zero = F.lit(0)
    rules = {
        "by_image_area": F.coalesce("large", zero) < SCAN_PAGES * F.least("pages", F.lit(FIRST_PAGES)),
        "by_text_len": F.col("by_text_len"),
        "by_mean_text": F.col("by_mean_text"),
        "by_image_count": ~((F.coalesce("with_images", zero) <= 1) & F.coalesce("equal", F.lit(True)) & (F.coalesce("most", zero) >= 10)),
        "by_direction": (F.col("vert") + F.col("horz") > 0) & (F.col("vert") < 0.5 * (F.col("vert") + F.col("horz"))),
        "by_strips": F.coalesce("strip_pages", zero) < 0.5 * F.col("pages"),
        "by_characters": F.col("by_characters"),
    }
    df = df.select("doc_id", "pages", *[rule.alias(name) for name, rule in rules.items()])
    every = reduce(lambda a, b: a & b, map(F.col, rules))
    some = reduce(lambda a, b: a | b, map(F.col, rules))
    return df.withColumn("parse_type", F.when(every, "txt").otherwise("ocr")).withColumn("mixed", some & ~every)


def usable(meta: DataFrame) -> DataFrame:
    """meta with drop_reason: why a document cannot be parsed, or null."""
    reason = F.when(F.col("needs_password"), "needs_password").when(F.col("is_encrypted"), "encrypted").when(F.col("total_page") == 0, "empty")
    return meta.withColumn("drop_reason", reason)


def frequent_boxes(lines: DataFrame, page_h: float, band: float = 0.25, least: int = 2, top: int = 3) -> DataFrame:
    """(doc_id, band, x0, y0, x1, y1, n, rank): boxes that recur in a document's upper or lower band."""
    where = F.when(F.col("y1") <= band * page_h, "header").when(F.col("y0") >= (1 - band) * page_h, "footer")
    counts = lines.withColumn("band", where).where("band is not null").groupBy("doc_id", "band", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("doc_id", "band").orderBy(F.col("n").desc(), "y0", "x0", "x1", "y1"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def flagged(lines: DataFrame, boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """lines with flag: header or footer where their box is, within the tolerance, one that recurs."""
    b = boxes.select(F.col("doc_id").alias("b_doc"), "band", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = reduce(lambda x, y: x & y, [F.abs(F.col(c) - F.col(f"b_{c}")) < tolerance for c in ("x0", "y0", "x1", "y1")])
    hits = lines.join(b, (F.col("doc_id") == F.col("b_doc")) & near).groupBy("doc_id", "line_no").agg(F.min("band").alias("flag"))
    return lines.join(hits, ["doc_id", "line_no"], "left")


def position_groups(boxes: DataFrame, share: float = 0.9, least: int = 3, part: int | None = 4) -> DataFrame:
    """(doc_id, page_idx, ord, n): boxes that lie, by IoU, where boxes of at least max(least, pages // part) other pages of the document do, or of least other ones without a part.

    A document has pages up to the last one with a box.
    """
    a, b = g.box("a."), g.box("b.")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_idx") != F.col("b.page_idx")) & (g.iou(a, b) >= share)
    found = boxes.alias("a").join(boxes.alias("b"), on).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "ord")]).agg(F.count_distinct("b.page_idx").alias("n"))
    if part is None:
        return found.where(F.col("n") >= least)
    needed = boxes.groupBy("doc_id").agg(F.greatest(F.lit(least), F.floor((F.max("page_idx") + 1) / part)).alias("needed"))
    return found.join(needed, "doc_id").where(F.col("n") >= F.col("needed")).select(*PAGE, "ord", "n")


def watermarks(lines: DataFrame, pages: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, x0, y0, text, n): texts that stand at one place on more than half of a document's pages, for documents of at least `least` pages.

    Counts by a hash of the text, whose rows are narrow, leave few candidates, and texts
    are counted of these only: lines stream past the candidates of their partition, so
    that no task holds or sorts the texts of all lines.
    """
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    often = F.col("n") > F.floor(F.col("pages") / 2)
    place = [F.col("doc_id"), F.col("x0"), F.col("y0")]
    hashed = lines.groupBy(*place, F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least // 2)
    found = hashed.join(total, "doc_id").where(often).select(F.col("doc_id").alias("c_doc"), F.col("x0").alias("c_x0"), F.col("y0").alias("c_y0"), "h", "pages")
    on = (F.col("doc_id") == F.col("c_doc")) & F.col("x0").eqNullSafe(F.col("c_x0")) & F.col("y0").eqNullSafe(F.col("c_y0")) & (F.xxhash64("text") == F.col("h"))
    same = lines.join(found.hint("shuffle_hash"), on).groupBy(*place, "text", "pages").agg(F.count(F.lit(1)).alias("n"))
    return same.where(often).select("doc_id", "x0", "y0", "text", "n")


def main_font(lines: DataFrame) -> DataFrame:
    """(doc_id, font, chars): the font of most characters; of equals the first by name."""
    counts = lines.groupBy("doc_id", "font").agg(F.sum(F.char_length("text")).cast("long").alias("chars"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("chars").desc(), "font")))
    return best.where("k = 1").drop("k")


def block_stats(lines: DataFrame) -> DataFrame:
    """Per page: medians of the line edges, mean character width, font of the widest line."""
    return lines.groupBy(*PAGE).agg(
        F.median("x0").alias("x0_median"),
        F.median("x1").alias("x1_median"),
        F.round(F.try_divide(F.sum(F.col("x1") - F.col("x0")), F.sum(F.char_length(F.regexp_replace("text", r"\s", "")))), 6).alias("char_width"),
        F.max_by("font", F.struct(F.col("x1") - F.col("x0"), -F.col("line_no"))).alias("widest_font"),
    )


def style_modes(lines: DataFrame) -> DataFrame:
    """(doc_id, font, size, n, rank): the two most common styles of a document."""
    counts = lines.groupBy("doc_id", "font", "size").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "font", "size"))
    return counts.withColumn("rank", rank).where("rank <= 2")


def title_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, mean, spread, threshold): sizes above the threshold are a title's."""
    return lines.groupBy("doc_id").agg(F.round(F.avg("size"), 6).alias("mean"), F.round(F.stddev_pop("size"), 6).alias("spread"), F.round(F.avg("size") + F.stddev_pop("size"), 6).alias("threshold"))


def style_cube(lines: DataFrame) -> DataFrame:
    """Counts by font and size, and by each of them: the grouping sets of a style report."""
    return lines.groupingSets([["font", "size"], ["font"], ["size"]], "font", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def mostly_single_lines(paras: DataFrame, share: float = 0.9, pages: float = 0.1) -> DataFrame:
    """(doc_id, n_pages, single_pages): documents in which too many pages are nearly all one-line paragraphs."""
    per_page = paras.groupBy(*PAGE).agg((F.count_if(F.col("n_lines") == 1) / F.count(F.lit(1))).alias("ratio"))
    docs = per_page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("ratio") > share).alias("single_pages"))
    return docs.where(F.col("single_pages") > pages * F.col("n_pages"))


def column_count(layouts: DataFrame) -> DataFrame:
    """(doc_id, page_idx, columns): the most leaves that any row of a page's layout has side by side."""
    rows = layouts.groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("leaves"))
    return rows.groupBy(*PAGE).agg(F.max("leaves").alias("columns"))


def footnote_regions(text: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Footnotes with real: no more than one block of text stands below them over their middle."""
    a, b = g.box("a."), g.box("b.")
    below = pairs(footnotes, text, (b.y0 >= a.y1) & g.center(a)[0].between(b.x0, b.x1)).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "ord")]).agg(F.count(F.lit(1)).alias("below"))
    return footnotes.join(below, [*PAGE, "ord"], "left").withColumn("real", F.coalesce("below", F.lit(0)) < 2).drop("below")
