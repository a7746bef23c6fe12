"""Rules of the page pipeline beyond the cleaning of detections: side text, rules of tables, headers, captions, fallbacks.

All compare what is on one page, by equi-joins on the page keys, or go along a page
or document by windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .detections import PAGE, pairs
from .kernels import Page, by_page

#: Kinds of the other detector by name, as numbers of ours.
OTHER_KINDS = {"title": 0, "text": 1, "reference": 1, "figure": 3, "figure_caption": 4, "table": 5, "table_caption": 6, "equation": 8, "header": 2, "footer": 2}
#: Words before the number in captions of figures and of tables.
FIGURE_TEXT, TABLE_TEXT = r"(?i)^\s*(?:fig\.?|figure|scheme)", r"(?i)^\s*(?:table\s*\d+|表)"
#: Words that tell a language by how many of them a text has, by language.
STOP_WORDS = {"de": ("der", "die", "und", "ist", "von"), "en": ("the", "of", "and", "is", "to"), "es": ("el", "los", "que", "del", "por"), "fr": ("le", "les", "des", "est", "une")}


def other_category(name: Column) -> Column:
    """Number of a kind of the other detector; null for names it does not have."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in OTHER_KINDS.items() for x in kv]), name)


def from_other_detector(dets: DataFrame) -> DataFrame:
    """Detections (page keys, ord, name, score, box) of the other detector as ours. One without a score is certain."""
    known = dets.withColumn("category_id", other_category(F.col("name"))).where("category_id is not null")
    return known.withColumn("score", F.coalesce("score", F.lit(1.0))).drop("name")


def without_kinds(dets: DataFrame, junk: tuple[int, ...]) -> DataFrame:
    return dets.where(~F.col("category_id").isin(*junk))


def distinct_images(images: DataFrame, junk: DataFrame | None = None) -> DataFrame:
    """Images (page keys, objid, box) once per place, without those that have no area and those of junk objects (doc_id, objid)."""
    seen = images.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(*PAGE, "objid", "x0", "y0", "x1", "y1").distinct()
    return seen if junk is None else seen.join(junk, ["doc_id", "objid"], "left_anti")


def merged_rules(drawings: DataFrame, thick: float = 3.0, row: float = 5.0, gap: float = 5.0) -> DataFrame:
    """(page keys, box, n): horizontal rules, put together from strokes on one row with small gaps.

    A stroke is at most `thick` high; rows are runs by y with steps of at most `row`,
    and on a row a rule ends where the next stroke starts `gap` or more to the right.
    """
    strokes = drawings.where(F.col("y1") - F.col("y0") <= thick).select(*PAGE, "ord", *g.Box._fields)

    def kernel(page: Page) -> list:
        b = page.boxes
        # strokes come by y0, then ord; a row begins where the step is too far
        rows = np.cumsum(np.append(True, ~(np.diff(b[:, 1]) <= row)))
        b = b[np.lexsort((page["ord"], np.where(np.isnan(b[:, 0]), -np.inf, b[:, 0]), rows))]
        rows.sort()
        starts = np.ones(len(b), dtype=bool)
        for a, z in zip(*(lambda at: (at[:-1], at[1:]))(np.append(np.flatnonzero(np.diff(rows, prepend=0)), len(b)).tolist())):
            starts[a + 1 : z] = ~(b[a + 1 : z, 0] - np.fmax.accumulate(b[a : z - 1, 2]) < gap)
        at = np.flatnonzero(starts)
        low, high = np.fmin.reduceat(b, at, axis=0), np.fmax.reduceat(b, at, axis=0)
        return [low[:, 0], low[:, 1], high[:, 2], high[:, 3], np.diff(np.append(at, len(b)))]

    return by_page(strokes, kernel, "doc_id long, page_idx int, x0 double, y0 double, x1 double, y1 double, n long", ("y0", "ord"))


def splitters(rects: DataFrame, solid: DataFrame, page_w: float) -> DataFrame:
    """Filled rectangles across the middle of the page that touch no image or table; a flat one is one point high."""
    across = rects.where((F.col("x0") < page_w / 2) & (F.col("x1") > page_w / 2))
    free = pairs(across, solid, g.touches(g.box("a."), g.box("b.")), "left_anti")
    return free.withColumn("y1", F.when(F.col("y1") <= F.col("y0"), F.col("y0") + 1).otherwise(F.col("y1")))


def layout_inputs(text: DataFrame, images: DataFrame, tables: DataFrame, bars: DataFrame, least: float = 50.0) -> DataFrame:
    """Boxes from which a layout is made: text off the splitters, images of which a side is long enough, and tables."""
    text = pairs(text, bars, g.touches(g.box("a."), g.box("b.")), "left_anti")
    images = images.where((F.col("x1") - F.col("x0") >= least) | (F.col("y1") - F.col("y0") >= least))
    return text.unionByName(images).unionByName(tables)


def rule_footnotes(blocks: DataFrame, page_h: float, pages: int = 3) -> DataFrame:
    """Blocks (page keys, ord, y0, size, font, n_lines, text) low on the first pages that look like footnotes.

    Below six tenths of the page, in smaller type than the document's most frequent
    size, and short or of another font than its main one; not a line in capitals,
    nor one of keywords.
    """
    top = lambda c: F.max_by(c, F.struct("chars", F.col(c))).alias(f"main_{c}")
    by = lambda c: blocks.groupBy("doc_id", c).agg(F.sum(F.char_length("text")).alias("chars")).groupBy("doc_id").agg(top(c))
    df = blocks.where(F.col("page_idx") < pages).join(by("size"), "doc_id").join(by("font"), "doc_id")
    small = (F.col("y0") > 0.6 * page_h) & (F.col("size") < F.col("main_size")) & ((F.col("n_lines") < 5) | (F.col("font") != F.col("main_font")))
    shouted = (F.col("n_lines") == 1) & ((F.upper("text") == F.col("text")) | F.lower("text").contains("keyword"))
    return df.where(small & ~shouted).select(blocks.columns)


def inside_bounds(spans: DataFrame, headers: DataFrame, footers: DataFrame) -> DataFrame:
    """Spans below all headers and above all footers of their page."""
    top = headers.groupBy(*PAGE).agg(F.max("y1").alias("_top"))
    bottom = footers.groupBy(*PAGE).agg(F.min("y0").alias("_bottom"))
    df = spans.join(top, PAGE, "left").join(bottom, PAGE, "left")
    return df.where((F.coalesce(F.col("y0") >= F.col("_top"), F.lit(True))) & F.coalesce(F.col("y1") <= F.col("_bottom"), F.lit(True))).drop("_top", "_bottom")


def without_page_numbers(lines: DataFrame) -> DataFrame:
    """Lines but the last one of a page if it is a lone number."""
    last = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y0"), F.desc("line_no"))) == 1
    return lines.withColumn("_last", last).where(~(F.col("_last") & F.col("text").rlike(r"^\s*\d+\s*$"))).drop("_last")


def side_text(lines: DataFrame, page_w: float, slack: float = 1.0) -> DataFrame:
    """(page keys, block, tag): blocks that are not read along: `rotated` if a line's direction is not level, `vertical` if in a margin and of one-word lines that begin at one x."""
    blocks = lines.groupBy(*PAGE, "block").agg(
        F.bool_or((F.col("dir_x") != 1) | (F.col("dir_y") != 0)).alias("turned"), F.bool_and(~F.btrim("text").contains(" ")).alias("words"),
        (F.max("x0") - F.min("x0") <= slack).alias("aligned"), ((F.max("x1") <= page_w * 0.2) | (F.min("x0") >= page_w * 0.8)).alias("margin"),
    )
    tag = F.when(F.col("turned"), "rotated").when(F.col("margin") & F.col("words") & F.col("aligned"), "vertical")
    return blocks.select(*PAGE, "block", tag.alias("tag")).where("tag is not null")


def blank_blocks(lines: DataFrame, white: int = 0xFFFFFF) -> DataFrame:
    """(page keys, block): blocks whose lines are all empty or in white."""
    blank = (F.btrim("text") == "") | (F.col("colour").bitwiseAND(white) == white)
    return lines.groupBy(*PAGE, "block").agg(F.bool_and(blank).alias("blank")).where("blank").select(*PAGE, "block")


def pseudo_columns(lines: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """(page keys, n, share): pages of many lines, of which at least a share lie wholly beside the line before."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    beside = (F.col("x0") > F.lag("x1").over(w)) | (F.col("x1") < F.lag("x0").over(w))
    found = lines.withColumn("_beside", beside).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_beside").cast("int")).alias("k"))
    part = F.try_divide(F.col("k").cast("double"), F.col("n") - 1)
    return found.where((F.col("n") > least) & (part >= share)).select(*PAGE, "n", F.round(part, 6).alias("share"))


def without_noise(blocks: DataFrame, *flags: str) -> DataFrame:
    """Blocks of which none of the flags is set; one that is not known is not."""
    out = blocks
    for flag in flags:
        out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    return out


def in_layout(blocks: DataFrame, layouts: DataFrame) -> DataFrame:
    """blocks with in_layout: whether some layout box, its ends rounded up, holds it."""
    a, b = g.box("a."), g.box("b.")
    rounded = g.Box(*[F.ceil(c) for c in b])
    held = pairs(blocks, layouts, g.contained(a, rounded), "left_semi").select(*PAGE, "ord", F.lit(True).alias("in_layout"))
    return blocks.join(held, [*PAGE, "ord"], "left").withColumn("in_layout", F.coalesce("in_layout", F.lit(False)))


def blocks_by_type(blocks: DataFrame, types: dict[str, int]) -> DataFrame:
    """(page keys, one array of ords per type)."""
    listed = lambda k: F.sort_array(F.collect_list(F.when(F.col("category_id") == k, F.col("ord"))))
    return blocks.groupBy(*PAGE).agg(*[listed(k).alias(name) for name, k in types.items()])


def same_record(blocks: DataFrame, records: DataFrame, share: float = 0.95) -> DataFrame:
    """(page keys, ord, record): the first record that all but is a block's box."""
    found = pairs(blocks, records, g.overlap_of_smaller(g.box("a."), g.box("b.")) > share)
    return found.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(F.min("b.ord").alias("record"))


def parts_of(blocks: DataFrame, spans: DataFrame, regions: dict[str, DataFrame], share: float = 0.6) -> DataFrame:
    """(page keys, ord, part, span): the spans of blocks of an image or a table.

    The body is the span whose box is the block's; the spans of a region, such as
    the captions, are those that lie on one by more than share, and belong to the
    block that region stands nearest to. What one region has taken is not for later ones.
    """
    same = [*PAGE, "x0", "y0", "x1", "y1"]
    body = blocks.select(*same, "ord").join(spans.select(*same, F.col("ord").alias("span")), same).groupBy(*PAGE, "ord").agg(F.min("span").alias("span"))
    out = body.select(*PAGE, "ord", F.lit("body").alias("part"), "span")
    a, b = g.box("a."), g.box("b.")
    left = spans
    for part, boxes in regions.items():
        near = pairs(boxes, blocks, F.lit(True)).groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(F.min(F.struct(g.distance(a, b), F.col("b.ord").alias("of"))).alias("n"))
        owned = boxes.join(near.select(*PAGE, "ord", "n.of"), [*PAGE, "ord"])
        held = pairs(left, owned, g.overlap_of_first(a, b) > share)
        first = held.groupBy(*[F.col(f"a.{k}").alias(k) for k in PAGE], F.col("a.ord").alias("span")).agg(F.min_by("b.of", "b.ord").alias("ord"))
        out = out.unionByName(first.select(*PAGE, "ord", F.lit(part).alias("part"), "span"))
        left = left.join(first.select(*PAGE, F.col("span").alias("ord")), [*PAGE, "ord"], "left_anti")
    return out


def retyped_in_text(spans: DataFrame, text: DataFrame, share: float = 0.6) -> DataFrame:
    """spans with display equations that lie on a text block as inline ones."""
    on = pairs(spans.where("type = 'interline_equation'"), text, g.overlap_of_first(g.box("a."), g.box("b.")) > share, "left_semi")
    on = on.select(*PAGE, "ord", F.lit("inline_equation").alias("_type"))
    return spans.join(on, [*PAGE, "ord"], "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")


def with_equations(text: DataFrame, equations: DataFrame) -> DataFrame:
    """Text blocks, and each equation as a block of its own, numbered after them."""
    last = text.groupBy(*PAGE).agg(F.max("ord").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord"))
    added = equations.withColumn("_nth", nth).join(last, PAGE, "left").withColumn("ord", F.coalesce("_last", F.lit(0)) + F.col("_nth"))
    return text.withColumn("is_equation", F.lit(False)).unionByName(added.select(*text.columns).withColumn("is_equation", F.lit(True)))


def zipped_by_box(blocks: DataFrame, chars: DataFrame) -> DataFrame:
    """(page keys, ord, other): blocks of two lists that have the same box."""
    same = [*PAGE, "x0", "y0", "x1", "y1"]
    return blocks.select(*same, "ord").join(chars.select(*same, F.col("ord").alias("other")), same).select(*PAGE, "ord", "other")


def resolved(text: DataFrame, images: DataFrame, tables: DataFrame, equations: DataFrame) -> DataFrame:
    """Boxes with tag, where kinds are in each other's way.

    `in_image_or_table` text and equations go with those; `backup` images overlap
    text in part or another image, and are kept for later; null is in nobody's way.
    """
    a, b = g.box("a."), g.box("b.")
    solid = images.unionByName(tables)
    tagged = lambda df, others, rule, tag: pairs(df, others, rule, "left_semi").select(*PAGE, "ord", F.lit(tag).alias("tag"))
    inside = tagged(text, solid, g.contained(a, b), "in_image_or_table").unionByName(tagged(equations, solid, g.touches(a, b), "in_image_or_table"))
    other = (F.col("a.ord") != F.col("b.ord")) & (g.overlap_area(a, b) > 0)
    over_text = (g.overlap_area(a, b) > 0) & ~g.contained(b, a)
    backup = tagged(images, text, over_text, "backup").unionByName(tagged(images, images, other, "backup")).distinct()
    return text.unionByName(solid).unionByName(equations).join(inside.unionByName(backup), [*PAGE, "ord"], "left")


def without_contained(boxes: DataFrame) -> DataFrame:
    """Boxes that lie in no other, of equal ones the first. What holds a box that goes holds what that one holds, so one look settles it."""
    a, b = g.box("a."), g.box("b.")
    beaten = (F.col("a.ord") != F.col("b.ord")) & g.contained(a, b) & (~g.contained(b, a) | (F.col("a.ord") > F.col("b.ord")))
    return pairs(boxes, boxes, beaten, "left_anti")


def captions_by_text(objects: DataFrame, lines: DataFrame, pattern: str, hops: int = 3, reach: float = 20.0) -> DataFrame:
    """(page keys, ord, line_no, hop): for each object the caption among the lines below it, within some hops.

    A hop goes to the nearest line that starts below, within reach, and shares some
    of the width; the first one whose text is as the pattern says is the caption.
    """
    a, b = g.box("a."), g.box("b.")
    at, out = objects.select(*PAGE, "ord", "x0", "y0", "x1", "y1"), None
    for hop in range(1, hops + 1):
        gap = b.y0 - a.y1
        near = F.min(F.struct(gap, F.col("b.line_no"), F.col("b.text"), b.x0, b.y0, b.x1, b.y1)).alias("n")
        found = pairs(at, lines, (gap >= 0) & (gap <= reach) & (g.common_width(a, b) > 0)).groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(near)
        hit = F.col("n.text").rlike(pattern)
        step = found.where(hit).select(*PAGE, "ord", "n.line_no", F.lit(hop).alias("hop"))
        out = step if out is None else out.unionByName(step)
        at = found.where(~hit).select(*PAGE, "ord", "n.x0", "n.y0", "n.x1", "n.y1")
    return out


def level_lines(spans: DataFrame) -> DataFrame:
    """spans (page keys, line, ord, type, box) of one line on one height, that of its first text span, if it has one.

    A display equation beside other spans on its line becomes an inline one, and no
    span starts below its end.
    """
    w = Window.partitionBy(*PAGE, "line")
    text = F.when(F.col("type") == "text", F.struct("x0", "ord", "y0", "y1"))
    first, n = F.min(text).over(w), F.count(F.lit(1)).over(w)
    kind = F.when((F.col("type") == "interline_equation") & (n > 1), "inline_equation").otherwise(F.col("type"))
    df = spans.withColumn("_f", first).withColumn("type", kind)
    df = df.withColumns({"y0": F.coalesce("_f.y0", "y0"), "y1": F.coalesce("_f.y1", "y1")})
    return df.withColumn("y0", F.least("y0", "y1")).drop("_f")


def lists_across_pages(coded: DataFrame, runs: DataFrame, slack: float = 1.0) -> DataFrame:
    """(doc_id, page_idx, line_no): lines that go on with the list in which the page before ends.

    The page before must end in a list run, and this one not begin with an item; its
    leading lines that begin at the first one's x are the list's.
    """
    ends = coded.groupBy(*PAGE).agg(F.max("line_no").alias("last_line"))
    in_list = ends.join(runs.select(*PAGE, "last_line"), [*PAGE, "last_line"], "left_semi").select("doc_id", (F.col("page_idx") + 1).alias("page_idx"))
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    df = coded.withColumn("_x", F.first("x0").over(w)).withColumn("_code", F.first("code").over(w))
    alike = F.abs(F.col("x0") - F.col("_x")) <= slack
    df = df.withColumn("_so_far", F.min(alike.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("_so_far = 1 and _code <> 1").join(in_list, PAGE, "left_semi").select(*PAGE, "line_no")


def sorted_by_layout(placed: DataFrame) -> DataFrame:
    """placed (page keys, ord, container, box) with place: by layout, then row by whole points, then from the left."""
    w = Window.partitionBy(*PAGE).orderBy("container", F.floor("y0"), "x0", "ord")
    return placed.withColumn("place", F.row_number().over(w))


def page_range(pages: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of pages first to last, counted from 0; a negative or missing last is the document's end."""
    rows = pages.where(F.col("page_idx") >= first)
    return rows if last is None or last < 0 else rows.where(F.col("page_idx") <= last)


def sampled_pages(pages: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """n pages of each document, or all if it has fewer, chosen by a hash, so that reruns agree."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "page_idx"))
    w = Window.partitionBy("doc_id").orderBy("_key", "page_idx")
    return pages.withColumn("_key", key).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_key", "_rank")


def language(text: Column, model: Callable[[Column], Column] | None = None) -> Column:
    """Language of a text by a model that the caller brings, else by stop words: "" if empty or without any.

    Control characters are taken out first. Of languages with as many words the first by name counts.
    """
    clean = F.btrim(F.regexp_replace(text, r"[\p{Cntrl}]", " "))
    if model is not None:
        return F.when(clean == "", F.lit("")).otherwise(F.lower(model(clean)))
    words = F.split(F.lower(clean), r"[^\p{L}]+")

    def among(stops):
        return F.size(F.filter(words, lambda w: w.isin(*stops)))

    counts = [F.struct(among(stops).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, stops) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*counts))
    return F.when((clean == "") | (best["n"] == 0), F.lit("")).otherwise(best["name"])


def entity_category(text: Column, votes: Callable[[Column], Column], share: float = 0.5) -> Column:
    """Whether at least a share of the parts of text, cut at separators and without those that are no words, get a vote."""
    parts = F.filter(F.split(text, r"[,;/|&]+|\s+(?:and|und|et|y)\s+"), lambda p: p.rlike(r"\p{L}"))
    return F.when(F.size(parts) == 0, F.lit(False)).otherwise(F.size(F.filter(parts, lambda p: votes(F.btrim(p)))) >= F.size(parts) * share)


def with_fallback(first: DataFrame, second: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of first, but of documents that failed (doc_id) those of second; branch says from where."""
    docs = failed.select("doc_id").distinct()
    kept = first.join(docs, "doc_id", "left_anti").withColumn("branch", F.lit("first"))
    return kept.unionByName(second.join(docs, "doc_id", "left_semi").withColumn("branch", F.lit("second")))


def accepted_latex(text: Column) -> Column:
    """What a table model gives is taken if it comes to its end."""
    return F.rtrim(text).rlike(r"end\{(?:tabular|table)\}$")


def image_links(docs: DataFrame, prefix: str = "images/") -> DataFrame:
    """(doc_id, idx, path, target): images of markdown; a URL stays, a local path is put under prefix with blanks quoted."""
    paths = F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1))
    found = docs.select("doc_id", F.posexplode(paths).alias("idx", "path"))
    local = F.concat(F.lit(prefix), F.replace(F.regexp_replace("path", r"^.*/", ""), F.lit(" "), F.lit("%20")))
    return found.withColumn("target", F.when(F.col("path").rlike("^https?://"), F.col("path")).otherwise(local))


def images_among_lines(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(page keys, place, kind, id): lines in order, and each image before the first line that starts below its top."""
    a, b = g.box("a."), g.box("b.")
    below = pairs(images, lines, b.y0 >= a.y0).groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, "ord")]).agg(F.min("b.line_no").alias("before"))
    at = images.select(*PAGE, "ord").join(below, [*PAGE, "ord"], "left")
    pages = lines.select(*PAGE).distinct()
    rows = lines.select(*PAGE, F.col("line_no").cast("double").alias("at"), F.lit("line").alias("kind"), F.col("line_no").alias("id"))
    rows = rows.unionByName(at.join(pages, PAGE, "left_semi").select(*PAGE, F.coalesce(F.col("before") - 0.5, F.lit(1e9)).alias("at"), F.lit("image").alias("kind"), F.col("ord").alias("id")))
    return rows.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("at", "kind", "id")).alias("place"), "kind", "id")


def inserted(text: Column, target: Column, addition: Column, after: bool = True) -> Column:
    """text with addition behind, or before, the first place of target; at the end if there is none."""
    at = F.position(target, text)
    cut = at + F.char_length(target) - 1 if after else at - 1
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), cut), addition, F.substring(text, cut + 1, F.char_length(text)))).otherwise(F.concat(text, addition))


def crops(boxes: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """(page keys, kind, ords): boxes to be cropped from each page, by kind."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("category_id"))
    known = boxes.withColumn("kind", kind).where("kind is not null")
    return known.groupBy(*PAGE, "kind").agg(F.array_join(F.sort_array(F.collect_list("ord")), ",").alias("ords"))


def text_or(*choices: Column) -> Column:
    """The first of choices that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))
