"""Lines and paragraphs from spans and lines, by window functions within a page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .detections import PAGE

#: Types of spans that stand on a line of their own.
BLOCK_LIKE = ("interline_equation", "image", "table")
#: Characters that end a sentence.
STOPS = (".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；")
SAME_LINE = 0.8


def islands(df: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """df numbered by runs: a run begins at the first row of a key and where starts holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def spans_to_lines(spans: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """spans with line: down the page, a new one begins where a span or the one before stands alone, or where
    their heights overlap by no more than 0.8 of the lower."""
    w = Window.partitionBy(*keys).orderBy("y0", "ord")
    before = g.Box(*[F.col(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    df = spans.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1", "type")])
    df = df.withColumn("starts", F.col("p_type").isNull() | F.col("type").isin(*BLOCK_LIKE) | F.col("p_type").isin(*BLOCK_LIKE) | ~g.same_line(g.box(), before, SAME_LINE))
    df = islands(df, keys, [F.col("y0"), F.col("ord")], F.col("starts"), "line")
    return df.drop("starts", "p_type", *[f"p_{c}" for c in ("x0", "y0", "x1", "y1")])


def line_boxes(lined: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per line: its box, and its spans' ords from left to right."""
    ords = F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord"))), lambda s: s["ord"])
    return lined.groupBy(*keys, "line").agg(*g.union_of(), F.count(F.lit(1)).alias("n_spans"), F.array_join(ords, ",").alias("ords"))


def merge_raw_lines(lines: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """Lines that share both y ends, give or take slack, with the one before them become one, left to right."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "line_no")
    apart = (F.abs(F.col("y0") - F.lag("y0").over(w)) >= slack) | (F.abs(F.col("y1") - F.lag("y1").over(w)) >= slack)
    run = islands(lines.withColumn("apart", apart), keys, [F.col("y0"), F.col("x0"), F.col("line_no")], F.col("apart"), "run")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "line_no", "text"))), lambda s: s["text"])
    return run.groupBy(*keys, "run").agg(*g.union_of(), F.count(F.lit(1)).alias("n"), F.array_join(texts, " ").alias("text"))


def spaced_on_row(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """lines with a space before the text of one that continues the row of the line before."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    same = (F.floor("y0") == F.floor(F.lag("y0").over(w))) & (F.floor("y1") == F.floor(F.lag("y1").over(w)))
    return lines.withColumn("text", F.when(F.coalesce(same, F.lit(False)), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))


def clusters(df: DataFrame, keys: list[str], value: str, eps: float, least: int, name: str) -> DataFrame:
    """Density clusters of one column: runs of values no farther than eps apart; name is null in a run of fewer than least.

    In one dimension, with least up to 2, that is what density clustering gives: a
    value with a neighbour within eps is a core, and cores chain.
    """
    w = Window.partitionBy(*keys).orderBy(value, "line_no")
    df = df.withColumn("_far", F.col(value) - F.lag(value).over(w) > eps)
    df = islands(df, keys, [F.col(value), F.col("line_no")], F.col("_far"), name)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, name))
    return df.withColumn(name, F.when(size >= least, F.col(name))).drop("_far")


def aligned(lines: DataFrame, keys: list[str] = PAGE, eps: float = 3.0) -> DataFrame:
    """lines with left starts and right ends of a cluster drawn to its outermost value."""
    df = clusters(lines, keys, "x0", eps, 2, "_c0")
    df = df.withColumn("x0", F.when(F.col("_c0").isNull(), F.col("x0")).otherwise(F.min("x0").over(Window.partitionBy(*keys, "_c0")))).drop("_c0")
    df = clusters(df, keys, "x1", eps, 2, "_c1")
    return df.withColumn("x1", F.when(F.col("_c1").isNull(), F.col("x1")).otherwise(F.max("x1").over(Window.partitionBy(*keys, "_c1")))).drop("_c1")


def clipped(lines: DataFrame, left: float, right: float) -> DataFrame:
    return lines.withColumns({"x0": F.greatest("x0", F.lit(left)), "x1": F.least("x1", F.lit(right))})


def line_codes(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """lines with code: 1 flush left and beginning like a list item, 4 flush left, 2 indented with a capital, 3 indented."""
    left = F.min("x0").over(Window.partitionBy(*keys))
    item = F.col("text").rlike(r"^[^\p{L}\p{N}]|^\d+\.")
    code = F.when(F.col("x0") == left, F.when(item, 1).otherwise(4)).otherwise(F.when(F.col("text").rlike(r"^\p{Lu}"), 2).otherwise(3))
    return lines.withColumn("code", code)


def list_runs(coded: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, run, first_line, last_line, items): runs of lines of codes 1 to 3 from a 1 on, with a second item or more than the item's line."""
    order = [F.col("line_no")]
    w = Window.partitionBy(*keys).orderBy("line_no")
    inside = F.col("code").isin(1, 2, 3)
    df = coded.withColumn("inside", inside)
    df = islands(df, keys, order, ~(F.col("inside") & F.coalesce(F.lag("inside").over(w), F.lit(False))), "stretch")
    started = F.max((F.col("code") == 1).cast("int")).over(Window.partitionBy(*keys, "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("started", started).where("inside and started = 1")
    runs = df.groupBy(*keys, F.col("stretch").alias("run")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum((F.col("code") == 1).cast("long")).alias("items"), F.count(F.lit(1)).alias("n"))
    return runs.where("items > 1 or n > 1").drop("n")


def segments(lines: DataFrame, runs: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, first_line, last_line, kind): the list runs and the text between them, which together hold every line."""
    ends = lines.groupBy(*keys).agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    w = Window.partitionBy(*keys).orderBy("first_line")
    r = runs.join(ends, keys).withColumn("before", F.coalesce(F.lag("last_line").over(w) + 1, F.col("low")))
    gaps = r.select(*keys, F.col("before").alias("first_line"), (F.col("first_line") - 1).alias("last_line"), F.lit("text").alias("kind"))
    tail = r.groupBy(*keys).agg((F.max("last_line") + 1).alias("first_line"), F.max("high").alias("last_line")).withColumn("kind", F.lit("text"))
    none = ends.join(runs, keys, "left_anti").select(*keys, F.col("low").alias("first_line"), F.col("high").alias("last_line"), F.lit("text").alias("kind"))
    lists = runs.select(*keys, "first_line", "last_line", F.lit("list").alias("kind"))
    return lists.unionByName(gaps).unionByName(tail).unionByName(none).where("first_line <= last_line")


def list_breaks(coded: DataFrame, runs: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, line_no, text): lines of lists of several items, with a paragraph break after each that stands before an item."""
    r = runs.where("items > 1").select(*keys, F.col("first_line").alias("f"), F.col("last_line").alias("l"))
    df = coded.join(r, keys).where("line_no between f and l")
    following = F.lead("code").over(Window.partitionBy(*keys, "f").orderBy("line_no"))
    return df.select(*keys, "line_no", F.when(following == 1, F.concat("text", F.lit("\n\n"))).otherwise(F.col("text")).alias("text"))


def joined_pages(lines: DataFrame, right: float, left: float) -> DataFrame:
    """(doc_id, page_idx, joined): pages whose first line goes on with the paragraph that ends the page before.

    The last line must reach the right edge without a stop at its end, and the first
    begin at the left edge; a page without lines in between breaks the chain.
    """
    w = Window.partitionBy("doc_id", "page_idx")
    ends = lines.groupBy("doc_id", "page_idx").agg(
        F.max_by(F.struct("x1", "text"), "line_no").alias("last"),
        F.min_by(F.struct("x0", "text"), "line_no").alias("first"),
    )
    del w
    o = Window.partitionBy("doc_id").orderBy("page_idx")
    e = ends.withColumn("p", F.lag("last").over(o)).withColumn("p_idx", F.lag("page_idx").over(o))
    tail = F.substring(F.col("p.text"), -1, 1)
    goes_on = (F.col("p_idx") == F.col("page_idx") - 1) & (F.col("p.x1") >= right) & ~tail.isin(*STOPS) & (F.col("first.x0") <= left)
    return e.select("doc_id", "page_idx", F.coalesce(goes_on, F.lit(False)).alias("joined"))


def paragraph_ids(joined: DataFrame) -> DataFrame:
    """joined with chain: pages whose paragraphs go on into one another share a number."""
    return islands(joined, ["doc_id"], [F.col("page_idx")], ~F.col("joined"), "chain")


def centred_runs(lines: DataFrame, middle: float, keys: list[str] = PAGE) -> DataFrame:
    """(keys, first_line, last_line): runs of two lines or more that cross the middle, of nearly equal height, not all flush left."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    df = lines.withColumn("across", (F.col("x0") < middle) & (F.col("x1") > middle)).withColumn("left_edge", F.min("x0").over(Window.partitionBy(*keys)))
    df = islands(df, keys, [F.col("line_no")], ~(F.col("across") & F.coalesce(F.lag("across").over(w), F.lit(False))), "run").where("across")
    runs = df.groupBy(*keys, "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("y1") - F.col("y0")).alias("spread"), F.bool_and(F.col("x0") == F.col("left_edge")).alias("flush"))
    return runs.where("n >= 2 and spread < 2 and not flush").select(*keys, "first_line", "last_line", "n")


def paragraphs(lines: DataFrame, right: float) -> DataFrame:
    """(doc_id, page_idx, para, first_line, n_lines, text): lines up to one that ends short of the right edge or with a stop."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    ends = (F.col("x1") < right) | F.substring("text", -1, 1).isin(*STOPS)
    df = islands(lines.withColumn("ends", ends), PAGE, [F.col("line_no")], F.lag("ends").over(w), "para")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    return df.groupBy(*PAGE, "para").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(texts, " ").alias("text"))


def titles(lines: DataFrame) -> DataFrame:
    """lines with is_title and level, from their own look and that of their neighbours.

    A title is short, begins with a capital, a digit or a numbering, holds few
    punctuation marks and no stop at its end, and is shorter than the line after it.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    n = F.char_length("text")
    dots = F.regexp_count("text", F.lit(r"[\p{Punct}]"))
    numbered = F.col("text").rlike(r"^(?:\d+(?:\.\d+)*|[IVXLC]+)[.)\s]")
    looks = (n > 0) & (n <= 200) & F.col("text").rlike(r"^[\p{Lu}\d]") & (dots < n * 0.1) & ~F.substring("text", -1, 1).isin(".", ",", ";", ":")
    df = lines.withColumn("is_title", looks & (n < F.coalesce(F.char_length(F.lead("text").over(w)), F.lit(0))))
    level = F.when(numbered, F.least(F.lit(3), F.regexp_count(F.regexp_extract("text", r"^(\d+(?:\.\d+)*)", 1), F.lit(r"\d+"))))
    return df.withColumn("level", F.when(F.col("is_title"), F.coalesce(level, F.when(n < 40, 1).when(n < 80, 2).otherwise(3))).cast("int"))


def continued(paras: DataFrame) -> DataFrame:
    """paras (doc_id, page_idx, para, text) with chain: paragraphs that go on with the one before share a number.

    One goes on if the one before ends without a stop and it begins in lower case,
    on the same page or the next that has any.
    """
    w = Window.partitionBy("doc_id").orderBy("page_idx", "para")
    open_ = ~F.substring(F.lag("text").over(w), -1, 1).isin(*STOPS)
    goes_on = F.coalesce(open_ & F.col("text").rlike(r"^\p{Ll}"), F.lit(False))
    return islands(paras.withColumn("goes_on", goes_on), ["doc_id"], [F.col("page_idx"), F.col("para")], ~F.col("goes_on"), "chain").drop("goes_on")
