"""Page evidence derived from the driver's tables, the same in Spark and in DuckDB SQL.

The tables hold no boxes, so detections come from lineitem, lines of text from
documents and images from lineitem, by whole-number arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_W, PAGE_H = 612.0, 792.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def detections(spark: SparkSession, sf_dir: str, across: int = 500, down: int = 700) -> DataFrame:
    """(doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1): about 32 boxes a page, eight pages a document."""
    li = read(spark, sf_dir, "lineitem")
    page = F.floor(F.col("l_orderkey") / 8)
    order = Window.partitionBy(page).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    x0, y0 = (F.col("l_partkey") % across).cast("double"), (F.col("l_suppkey") * 7 % down).cast("double")
    kind = F.col("l_partkey") % 16
    return li.select(
        F.floor(F.col("l_orderkey") / 64).cast("long").alias("doc_id"),
        (page % 8).cast("int").alias("page_idx"),
        F.row_number().over(order).alias("ord"),
        F.when(kind.isin(9, 10, 11, 12), 1).otherwise(kind).cast("int").alias("category_id"),
        F.round(F.col("l_discount") * 10, 1).alias("score"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + F.floor("l_quantity") * 4).cast("double").alias("x1"),
        (y0 + 10 + F.col("l_linenumber") * 6).cast("double").alias("y1"),
    )


def detections_sql(across: int = 500, down: int = 700) -> str:
    return f"""dets AS MATERIALIZED (
    SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS doc_id, CAST(floor(l_orderkey / 8) % 8 AS INT) AS page_idx,
           CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 8)
                ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS ord,
           CAST(CASE WHEN l_partkey % 16 IN (9, 10, 11, 12) THEN 1 ELSE l_partkey % 16 END AS INT) AS category_id,
           round(l_discount * 10, 1) AS score,
           CAST(l_partkey % {across} AS DOUBLE) AS x0, CAST(l_suppkey * 7 % {down} AS DOUBLE) AS y0,
           CAST(l_partkey % {across} + 20 + floor(l_quantity) * 4 AS DOUBLE) AS x1,
           CAST(l_suppkey * 7 % {down} + 10 + l_linenumber * 6 AS DOUBLE) AS y1
    FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str, per_page: int = 8) -> DataFrame:
    """(doc_id, page_idx, line_no, x0, y0, x1, y1, text): the lines of documents, laid out on pages."""
    docs = read(spark, sf_dir, "documents")
    split = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return _laid_out(split, per_page)


def _laid_out(split: DataFrame, per_page: int) -> DataFrame:
    n = F.char_length("text")
    x0 = 72.0 + 18 * (n % 3)
    y0 = 60.0 + 14 * (F.col("line_no") % per_page)
    return split.select(
        "doc_id",
        F.floor(F.col("line_no") / per_page).cast("int").alias("page_idx"),
        "line_no",
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        F.least(F.lit(540.0), x0 + 6 * n).cast("double").alias("x1"),
        (y0 + 12).cast("double").alias("y1"),
        "lang",
        "text",
    )


def lines_sql(per_page: int = 8) -> str:
    return f"""lines AS (
    SELECT doc_id, CAST(floor(line_no / {per_page}) AS INT) AS page_idx, CAST(line_no AS INT) AS line_no,
           CAST(72 + 18 * (length(text) % 3) AS DOUBLE) AS x0, CAST(60 + 14 * (line_no % {per_page}) AS DOUBLE) AS y0,
           CAST(least(540, 72 + 18 * (length(text) % 3) + 6 * length(text)) AS DOUBLE) AS x1,
           CAST(72 + 14 * (line_no % {per_page}) AS DOUBLE) AS y1, lang, text
    FROM (SELECT doc_id, lang, unnest(range(len(parts))) AS line_no, unnest(parts) AS text
          FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)))"""


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_idx, ord, objid, x0, y0, x1, y1): images on pages, with objects that come again."""
    d = detections(spark, sf_dir)
    return d.where("category_id in (3, 5, 13)").select("doc_id", "page_idx", "ord", (F.col("x0") % 37).cast("int").alias("objid"), "x0", "y0", "x1", "y1")


IMAGES_SQL = """images AS (
    SELECT doc_id, page_idx, ord, CAST(x0 % 37 AS INT) AS objid, x0, y0, x1, y1 FROM dets WHERE category_id IN (3, 5, 13))"""


def spans_with_chars(spark: SparkSession, sf_dir: str, wide: int = 12) -> DataFrame:
    """(doc_id, page_idx, block_no, line_no, span_no, block_box, line_box, box, chars): lines of documents in spans of `wide` characters, four lines a block."""
    corners = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"))])
    lns = lines(spark, sf_dir).where("text <> ''").withColumn("block_no", F.floor(F.col("line_no") % 8 / 4).cast("int"))
    # A page's characters weigh far more than its text, so pages are dealt to all cores first.
    lns = lns.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id", "page_idx")
    block = Window.partitionBy("doc_id", "page_idx", "block_no")
    lns = lns.withColumn("block_box", corners(F.min("x0").over(block), F.min("y0").over(block), F.max("x1").over(block), F.max("y1").over(block)))

    def cut(batches):
        for batch in batches:
            texts, (left, top, right, bottom) = batch.column("text").to_pylist(), (batch.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
            sizes = np.array([len(t) for t in texts])
            row = np.repeat(np.arange(len(texts)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x = [left[row] + (nth + k) * (right - left)[row] / sizes[row] for k in (0, 1)]
            starts = np.append(np.flatnonzero(nth % wide == 0), len(row)).astype(np.int32)
            at = row[starts[:-1]]
            chars = pa.StructArray.from_arrays([pa.array([c for t in texts for c in t], pa.string()), *map(pa.array, (x[0], top[row], x[1], bottom[row]))], ["c", "x0", "y0", "x1", "y1"])
            box = [x[0][starts[:-1]], top[at], x[1][starts[1:] - 1], bottom[at]]
            line = [left[at], top[at], right[at], bottom[at]]
            structs = [pa.StructArray.from_arrays([pa.array(v) for v in b], ["x0", "y0", "x1", "y1"]) for b in (line, box)]
            keys = [batch.column(k).take(pa.array(at)) for k in ("doc_id", "page_idx", "block_no", "line_no")]
            spans = [pa.array((nth[starts[:-1]] // wide).astype(np.int32)), batch.column("block_box").take(pa.array(at)), *structs, pa.ListArray.from_arrays(pa.array(starts), chars)]
            yield pa.RecordBatch.from_arrays([*keys, *spans], names=["doc_id", "page_idx", "block_no", "line_no", "span_no", "block_box", "line_box", "box", "chars"])

    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    schema = f"doc_id long, page_idx int, block_no int, line_no int, span_no int, block_box {box}, line_box {box}, box {box}, chars array<struct<c: string, x0: double, y0: double, x1: double, y1: double>>"
    return lns.mapInArrow(cut, schema)


def lines_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_idx, block_no, line_no, x0, y0, x1, y1, text): the lines that spans_with_chars() cuts, whole."""
    block = F.floor(F.col("line_no") % 8 / 4).cast("int")
    return lines(spark, sf_dir).where("text <> ''").select("doc_id", "page_idx", block.alias("block_no"), "line_no", "x0", "y0", "x1", "y1", "text")


def spans_of_page(page: dict, wide: int = 12) -> dict:
    """The spans of spans_with_chars() of a page's lines_in_blocks() in order, as inline.with_formulas_in_lines() takes them."""
    texts, sides = page["text"], [page[c].astype(float) for c in ("x0", "y0", "x1", "y1")]
    left, top, right, bottom = sides
    blocks = np.append(0, np.cumsum(page["block_no"][1:] != page["block_no"][:-1]))
    begins = np.append(0, np.flatnonzero(np.diff(blocks)) + 1)
    around = [f.reduceat(v, begins)[blocks] for f, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), sides)]
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = [left[row] + (nth + k) * (right - left)[row] / sizes[row] for k in (0, 1)]
    starts = np.flatnonzero(nth % wide == 0)
    ends = np.append(starts[1:], len(row))
    at, letters = row[starts], "".join(texts)
    parts = lambda v: [v[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    own = {"line": at, "x0": x[0][starts], "y0": top[at], "x1": x[1][ends - 1], "y1": bottom[at]}
    own |= {"letters": [list(p) for p in parts(letters)], "lefts": parts(x[0]), "tops": parts(top[row]), "rights": parts(x[1]), "bottoms": parts(bottom[row])}
    return own | {f"{of}_{c}": v[at] for of, box in (("line", sides), ("block", around)) for c, v in zip(("x0", "y0", "x1", "y1"), box)}


def inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_idx, ord, latex, x0, y0, x1, y1): up to three formulas over the characters of each line, some between two lines or beyond its end."""
    lns = lines(spark, sf_dir).where("text <> ''")
    w = (F.col("x1") - F.col("x0")) / F.char_length("text")
    spot = lambda n, start, end, down: F.struct(F.lit(n).alias("n"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(down).alias("down"))
    spots = F.array(spot(0, 5.3, 9.6, 1.0), spot(1, 10.2, 14.8, 0.0), spot(2, 17.45, 40.0, 7.0))
    rows = lns.select("*", F.explode(F.slice(spots, (F.col("line_no") % 3 + 1).cast("int"), F.lit(2))).alias("s"))
    return rows.select(
        "doc_id", "page_idx", (F.col("line_no") * 3 + F.col("s.n")).cast("int").alias("ord"), F.concat(F.lit("x_{"), "line_no", F.lit("}")).alias("latex"),
        (F.col("x0") + F.col("s.start") * w).alias("x0"), (F.col("y0") + F.col("s.down")).alias("y0"), (F.col("x0") + F.col("s.end") * w).alias("x1"), (F.col("y1") + F.col("s.down")).alias("y1"),
    )
