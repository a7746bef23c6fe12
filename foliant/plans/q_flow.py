"""Queries of lines that move over page ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, neighbours
from ..operators import lines as ln
from ..sources import fixtures as fx
from .q_windows import DOC, RUNS, _coded
from .registry import query

FLOW_STOPS = "('" + "', '".join(flow.STOPS) + "')"

#: Even documents have one block a page, odd ones two. Lines at a page's end have no stop in two of three documents.
_TEXT = "CASE WHEN line_no % 8 = 7 AND doc_id % 3 > 0 THEN rtrim(text, '.') ELSE text END"

MOVED_SQL = f"""{RUNS.replace("WITH ", "WITH RECURSIVE ", 1)},
    l AS MATERIALIZED (SELECT doc_id, page_idx, line_no, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE (line_no % 8) // 4 END AS block_no, x0, x1, trim({_TEXT}) AS t FROM coded),
    s AS (SELECT doc_id, page_idx, bool_or(first_line % 8 = 0) AS starts_list FROM runs GROUP BY ALL),
    e AS (SELECT r.doc_id, r.page_idx, bool_or(last_line = high) AS ends_list FROM runs r JOIN (SELECT doc_id, page_idx, max(line_no) AS high FROM l GROUP BY ALL) h ON r.doc_id = h.doc_id AND r.page_idx = h.page_idx GROUP BY ALL),
    f AS (SELECT doc_id, page_idx, list({{'x0': x0}} ORDER BY line_no) AS ls FROM l WHERE block_no = 0 GROUP BY ALL),
    z AS (SELECT doc_id, page_idx, max(block_no) AS last_block, arg_max(t, line_no) AS t, arg_max(x1, line_no) AS x1 FROM l GROUP BY ALL),
    p AS MATERIALIZED (SELECT z.doc_id, z.page_idx, last_block, t, x1, ls, coalesce(starts_list, false) AS starts_list, coalesce(ends_list, false) AS ends_list,
        CASE WHEN len(list_filter(ls, lambda q: q.x0 <= 72)) = 0 THEN len(ls) ELSE list_position(list_transform(ls, lambda q: q.x0 <= 72), true) - 1 END AS n_lead
        FROM z JOIN f USING (doc_id, page_idx) LEFT JOIN s USING (doc_id, page_idx) LEFT JOIN e USING (doc_id, page_idx)),
    walk(doc_id, page_idx, last_block, t, x1, ends_list, n_first, whole, lead, emptied) AS (
        SELECT doc_id, page_idx, last_block, t, x1, ends_list, len(ls), false, 0::BIGINT, false FROM p WHERE page_idx = 0
        UNION ALL SELECT doc_id, page_idx, last_block, t, x1, ends_list, n, whole, CASE WHEN NOT whole AND listed THEN n_lead ELSE 0 END, whole OR (listed AND n_lead = n) FROM (
            SELECT p.doc_id, p.page_idx, p.last_block, p.t, p.x1, p.ends_list, len(ls) AS n, p.n_lead,
                w.x1 = 540 AND w.t <> '' AND right(w.t, 1) NOT IN {FLOW_STOPS} AND ls[1].x0 = 72 AND NOT (w.emptied AND w.last_block = 0) AS whole,
                w.ends_list AND NOT p.starts_list AND p.n_lead > 0 AND len(list_distinct(list_transform(ls[1:p.n_lead], lambda q: q.x0))) = 1 AS listed
            FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.page_idx = w.page_idx + 1)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, block_no ORDER BY line_no) AS nth FROM l),
    moved AS (SELECT l.*, w.whole AND block_no = 0 AS lines_deleted, block_no = 0 AND (w.whole OR nth <= w.lead) AS cross_page, b.last_block AS goal
        FROM ranked l JOIN walk w ON w.doc_id = l.doc_id AND w.page_idx = l.page_idx LEFT JOIN z b ON b.doc_id = l.doc_id AND b.page_idx = l.page_idx - 1)
    SELECT doc_id, page_idx, block_no, line_no, CASE WHEN cross_page THEN page_idx - 1 ELSE page_idx END AS to_page, CASE WHEN cross_page THEN goal ELSE block_no END AS to_block, cross_page, lines_deleted FROM moved"""


def blocks_of_lines(spark, sf_dir):
    """Lines in blocks, and which pages begin and end with a list, by runs of items."""
    coded = _coded(spark, sf_dir)
    text = F.when((F.col("line_no") % 8 == 7) & (F.col("doc_id") % 3 > 0), F.rtrim("text", F.lit("."))).otherwise(F.col("text"))
    block = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.floor(F.col("line_no") % 8 / 4)).cast("int")
    kind = F.lit("text")
    lines = coded.select(*DOC, "line_no", block.alias("block_no"), kind.alias("type"), kind.alias("first_kind"), kind.alias("last_kind"), "x0", "x1", text.alias("text"), F.lit(72.0).alias("left"), F.lit(540.0).alias("right"))
    ends = coded.groupBy(*DOC).agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    lists = ln.list_runs(coded).join(ends, DOC).groupBy(*DOC).agg(F.bool_or(F.col("first_line") == F.col("low")).alias("starts_list"), F.bool_or(F.col("last_line") == F.col("high")).alias("ends_list"))
    return lines, lists


@query("lines_moved_over_pages", MOVED_SQL)
def lines_moved_over_pages(spark, sf_dir):
    return flow.joined_over_pages(*blocks_of_lines(spark, sf_dir)).select(*DOC, "block_no", "line_no", "to_page", "to_block", "cross_page", "lines_deleted")


_FACE_Y = "((a.y0 < b.y1 AND b.y0 < a.y1) OR (a.y0 = b.y0 AND a.y1 = b.y1))"
_FACE_X = "((a.x0 < b.x1 AND b.x0 < a.x1) OR (a.x0 = b.x0 AND a.x1 = b.x1))"
_TWO = "dets a LEFT JOIN dets b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.ord <> b.ord"


def _pick(rule: str, order: str, name: str) -> str:
    return f"list(b.ord ORDER BY {order}, b.ord) FILTER ({rule})[1] AS {name}".replace("list(", "(list(", 1).replace(")[1]", "))[1]")


_LEFT = f"(b.x1 <= a.x0 AND {_FACE_Y}) OR (b.x1 > a.x0 AND b.x0 < a.x0 AND (a.y0 BETWEEN b.y0 AND b.y1 OR a.y1 BETWEEN b.y0 AND b.y1))"
_RIGHT = f"(b.x0 >= a.x1 AND {_FACE_Y}) OR (b.x1 > a.x0 AND b.x1 < a.x1 AND (b.y0 BETWEEN a.y0 AND a.y1 OR b.y1 BETWEEN a.y0 AND a.y1))"
_TOP, _BOTTOM = f"b.y1 <= a.y0 AND {_FACE_X}", f"b.y0 >= a.y1 AND {_FACE_X}"

DIRECT_SQL = f"""WITH {fx.detections_sql()} SELECT a.doc_id, a.page_idx, a.ord, {_pick(_LEFT, "b.x1 DESC", '"left"')}, {_pick(_RIGHT, "b.x0", '"right"')}, {_pick(_TOP, "b.y1 DESC", "top")}, {_pick(_BOTTOM, "b.y0", "bottom")},
    {_pick(_TOP, "b.y1 DESC, b.x0", "top_from_left")}, {_pick(_TOP, "b.y1 DESC, b.x1 DESC", "top_from_right")}, {_pick(_BOTTOM, "b.y0, b.x0", "bottom_from_left")}, {_pick(_BOTTOM, "b.y0, b.x1 DESC", "bottom_from_right")},
    {_pick("b.x1 <= a.x0", "b.x1 DESC", "left_line")}, {_pick("b.x0 >= a.x1", "b.x0", "right_line")} FROM {_TWO} GROUP BY ALL"""


@query("direct_neighbours", DIRECT_SQL)
def direct_neighbours(spark, sf_dir):
    return neighbours.direct(fx.detections(spark, sf_dir))


def _walk(name: str, parent: str) -> str:
    return f"""{name}(doc_id, page_idx, ord, n) AS (SELECT doc_id, page_idx, ord, 0 FROM parents WHERE {parent} IS NULL
        UNION ALL SELECT p.doc_id, p.page_idx, p.ord, w.n + 1 FROM {name} w JOIN parents p ON p.doc_id = w.doc_id AND p.page_idx = w.page_idx AND p.{parent} = w.ord)"""


DEPTHS_SQL = f"""WITH RECURSIVE {fx.detections_sql()}, parents AS MATERIALIZED (SELECT a.doc_id, a.page_idx, a.ord, {_pick(f"b.x1 <= a.x0 AND {_FACE_Y}", "b.x1 DESC", "px")}, {_pick(_TOP, "b.y1 DESC", "py")} FROM {_TWO} GROUP BY ALL),
    {_walk("xs", "px")}, {_walk("ys", "py")}
    SELECT doc_id, page_idx, ord, xs.n AS idx_x, ys.n AS idx_y FROM xs JOIN ys USING (doc_id, page_idx, ord)"""


@query("box_depths", DEPTHS_SQL)
def box_depths(spark, sf_dir):
    return neighbours.depths(fx.detections(spark, sf_dir))
