"""Queries of the page kernels and of the whole page pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign, kernels
from ..operators import detections as d
from ..sources import fixtures as fx
from . import parse
from .q_boxes import AREA_A, AREA_B, BESIDE, CH, CW, DENSE, DETS, IOU, ON
from .registry import query


def _folded(cte: str, boxes: str, rule: str, loser: str) -> str:
    """SQL for boxes but the losers of pairs that meet in order; a list of pairs is folded page by page."""
    return f"""{cte}, boxes AS MATERIALIZED ({boxes}),
    met AS (SELECT a.doc_id, a.page_idx, list({{'i': a.ord, 'j': b.ord, 'loser': {loser}}} ORDER BY a.ord, b.ord) AS p FROM boxes a JOIN boxes b ON {ON} AND a.ord < b.ord AND {rule} GROUP BY ALL),
    lost AS (SELECT doc_id, page_idx, unnest(list_reduce(list_transform(p, lambda x: [x]), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda l: l.loser = x[1].i OR l.loser = x[1].j)) > 0 THEN acc ELSE list_concat(acc, x) END)).loser AS ord FROM met)
    SELECT doc_id, page_idx, ord FROM boxes WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM lost)"""


def _captions_sql(subject: int, kind: int, name: str) -> str:
    apart = f"sqrt(power(greatest(-{CW}, 0), 2) + power(greatest(-{CH}, 0), 2))"
    return f"""{name}_met AS (SELECT a.doc_id, a.page_idx, list({{'ord': a.ord, 'object': b.ord}} ORDER BY {apart}, a.ord, b.ord) AS p
        FROM dets a JOIN dets b ON {ON} AND a.category_id = {subject} AND b.category_id = {kind} AND ({CW} > 0 OR {CH} > 0) AND {apart} <= greatest(a.x1 - a.x0, a.y1 - a.y0) GROUP BY ALL),
    {name} AS (SELECT doc_id, page_idx, c.ord AS ord, c.object AS object FROM (SELECT doc_id, page_idx, unnest(list_reduce(list_transform(p, lambda x: [x]), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda h: h.ord = x[1].ord OR h.object = x[1].object)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS c FROM {name}_met))"""


SORTED_SQL = f"""{DETS}, r AS (SELECT doc_id, page_idx, list({{'y': y0, 'x': x0, 'ord': ord}} ORDER BY y0, x0, ord) AS l FROM dets WHERE category_id = 15 GROUP BY ALL),
    s AS (SELECT doc_id, page_idx, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: list_concat(
        acc[1:coalesce(list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (abs(x[1].y - acc[i].y) < 10 AND x[1].x < acc[i].x))), 0)], x,
        acc[coalesce(list_max(list_filter(range(1, len(acc) + 1), lambda i: NOT (abs(x[1].y - acc[i].y) < 10 AND x[1].x < acc[i].x))), 0) + 1:])) AS l FROM r)
    SELECT doc_id, page_idx, unnest(l).ord AS ord, unnest(range(1, len(l) + 1))::INT AS place FROM s"""


def _depth_sql(name: str, near: str, far: str, low: str, high: str) -> str:
    """SQL for how many boxes stand one before another, up to the page's edge."""
    return f"""{name}_up AS (SELECT doc_id, page_idx, ord, up FROM (SELECT a.doc_id, a.page_idx, a.ord, b.ord AS up, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY b.{far} DESC, b.ord) AS k
        FROM b a JOIN b b ON {ON} AND b.{far} <= a.{near} AND least(b.{high}, a.{high}) > greatest(b.{low}, a.{low})) WHERE k = 1),
    {name} AS (WITH RECURSIVE t AS (SELECT doc_id, page_idx, ord, 0 AS depth FROM b WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM {name}_up)
        UNION ALL SELECT u.doc_id, u.page_idx, u.ord, t.depth + 1 FROM t JOIN {name}_up u ON t.doc_id = u.doc_id AND t.page_idx = u.page_idx AND t.ord = u.up) SELECT * FROM t)"""


@query("spans_without_repeats", _folded(DENSE, "SELECT * FROM dets", f"{IOU} > 0.9", "CASE WHEN a.score < b.score THEN a.ord ELSE b.ord END"))
def spans_without_repeats(spark, sf_dir):
    return kernels.drop_repeated_spans(fx.detections(spark, sf_dir, 60, 80))


@query("blocks_apart", _folded(DETS, "SELECT * FROM dets WHERE category_id IN (0, 1)", f"({BESIDE.format(p='a', q='b')} OR {BESIDE.format(p='b', q='a')})", f"CASE WHEN {AREA_A} <= {AREA_B} THEN a.ord ELSE b.ord END"))
def blocks_apart(spark, sf_dir):
    return kernels.drop_until_apart(d.by_category(fx.detections(spark, sf_dir), 0, 1))


@query("separated_blocks")
def separated_blocks(spark, sf_dir):
    return kernels.separate(d.by_category(fx.detections(spark, sf_dir), 0, 1))


@query("captions_of_images", f"{DETS}, {_captions_sql(3, 4, 'c')} SELECT * FROM c")
def captions_of_images(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return kernels.assign_captions(assign.caption_candidates(d.by_category(dets, 3), d.by_category(dets, 4)))


@query("captions_of_tables", f"""{DETS}, {_captions_sql(5, 6, "c")}, {_captions_sql(5, 7, "n")}
    SELECT d.doc_id, d.page_idx, d.ord, c.object AS caption, n.object AS footnote FROM dets d LEFT JOIN c USING (doc_id, page_idx, ord) LEFT JOIN n ON n.doc_id = d.doc_id AND n.page_idx = d.page_idx AND n.ord = d.ord
    WHERE category_id = 5""")
def captions_of_tables(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    tables = d.by_category(dets, 5)
    captions = kernels.assign_captions(assign.caption_candidates(tables, d.by_category(dets, 6))).withColumnRenamed("object", "caption")
    notes = kernels.assign_captions(assign.caption_candidates(tables, d.by_category(dets, 7))).withColumnRenamed("object", "footnote")
    return tables.join(captions, [*d.PAGE, "ord"], "left").join(notes, [*d.PAGE, "ord"], "left").select(*d.PAGE, "ord", "caption", "footnote")


@query("reading_order", f"""{DETS}, b AS MATERIALIZED (SELECT * FROM dets WHERE category_id IN (0, 1)), {_depth_sql("dx", "x0", "x1", "y0", "y1")}, {_depth_sql("dy", "y0", "y1", "x0", "x1")}
    SELECT doc_id, page_idx, ord, dx.depth AS depth_x, dy.depth AS depth_y, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY dx.depth, dy.depth, ord)::INT AS place
    FROM b JOIN dx USING (doc_id, page_idx, ord) JOIN dy USING (doc_id, page_idx, ord)""")
def reading_order(spark, sf_dir):
    return kernels.reading_order(d.by_category(fx.detections(spark, sf_dir), 0, 1))


@query("layout_parts")
def layout_parts(spark, sf_dir):
    return kernels.xy_cut(d.by_category(fx.detections(spark, sf_dir), 0, 1))


@query("sorted_text_boxes", SORTED_SQL)
def sorted_text_boxes(spark, sf_dir):
    return kernels.sort_text_boxes(d.by_category(fx.detections(spark, sf_dir), 15))


@query("touching_images", f"""{DETS}, i AS (SELECT doc_id, page_idx, ord, x0, y0, x1, y1 FROM dets WHERE category_id = 3),
    e AS (SELECT a.doc_id, a.page_idx, a.ord, b.ord AS other FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
    r AS (WITH RECURSIVE t AS (SELECT doc_id, page_idx, ord, ord AS seen FROM i UNION SELECT t.doc_id, t.page_idx, t.ord, e.other FROM t JOIN e ON t.doc_id = e.doc_id AND t.page_idx = e.page_idx AND t.seen = e.ord) SELECT * FROM t)
    SELECT doc_id, page_idx, ord, min(seen) AS grp FROM r GROUP BY ALL""")  # fmt: skip
def touching_images(spark, sf_dir):
    return kernels.touching_groups(d.by_category(fx.detections(spark, sf_dir), 3))


@query("parsed_blocks")
def parsed_blocks(spark, sf_dir):
    return parse.parse_pages(fx.detections(spark, sf_dir), fx.PAGE_W, fx.PAGE_H)


@query("page_status")
def page_status(spark, sf_dir):
    return parse.page_status(parse.parse_pages(fx.detections(spark, sf_dir), fx.PAGE_W, fx.PAGE_H))


@query("sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first_ts, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")  # fmt: skip
def sessions(spark, sf_dir):
    ev = fx.read(spark, sf_dir, "events")
    s = ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return s.drop("session_window")
