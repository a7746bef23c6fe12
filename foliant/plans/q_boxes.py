"""Queries of the box operators: predicates, filters, spatial joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign, detections as d
from ..sources import fixtures as fx
from .registry import query

DETS = "WITH " + fx.detections_sql()
DENSE = "WITH " + fx.detections_sql(60, 80)
ROW = "doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1"
ON = "a.doc_id = b.doc_id AND a.page_idx = b.page_idx"
CW = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))"
CH = "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
BOTH = f"(greatest({CW}, 0) * greatest({CH}, 0))"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
IOU = f"({BOTH} / ({AREA_A} + {AREA_B} - {BOTH}))"
MIN_RATIO, FIRST_RATIO = f"({BOTH} / least({AREA_A}, {AREA_B}))", f"({BOTH} / {AREA_A})"


def A_STAR(cols: str = ROW) -> str:
    return ", ".join(f"a.{c.strip()}" for c in cols.split(","))


@query(
    "box_predicates",
    f"""{DETS}, p AS (
    SELECT doc_id, page_idx, ord, x0, y0, x1, y1, lead(x0) OVER w AS u0, lead(y0) OVER w AS v0, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1
    FROM dets WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY ord)),
q AS (SELECT a.doc_id, a.page_idx, a.ord, a.x0, a.y0, a.x1, a.y1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, {BOTH} AS both_area, {CW} AS cw, {CH} AS ch
      FROM p a JOIN (SELECT doc_id, page_idx, ord, u0 AS x0, v0 AS y0, u1 AS x1, v1 AS y1 FROM p WHERE u0 IS NOT NULL) b ON {ON} AND a.ord = b.ord)
SELECT doc_id, page_idx, ord, cw >= 0 AND ch >= 0 AS touches, x0 >= bx0 AND y0 >= by0 AND x1 <= bx1 AND y1 <= by1 AS contained,
       cw >= 0 AND ch >= 0 AND NOT (x0 >= bx0 AND y0 >= by0 AND x1 <= bx1 AND y1 <= by1) AS partly,
       round(both_area / ((x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) - both_area), 6) AS iou,
       round(both_area / least((x1 - x0) * (y1 - y0), (bx1 - bx0) * (by1 - by0)), 6) AS of_smaller,
       round(both_area / ((x1 - x0) * (y1 - y0)), 6) AS of_first,
       round(greatest(ch, 0) / least(y1 - y0, by1 - by0), 6) AS y_share, round(greatest(cw, 0) / (bx1 - bx0), 6) AS x_share,
       round(sqrt(power(greatest(-cw, 0), 2) + power(greatest(-ch, 0), 2)), 6) AS distance,
       bx1 < x0 AS is_left, x1 < bx0 AS is_right, by1 < y0 AS is_below, y1 < by0 AS is_above,
       bx0 < x0 AND x0 < bx1 AND bx1 < x1 AND (by0 BETWEEN y0 AND y1 OR by1 BETWEEN y0 AND y1) AS left_crossing,
       x0 < bx0 AND bx0 < x1 AND x1 < bx1 AND (by0 BETWEEN y0 AND y1 OR by1 BETWEEN y0 AND y1) AS right_crossing,
       bx0 BETWEEN x0 AND x1 AND ch > 0 AND (ch >= 0.5 * (y1 - y0) OR ch >= 0.5 * (by1 - by0)) AS beside,
       ((x0 >= bx0 - 2 AND x1 <= bx1 + 2) OR (bx0 >= x0 - 2 AND bx1 <= x1 + 2)) AND ch >= 0 AS stacked,
       ((x0 >= bx0 - 2 AND x1 <= bx1 + 2) OR (bx0 >= x0 - 2 AND bx1 <= x1 + 2)) AND ch >= 0 AND y1 > by0 AND y1 - by0 < 2 AS bottoms_onto,
       (least(x1 - x0, y1 - y0) <= 3 OR greatest(x1 - x0, y1 - y0) >= 30 * least(x1 - x0, y1 - y0)) AS is_rule,
       (x1 <= 122.4 OR x0 >= 489.6) AS on_side, (x1 - x0) * (y1 - y0) <= (bx1 - bx0) * (by1 - by0) AS first_smaller
FROM q""",
)
def box_predicates(spark, sf_dir):
    w = Window.partitionBy(*d.PAGE).orderBy("ord")
    p = fx.detections(spark, sf_dir)
    p = p.select("*", *[F.lead(c).over(w).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).where("b_x0 is not null")
    a, b = g.box(), g.box("b")
    pos = g.relative_position(a, b)
    return p.select(
        *d.PAGE, "ord", g.touches(a, b).alias("touches"), g.contained(a, b).alias("contained"), g.partly_overlaps(a, b).alias("partly"),
        F.round(g.iou(a, b), 6).alias("iou"), F.round(g.overlap_of_smaller(a, b), 6).alias("of_smaller"), F.round(g.overlap_of_first(a, b), 6).alias("of_first"),
        F.round(g.y_overlap_of_lower(a, b), 6).alias("y_share"), F.round(g.x_overlap_of(a, b), 6).alias("x_share"), F.round(g.distance(a, b), 6).alias("distance"),
        pos["left"].alias("is_left"), pos["right"].alias("is_right"), pos["bottom"].alias("is_below"), pos["top"].alias("is_above"),
        g.left_crossing(a, b).alias("left_crossing"), g.right_crossing(a, b).alias("right_crossing"), g.beside_from_left(a, b).alias("beside"),
        g.stacked(a, b).alias("stacked"), g.bottoms_onto(a, b).alias("bottoms_onto"), g.is_rule(a).alias("is_rule"), g.on_side(a, F.lit(fx.PAGE_W)).alias("on_side"),
        g.smaller_is_first(a, b).alias("first_smaller"),
    )


@query("page_scale", f"""{DETS} SELECT doc_id, page_idx, ord, category_id, score, CAST(floor(x0 / 2.5) AS INT) AS x0, CAST(floor(y0 / 2.4) AS INT) AS y0,
    CAST(floor(x1 / 2.5) AS INT) AS x1, CAST(floor(y1 / 2.4) AS INT) AS y1 FROM dets WHERE floor(x1 / 2.5) > floor(x0 / 2.5) AND floor(y1 / 2.4) > floor(y0 / 2.4)""")  # fmt: skip
def page_scale(spark, sf_dir):
    return d.to_page_scale(fx.detections(spark, sf_dir), 2.5, 2.4)


@query("confident_detections", f"{DETS} SELECT {ROW} FROM dets WHERE score > 0.05")
def confident_detections(spark, sf_dir):
    return d.confident(fx.detections(spark, sf_dir))


@query("category_counts", f"""{DETS} SELECT CASE category_id {" ".join(f"WHEN {k} THEN '{v}'" for k, v in d.CATEGORIES.items())} END AS category, count(*) AS n, sum(CASE WHEN category_id IN (8, 13, 14) THEN 1 ELSE 0 END)::BIGINT AS equations FROM dets GROUP BY 1""")
def category_counts(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return dets.groupBy(d.category_name(F.col("category_id")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("category_id").isin(8, 13, 14).cast("long")).alias("equations"))


@query("spans_of_detections", f"""{DENSE} SELECT doc_id, page_idx, category_id, score, x0, y0, x1, y1,
    CASE category_id {" ".join(f"WHEN {k} THEN '{v}'" for k, v in d.SPAN_TYPES.items())} END AS type, min(ord) AS ord
    FROM dets WHERE category_id IN (3, 5, 13, 14, 15) GROUP BY ALL""")  # fmt: skip
def spans_of_detections(spark, sf_dir):
    return d.spans_of(fx.detections(spark, sf_dir, 60, 80))


@query("without_repeated_boxes", f"""{DENSE} SELECT {A_STAR()} FROM dets a WHERE NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND a.ord <> b.ord AND {IOU} > 0.9
    AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.score = b.score AND a.category_id = b.category_id)
    AND a.score <= b.score AND a.category_id <= 9 AND b.category_id <= 9)""")  # fmt: skip
def without_repeated_boxes(spark, sf_dir):
    return d.without_repeats(fx.detections(spark, sf_dir, 60, 80))


@query("without_small_spans", f"""{DETS}, s AS (SELECT * FROM dets WHERE category_id IN (3, 5, 13, 14, 15)) SELECT {A_STAR()} FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b
    WHERE {ON} AND a.ord <> b.ord AND ({AREA_A} < {AREA_B} OR ({AREA_A} = {AREA_B} AND a.ord > b.ord)) AND {MIN_RATIO} > 0.65)""")  # fmt: skip
def without_small_spans(spark, sf_dir):
    return d.without_small_inside(d.by_category(fx.detections(spark, sf_dir), *d.SPAN_TYPES), d.SPAN_INSIDE)


def _anti(rule: str, mine: str, theirs: str, cte: str = DENSE) -> str:
    return f"{cte} SELECT {A_STAR()} FROM dets a WHERE a.category_id = {mine} AND NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = {theirs} AND {rule})"


@query("titles_off_text", _anti(f"{IOU} > 0.8", "0", "1"))
def titles_off_text(spark, sf_dir):
    dets = fx.detections(spark, sf_dir, 60, 80)
    return d.without_those_like(d.by_category(dets, 0), d.by_category(dets, 1))


@query("text_off_formulas", _anti(f"{IOU} > 0.8", "1", "14"))
def text_off_formulas(spark, sf_dir):
    dets = fx.detections(spark, sf_dir, 60, 80)
    return d.without_those_like(d.by_category(dets, 1), d.by_category(dets, 14))


@query("blocks_off_abandoned", _anti(f"{FIRST_RATIO} > 0.6", "1", "2", DETS))
def blocks_off_abandoned(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return d.without_those_on(d.by_category(dets, 1), d.by_category(dets, 2))


@query("spans_tagged_on_images", f"""{DETS} SELECT {A_STAR()}, 'on_image' AS tag FROM dets a WHERE a.category_id = 1 AND EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = 3 AND {FIRST_RATIO} > 0.5)""")
def spans_tagged_on_images(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return d.those_on(d.by_category(dets, 1), d.by_category(dets, 3), 0.5, "on_image")


@query("footnotes_among_abandoned", f"{DETS} SELECT {ROW} FROM dets WHERE category_id = 2 AND x1 - x0 > 204 AND y1 - y0 > 10 AND y0 > 396")
def footnotes_among_abandoned(spark, sf_dir):
    return d.footnotes_among(d.by_category(fx.detections(spark, sf_dir), 2), fx.PAGE_W, fx.PAGE_H)


@query("small_blocks_removed", f"""{DETS} SELECT {A_STAR()} FROM dets a WHERE NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND a.ord <> b.ord
    AND ({AREA_A} < {AREA_B} OR ({AREA_A} = {AREA_B} AND a.ord > b.ord)) AND {MIN_RATIO} > 0.8)""")  # fmt: skip
def small_blocks_removed(spark, sf_dir):
    return d.without_small_inside(fx.detections(spark, sf_dir), 0.8)


def _not_exists(a: str, b: str, rule: str) -> str:
    return f"SELECT {A_STAR()} FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE {ON} AND {rule})"


@query("all_blocks", f"""{DETS}, abandoned AS (SELECT * FROM dets WHERE category_id = 2),
    txt AS (SELECT * FROM ({_not_exists("(SELECT * FROM dets WHERE category_id = 1)", "(SELECT * FROM dets WHERE category_id = 14)", f"{IOU} > 0.8")})),
    ttl AS (SELECT * FROM ({_not_exists("(SELECT * FROM dets WHERE category_id = 0)", "txt", f"{IOU} > 0.8")})),
    blk AS (SELECT {ROW} FROM txt UNION ALL SELECT {ROW} FROM ttl UNION ALL SELECT {ROW} FROM dets WHERE category_id IN (3, 5, 14)),
    kept AS ({_not_exists("blk", "abandoned", f"{FIRST_RATIO} > 0.6")} UNION ALL SELECT {ROW} FROM abandoned WHERE x1 - x0 > 204 AND y1 - y0 > 10 AND y0 > 396)
    {_not_exists("kept", "kept", f"a.ord <> b.ord AND ({AREA_A} < {AREA_B} OR ({AREA_A} = {AREA_B} AND a.ord > b.ord)) AND {MIN_RATIO} > 0.8")}""")  # fmt: skip
def all_blocks(spark, sf_dir):
    return d.all_blocks(fx.detections(spark, sf_dir), fx.PAGE_W, fx.PAGE_H)


@query("boxes_in_margin", f"{DETS} SELECT {ROW} FROM dets WHERE x1 <= 122.4 OR x0 >= 489.6")
def boxes_in_margin(spark, sf_dir):
    return d.in_margin(fx.detections(spark, sf_dir), fx.PAGE_W)


@query("detected_regions", f"{DETS} SELECT {ROW}, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0, ord)::INT AS region FROM dets WHERE category_id = 5 AND score >= 0.3")
def detected_regions(spark, sf_dir):
    return d.regions(fx.detections(spark, sf_dir), 5)


@query("coloured_strips", f"""{DETS} SELECT {ROW} FROM dets WHERE category_id = 4 AND (x1 - x0) * (y1 - y0) > 100 AND ((x0 < 306 AND x1 > 306) OR least(abs(x0 - 306), abs(x1 - 306)) <= 122.4)
    AND y1 < 237.6 AND x1 - x0 > 4 * (y1 - y0)""")  # fmt: skip
def coloured_strips(spark, sf_dir):
    return d.coloured_strips(d.by_category(fx.detections(spark, sf_dir), 4), fx.PAGE_W, fx.PAGE_H)


@query("pages_on_colour", f"""{DENSE}, h AS (SELECT a.* FROM dets a WHERE a.category_id = 3 AND EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = 15 AND b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY (x1 - x0) * (y1 - y0) DESC, ord) AS k FROM h)
    SELECT doc_id, page_idx FROM r WHERE k = 1 AND x1 - x0 > 122.4 AND y1 - y0 > 40""")  # fmt: skip
def pages_on_colour(spark, sf_dir):
    dets = fx.detections(spark, sf_dir, 60, 80)
    return d.pages_on_colour(d.by_category(dets, 3), d.by_category(dets, 15), fx.PAGE_W, 400.0)


@query("spans_to_blocks", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, a.ord, min(b.ord) AS container FROM dets a JOIN dets b ON {ON} AND a.category_id = 15 AND b.category_id IN (0, 1) AND {FIRST_RATIO} > 0.6 GROUP BY ALL)
    SELECT doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1, container FROM dets JOIN m USING (doc_id, page_idx, ord)""")  # fmt: skip
def spans_to_blocks(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.first_container(d.by_category(dets, 15), d.by_category(dets, 0, 1), 0.6)


@query("blocks_to_layouts", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, a.ord, min(b.ord) AS container FROM dets a JOIN dets b ON {ON} AND a.category_id = 1 AND b.category_id = 3 AND {FIRST_RATIO} > 0.8 GROUP BY ALL)
    SELECT doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1, container, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY container, y0, ord)::INT AS place FROM dets JOIN m USING (doc_id, page_idx, ord)""")  # fmt: skip
def blocks_to_layouts(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    placed = assign.first_container(d.by_category(dets, 1), d.by_category(dets, 3), 0.8)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*d.PAGE).orderBy("container", "y0", "ord")))


@query("spans_without_block", f"{DETS} SELECT {A_STAR()} FROM dets a WHERE a.category_id = 15 AND NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id IN (0, 1) AND {FIRST_RATIO} > 0.4)")
def spans_without_block(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.unassigned(d.by_category(dets, 15), d.by_category(dets, 0, 1), 0.4)


def _nearest_sql() -> str:
    gaps = {"left": ("a.x0 - b.x1", CH), "right": ("b.x0 - a.x1", CH), "top": ("a.y0 - b.y1", CW), "bottom": ("b.y0 - a.y1", CW)}
    inside = "(a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1)"
    around = "(b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1)"
    one = "SELECT a.doc_id, a.page_idx, a.ord, '{side}' AS side, b.ord AS neighbour, {gap} AS gap, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY {gap}, b.ord) AS k FROM dets a JOIN dets b ON " + ON
    one += f" AND a.category_id IN (3, 5) AND b.category_id = 1 AND a.ord <> b.ord AND {{gap}} >= -2 AND {{across}} > 0 AND NOT {inside} AND NOT {around}"
    parts = " UNION ALL ".join(one.format(side=s, gap=f"({x})", across=y) for s, (x, y) in gaps.items())
    return f"{DETS} SELECT doc_id, page_idx, ord, side, neighbour, gap FROM ({parts}) WHERE k = 1"


@query("nearest_text_by_side", _nearest_sql())
def nearest_text_by_side(spark, sf_dir):
    dets = d.by_category(fx.detections(spark, sf_dir), 1, 3, 5)
    return assign.nearest_by_side(dets.withColumn("item", F.col("category_id") != 1))


@query("left_edge_boxes", f"{DETS} SELECT {A_STAR()} FROM dets a WHERE NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND a.ord <> b.ord AND b.x1 <= a.x0 AND {CH} > 0)")
def left_edge_boxes(spark, sf_dir):
    return assign.edge_boxes(fx.detections(spark, sf_dir), "left")


@query("caption_candidates", f"""{DETS} SELECT a.doc_id, a.page_idx, a.ord, b.ord AS object, round(sqrt(power(greatest(-{CW}, 0), 2) + power(greatest(-{CH}, 0), 2)), 6) AS distance,
    row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY sqrt(power(greatest(-{CW}, 0), 2) + power(greatest(-{CH}, 0), 2)), b.ord)::INT AS rank
    FROM dets a JOIN dets b ON {ON} AND a.category_id = 3 AND b.category_id = 4 AND ({CW} > 0 OR {CH} > 0)
    AND sqrt(power(greatest(-{CW}, 0), 2) + power(greatest(-{CH}, 0), 2)) <= greatest(a.x1 - a.x0, a.y1 - a.y0)""")  # fmt: skip
def caption_candidates(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    found = assign.caption_candidates(d.by_category(dets, 3), d.by_category(dets, 4))
    return found.withColumn("distance", F.round("distance", 6))


BESIDE = f"({{p}}.x0 <= {{q}}.x0 AND {{q}}.x0 <= {{p}}.x1 AND {CH} > 0 AND ({CH} >= 0.5 * (a.y1 - a.y0) OR {CH} >= 0.5 * (b.y1 - b.y0)))"


@query("first_overlapping_pair", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, CASE WHEN {AREA_A} <= {AREA_B} THEN a.ord ELSE b.ord END AS ord,
    row_number() OVER (PARTITION BY a.doc_id, a.page_idx ORDER BY a.ord, b.ord) AS k
    FROM dets a JOIN dets b ON {ON} AND a.ord < b.ord AND ({BESIDE.format(p="a", q="b")} OR {BESIDE.format(p="b", q="a")}))
    SELECT doc_id, page_idx, ord FROM m WHERE k = 1""")  # fmt: skip
def first_overlapping_pair(spark, sf_dir):
    return assign.first_overlap(fx.detections(spark, sf_dir))


@query("text_between_formulas", f"""{DETS}, cut AS (SELECT a.doc_id, a.page_idx, a.ord, a.x0 AS t0, a.x1 AS t1, greatest(a.x0, b.x0) AS h0, least(a.x1, b.x1) AS h1
    FROM dets a JOIN dets b ON {ON} AND a.category_id = 15 AND b.category_id = 13 AND greatest({CH}, 0) / least(a.y1 - a.y0, b.y1 - b.y0) > 0.6 AND {CW} > 0),
    n AS (SELECT *, max(h1) OVER (PARTITION BY doc_id, page_idx, ord ORDER BY h0, h1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM cut),
    i AS (SELECT *, sum(CASE WHEN far IS NULL OR h0 > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, ord ORDER BY h0, h1 ROWS UNBOUNDED PRECEDING) AS island FROM n),
    e AS (SELECT doc_id, page_idx, ord, t0, t1, island, min(h0) AS h0, max(h1) AS h1 FROM i GROUP BY ALL),
    parts AS (SELECT doc_id, page_idx, ord, coalesce(lag(h1) OVER (PARTITION BY doc_id, page_idx, ord ORDER BY island), t0) AS x0, h0 AS x1 FROM e
        UNION ALL SELECT doc_id, page_idx, ord, max(h1), max(t1) FROM e GROUP BY doc_id, page_idx, ord
        UNION ALL SELECT doc_id, page_idx, ord, x0, x1 FROM dets WHERE category_id = 15 AND (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM cut))
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, ord ORDER BY x0)::INT AS part FROM parts WHERE x1 > x0""")  # fmt: skip
def text_between_formulas(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.subtract_intervals(d.by_category(dets, 15), d.by_category(dets, 13))


@query("text_off_inline_formulas", _anti(f"{FIRST_RATIO} > 0.5", "15", "13", DETS))
def text_off_inline_formulas(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.chars_in_formulas(d.by_category(dets, 15), d.by_category(dets, 13))


@query("spans_below_footnotes", f"{DETS} SELECT {A_STAR()} FROM dets a WHERE a.category_id = 15 AND EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = 7 AND a.y0 >= b.y1 AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1)")
def spans_below_footnotes(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.rows_below(d.by_category(dets, 15), d.by_category(dets, 7))


@query("tables_grown_to_rules", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, a.ord, min(b.x0) AS r0, min(b.y0) AS r1, max(b.x1) AS r2, max(b.y1) AS r3
    FROM dets a JOIN dets b ON {ON} AND a.category_id = 5 AND b.category_id = 8 AND b.y0 >= a.y0 - (a.y1 - a.y0) * 0.1 AND b.y1 <= a.y1 + (a.y1 - a.y0) * 0.1 AND {CW} > 0 GROUP BY ALL)
    SELECT d.doc_id, d.page_idx, d.ord, least(x0, coalesce(r0, x0)) AS x0, least(y0, coalesce(r1, y0)) AS y0, greatest(x1, coalesce(r2, x1)) AS x1, greatest(y1, coalesce(r3, y1)) AS y1
    FROM dets d LEFT JOIN m USING (doc_id, page_idx, ord) WHERE category_id = 5""")  # fmt: skip
def tables_grown_to_rules(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.grown_to_rules(d.by_category(dets, 5), d.by_category(dets, 8))


@query("images_trimmed_to_text", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, a.ord, max(CASE WHEN b.y0 < a.y0 AND b.y1 < a.y1 THEN b.y1 END) AS t, min(CASE WHEN b.y1 > a.y1 AND b.y0 > a.y0 THEN b.y0 END) AS u
    FROM dets a JOIN dets b ON {ON} AND a.category_id = 3 AND b.category_id = 1 AND {CW} > 0 AND {CH} > 0
    AND NOT (a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1) AND NOT (b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1) GROUP BY ALL),
    c AS (SELECT d.doc_id, d.page_idx, d.ord, x0, greatest(y0, coalesce(t, y0)) AS y0, x1, least(y1, coalesce(u, y1)) AS y1 FROM dets d LEFT JOIN m USING (doc_id, page_idx, ord) WHERE category_id = 3)
    SELECT * FROM c WHERE y1 > y0""")  # fmt: skip
def images_trimmed_to_text(spark, sf_dir):
    dets = fx.detections(spark, sf_dir)
    return assign.trimmed_to_text(d.by_category(dets, 3), d.by_category(dets, 1))
