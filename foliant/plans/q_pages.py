"""Queries of the page rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign, lines as ln, page_rules as r
from ..operators import detections as d
from ..sources import fixtures as fx
from .q_boxes import A_STAR, BOTH, CH, CW, DENSE, DETS, FIRST_RATIO, MIN_RATIO, ON, ROW
from .registry import query

LINES = "WITH " + fx.lines_sql()
TOUCH = f"({CW} >= 0 AND {CH} >= 0)"
A_IN_B = "(a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1)"
B_IN_A = "(b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1)"
APART = f"sqrt(power(greatest(-{CW}, 0), 2) + power(greatest(-{CH}, 0), 2))"
NAMES = ("title", "text", "figure", "figure_caption", "table", "table_caption", "equation", "header", "other")


def dets(spark, sf_dir, *categories):
    found = fx.detections(spark, sf_dir)
    return d.by_category(found, *categories) if categories else found


@query("other_detector", f"""{DETS} SELECT doc_id, page_idx, ord, coalesce(CASE WHEN ord % 5 > 0 THEN score END, 1.0) AS score, x0, y0, x1, y1, CAST(CASE category_id % 9
    {" ".join(f"WHEN {i} THEN {r.OTHER_KINDS[n]}" for i, n in enumerate(NAMES[:-1]))} END AS INT) AS category_id FROM dets WHERE category_id % 9 < 8""")  # fmt: skip
def other_detector(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("category_id") % 9 + 1)
    rows = dets(spark, sf_dir).withColumn("name", name).withColumn("score", F.when(F.col("ord") % 5 > 0, F.col("score"))).drop("category_id")
    return r.from_other_detector(rows)


@query("without_kinds", f"{DETS} SELECT {ROW} FROM dets WHERE category_id NOT IN (2, 13, 15)")
def without_kinds(spark, sf_dir):
    return r.without_kinds(dets(spark, sf_dir), (2, 13, 15))


@query("distinct_images", f"""{DETS}, {fx.IMAGES_SQL}, flat AS (SELECT doc_id, page_idx, objid, x0, y0, CASE WHEN ord % 7 = 0 THEN x0 ELSE x1 END AS x1, y1 FROM images),
    junk AS (SELECT doc_id, objid FROM images GROUP BY ALL HAVING count(DISTINCT page_idx) >= 3)
    SELECT DISTINCT doc_id, objid, page_idx, x0, y0, x1, y1 FROM flat WHERE x1 > x0 AND y1 > y0 AND (doc_id, objid) NOT IN (SELECT (doc_id, objid) FROM junk)""")  # fmt: skip
def distinct_images(spark, sf_dir):
    images = fx.page_images(spark, sf_dir)
    junk = images.groupBy("doc_id", "objid").agg(F.count_distinct("page_idx").alias("n")).where("n >= 3").select("doc_id", "objid")
    return r.distinct_images(images.withColumn("x1", F.when(F.col("ord") % 7 == 0, F.col("x0")).otherwise(F.col("x1"))), junk)


@query("merged_rules", f"""{DETS}, s AS (SELECT doc_id, page_idx, ord, x0, y0, x1, y0 + ord % 5 AS y1 FROM dets WHERE ord % 5 <= 3),
    a AS (SELECT *, CASE WHEN y0 - lag(y0) OVER w <= 5 THEN 0 ELSE 1 END AS far FROM s WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY y0, ord)),
    b AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page_idx ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS k FROM a),
    c AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc_id, page_idx, k ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 THEN 0 ELSE 1 END AS cut FROM b),
    e AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_idx, k ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS rule FROM c)
    SELECT doc_id, page_idx, x0, y0, x1, y1, n FROM (SELECT doc_id, page_idx, k, rule, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM e GROUP BY ALL)""")  # fmt: skip
def merged_rules(spark, sf_dir):
    return r.merged_rules(dets(spark, sf_dir).withColumn("y1", F.col("y0") + F.col("ord") % 5))


BARS = f"bars AS (SELECT {A_STAR()} FROM dets a WHERE category_id = 4 AND x0 < 306 AND x1 > 306 AND NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id IN (3, 5) AND {TOUCH}))"


@query("splitters", f"{DETS}, {BARS} SELECT {ROW} FROM bars")
def splitters(spark, sf_dir):
    return r.splitters(dets(spark, sf_dir, 4), dets(spark, sf_dir, 3, 5), fx.PAGE_W)


@query("layout_inputs", f"""{DETS}, {BARS} SELECT {A_STAR()} FROM dets a WHERE category_id = 1 AND NOT EXISTS (SELECT 1 FROM bars b WHERE {ON} AND {TOUCH})
    UNION ALL SELECT {ROW} FROM dets WHERE category_id = 3 AND (x1 - x0 >= 50 OR y1 - y0 >= 50) UNION ALL SELECT {ROW} FROM dets WHERE category_id = 5""")  # fmt: skip
def layout_inputs(spark, sf_dir):
    bars = r.splitters(dets(spark, sf_dir, 4), dets(spark, sf_dir, 3, 5), fx.PAGE_W)
    return r.layout_inputs(dets(spark, sf_dir, 1), dets(spark, sf_dir, 3), dets(spark, sf_dir, 5), bars)


@query("rule_footnotes", f"""{LINES}, s AS (SELECT doc_id, page_idx, line_no AS ord, y0 * 5 AS y0, 8 + line_no % 4 AS size, 'f' || (line_no % 3) AS font, 1 + line_no % 6 AS n_lines, text FROM lines),
    ms AS (SELECT doc_id, max(struct_pack(c := c, v := size)).v AS m FROM (SELECT doc_id, size, sum(length(text)) AS c FROM s GROUP BY ALL) GROUP BY doc_id),
    mf AS (SELECT doc_id, max(struct_pack(c := c, v := font)).v AS f FROM (SELECT doc_id, font, sum(length(text)) AS c FROM s GROUP BY ALL) GROUP BY doc_id)
    SELECT s.doc_id, page_idx, ord, y0, size, font, n_lines, text FROM s JOIN ms USING (doc_id) JOIN mf USING (doc_id)
    WHERE page_idx < 3 AND y0 > 475.2 AND size < m AND (n_lines < 5 OR font <> f) AND NOT (n_lines = 1 AND (upper(text) = text OR contains(lower(text), 'keyword')))""")  # fmt: skip
def rule_footnotes(spark, sf_dir):
    n = F.col("line_no")
    rows = fx.lines(spark, sf_dir).select("doc_id", "page_idx", n.alias("ord"), (F.col("y0") * 5).alias("y0"), (8 + n % 4).alias("size"), F.concat(F.lit("f"), (n % 3).cast("string")).alias("font"), (1 + n % 6).alias("n_lines"), "text")
    return r.rule_footnotes(rows, fx.PAGE_H)


@query("inside_bounds", f"""{DETS}, t AS (SELECT doc_id, page_idx, max(y1) AS t FROM dets WHERE category_id = 2 AND y1 < 160 GROUP BY ALL), u AS (SELECT doc_id, page_idx, min(y0) AS u FROM dets WHERE category_id = 2 AND y0 > 560 GROUP BY ALL)
    SELECT doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1 FROM dets LEFT JOIN t USING (doc_id, page_idx) LEFT JOIN u USING (doc_id, page_idx) WHERE category_id = 15 AND coalesce(y0 >= t, true) AND coalesce(y1 <= u, true)""")  # fmt: skip
def inside_bounds(spark, sf_dir):
    marks = dets(spark, sf_dir, 2)
    return r.inside_bounds(dets(spark, sf_dir, 15), marks.where("y1 < 160"), marks.where("y0 > 560"))


@query("without_page_numbers", f"""{LINES}, n AS (SELECT doc_id, page_idx, line_no, y0, CASE WHEN line_no % 8 = 7 THEN ' ' || page_idx || ' ' ELSE text END AS text FROM lines),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0 DESC, line_no DESC) AS k FROM n)
    SELECT doc_id, page_idx, line_no, text FROM k WHERE NOT (k = 1 AND regexp_matches(text, '^\\s*\\d+\\s*$'))""")  # fmt: skip
def without_page_numbers(spark, sf_dir):
    rows = fx.lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 8 == 7, F.concat(F.lit(" "), F.col("page_idx").cast("string"), F.lit(" "))).otherwise(F.col("text")))
    return r.without_page_numbers(rows).select("doc_id", "page_idx", "line_no", "text")


SIDE = """side AS (SELECT doc_id, page_idx, line_no // 2 AS block, line_no, CASE WHEN line_no % 4 < 2 THEN 40.0 ELSE x0 END AS x0, CASE WHEN line_no % 4 < 2 THEN 90.0 ELSE x1 END AS x1,
    CASE WHEN line_no % 11 = 0 THEN 0 ELSE 1 END AS dir_x, CASE WHEN line_no % 11 = 0 THEN 1 ELSE 0 END AS dir_y, CASE WHEN line_no % 4 < 2 THEN split_part(text, ' ', 1) ELSE text END AS text,
    CASE WHEN line_no % 6 < 2 THEN 16777215 ELSE line_no END AS colour FROM lines)"""


def side_lines(spark, sf_dir):
    n, edge, turned = F.col("line_no"), F.col("line_no") % 4 < 2, F.col("line_no") % 11 == 0
    return fx.lines(spark, sf_dir).select(
        "doc_id", "page_idx", F.floor(n / 2).cast("int").alias("block"), "line_no", F.when(edge, 40.0).otherwise(F.col("x0")).alias("x0"), F.when(edge, 90.0).otherwise(F.col("x1")).alias("x1"),
        F.when(turned, 0).otherwise(1).alias("dir_x"), F.when(turned, 1).otherwise(0).alias("dir_y"), F.when(edge, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.col("text")).alias("text"),
        F.when(n % 6 < 2, 16777215).otherwise(n).alias("colour"),
    )


@query("side_text", f"""{LINES}, {SIDE}, b AS (SELECT doc_id, page_idx, block, bool_or(dir_x <> 1 OR dir_y <> 0) AS turned, bool_and(NOT contains(trim(text), ' ')) AS words, max(x0) - min(x0) <= 1 AS aligned, max(x1) <= 122.4 OR min(x0) >= 489.6 AS margin FROM side GROUP BY ALL),
    t AS (SELECT doc_id, page_idx, block, CASE WHEN turned THEN 'rotated' WHEN margin AND words AND aligned THEN 'vertical' END AS tag FROM b) SELECT CAST(block AS INT) AS block, doc_id, page_idx, tag FROM t WHERE tag IS NOT NULL""")  # fmt: skip
def side_text(spark, sf_dir):
    return r.side_text(side_lines(spark, sf_dir), fx.PAGE_W)


@query("blank_blocks", f"{LINES}, {SIDE} SELECT doc_id, page_idx, CAST(block AS INT) AS block FROM side GROUP BY doc_id, page_idx, block HAVING bool_and(trim(text) = '' OR colour & 16777215 = 16777215)")
def blank_blocks(spark, sf_dir):
    return r.blank_blocks(side_lines(spark, sf_dir))


@query("pseudo_columns", f"""{DETS}, b AS (SELECT *, x0 > lag(x1) OVER w OR x1 < lag(x0) OVER w AS beside FROM dets WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY ord)),
    c AS (SELECT doc_id, page_idx, count(*) AS n, sum(CASE WHEN beside THEN 1 ELSE 0 END) AS k FROM b GROUP BY ALL) SELECT doc_id, page_idx, n, round(k / (n - 1), 6) AS share FROM c WHERE n > 20 AND k / (n - 1) >= 0.5""")  # fmt: skip
def pseudo_columns(spark, sf_dir):
    return r.pseudo_columns(dets(spark, sf_dir))


@query("without_noise", f"{DETS} SELECT {ROW} FROM dets WHERE NOT (category_id = 2 AND y0 < 100) AND NOT (x1 <= 122.4) AND NOT coalesce(CASE WHEN ord % 3 > 0 THEN score < 0.2 END, false)")
def without_noise(spark, sf_dir):
    flags = {"is_header": (F.col("category_id") == 2) & (F.col("y0") < 100), "is_margin": F.col("x1") <= 122.4, "is_doubtful": F.when(F.col("ord") % 3 > 0, F.col("score") < 0.2)}
    return r.without_noise(dets(spark, sf_dir).withColumns(flags), *flags).drop(*flags)


@query("in_layout", f"""{DETS} SELECT {A_STAR()}, EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = 3 AND a.x0 >= ceil(b.x0) AND a.y0 >= ceil(b.y0) AND a.x1 <= ceil(b.x1) AND a.y1 <= ceil(b.y1)) AS in_layout FROM dets a WHERE a.category_id = 1""")
def in_layout(spark, sf_dir):
    return r.in_layout(dets(spark, sf_dir, 1), dets(spark, sf_dir, 3))


QA = {"images": 3, "tables": 5, "equations": 14}


@query("blocks_by_type", f"{DETS} SELECT doc_id, page_idx, {', '.join(f'coalesce(list(ord ORDER BY ord) FILTER (category_id = {k}), []) AS {n}' for n, k in QA.items())} FROM dets GROUP BY ALL")
def blocks_by_type(spark, sf_dir):
    return r.blocks_by_type(dets(spark, sf_dir), QA)


@query("same_record", f"{DENSE} SELECT a.doc_id, a.page_idx, a.ord, min(b.ord) AS record FROM dets a JOIN dets b ON {ON} AND a.category_id = 3 AND b.category_id = 4 AND {MIN_RATIO} > 0.95 GROUP BY ALL")
def same_record(spark, sf_dir):
    found = fx.detections(spark, sf_dir, 60, 80)
    return r.same_record(d.by_category(found, 3), d.by_category(found, 4))


def _parts_sql(block: int, regions: dict[str, int]) -> str:
    """SQL for parts_of(), with all text as spans, region by region."""
    ctes, names = [], []
    for i, (part, kind) in enumerate(regions.items()):
        ctes.append(f"""own{i} AS (SELECT doc_id, page_idx, ord, x0, y0, x1, y1, blk FROM (SELECT a.*, b.ord AS blk, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY {APART}, b.ord) AS k
            FROM dets a JOIN dets b ON {ON} AND a.category_id = {kind} AND b.category_id = {block}) WHERE k = 1),
        part{i} AS (SELECT doc_id, page_idx, blk AS ord, '{part}' AS part, span FROM (SELECT a.doc_id, a.page_idx, a.ord AS span, b.blk, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY b.ord) AS k
            FROM spans a JOIN own{i} b ON {ON} AND {FIRST_RATIO} > 0.6 {"".join(f"AND (a.doc_id, a.page_idx, a.ord) NOT IN (SELECT (doc_id, page_idx, span) FROM part{j}) " for j in range(i))}) WHERE k = 1)""")
        names.append(f"SELECT * FROM part{i}")
    return f"""{DENSE}, spans AS (SELECT * FROM dets WHERE category_id IN ({block}, 15)), body AS (SELECT b.doc_id, b.page_idx, b.ord, 'body' AS part, min(s.ord) AS span FROM dets b JOIN spans s
        ON b.doc_id = s.doc_id AND b.page_idx = s.page_idx AND b.x0 = s.x0 AND b.y0 = s.y0 AND b.x1 = s.x1 AND b.y1 = s.y1 WHERE b.category_id = {block} GROUP BY ALL), {", ".join(ctes)}
    SELECT * FROM body UNION ALL {" UNION ALL ".join(names)}"""


def _parts(spark, sf_dir, block, regions):
    found = fx.detections(spark, sf_dir, 60, 80)
    return r.parts_of(d.by_category(found, block), d.by_category(found, block, 15), {part: d.by_category(found, kind) for part, kind in regions.items()})


@query("parts_of_images", _parts_sql(3, {"caption": 4}))
def parts_of_images(spark, sf_dir):
    return _parts(spark, sf_dir, 3, {"caption": 4})


@query("parts_of_tables", _parts_sql(5, {"caption": 6, "footnote": 7}))
def parts_of_tables(spark, sf_dir):
    return _parts(spark, sf_dir, 5, {"caption": 6, "footnote": 7})


@query("retyped_in_text", f"""{DETS} SELECT {A_STAR("doc_id, page_idx, ord, score, x0, y0, x1, y1")}, a.category_id, CASE WHEN category_id = 14 AND NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND b.category_id = 1 AND {FIRST_RATIO} > 0.6) THEN 'interline_equation'
    WHEN category_id = 14 THEN 'inline_equation' ELSE 'text' END AS type FROM dets a WHERE a.category_id IN (14, 15)""")  # fmt: skip
def retyped_in_text(spark, sf_dir):
    spans = dets(spark, sf_dir, 14, 15).withColumn("type", F.when(F.col("category_id") == 14, "interline_equation").otherwise("text"))
    return r.retyped_in_text(spans, dets(spark, sf_dir, 1))


@query("with_equations", f"""{DETS}, t AS (SELECT doc_id, page_idx, max(ord) AS m FROM dets WHERE category_id = 1 GROUP BY ALL)
    SELECT {ROW}, false AS is_equation FROM dets WHERE category_id = 1 UNION ALL
    SELECT doc_id, page_idx, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0, ord) AS INT), category_id, score, x0, y0, x1, y1, true FROM dets LEFT JOIN t USING (doc_id, page_idx) WHERE category_id = 14""")  # fmt: skip
def with_equations(spark, sf_dir):
    return r.with_equations(dets(spark, sf_dir, 1), dets(spark, sf_dir, 14))


@query("zipped_by_box", f"{DENSE} SELECT a.doc_id, a.page_idx, a.ord, b.ord AS other FROM dets a JOIN dets b ON {ON} AND a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 WHERE a.category_id = 1 AND b.category_id IN (1, 15)")
def zipped_by_box(spark, sf_dir):
    found = fx.detections(spark, sf_dir, 60, 80)
    return r.zipped_by_box(d.by_category(found, 1), d.by_category(found, 1, 15))


@query("resolved_conflicts", f"""{DETS}, k AS (SELECT * FROM dets WHERE category_id IN (1, 3, 5, 14)), tags AS (
    SELECT DISTINCT a.doc_id, a.page_idx, a.ord, 'in_image_or_table' AS tag FROM k a JOIN k b ON {ON} AND b.category_id IN (3, 5) AND ((a.category_id = 1 AND {A_IN_B}) OR (a.category_id = 14 AND {TOUCH}))
    UNION SELECT a.doc_id, a.page_idx, a.ord, 'backup' FROM k a JOIN k b ON {ON} AND a.category_id = 3 AND {BOTH} > 0 AND ((b.category_id = 1 AND NOT {B_IN_A}) OR (b.category_id = 3 AND a.ord <> b.ord)))
    SELECT doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1, tag FROM k LEFT JOIN tags USING (doc_id, page_idx, ord)""")  # fmt: skip
def resolved_conflicts(spark, sf_dir):
    return r.resolved(*[dets(spark, sf_dir, k) for k in (1, 3, 5, 14)])


@query("without_contained", f"{DENSE} SELECT {A_STAR()} FROM dets a WHERE NOT EXISTS (SELECT 1 FROM dets b WHERE {ON} AND a.ord <> b.ord AND {A_IN_B} AND (NOT {B_IN_A} OR a.ord > b.ord))")
def without_contained(spark, sf_dir):
    return r.without_contained(fx.detections(spark, sf_dir, 60, 80))


CAPTIONED = """objs AS (SELECT doc_id, page_idx, CAST(line_no AS INT) AS ord, x0, y0 - 2 AS y0, x1, y0 AS y1 FROM lines WHERE line_no % 8 = 0),
    texts AS (SELECT doc_id, page_idx, line_no, x0, y0, x1, y1, CASE WHEN line_no % 5 = 2 THEN 'Fig. ' || line_no ELSE text END AS text FROM lines)"""


def _hops_sql(hops: int) -> str:
    ctes, hits, at = [], [], "objs"
    for h in range(1, hops + 1):
        ctes.append(f"""n{h} AS (SELECT * FROM (SELECT a.doc_id, a.page_idx, a.ord, b.line_no, b.text, b.x0, b.y0, b.x1, b.y1, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY b.y0 - a.y1, b.line_no) AS k
            FROM {at} a JOIN texts b ON {ON} AND b.y0 - a.y1 BETWEEN 0 AND 20 AND {CW} > 0) WHERE k = 1), m{h} AS (SELECT * FROM n{h} WHERE NOT regexp_matches(text, '(?i)^\\s*(?:fig\\.?|figure|scheme)'))""")
        hits.append(f"SELECT doc_id, page_idx, ord, line_no, {h} AS hop FROM n{h} WHERE regexp_matches(text, '(?i)^\\s*(?:fig\\.?|figure|scheme)')")
        at = f"m{h}"
    return f"{LINES}, {CAPTIONED}, {', '.join(ctes)} {' UNION ALL '.join(hits)}"


@query("captions_by_text", _hops_sql(3))
def captions_by_text(spark, sf_dir):
    rows, n = fx.lines(spark, sf_dir), F.col("line_no")
    objects = rows.where(n % 8 == 0).select("doc_id", "page_idx", n.cast("int").alias("ord"), "x0", (F.col("y0") - 2).alias("y0"), "x1", F.col("y0").alias("y1"))
    return r.captions_by_text(objects, rows.withColumn("text", F.when(n % 5 == 2, F.concat(F.lit("Fig. "), n.cast("string"))).otherwise(F.col("text"))), r.FIGURE_TEXT)


@query("level_lines", f"""{DETS}, s AS (SELECT doc_id, page_idx, ord, ord // 4 AS line, CASE category_id WHEN 14 THEN 'interline_equation' WHEN 13 THEN 'inline_equation' ELSE 'text' END AS type, x0, y0, x1, y1 FROM dets WHERE category_id IN (13, 14, 15)),
    f AS (SELECT doc_id, page_idx, line, y0 AS f0, y1 AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, line ORDER BY x0, ord) AS k FROM s WHERE type = 'text') WHERE k = 1),
    n AS (SELECT doc_id, page_idx, line, count(*) AS n FROM s GROUP BY ALL)
    SELECT doc_id, page_idx, ord, CAST(line AS INT) AS line, CASE WHEN type = 'interline_equation' AND n > 1 THEN 'inline_equation' ELSE type END AS type, x0, least(coalesce(f0, y0), coalesce(f1, y1)) AS y0, x1, coalesce(f1, y1) AS y1
    FROM s LEFT JOIN f USING (doc_id, page_idx, line) JOIN n USING (doc_id, page_idx, line)""")  # fmt: skip
def level_lines(spark, sf_dir):
    kind = F.when(F.col("category_id") == 14, "interline_equation").when(F.col("category_id") == 13, "inline_equation").otherwise("text")
    return r.level_lines(dets(spark, sf_dir, 13, 14, 15).select("doc_id", "page_idx", "ord", F.floor(F.col("ord") / 4).cast("int").alias("line"), kind.alias("type"), "x0", "y0", "x1", "y1"))


@query("lists_across_pages", f"""{LINES}, c AS (SELECT *, CASE WHEN line_no % 8 IN (6, 7) THEN 1 ELSE 2 END AS code FROM lines), e AS (SELECT doc_id, page_idx, max(line_no) AS l FROM c GROUP BY ALL),
    runs AS (SELECT doc_id, page_idx, max(line_no) AS l FROM c WHERE code = 1 GROUP BY ALL), p AS (SELECT e.doc_id, e.page_idx + 1 AS page_idx FROM e JOIN runs USING (doc_id, page_idx, l)),
    f AS (SELECT *, first_value(x0) OVER w AS fx, first_value(code) OVER w AS fc FROM c WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),
    s AS (SELECT *, min(CASE WHEN abs(x0 - fx) <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS so_far FROM f)
    SELECT doc_id, page_idx, line_no FROM s JOIN p USING (doc_id, page_idx) WHERE so_far = 1 AND fc <> 1""")  # fmt: skip
def lists_across_pages(spark, sf_dir):
    coded = fx.lines(spark, sf_dir).withColumn("code", F.when((F.col("line_no") % 8).isin(6, 7), 1).otherwise(2))
    runs = coded.where("code = 1").groupBy("doc_id", "page_idx").agg(F.max("line_no").alias("last_line"))
    return r.lists_across_pages(coded, runs)


@query("sorted_by_layout", f"""{DETS}, m AS (SELECT a.doc_id, a.page_idx, a.ord, min(b.ord) AS container FROM dets a JOIN dets b ON {ON} AND a.category_id = 1 AND b.category_id = 3 AND {FIRST_RATIO} > 0.5 GROUP BY ALL)
    SELECT {ROW}, container, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY container, floor(y0), x0, ord)::INT AS place FROM dets JOIN m USING (doc_id, page_idx, ord)""")  # fmt: skip
def sorted_by_layout(spark, sf_dir):
    return r.sorted_by_layout(assign.first_container(dets(spark, sf_dir, 1), dets(spark, sf_dir, 3), 0.5))


@query("page_range", f"{DETS} SELECT {ROW} FROM dets WHERE page_idx >= 2 AND page_idx <= 5")
def page_range(spark, sf_dir):
    return r.page_range(dets(spark, sf_dir), 2, 5)


@query("sampled_pages", f"""{DETS}, p AS (SELECT DISTINCT doc_id, page_idx FROM dets), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || doc_id || ':' || page_idx), page_idx) AS k FROM p) SELECT doc_id, page_idx FROM k WHERE k <= 3""")
def sampled_pages(spark, sf_dir):
    return r.sampled_pages(dets(spark, sf_dir).select("doc_id", "page_idx").distinct(), 3)


def _language_sql() -> str:
    counts = [f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in words)}))), 'i': {-i}, 'name': '{name}'}}" for i, (name, words) in enumerate(sorted(r.STOP_WORDS.items()))]
    return f"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(trim(text)), '[^\\p{{L}}]+') AS w FROM documents), b AS (SELECT doc_id, list_max([{', '.join(counts)}]) AS b FROM w)
    SELECT doc_id, CASE WHEN b.n = 0 THEN '' ELSE b.name END AS language FROM b"""


@query("stop_word_language", _language_sql())
def stop_word_language(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", r.language(F.col("text")).alias("language"))


@query("entity_category", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '[,;/|&]+|\s+(?:and|und|et|y)\s+'), lambda p: regexp_matches(p, '\p{L}')) AS p FROM documents)
    SELECT doc_id, len(p) > 0 AND len(list_filter(p, lambda x: regexp_matches(trim(x), '^\p{Lu}'))) >= len(p) * 0.5 AS entity FROM t""")  # fmt: skip
def entity_category(spark, sf_dir):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return fx.read(spark, sf_dir, "documents").select("doc_id", r.entity_category(first, lambda p: p.rlike(r"^\p{Lu}")).alias("entity"))


@query("with_fallback", f"""{LINES}, failed AS (SELECT DISTINCT doc_id FROM lines WHERE length(text) > 900), ocr AS (SELECT doc_id, page_idx, line_no, upper(lang) AS lang FROM lines)
    SELECT doc_id, page_idx, line_no, lang, 'first' AS branch FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM failed) UNION ALL SELECT doc_id, page_idx, line_no, lang, 'second' FROM ocr WHERE doc_id IN (SELECT doc_id FROM failed)""")  # fmt: skip
def with_fallback(spark, sf_dir):
    rows = fx.lines(spark, sf_dir)
    first = rows.select("doc_id", "page_idx", "line_no", "lang")
    return r.with_fallback(first, first.withColumn("lang", F.upper("lang")), rows.where(F.char_length("text") > 900))


@query("accepted_latex", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS accepted FROM documents""")
def accepted_latex(spark, sf_dir):
    ends = F.element_at(F.array(F.lit(r"\end{tabular} "), F.lit(r"\end{table}"), F.lit(r"\end{tabular")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", r.accepted_latex(F.concat(F.lit(r"\begin{tabular}"), "text", ends)).alias("accepted"))


@query("image_links", r"""SELECT doc_id, 0 AS idx, 'https://x.org/' || doc_id || '.png' AS path, 'https://x.org/' || doc_id || '.png' AS target FROM documents
    UNION ALL SELECT doc_id, 1, 'a/b/my pic ' || doc_id || '.jpg', 'images/my%20pic%20' || doc_id || '.jpg' FROM documents""")  # fmt: skip
def image_links(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit(" ![u](https://x.org/"), i, F.lit(".png) and ![](a/b/my pic "), i, F.lit(".jpg)"))
    return r.image_links(fx.read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


@query("images_among_lines", f"""{LINES}, {fx.detections_sql()}, im AS (SELECT i.doc_id, i.page_idx, i.ord, min(l.line_no) AS before FROM (SELECT doc_id, page_idx, ord, y0 FROM dets WHERE category_id = 3 AND (doc_id, page_idx) IN (SELECT (doc_id, page_idx) FROM lines)) i
      LEFT JOIN lines l ON i.doc_id = l.doc_id AND i.page_idx = l.page_idx AND l.y0 >= i.y0 GROUP BY ALL),
    u AS (SELECT doc_id, page_idx, CAST(line_no AS DOUBLE) AS k, 'line' AS kind, line_no AS id FROM lines UNION ALL SELECT doc_id, page_idx, coalesce(before - 0.5, 1e9), 'image', ord FROM im)
    SELECT doc_id, page_idx, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY k, kind, id)::INT AS place, kind, id FROM u""")  # fmt: skip
def images_among_lines(spark, sf_dir):
    return r.images_among_lines(fx.lines(spark, sf_dir), dets(spark, sf_dir, 3))


@query("inserted_text", """SELECT doc_id, CASE WHEN instr(text, ' ') > 0 THEN substr(text, 1, instr(text, ' ')) || '![](i.png)' || substr(text, instr(text, ' ') + 1) ELSE text || '![](i.png)' END AS behind,
    '[[' || text AS ahead FROM documents""")  # fmt: skip
def inserted_text(spark, sf_dir):
    t = F.col("text")
    return fx.read(spark, sf_dir, "documents").select("doc_id", r.inserted(t, F.lit(" "), F.lit("![](i.png)")).alias("behind"), r.inserted(t, F.substring(t, 1, 3), F.lit("[["), after=False).alias("ahead"))


CROPS = {3: "images", 4: "image_backup", 5: "tables", 14: "equations"}


@query("crops_by_kind", f"{DETS} SELECT doc_id, page_idx, CASE category_id {' '.join(f'WHEN {k} THEN {v!r}' for k, v in CROPS.items())} END AS kind, string_agg(ord, ',' ORDER BY ord) AS ords FROM dets WHERE category_id IN (3, 4, 5, 14) GROUP BY ALL")
def crops_by_kind(spark, sf_dir):
    return r.crops(dets(spark, sf_dir), CROPS)


@query("text_or_default", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source, '') AS value FROM documents")
def text_or_default(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", r.text_or(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("value"))


@query("inline_equations_by_line", f"{DETS} SELECT doc_id, page_idx, ord // 4 AS line, sum(CASE WHEN category_id = 13 THEN 1 ELSE 0 END)::BIGINT AS inline_equations, bool_or(category_id IN (3, 5, 14)) AS stands_alone FROM dets GROUP BY ALL")
def inline_equations_by_line(spark, sf_dir):
    line = F.floor(F.col("ord") / 4).alias("line")
    return dets(spark, sf_dir).groupBy("doc_id", "page_idx", line).agg(F.sum((F.col("category_id") == 13).cast("long")).alias("inline_equations"), F.bool_or(F.col("category_id").isin(3, 5, 14)).alias("stands_alone"))


@query("spans_with_extent", f"""{DETS}, s AS (SELECT doc_id, page_idx, ord, CASE category_id WHEN 13 THEN 'inline_equation' WHEN 15 THEN 'text' END AS type, x0, y0, CASE WHEN ord % 4 = 0 THEN x0 ELSE x1 END AS x1, y1 FROM dets WHERE category_id IN (13, 15))
    SELECT * FROM s WHERE type = 'inline_equation' OR abs(x1 - x0) > 1e-4""")  # fmt: skip
def spans_with_extent(spark, sf_dir):
    s = dets(spark, sf_dir, 13, 15).select("doc_id", "page_idx", "ord", F.when(F.col("category_id") == 13, "inline_equation").otherwise("text").alias("type"), "x0", "y0", F.when(F.col("ord") % 4 == 0, F.col("x0")).otherwise(F.col("x1")).alias("x1"), "y1")
    return d.with_extent(s)


@query("text_replaced", f"{DETS} SELECT doc_id, page_idx, ord, 'image' AS type FROM dets WHERE category_id = 3 UNION ALL SELECT doc_id, page_idx, ord + 1000, 'text' FROM dets WHERE category_id = 1")
def text_replaced(spark, sf_dir):
    cols = ("doc_id", "page_idx", "ord")
    spans = dets(spark, sf_dir, 3, 15).select(*cols, F.when(F.col("category_id") == 3, "image").otherwise("text").alias("type"))
    return d.replace_text(spans, dets(spark, sf_dir, 1).select("doc_id", "page_idx", (F.col("ord") + 1000).alias("ord"), F.lit("text").alias("type")))


@query("thin_boxes", f"{DETS} SELECT doc_id, page_idx, ord, x0, y0, x1, y0 + ord % 4 AS y1 FROM dets WHERE ord % 4 <= 1")
def thin_boxes(spark, sf_dir):
    return d.thin(dets(spark, sf_dir).select("doc_id", "page_idx", "ord", "x0", "y0", "x1", (F.col("y0") + F.col("ord") % 4).alias("y1")))


@query("overlaps_enough", f"{DETS} SELECT a.doc_id, a.page_idx, a.ord, b.ord AS other FROM dets a JOIN dets b ON {ON} AND a.category_id = 1 AND b.category_id = 5 AND {FIRST_RATIO} > 0.6")
def overlaps_enough(spark, sf_dir):
    found = d.pairs(dets(spark, sf_dir, 1), dets(spark, sf_dir, 5), g.overlaps_more_than(g.box("a."), g.box("b.")))
    return found.select("a.doc_id", "a.page_idx", "a.ord", F.col("b.ord").alias("other"))


@query("polygon_round_trip", f"{DETS} SELECT doc_id, page_idx, ord, x0, y0, x1, y1 FROM dets")
def polygon_round_trip(spark, sf_dir):
    return dets(spark, sf_dir).select("doc_id", "page_idx", "ord", g.box_polygon(g.box()).alias("poly")).select("doc_id", "page_idx", "ord", *g.polygon_box(F.col("poly")))


@query("list_items_by_run", f"{LINES}, c AS (SELECT doc_id, page_idx, line_no, CASE WHEN line_no % 8 IN (2, 4) THEN 1 WHEN line_no % 8 IN (3, 5) THEN 2 ELSE 4 END AS code FROM lines) SELECT doc_id, page_idx, min(line_no) AS first_line, max(line_no) AS last_line, sum(CASE WHEN code = 1 THEN 1 ELSE 0 END)::BIGINT AS items FROM c WHERE code IN (1, 2) GROUP BY doc_id, page_idx HAVING sum(CASE WHEN code = 1 THEN 1 ELSE 0 END) > 1 OR count(*) > 1")
def list_items_by_run(spark, sf_dir):
    m = F.col("line_no") % 8
    coded = fx.lines(spark, sf_dir).withColumn("code", F.when(m.isin(2, 4), 1).when(m.isin(3, 5), 2).otherwise(4))
    return ln.list_runs(coded).drop("run")
