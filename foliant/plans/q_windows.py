"""Queries of lines, lists and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as d
from ..operators import lines as ln
from ..sources import fixtures as fx
from .q_boxes import DETS
from .registry import query

LINES = "WITH " + fx.lines_sql()
STOPS = "('" + "', '".join(ln.STOPS) + "')"
PAGE = "PARTITION BY doc_id, page_idx"
DOC = ["doc_id", "page_idx"]

TYPED = f"""{DETS}, s AS (SELECT doc_id, page_idx, ord, x0, y0, x1, y1, CASE category_id WHEN 3 THEN 'image' WHEN 5 THEN 'table' WHEN 13 THEN 'inline_equation' WHEN 14 THEN 'interline_equation' ELSE 'text' END AS type
    FROM dets WHERE category_id IN (3, 5, 13, 14, 15, 1)),
    p AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1, lag(type) OVER w AS pt FROM s WINDOW w AS ({PAGE} ORDER BY y0, ord)),
    lined AS (SELECT doc_id, page_idx, ord, x0, y0, x1, y1, type, sum(CASE WHEN pt IS NULL OR type IN ('interline_equation', 'image', 'table') OR pt IN ('interline_equation', 'image', 'table')
        OR NOT greatest(least(y1, p1) - greatest(y0, p0), 0) / least(y1 - y0, p1 - p0) > 0.8 THEN 1 ELSE 0 END) OVER ({PAGE} ORDER BY y0, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM p)"""


def _spans(spark, sf_dir):
    dets = d.by_category(fx.detections(spark, sf_dir), 3, 5, 13, 14, 15, 1)
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.SPAN_TYPES.items() for x in kv]), F.col("category_id")), F.lit("text"))
    return dets.select(*DOC, "ord", "x0", "y0", "x1", "y1", kind.alias("type"))


@query("spans_to_lines", TYPED + " SELECT * FROM lined")
def spans_to_lines(spark, sf_dir):
    return ln.spans_to_lines(_spans(spark, sf_dir))


@query("line_boxes", TYPED + " SELECT doc_id, page_idx, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_spans, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY x0, ord) AS ords FROM lined GROUP BY ALL")
def line_boxes(spark, sf_dir):
    return ln.line_boxes(ln.spans_to_lines(_spans(spark, sf_dir)))


# two documents share a page here, so that their lines meet on rows
@query("merged_raw_lines", f"""{LINES}, l AS (SELECT CAST(floor(doc_id / 2) AS BIGINT) AS pair, page_idx, line_no * 2 + doc_id % 2 AS line_no, x0, y0, x1, y1, text FROM lines),
    a AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1 FROM l WINDOW w AS (PARTITION BY pair, page_idx ORDER BY y0, x0, line_no)),
    r AS (SELECT *, sum(CASE WHEN p0 IS NULL OR abs(y0 - p0) >= 2 OR abs(y1 - p1) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY pair, page_idx ORDER BY y0, x0, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a)
    SELECT pair, page_idx, run, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, string_agg(text, ' ' ORDER BY x0, line_no) AS text FROM r GROUP BY ALL""")  # fmt: skip
def merged_raw_lines(spark, sf_dir):
    l = fx.lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).cast("long").alias("pair"), "page_idx", (F.col("line_no") * 2 + F.col("doc_id") % 2).alias("line_no"), "x0", "y0", "x1", "y1", "text")
    return ln.merge_raw_lines(l, ["pair", "page_idx"])


@query("lines_spaced_on_row", f"""{LINES}, l AS (SELECT doc_id, page_idx, line_no, 60 + 14 * floor((line_no % 8) / 2) AS y, text FROM lines)
    SELECT doc_id, page_idx, line_no, CASE WHEN lag(y) OVER ({PAGE} ORDER BY line_no) = y THEN ' ' || text ELSE text END AS text FROM l""")  # fmt: skip
def lines_spaced_on_row(spark, sf_dir):
    l = fx.lines(spark, sf_dir).withColumn("y0", 60 + 14 * F.floor(F.col("line_no") % 8 / 2)).withColumn("y1", F.col("y0") + 12)
    return ln.spaced_on_row(l).select(*DOC, "line_no", "text")


def _cluster(cte: str, table: str, col: str, out: str, how: str) -> str:
    return f"""{cte}_far AS (SELECT *, lag({col}) OVER ({PAGE} ORDER BY {col}, line_no) AS _p FROM {table}),
    {cte}_run AS (SELECT * EXCLUDE (_p), sum(CASE WHEN _p IS NULL OR {col} - _p > 3 THEN 1 ELSE 0 END) OVER ({PAGE} ORDER BY {col}, line_no ROWS UNBOUNDED PRECEDING) AS _c FROM {cte}_far),
    {out} AS (SELECT * EXCLUDE (_c) REPLACE ({how}({col}) OVER (PARTITION BY doc_id, page_idx, _c) AS {col}) FROM {cte}_run)"""


@query("aligned_lines", f"{LINES}, {_cluster('l', 'lines', 'x0', 'a', 'min')}, {_cluster('r', 'a', 'x1', 'b', 'max')} SELECT doc_id, page_idx, line_no, x0, x1 FROM b")
def aligned_lines(spark, sf_dir):
    return ln.aligned(fx.lines(spark, sf_dir)).select(*DOC, "line_no", "x0", "x1")


@query("indent_clusters", f"""{LINES}, f AS (SELECT doc_id, page_idx, line_no, x1, lag(x1) OVER ({PAGE} ORDER BY x1, line_no) AS p FROM lines),
    c AS (SELECT *, sum(CASE WHEN p IS NULL OR x1 - p > 3 THEN 1 ELSE 0 END) OVER ({PAGE} ORDER BY x1, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
    SELECT doc_id, page_idx, line_no, CASE WHEN count(*) OVER (PARTITION BY doc_id, page_idx, run) >= 2 THEN run END AS cluster FROM c""")  # fmt: skip
def indent_clusters(spark, sf_dir):
    return ln.clusters(fx.lines(spark, sf_dir), DOC, "x1", 3.0, 2, "cluster").select(*DOC, "line_no", "cluster")


@query("clipped_lines", f"{LINES} SELECT doc_id, page_idx, line_no, greatest(x0, 80) AS x0, least(x1, 500) AS x1 FROM lines")
def clipped_lines(spark, sf_dir):
    return ln.clipped(fx.lines(spark, sf_dir), 80.0, 500.0).select(*DOC, "line_no", "x0", "x1")


CODED = f"""{LINES}, coded AS (SELECT *, CASE WHEN x0 = min(x0) OVER ({PAGE}) THEN CASE WHEN regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]|^\\d+\\.') THEN 1 ELSE 4 END
    WHEN regexp_matches(text, '^\\p{{Lu}}') THEN 2 ELSE 3 END AS code FROM (SELECT * REPLACE (CASE WHEN line_no % 3 = 0 THEN '- ' || text ELSE text END AS text) FROM lines))"""
RUNS = CODED + f""", i AS (SELECT *, code IN (1, 2, 3) AS inside FROM coded),
    j AS (SELECT *, coalesce(lag(inside) OVER ({PAGE} ORDER BY line_no), false) AS was FROM i),
    k AS (SELECT *, sum(CASE WHEN inside AND was THEN 0 ELSE 1 END) OVER ({PAGE} ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM j),
    m AS (SELECT *, max(CASE WHEN code = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, run ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS started FROM k),
    runs AS (SELECT doc_id, page_idx, run, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (code = 1) AS items
        FROM m WHERE inside AND started = 1 GROUP BY ALL HAVING count(*) FILTER (code = 1) > 1 OR count(*) > 1)"""


def _coded(spark, sf_dir):
    l = fx.lines(spark, sf_dir)
    return ln.line_codes(l.withColumn("text", F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("- "), "text")).otherwise(F.col("text"))))


@query("line_codes", CODED + " SELECT doc_id, page_idx, line_no, code FROM coded")
def line_codes(spark, sf_dir):
    return _coded(spark, sf_dir).select(*DOC, "line_no", "code")


@query("list_runs", RUNS + " SELECT * FROM runs")
def list_runs(spark, sf_dir):
    return ln.list_runs(_coded(spark, sf_dir))


@query("list_and_text_segments", RUNS + f""", e AS (SELECT doc_id, page_idx, min(line_no) AS low, max(line_no) AS high FROM coded GROUP BY ALL),
    g AS (SELECT r.doc_id, r.page_idx, coalesce(lag(last_line) OVER (PARTITION BY r.doc_id, r.page_idx ORDER BY first_line) + 1, low) AS first_line, first_line - 1 AS last_line, 'text' AS kind FROM runs r JOIN e USING (doc_id, page_idx)),
    u AS (SELECT doc_id, page_idx, first_line, last_line, 'list' AS kind FROM runs UNION ALL SELECT * FROM g
        UNION ALL SELECT doc_id, page_idx, max(last_line) + 1, max(high), 'text' FROM runs JOIN e USING (doc_id, page_idx) GROUP BY doc_id, page_idx
        UNION ALL SELECT doc_id, page_idx, low, high, 'text' FROM e WHERE (doc_id, page_idx) NOT IN (SELECT (doc_id, page_idx) FROM runs))
    SELECT * FROM u WHERE first_line <= last_line""")  # fmt: skip
def list_and_text_segments(spark, sf_dir):
    c = _coded(spark, sf_dir)
    return ln.segments(c, ln.list_runs(c))


@query("list_breaks", RUNS + """ SELECT c.doc_id, c.page_idx, line_no, CASE WHEN lead(code) OVER (PARTITION BY c.doc_id, c.page_idx, first_line ORDER BY line_no) = 1 THEN text || chr(10) || chr(10) ELSE text END AS text
    FROM coded c JOIN runs r ON c.doc_id = r.doc_id AND c.page_idx = r.page_idx AND line_no BETWEEN first_line AND last_line WHERE items > 1""")  # fmt: skip
def list_breaks(spark, sf_dir):
    c = _coded(spark, sf_dir)
    return ln.list_breaks(c, ln.list_runs(c))


JOINED = f"""{LINES}, e AS (SELECT doc_id, page_idx, arg_max(x1, line_no) AS lx, arg_max(text, line_no) AS lt, arg_min(x0, line_no) AS fx FROM lines GROUP BY ALL),
    p AS (SELECT *, lag(lx) OVER w AS px, lag(lt) OVER w AS pt, lag(page_idx) OVER w AS pi FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx)),
    joined AS (SELECT doc_id, page_idx, coalesce(pi = page_idx - 1 AND px >= 300 AND substr(pt, -1) NOT IN {STOPS} AND fx <= 90, false) AS joined FROM p)"""


@query("joined_pages", JOINED + " SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM joined")
def joined_pages(spark, sf_dir):
    return ln.paragraph_ids(ln.joined_pages(fx.lines(spark, sf_dir), 300.0, 90.0))


@query("centred_runs", f"""{LINES}, a AS (SELECT *, x0 < 306 AND x1 > 306 AS across, min(x0) OVER ({PAGE}) AS edge FROM lines),
    b AS (SELECT *, coalesce(lag(across) OVER ({PAGE} ORDER BY line_no), false) AS was FROM a),
    r AS (SELECT *, sum(CASE WHEN across AND was THEN 0 ELSE 1 END) OVER ({PAGE} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT doc_id, page_idx, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM r WHERE across GROUP BY doc_id, page_idx, run
    HAVING count(*) >= 2 AND stddev_pop(y1 - y0) < 2 AND NOT bool_and(x0 = edge)""")  # fmt: skip
def centred_runs(spark, sf_dir):
    return ln.centred_runs(fx.lines(spark, sf_dir), 306.0)


PARAS = f"""{LINES}, a AS (SELECT *, x1 < 400 OR substr(text, -1) IN {STOPS} AS ends FROM lines), b AS (SELECT *, lag(ends) OVER ({PAGE} ORDER BY line_no) AS s FROM a),
    c AS (SELECT *, sum(CASE WHEN coalesce(s, true) THEN 1 ELSE 0 END) OVER ({PAGE} ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS para FROM b),
    paras AS (SELECT doc_id, page_idx, para, min(line_no) AS first_line, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line_no) AS text FROM c GROUP BY ALL)"""


@query("paragraphs", PARAS + " SELECT * FROM paras")
def paragraphs(spark, sf_dir):
    return ln.paragraphs(fx.lines(spark, sf_dir), 400.0)


@query("continued_paragraphs", PARAS + f""", g AS (SELECT doc_id, page_idx, para, coalesce(substr(lag(text) OVER w, -1) NOT IN {STOPS} AND regexp_matches(text, '^\\p{{Ll}}'), false) AS goes_on FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, para))
    SELECT doc_id, page_idx, para, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_idx, para ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM g""")  # fmt: skip
def continued_paragraphs(spark, sf_dir):
    return ln.continued(ln.paragraphs(fx.lines(spark, sf_dir), 400.0)).select(*DOC, "para", "chain")


@query("titles", f"""{LINES}, t AS (SELECT *, length(text) AS n, length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')) AS dots, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM lines),
    u AS (SELECT doc_id, line_no, text, n, n > 0 AND n <= 200 AND regexp_matches(text, '^[\\p{{Lu}}\\d]') AND dots < n * 0.1 AND substr(text, -1) NOT IN ('.', ',', ';', ':') AND n < coalesce(length(nxt), 0) AS is_title FROM t)
    SELECT doc_id, line_no, is_title, CASE WHEN is_title THEN coalesce(CASE WHEN regexp_matches(text, '^(?:\\d+(?:\\.\\d+)*|[IVXLC]+)[.)\\s]') THEN least(3, len(regexp_extract_all(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)', 1), '\\d+'))) END,
        CASE WHEN n < 40 THEN 1 WHEN n < 80 THEN 2 ELSE 3 END)::INT END AS level FROM u""")  # fmt: skip
def titles(spark, sf_dir):
    return ln.titles(fx.lines(spark, sf_dir)).select("doc_id", "line_no", "is_title", "level")
