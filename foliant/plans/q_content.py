"""Queries from detections and spans to what a page says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import content
from ..operators.settle import settled, steps
from ..sources import fixtures as fx
from . import parse
from .q_arrangement import _corners, _tied_sql
from .q_boxes import AREA_A, AREA_B, BESIDE, DETS, FIRST_RATIO, IOU, MIN_RATIO, ON
from .registry import query

COLS = "doc_id, page_idx, ord, category_id, score, x0, y0, x1, y1"
A_COLS = ", ".join(f"a.{c}" for c in COLS.split(", "))
WIDE = "(0, 1, 3, 5)"


def page_evidence(spark, sf_dir):
    """Detections whose blocks are wide and whose text and formulas are small, so that blocks hold some."""
    wide, small = F.col("category_id").isin(0, 1, 3, 5), F.col("category_id").isin(13, 14, 15)
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return fx.detections(spark, sf_dir, 300).select(
        "doc_id", "page_idx", "ord", F.when(F.col("category_id") == 8, 15).otherwise(F.col("category_id")).alias("category_id"), "score", "x0", "y0",
        F.when(wide, F.col("x1") + 150).when(small, F.col("x0") + width / 4).otherwise(F.col("x1")).alias("x1"),
        F.when(wide, F.col("y1") + 60).when(small, F.col("y0") + height / 4).otherwise(F.col("y1")).alias("y1"),
    )


def contents(spark, sf_dir, evidence=None):
    """(page keys, ord, content): words of the document of the same number, as many to a page as it has detections, which are
    numbered anew if evidence does not have them; tables have a formula where the word is short."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    dets = page_evidence(spark, sf_dir) if evidence is None else evidence
    # Texts are dealt out as they are, since an array of words weighs several times as much, and cut once a document.
    by_doc = dets.groupBy("doc_id").agg(F.collect_list(F.struct("page_idx", "ord", "category_id")).alias("dets")).join(docs, "doc_id", "left")
    word = lambda w, x: F.coalesce(F.try_element_at(w, x["page_idx"] * 40 + x["ord"]), F.concat(F.lit("w"), x["ord"].cast("string")))
    named = lambda w: F.transform("dets", lambda x: x.withField("content", word(w, x)))
    said = by_doc.select("doc_id", F.explode(F.transform(F.array(F.split("text", " ")), named)[0]).alias("x")).select("doc_id", "x.*")
    return said.select("doc_id", "page_idx", "ord", F.when(~F.col("category_id").isin(3, 5) | (F.char_length("content") < 6), F.col("content")).alias("content"))


def path(kind, box):
    return t.crop_name(F.col("doc_id").cast("string"), "crops", F.col("page_idx"), [box[i] for i in range(4)])


def _folded(name: str, boxes: str, rule: str, loser: str) -> str:
    """SQL for a CTE of the boxes that lose when pairs meet in order."""
    return f"""{name}_met AS (SELECT a.doc_id, a.page_idx, list({{'i': a.ord, 'j': b.ord, 'loser': {loser}}} ORDER BY a.ord, b.ord) AS p FROM {boxes} a JOIN {boxes} b ON {ON} AND a.ord < b.ord AND {rule} GROUP BY ALL),
    {name} AS (SELECT doc_id, page_idx, unnest(list_reduce(list_transform(p, lambda x: [x]), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda l: l.loser = x[1].i OR l.loser = x[1].j)) > 0 THEN acc ELSE list_concat(acc, x) END)).loser AS ord FROM {name}_met)"""


def _beaten(name: str, a: str, b: str, rule: str) -> str:
    """SQL for a CTE of the boxes of a that some box of b beats."""
    return f"{name} AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.page_idx, a.ord FROM {a} a JOIN {b} b ON {ON} AND {rule})"


SMALLER = f"({AREA_A} < {AREA_B} OR ({AREA_A} = {AREA_B} AND a.ord > b.ord))"
FRAME = "CAST(NULL AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE))"
_ON_PART = """{0} IS NOT NULL AND coalesce(greatest(least(x1, {0}.x1) - greatest(x0, {0}.x0), 0) * greatest(least(y1, {0}.y1) - greatest(y0, {0}.y0), 0) / ((x1 - x0) * (y1 - y0)) > 0.6, false)"""

EVIDENCE = f"""{DETS.replace("WITH dets AS", "WITH RECURSIVE raw AS").replace("% 500", "% 300")}, evidence AS MATERIALIZED (
    SELECT doc_id, page_idx, ord, CASE category_id WHEN 8 THEN 15 ELSE category_id END AS category_id, score, x0, y0,
        CASE WHEN category_id IN {WIDE} THEN x1 + 150 WHEN category_id IN (13, 14, 15) THEN x0 + (x1 - x0) / 4 ELSE x1 END AS x1,
        CASE WHEN category_id IN {WIDE} THEN y1 + 60 WHEN category_id IN (13, 14, 15) THEN y0 + (y1 - y0) / 4 ELSE y1 END AS y1 FROM raw),
    contents AS MATERIALIZED (SELECT e.doc_id, page_idx, ord, CASE WHEN category_id NOT IN (3, 5) OR length(word) < 6 THEN word END AS content FROM (
        SELECT e.*, coalesce(w[page_idx * 40 + ord], 'w' || ord) AS word FROM evidence e LEFT JOIN (SELECT doc_id, string_split(text, ' ') AS w FROM documents) USING (doc_id)) e),
    sure AS MATERIALIZED (SELECT * FROM evidence WHERE score > 0.05),
    {_beaten("twice", "sure", "sure", f"a.ord <> b.ord AND {IOU} > 0.9 AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.score = b.score AND a.category_id = b.category_id) AND a.score <= b.score AND a.category_id <= 9 AND b.category_id <= 9")},
    dets AS MATERIALIZED (SELECT * FROM sure WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM twice))"""

BLOCKS = f"""{_tied_sql(3, 4, "ic")}, {_tied_sql(5, 6, "tc")}, {_tied_sql(5, 7, "tn")},
    flat AS MATERIALIZED (SELECT {COLS}, {FRAME} AS body, {FRAME} AS cap, {FRAME} AS note FROM dets WHERE category_id NOT IN (3, 5)
        UNION ALL SELECT doc_id, page_idx, ord, 3, score, {_corners("u", "body", "other").replace("u_", "")}, body, other, {FRAME} FROM ic
        UNION ALL SELECT doc_id, page_idx, ord, 5, tc.score, {_corners("u", "tc.body", "tc.other", "tn.other").replace("u_", "")}, tc.body, tc.other, tn.other FROM tc JOIN tn USING (doc_id, page_idx, ord)),
    {_beaten("off_text", "(SELECT * FROM flat WHERE category_id = 1)", "(SELECT * FROM flat WHERE category_id = 14)", f"{IOU} > 0.8")},
    txt AS (SELECT * FROM flat WHERE category_id = 1 AND (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM off_text)),
    {_beaten("off_title", "(SELECT * FROM flat WHERE category_id = 0)", "txt", f"{IOU} > 0.8")},
    body AS (SELECT * FROM txt UNION ALL SELECT * FROM flat WHERE category_id IN (3, 5, 14) UNION ALL SELECT * FROM flat WHERE category_id = 0 AND (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM off_title)),
    {_beaten("dropped", "body", "(SELECT * FROM flat WHERE category_id = 2)", f"{FIRST_RATIO} > 0.6")},
    kept AS MATERIALIZED (SELECT * FROM body WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM dropped) UNION ALL SELECT * FROM flat WHERE category_id = 2 AND x1 - x0 > 204 AND y1 - y0 > 10 AND y0 > 396),
    {_beaten("small", "kept", "kept", f"a.ord <> b.ord AND {SMALLER} AND {MIN_RATIO} > 0.8")},
    large AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0, ord) AS place FROM kept WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM small)),
    {_folded("aside", "large", f"({BESIDE.format(p='a', q='b')} OR {BESIDE.format(p='b', q='a')})", f"CASE WHEN {AREA_A} <= {AREA_B} THEN a.ord ELSE b.ord END")},
    blocks AS MATERIALIZED (SELECT * FROM large WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM aside))"""

SPANS = f"""every AS MATERIALIZED (SELECT min(ord) AS ord, doc_id, page_idx, category_id, score, x0, y0, x1, y1 FROM sure WHERE category_id IN (3, 5, 13, 14, 15) GROUP BY ALL),
    {_folded("unsure", "every", f"{IOU} > 0.9", "CASE WHEN a.score < b.score THEN a.ord ELSE b.ord END")},
    certain AS MATERIALIZED (SELECT * FROM every WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM unsure)),
    {_beaten("tiny", "certain", "certain", f"a.ord <> b.ord AND {SMALLER} AND {MIN_RATIO} > 0.65")},
    {_beaten("gone", "certain", "(SELECT * FROM dets WHERE category_id = 2)", f"{FIRST_RATIO} > 0.4")},
    spans AS MATERIALIZED (SELECT doc_id, page_idx, ord, CASE category_id WHEN 3 THEN 'image' WHEN 5 THEN 'table' WHEN 13 THEN 'inline_equation' WHEN 14 THEN 'interline_equation' ELSE 'text' END AS type, content, x0, y0, x1, y1
        FROM certain JOIN contents USING (doc_id, page_idx, ord) WHERE (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM tiny) AND (doc_id, page_idx, ord) NOT IN (SELECT (doc_id, page_idx, ord) FROM gone)),
    held AS (SELECT a.*, b.place, b.ord AS block, CASE b.category_id WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 5 THEN 'table' WHEN 14 THEN 'interline_equation' END AS kind, b.body, b.cap, b.note,
        row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.ord ORDER BY b.place) AS k FROM spans a JOIN blocks b ON {ON} AND {FIRST_RATIO} > 0.6),
    whole AS (SELECT *, kind IN ('image', 'table') AS picture, coalesce(body.x0 = x0 AND body.y0 = y0 AND body.x1 = x1 AND body.y1 = y1, false) AND type = kind AS is_body FROM held WHERE k = 1 AND kind IS NOT NULL),
    parts AS MATERIALIZED (SELECT doc_id, page_idx, ord, CASE WHEN kind IN ('text', 'title') AND type = 'interline_equation' THEN 'inline_equation' ELSE type END AS type, content, x0, y0, x1, y1, place, block, kind,
        CASE WHEN NOT picture THEN 'text' WHEN ord = first THEN 'body' WHEN {_ON_PART.format("cap")} THEN 'caption' WHEN {_ON_PART.format("note")} THEN 'note' END AS part
        FROM (SELECT *, min(CASE WHEN picture AND is_body THEN ord END) OVER (PARTITION BY doc_id, page_idx, place) AS first FROM whole)),
    before AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1, lag(type) OVER w AS pt FROM parts WHERE part IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page_idx, place, part ORDER BY y0, ord)),
    lined AS (SELECT *, sum(CASE WHEN pt IS NULL OR type IN ('interline_equation', 'image', 'table') OR pt IN ('interline_equation', 'image', 'table') OR NOT greatest(least(y1, p1) - greatest(y0, p0), 0) / least(y1 - y0, p1 - p0) > 0.8 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, page_idx, place, part ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS line FROM before),
    toned AS (SELECT *, string_agg(CASE WHEN type = 'text' THEN trim(content, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END, '') OVER (PARTITION BY doc_id, page_idx, place, part, line) AS said FROM lined),
    pieces AS (SELECT *, CASE WHEN len(regexp_extract_all(said, '[一-鿿]')) > len(regexp_extract_all(said, '[A-Za-z]')) THEN '' ELSE ' ' END AS gap,
        CASE type WHEN 'text' THEN replace(replace(replace(replace(content, '*', '\\*'), '`', '\\`'), '~', '\\~'), '$', '\\$') WHEN 'inline_equation' THEN ' $' || content || '$ '
        WHEN 'interline_equation' THEN chr(10) || '$$' || chr(10) || content || chr(10) || '$$' || chr(10) ELSE '' END AS piece FROM toned),
    texts AS (SELECT doc_id, page_idx, place, part, block, kind, coalesce(string_agg(piece || gap, '' ORDER BY line, x0, y0, ord) FILTER (piece <> ''), '') AS text,
        min_by({{'content': content, 'name': concat_ws('_', page_idx, CAST(floor(x0) AS INT), CAST(floor(y0) AS INT), CAST(floor(x1) AS INT), CAST(floor(y1) AS INT))}}, ord) AS b FROM pieces GROUP BY ALL),
    said AS MATERIALIZED (SELECT doc_id, page_idx, place, block AS ord, kind AS type, max(text) FILTER (part = 'text') AS text, max(text) FILTER (part = 'caption') AS caption, max(text) FILTER (part = 'note') AS note,
        max(sha256(doc_id || '/crops/' || b.name) || '.jpg') FILTER (part = 'body') AS img_path, nullif(max(CASE WHEN kind = 'table' THEN b.content END) FILTER (part = 'body'), '') AS latex FROM texts GROUP BY ALL)"""

CONTENTS_SQL = f"{EVIDENCE}, {BLOCKS}, {SPANS} SELECT CAST(place AS INT) AS place, * EXCLUDE (place) FROM said"

MARKDOWN_SQL = f"""{EVIDENCE}, {BLOCKS}, {SPANS}, md AS (SELECT doc_id, page_idx, place, trim(CASE type WHEN 'title' THEN '# ' || text
    WHEN 'image' THEN coalesce(chr(10) || '![](' || img_path || ')  ' || chr(10), '') || coalesce(caption, '')
    WHEN 'table' THEN coalesce(chr(10) || chr(10) || '$' || chr(10) || ' ' || latex || chr(10) || '$' || chr(10) || chr(10), chr(10) || '![' || coalesce(caption, '') || '](' || img_path || ')  ' || chr(10), '') || coalesce(note, '')
    ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS md FROM said)
    SELECT doc_id, page_idx, count(*) AS n_blocks, string_agg(md || '  ', chr(10) || chr(10) ORDER BY place) AS markdown FROM md WHERE md <> '' GROUP BY ALL"""


def _contents(spark, sf_dir, order):
    with steps(spark):
        evidence = settled(page_evidence(spark, sf_dir))
        return parse.page_contents(evidence, contents(spark, sf_dir, evidence), path, fx.PAGE_W, fx.PAGE_H, order)


@query("page_contents", CONTENTS_SQL)
def page_contents(spark, sf_dir):
    return _contents(spark, sf_dir, parse.by_height)


@query("pages_to_markdown", MARKDOWN_SQL)
def pages_to_markdown(spark, sf_dir):
    return content.pages_markdown(_contents(spark, sf_dir, parse.by_height))


@query("laid_out_pages_to_markdown")
def laid_out_pages_to_markdown(spark, sf_dir):
    return content.pages_markdown(_contents(spark, sf_dir, parse.by_layout))
