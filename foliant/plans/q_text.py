"""Queries of text functions, rendering and translation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import render, translate
from ..sources import fixtures as fx
from .q_boxes import DETS
from .q_windows import LINES
from .registry import query

BLOCKS = f"""{LINES}, blocks AS (SELECT doc_id, page_idx, line_no AS block_ord, CASE WHEN line_no = 0 THEN 'title' WHEN line_no % 7 = 3 THEN 'image' WHEN line_no % 11 = 5 THEN 'table' WHEN line_no % 13 = 6 THEN 'interline_equation' ELSE 'text' END AS type, text,
    'images/' || doc_id || '_' || line_no || '.jpg' AS img_path, CASE WHEN line_no % 2 = 0 THEN 'Figure ' || line_no ELSE '' END AS caption, CASE WHEN line_no % 3 = 0 THEN '<table>' || line_no || '</table>' ELSE '' END AS body,
    CASE WHEN line_no % 5 = 0 THEN 'note ' || line_no ELSE '' END AS footnote, (doc_id + page_idx) % 9 = 4 AS need_drop FROM lines)"""
ESC = "replace(replace(replace(replace(text, '*', '\\*'), '`', '\\`'), '~', '\\~'), '$', '\\$')"
IMG = "'![](' || img_path || ')'"
NL = "'  ' || chr(10)"
MD = BLOCKS + f""", md AS (SELECT doc_id, page_idx, block_ord, type, trim(CASE type WHEN 'title' THEN '# ' || {ESC} WHEN 'interline_equation' THEN chr(10) || '$$' || chr(10) || text || chr(10) || '$$' || chr(10)
    WHEN 'image' THEN concat_ws({NL}, {IMG}, nullif(caption, ''), nullif(footnote, '')) WHEN 'table' THEN concat_ws({NL}, nullif(caption, ''), coalesce(nullif(body, ''), {IMG}), nullif(footnote, '')) ELSE {ESC} END, ' ' || chr(9) || chr(10)) AS md FROM blocks)"""


def blocks(spark, sf_dir):
    l, n = fx.lines(spark, sf_dir), F.col("line_no")
    kind = F.when(n == 0, "title").when(n % 7 == 3, "image").when(n % 11 == 5, "table").when(n % 13 == 6, "interline_equation").otherwise("text")
    when = lambda k, prefix, suffix="": F.when(n % k == 0, F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix))).otherwise("")
    return l.select("doc_id", "page_idx", n.alias("block_ord"), kind.alias("type"), "text", F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit("_"), n.cast("string"), F.lit(".jpg")).alias("img_path"),
                    when(2, "Figure ").alias("caption"), when(3, "<table>", "</table>").alias("body"), when(5, "note ").alias("footnote"), ((F.col("doc_id") + F.col("page_idx")) % 9 == 4).alias("need_drop"))


@query("markdown", MD + " SELECT doc_id, string_agg(md || '  ', chr(10) || chr(10) ORDER BY page_idx, block_ord) AS markdown FROM md WHERE md <> '' GROUP BY doc_id")
def markdown(spark, sf_dir):
    return render.markdown(blocks(spark, sf_dir))


@query("markdown_text_only", MD + " SELECT doc_id, string_agg(md || '  ', chr(10) || chr(10) ORDER BY page_idx, block_ord) AS markdown FROM md WHERE md <> '' AND type NOT IN ('image', 'table') GROUP BY doc_id")
def markdown_text_only(spark, sf_dir):
    return render.markdown(blocks(spark, sf_dir), pictures=False)


@query("markdown_by_page", MD + """, p AS (SELECT doc_id, page_idx, string_agg(md || '  ', chr(10) || chr(10) ORDER BY block_ord) AS markdown FROM md WHERE md <> '' GROUP BY ALL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1)::INT AS page_no, markdown FROM p""")  # fmt: skip
def markdown_by_page(spark, sf_dir):
    return render.pages_markdown(blocks(spark, sf_dir))


@query("content_list", BLOCKS + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, block_ord)::INT AS ord, page_idx, CASE type WHEN 'title' THEN 'text' WHEN 'interline_equation' THEN 'equation' ELSE type END AS type,
    CASE WHEN type IN ('text', 'title', 'interline_equation') THEN text END AS text, CASE WHEN type = 'title' THEN 1 END AS text_level, CASE WHEN type = 'interline_equation' THEN 'latex' END AS text_format,
    CASE WHEN type IN ('image', 'table') THEN img_path END AS img_path, CASE WHEN type = 'image' THEN caption END AS img_caption, CASE WHEN type = 'table' THEN body END AS table_body,
    CASE WHEN type = 'table' THEN caption END AS table_caption, CASE WHEN type = 'table' THEN footnote END AS table_footnote FROM blocks""")  # fmt: skip
def content_list(spark, sf_dir):
    return render.content_list(blocks(spark, sf_dir))


@query("single_pages_dropped", BLOCKS + " SELECT doc_id, page_idx, count(*) AS n FROM blocks WHERE NOT need_drop GROUP BY ALL")
def single_pages_dropped(spark, sf_dir):
    return render.drop_pages(blocks(spark, sf_dir), "single_page").groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))


@query("whole_documents_dropped", BLOCKS + " SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id HAVING NOT bool_or(need_drop)")
def whole_documents_dropped(spark, sf_dir):
    return render.drop_pages(blocks(spark, sf_dir), "whole_pdf").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("draw_boxes", BLOCKS + """ SELECT doc_id, page_idx, block_ord, CASE type WHEN 'title' THEN 'blue' WHEN 'text' THEN 'red' WHEN 'image' THEN 'green' WHEN 'table' THEN 'orange' WHEN 'interline_equation' THEN 'purple' ELSE 'grey' END AS colour,
    row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_ord)::INT AS number FROM blocks""")  # fmt: skip
def draw_boxes(spark, sf_dir):
    return render.draw_boxes(blocks(spark, sf_dir))


@query("documents_as_json")
def documents_as_json(spark, sf_dir):
    return render.to_document(blocks(spark, sf_dir))


SPANS = f"""{LINES}, w AS (SELECT doc_id, page_idx, line_no AS line, unnest(range(len(p))) AS i, unnest(p) AS content FROM (SELECT *, string_split(text, ' ') AS p FROM lines)),
    spans AS (SELECT doc_id, page_idx, line, CAST(i AS INT) AS ord, CAST(i * 10 AS DOUBLE) AS x0, CASE WHEN i % 7 = 3 THEN 'inline_equation' WHEN i % 19 = 11 THEN 'interline_equation' ELSE 'text' END AS type, content FROM w)"""


@query("line_texts", SPANS + """ SELECT doc_id, page_idx, line, string_agg(CASE type WHEN 'inline_equation' THEN ' $' || content || '$ ' WHEN 'interline_equation' THEN chr(10) || '$$' || chr(10) || content || chr(10) || '$$' || chr(10)
    ELSE content || ' ' END, '' ORDER BY x0, ord) AS text FROM spans GROUP BY ALL""")  # fmt: skip
def line_texts(spark, sf_dir):
    # Lines are dealt out before they are cut into spans, which takes far less than to deal the spans.
    lines = fx.lines(spark, sf_dir).select("doc_id", "page_idx", F.col("line_no").alias("line"), "text").repartition("doc_id", "page_idx", "line")
    w = lines.select("doc_id", "page_idx", "line", F.posexplode(F.split("text", " ")).alias("ord", "content"))
    kind = F.when(F.col("ord") % 7 == 3, "inline_equation").when(F.col("ord") % 19 == 11, "interline_equation").otherwise("text")
    return render.line_text(w.withColumn("x0", (F.col("ord") * 10).cast("double")).withColumn("type", kind))


@query("text_functions", r"""WITH s AS (SELECT doc_id, text, split_part(text, ' ', 1) AS w, split_part(text, ' ', 3) AS v FROM documents)
    SELECT doc_id, upper(md5(text)) AS md5, sha256(text) AS sha, replace(replace(replace(replace(text, '*', '\*'), '`', '\`'), '~', '\~'), '$', '\$') AS escaped,
    CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'en' END AS script, regexp_replace('a/b//', '/+$', '') || '/' || w || '/' || regexp_replace(v || '/', '/+$', '') AS path,
    regexp_replace(w || ':?' || v, '[<>:"/\\|?*]', '_', 'g') AS filename, regexp_replace(w || ' [12, 3] ' || v || '. [4-6]', '(\w[.,;]?)\s?\[\d+(?:\s*[-,]\s*\d+)*\]', '\1', 'g') AS uncited,
    doc_id % 32 & 2 > 0 AS italic, CAST(doc_id * 7919 % 16777216 // 65536 AS INT) AS red, CAST((doc_id * 7919 % 16777216 // 256) % 256 AS INT) AS green, doc_id * 7919 % 16777216 = 16777215 AS white,
    regexp_matches(lower(trim(text)), '^(?:fig|figure|scheme)') AS figure, regexp_matches(lower('Table ' || doc_id || text), '^table\s*\d+|^表') AS table_title,
    round((length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'))) / greatest(length(text), 1), 6) AS punctuation,
    CASE WHEN least(length(w), length(v)) = 0 THEN 0 ELSE len(list_filter(range(1, least(length(w), length(v)) + 1), lambda i: left(w, i) = left(v, i))) END::INT AS prefix,
    coalesce(nullif(w, ''), v, '') AS span, strftime(make_timestamp(doc_id * 86399 * 1000000), '%Y-%m-%d-%H:%M:%S') AS at FROM s""")  # fmt: skip
def text_functions(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents")
    s = docs.select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(1)).alias("w"), F.split_part("text", F.lit(" "), F.lit(3)).alias("v"))
    w, v, text = F.col("w"), F.col("v"), F.col("text")
    colour = F.col("doc_id") * 7919 % 16777216
    return s.select(
        "doc_id", t.upper_md5(text).alias("md5"), F.sha2(text, 256).alias("sha"), t.escape_markdown(text).alias("escaped"), t.chinese_or_english(text).alias("script"),
        t.join_path(F.lit("a/b//"), w, F.concat(v, F.lit("/"))).alias("path"), t.safe_filename(F.concat(w, F.lit(":?"), v)).alias("filename"),
        t.remove_citations(F.concat(w, F.lit(" [12, 3] "), v, F.lit(". [4-6]"))).alias("uncited"), t.font_flag(F.col("doc_id") % 32, "italic").alias("italic"),
        t.rgb(colour)["r"].alias("red"), t.rgb(colour)["g"].alias("green"), t.is_white(colour).alias("white"), t.is_figure_caption(text).alias("figure"),
        t.is_table_caption(F.concat(F.lit("Table "), F.col("doc_id").cast("string"), text)).alias("table_title"), F.round(t.punctuation_share(text), 6).alias("punctuation"),
        t.common_prefix(w, v).cast("int").alias("prefix"), t.span_text(w, v).alias("span"), t.epoch_text(F.col("doc_id") * 86399).alias("at"),
    )


@query("garbled_share", r"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '(cid:12)(cid:7) ' || text ELSE text END AS text FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(text, '\(cid:\d+\)')) AS k, length(regexp_replace(text, '\(cid:\d+\)', '', 'g')) AS r FROM g)
    SELECT doc_id, round(k / greatest(k + r, 1), 6) AS share, k / greatest(k + r, 1) > 0.05 AS garbled FROM c""")  # fmt: skip
def garbled_share(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("(cid:12)(cid:7) "), "text")).otherwise(F.col("text")).alias("text"))
    share = t.garbled_share(F.col("text"))
    return docs.select("doc_id", F.round(share, 6).alias("share"), (share > 0.05).alias("garbled"))


@query("long_words", r"SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) >= 16)) AS word FROM documents")
def long_words(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.explode(t.long_words(F.col("text"))).alias("word"))


@query("s3_paths", r"""SELECT doc_id, 'b' || doc_id % 7 AS bucket, 'raw/' || source || '/' || doc_id || '.pdf' AS key, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END AS "offset", CASE WHEN doc_id % 2 = 0 THEN n_chars END AS length FROM documents""")
def s3_paths(spark, sf_dir):
    docs, i = fx.read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    path = F.concat(F.lit("s3://b"), (F.col("doc_id") % 7).cast("string"), F.lit("/raw/"), "source", F.lit("/"), i, F.lit(".pdf"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("?bytes="), (F.col("doc_id") * 10).cast("string"), F.lit(","), F.col("n_chars").cast("string"))).otherwise(""))
    return docs.select("doc_id", t.s3_parts(path).alias("p")).select("doc_id", "p.*")


@query("crop_names", f"{DETS} SELECT doc_id, page_idx, ord, sha256(md5(CAST(doc_id AS VARCHAR)) || '/images/' || page_idx || '_' || CAST(floor(x0) AS INT) || '_' || CAST(floor(y0) AS INT) || '_' || CAST(floor(x1) AS INT) || '_' || CAST(floor(y1) AS INT)) || '.jpg' AS name FROM dets WHERE category_id = 3")
def crop_names(spark, sf_dir):
    dets = fx.detections(spark, sf_dir).where("category_id = 3")
    name = t.crop_name(F.md5(F.col("doc_id").cast("string")), "images", F.col("page_idx"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return dets.select("doc_id", "page_idx", "ord", name.alias("name"))


@query("citation_spans", rf"""WITH {fx.lines_sql()}, w AS (SELECT doc_id, line_no, unnest(range(len(p))) AS i, unnest(p) AS tok FROM (SELECT *, string_split(text, ' ') AS p FROM lines)),
    c AS (SELECT doc_id, line_no, CAST(i AS INT) AS i, CASE WHEN i % 9 = 4 THEN '[' || i || ']' ELSE tok END AS tok, CASE WHEN i % 9 = 4 THEN 6 ELSE 10 END AS size FROM w),
    m AS (SELECT *, max(size) OVER (PARTITION BY doc_id, line_no) AS top, substr(lag(tok) OVER (PARTITION BY doc_id, line_no ORDER BY i), -1) AS before FROM c)
    SELECT doc_id, line_no, count(*) AS n FROM m WHERE size < top - 1 AND (coalesce(before IN ('.', ',', ';'), false) OR regexp_matches(trim(tok), '^\[?\d+(?:\s*[-,–]\s*\d+)*\]?$|^[a-z]\s*-\s*[a-z]$')) GROUP BY ALL""")  # fmt: skip
def citation_spans(spark, sf_dir):
    w = fx.lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("i", "tok"))
    mark = F.col("i") % 9 == 4
    w = w.withColumn("tok", F.when(mark, F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(F.col("tok"))).withColumn("size", F.when(mark, 6).otherwise(10))
    line = Window.partitionBy("doc_id", "line_no")
    before = F.substring(F.lag("tok").over(line.orderBy("i")), -1, 1)
    w = w.withColumn("small", F.col("size") < F.max("size").over(line) - 1).withColumn("after_stop", F.coalesce(before.isin(".", ",", ";"), F.lit(False)))
    return w.where(F.col("small") & (F.col("after_stop") | t.is_citation(F.col("tok")))).groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"))


def marked(spark, sf_dir):
    """Documents with something of each kind that is masked."""
    docs = fx.read(spark, sf_dir, "documents")
    extra = F.lit("\n# Head\n\nsee https://example.org/a and `code` and ![alt](x.png)\n\n```\nprint(1)\n```\n\n|a|b|\n|1|2|\n\n$$x^2$$ and $y$\n<!-- note --><br>\n")
    return docs.select("doc_id", F.concat("text", extra).alias("text"))


@query("mask_round_trip", """SELECT doc_id, true AS same FROM documents""")
def mask_round_trip(spark, sf_dir):
    docs = marked(spark, sf_dir)
    back = translate.restore(translate.mask(docs)).select("doc_id", F.col("text").alias("back"))
    return docs.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


@query("masks_by_kind")
def masks_by_kind(spark, sf_dir):
    return translate.mask(marked(spark, sf_dir)).select(F.explode("masks.placeholder").alias("p")).groupBy(F.regexp_extract("p", r"<PH>([A-Z]+)_", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("token_counts", """SELECT doc_id, CAST(ceil(length(text) / 4) AS INT) AS tokens, CAST(floor(ceil(length(text) / 4) / greatest(ceil(ceil(length(text) / 4) / 300), 1)
    + ceil((ceil(length(text) / 4) % 300) / greatest(ceil(ceil(length(text) / 4) / 300), 1))) AS INT) AS chunk FROM documents""")  # fmt: skip
def token_counts(spark, sf_dir):
    tokens = translate.token_count(F.col("text"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), translate.chunk_size(tokens, 300).alias("chunk"))


@query("translated_documents", "SELECT doc_id, text, CAST(0 AS BIGINT) AS errors FROM documents")
def translated_documents(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    return translate.joined(translate.translate(translate.chunks(docs, 300)))


@query("chunks")
def chunks(spark, sf_dir):
    return translate.chunks(marked(spark, sf_dir), 300)
