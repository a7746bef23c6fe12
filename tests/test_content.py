"""From spans and blocks to text and markdown: small pages by hand, a whole table against loops."""

import os
import re

from pyspark.sql import functions as F

from foliant.operators import content, kernels
from foliant.operators import detections as d
from foliant.plans import parse, q_content
from foliant.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"
SPANS = "doc_id long, page_idx int, ord int, type string, content string, x0 double, y0 double, x1 double, y1 double"
BLOCKS = "doc_id long, page_idx int, place int, ord int, type string, x0 double, y0 double, x1 double, y1 double, body array<double>, caption_box array<double>, note_box array<double>"


def rendered(spark, blocks, spans, **options):
    b = spark.createDataFrame([(1, 0, i, i, *row) for i, row in enumerate(blocks)], BLOCKS)
    s = spark.createDataFrame([(1, 0, i, *row) for i, row in enumerate(spans)], SPANS)
    rows = content.block_texts(content.part_texts(content.in_parts(content.filled(b, s))), lambda kind, box: F.concat(kind, F.lit(".jpg")))
    return [r["markdown"] for r in content.pages_markdown(rows, **options).collect()]


def test_lines_run_from_left_to_right(spark):
    block = ("text", 0.0, 0.0, 100.0, 50.0, None, None, None)
    spans = [("text", "b*", 50.0, 1.0, 90.0, 10.0), ("text", "a", 0.0, 0.0, 40.0, 10.0), ("interline_equation", "x", 0.0, 20.0, 40.0, 30.0), ("text", None, 50.0, 20.0, 90.0, 30.0)]
    assert rendered(spark, [block], spans) == ["a b\\*  $x$  "]


def test_chinese_lines_have_no_spaces(spark):
    block = ("text", 0.0, 0.0, 100.0, 50.0, None, None, None)
    assert rendered(spark, [block], [("text", "中", 0.0, 0.0, 10.0, 10.0), ("text", "文", 20.0, 0.0, 30.0, 10.0)]) == ["中文  "]


def test_pictures_take_their_parts(spark):
    image = ("image", 0.0, 0.0, 100.0, 80.0, [0.0, 0.0, 100.0, 50.0], [0.0, 60.0, 100.0, 80.0], None)
    table = ("table", 0.0, 100.0, 100.0, 190.0, [0.0, 120.0, 100.0, 160.0], [0.0, 100.0, 100.0, 115.0], [0.0, 165.0, 100.0, 190.0])
    spans = [
        ("image", None, 0.0, 0.0, 100.0, 50.0), ("text", "Fig", 0.0, 60.0, 50.0, 75.0), ("text", "inside", 10.0, 10.0, 20.0, 20.0),
        ("table", None, 0.0, 120.0, 100.0, 160.0), ("text", "Tab", 0.0, 100.0, 50.0, 112.0), ("text", "note", 0.0, 170.0, 50.0, 185.0),
    ]
    assert rendered(spark, [image, table], spans) == ["![](image.jpg)  \nFig  \n\n![Tab ](table.jpg)  \nnote  "]
    spans[3] = ("table", "t", *spans[3][2:])
    assert rendered(spark, [table], spans[3:]) == ["$\n t\n$\n\nnote  "]
    assert rendered(spark, [image, table], spans, pictures=False) == []


def test_a_span_goes_to_the_first_block(spark):
    blocks = [("title", 0.0, 0.0, 100.0, 20.0, None, None, None), ("text", 0.0, 0.0, 100.0, 50.0, None, None, None)]
    assert rendered(spark, blocks, [("text", "one", 0.0, 0.0, 40.0, 10.0), ("text", "two", 0.0, 30.0, 40.0, 40.0), ("text", "out", 200.0, 0.0, 240.0, 10.0)]) == ["# one  \n\ntwo  "]


def test_nothing_gives_nothing(spark):
    block = ("text", 0.0, 0.0, 100.0, 50.0, None, None, None)
    assert rendered(spark, [], [("text", "a", 0.0, 0.0, 1.0, 1.0)]) == rendered(spark, [block], []) == rendered(spark, [block], [("text", " ", 0.0, 0.0, 9.0, 9.0)]) == []


def share(a, b):
    w, h = min(a.x1, b[2]) - max(a.x0, b[0]), min(a.y1, b[3]) - max(a.y0, b[1])
    return max(w, 0) * max(h, 0) / ((a.x1 - a.x0) * (a.y1 - a.y0))


def said(spans):
    """Text of spans by loops: lines down, then left to right."""
    lines = []
    for s in sorted(spans, key=lambda s: (s.y0, s.ord)):
        last = lines[-1][-1] if lines else None
        alone = ("image", "table", "interline_equation")
        if last is None or s.type in alone or last.type in alone or max(0, min(s.y1, last.y1) - max(s.y0, last.y0)) / min(s.y1 - s.y0, last.y1 - last.y0) <= 0.8:
            lines.append([])
        lines[-1].append(s)
    text = ""
    for line in lines:
        plain = "".join(s.content or "" for s in line if s.type == "text")
        gap = "" if len(re.findall("[一-鿿]", plain)) > len(re.findall("[A-Za-z]", plain)) else " "
        for s in sorted(line, key=lambda s: (s.x0, s.y0, s.ord)):
            piece = {"text": re.sub(r"([*`~$])", r"\\\1", s.content or ""), "inline_equation": f" ${s.content}$ ", "interline_equation": f"\n$$\n{s.content}\n$$\n"}.get(s.type, "")
            text += piece + gap if piece else ""
    return text


class Span:
    def __init__(self, row, kind):
        self.__dict__.update(row.asDict())
        self.type = "inline_equation" if kind in ("text", "title") and self.type == "interline_equation" else self.type


def test_laid_out_pages_against_loops(spark):
    dets, contents = q_content.page_evidence(spark, DIR), q_content.contents(spark, DIR)
    seen = []

    def order(blocks):
        seen.append(parse.by_layout(blocks))
        return seen[0]

    got = {(r.doc_id, r.page_idx, r.place): r for r in parse.page_contents(dets, contents, q_content.path, fx.PAGE_W, fx.PAGE_H, order).collect()}
    stay = {tuple(r) for r in kernels.drop_until_apart(seen[0]).collect()}
    pages = {}
    for b in seen[0].orderBy(*d.PAGE, "place").collect():
        if (b.doc_id, b.page_idx, b.ord) in stay:
            pages.setdefault((b.doc_id, b.page_idx), []).append(b)
    abandoned = {}
    for b in d.by_category(d.without_repeats(d.confident(dets)), 2).collect():
        abandoned.setdefault((b.doc_id, b.page_idx), []).append((b.x0, b.y0, b.x1, b.y1))
    want = {}
    for s in parse.page_spans(d.confident(dets), contents).collect():
        key = (s.doc_id, s.page_idx)
        if any(share(s, b) > 0.4 for b in abandoned.get(key, [])):
            continue
        holder = next((b for b in pages.get(key, []) if share(s, (b.x0, b.y0, b.x1, b.y1)) > 0.6), None)
        if holder is not None and holder.type is not None:
            want.setdefault((*key, holder.place), (holder, []))[1].append(s)
    rows = {}
    for key, (b, spans) in want.items():
        spans = [Span(s, b.type) for s in sorted(spans, key=lambda s: s.ord)]
        if b.type not in ("image", "table"):
            rows[key] = (b.type, said(spans), None, None, False)
            continue
        body = next((s for s in spans if s.type == b.type and [s.x0, s.y0, s.x1, s.y1] == b.body), None)
        caption = [s for s in spans if s is not body and b.caption_box and share(s, b.caption_box) > 0.6]
        note = [s for s in spans if s is not body and s not in caption and b.note_box and share(s, b.note_box) > 0.6]
        if body or caption or note:
            rows[key] = (b.type, None, said(caption) if caption else None, said(note) if note else None, body is not None)
    assert len(rows) > 50 and {r[0] for r in rows.values()} == {"text", "title", "image", "table", "interline_equation"}
    assert {k: (r.type, r.text, r.caption, r.note, r.img_path is not None) for k, r in got.items()} == rows


def test_only_blocks_and_spans_stay_on_disk(spark):
    """What steps settle goes when the next ones are done, and their shuffles go with them."""
    sc = spark.sparkContext
    tables = lambda: {f.getPath().toString() for f in fs.listStatus(folder)}
    q_content.settled(spark.range(1))
    folder = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    before = tables()
    df = q_content.page_contents(spark, DIR)
    left = tables() - before
    assert len(left) == 3 and all(p.endswith("-settled") for p in left)
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows and rows == sorted(map(tuple, df.collect()), key=str)


def test_settled_queries_leave_no_shuffle(spark):
    sc = spark.sparkContext
    root = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for d in root.localDirsString() for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = shuffles()
    kept = q_content.settled(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert not shuffles() - before and kept.count() == 10
