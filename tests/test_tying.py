"""Captions tied to bodies, boxes pushed apart and merged, against plain loops over the rules, on whole tables."""

import itertools
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import kernels, tying
from foliant.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"


def pages_of(df):
    """{page: [(ord, category, score, box)] in order}."""
    found = defaultdict(list)
    for r in df.collect():
        found[r["doc_id"], r["page_idx"]].append((r["ord"], r["category_id"], r["score"], (r["x0"], r["y0"], r["x1"], r["y1"])))
    return {k: sorted(v) for k, v in found.items()}


def dense(spark):
    """Detections of all kinds near one another, so that all rules speak."""
    return fx.detections(spark, DIR, 200, 260).withColumn("category_id", F.when(F.col("ord") % 3 == 0, 3).when(F.col("ord") % 3 == 1, 4).otherwise(F.lit(5)).cast("int"))


def within(a, b):
    return a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]


def meet(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def around(boxes):
    return tuple(f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max)))


def size(b):
    return abs(b[2] - b[0]) * abs(b[3] - b[1])


def apart(a, b):
    return max(0, b[0] - a[2], a[0] - b[2]), max(0, b[1] - a[3], a[1] - b[3])


def distance(a, b):
    return math.hypot(*apart(a, b))


def straight(a, b):
    x, y = apart(a, b)
    return not (x and y)


def alone(rows):
    return [r for r in rows if not any(q is not r and within(r[3], q[3]) for q in rows)]


def tied_by_hand(rows, subject, kind):
    bodies = sorted(alone([r for r in rows if r[1] == subject]), key=lambda r: r[3][0] ** 2 + r[3][1] ** 2)
    objects, taken, out = alone([r for r in rows if r[1] == kind]), set(), []
    for n, body in enumerate(bodies):
        box, options = body[3], []
        for o in objects:
            x, _ = apart(box, o[3])
            if o[0] not in taken and straight(box, o[3]) and distance(box, o[3]) <= (box[2] - box[0] if x else box[3] - box[1]):
                options.append((distance(box, o[3]), objects.index(o), o))
        group = []
        if options:
            limit, _, first = min(options)
            both, rivals = around([box, first[3]]), []
            for other in bodies:
                if other is not body and ((meet(both, other[3]) and not within(both, other[3])) or within(other[3], both)) and size(other[3]) >= size(first[3]):
                    rivals.append(distance(other[3], first[3]))
            if not rivals or rivals[-1] >= limit:
                group = [first]
                for o in objects:
                    step = distance(first[3], o[3])
                    if o[0] in taken or o in group or not straight(first[3], o[3]) or step > limit:
                        continue
                    rest = [q[3] for q in bodies[n + 1 :]] + [q[3] for q in objects if q is not o and q[0] not in taken and q not in group]
                    if all(distance(r, o[3]) - step > 0.0001 for r in rest) and not limit - distance(box, around([g[3] for g in group] + [o[3]])) > 0.0001:
                        group.append(o)
        whole, sides = around([box] + [g[3] for g in group]), []
        for s in ((whole[0], whole[1], box[0], whole[3]), (whole[0], whole[1], whole[2], box[1]), (whole[0], box[3], whole[2], whole[3]), (box[2], whole[1], whole[2], whole[3])):
            on = []
            for g in group:
                w, h = min(g[3][2], s[2]) - max(g[3][0], s[0]), min(g[3][3], s[3]) - max(g[3][1], s[1])
                if w >= 0 and h >= 0 and size(g[3]) and w * h / size(g[3]) > 0.6:
                    on.append(g)
            sides.append((int(size(around([g[3] for g in on]))) if on else 0, on))
        most = max(s[0] for s in sides)
        kept = next(on for room, on in sides if room == most) if most else []
        taken |= {g[0] for g in kept}
        objects_box = around([g[3] for g in kept]) if kept else None
        out.append((body[0], n, [g[0] for g in kept], objects_box, around([box] + [g[3] for g in kept])))
    return out


@pytest.mark.parametrize("source", ["as they are", "dense"])
def test_captions_against_loops(spark, source):
    dets = dense(spark) if source == "dense" else fx.detections(spark, DIR)
    want = {(*page, *r[:2]): r[2:] for page, rows in pages_of(dets).items() for r in tied_by_hand(rows, 3, 4)}
    got = {(r["doc_id"], r["page_idx"], r["ord"], r["place"]): (r["objects"], tuple(r["object_box"]) if r["object_box"] else None, tuple(r["box"])) for r in tying.tied(dets, 3, 4).collect()}
    assert got == want and any(len(v[0]) > 1 for v in want.values()) >= (source == "dense")


def test_tables_are_zipped(spark):
    dets = fx.detections(spark, DIR, 200, 260)
    pages = pages_of(dets)
    captions, notes = ({(*page, r[0]): r for page, rows in pages.items() for r in tied_by_hand(rows, 5, kind)} for kind in (6, 7))
    got = {(r["doc_id"], r["page_idx"], r["ord"]): (r["caption_box"], r["note_box"], tuple(r["box"])) for r in tying.tables_with_captions(dets).collect()}
    as_list = lambda b: list(b) if b else None
    assert got == {k: (as_list(captions[k][3]), as_list(notes[k][3]), around([captions[k][4], notes[k][4]])) for k in captions}


def test_captions_worked_out_by_hand(spark):
    rows = [
        (1, 3, (0, 0, 100, 100)),
        (2, 4, (0, 110, 100, 120)),  # nearest below: the seed
        (3, 4, (0, 122, 100, 130)),  # next to it: joins
        (4, 4, (300, 0, 310, 10)),  # too far
        (5, 3, (0, 300, 50, 350)),
        (6, 4, (60, 360, 70, 370)),  # across a corner: never
    ]
    df = spark.createDataFrame([(1, 0, i, k, 0.5, *map(float, b)) for i, k, b in rows], "doc_id long, page_idx int, ord int, category_id int, score double, x0 double, y0 double, x1 double, y1 double")
    got = {r["ord"]: (r["objects"], r["box"]) for r in tying.tied(df, 3, 4).collect()}
    assert got == {1: ([2, 3], [0, 0, 100, 130]), 5: ([], [0, 300, 50, 350])}
    assert tying.tied(df.limit(0), 3, 4).collect() == []
    assert [r["ord"] for r in tying.images_with_captions(df).orderBy("ord").collect()] == [1, 5]


def test_pushing_against_loops(spark):
    dets = fx.detections(spark, DIR, 300, 300).where("category_id in (0, 1, 3)")
    want = set()
    for page, rows in pages_of(dets).items():
        rows = [[r[0], list(r[3])] for r in alone(rows)]
        for (_, a), (_, b) in itertools.combinations(rows, 2):
            if not meet(a, b) or within(a, b):
                continue
            signed = lambda q: (q[2] - q[0]) * (q[3] - q[1])
            large, small = (a, b) if signed(a) > signed(b) else (b, a)
            x, y = ((large[k] + large[k + 2]) / 2 - (small[k] + small[k + 2]) / 2 for k in (0, 1))
            k, off = (0, x) if abs(x) > abs(y) else (1, y)
            if off > 0 and large[k] < small[k + 2]:
                large[k] = small[k + 2] + 1
            if off < 0 and large[k + 2] > small[k]:
                large[k + 2] = small[k] - 1
        want |= {(*page, o, *b) for o, b in rows}
    assert {tuple(r) for r in tying.pushed_apart(dets).collect()} == want


def test_growing_against_loops(spark):
    dets = fx.detections(spark, DIR, 200, 500).where("category_id in (0, 1, 3)")
    want = set()
    for page, rows in pages_of(dets).items():
        boxes, before = [r[3] for r in alone(rows)], None
        while before != len(boxes):
            before, gone, new = len(boxes), set(), []
            for i, a in enumerate(boxes):
                if i in gone:
                    continue
                for j in range(i + 1, len(boxes)):
                    b = boxes[j]
                    held = (a[0] - 2 <= b[0] and a[2] + 2 >= b[2]) or (b[0] - 2 <= a[0] and b[2] + 2 >= a[2])
                    if j not in gone and held and a[3] >= b[1] and a[1] <= b[3]:
                        new.append(around([a, b]))
                        gone |= {i, j}
            boxes = new + [b for i, b in enumerate(boxes) if i not in gone]
        want |= {(*page, i, *b) for i, b in enumerate(boxes)}
    assert {tuple(r) for r in tying.grown_over_overlaps(dets).collect()} == want


def test_pages_with_null_keys_stay(spark):
    rows = [(k, p, i, 0.5, 0.0, 20.0 * i, 10.0, 20.0 * i + 9) for k, p in ((1, 0), (None, 0), (1, None), (None, None)) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, score double, x0 double, y0 double, x1 double, y1 double")
    for got in (kernels.reading_order(df), kernels.touching_groups(df), kernels.separate(df), tying.pushed_apart(df)):
        assert sorted(((r["doc_id"], r["page_idx"], r["ord"]) for r in got.collect()), key=str) == sorted((r[:3] for r in rows), key=str)


@pytest.mark.parametrize("name", ["images_with_captions", "tables_with_captions", "layouts_pushed_apart", "overlaps_grown", "layout_parts", "reading_order", "touching_images"])
def test_pages_pass_once_and_without_data_frames(spark, name):
    """A page costs no data frame of its own, captions and notes of tables come of one pass, and no join is left."""
    from foliant.plans.registry import QUERIES

    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_null_page_keys_are_a_page(spark):
    """Boxes without a document, a page or both are pages of their own, whole over batches of one row."""
    rows = [(d, p, o, 3, 1.0, 0.0, o * 10.0, 10.0, o * 10.0 + 10) for d in (None, 0, 1) for p in (None, 0, 1) for o in range(3)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, category_id int, score double, x0 double, y0 double, x1 double, y1 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = kernels.touching_groups(boxes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 27 and {r["grp"] for r in got} == {0} and len({(r["doc_id"], r["page_idx"], r["ord"]) for r in got}) == 27
