"""Lines that move over page ends, and neighbours of boxes, against plain loops over the rules."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import flow, neighbours
from foliant.plans.registry import QUERIES
from foliant.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"
LINES = "doc_id long, page_idx int, block_no int, line_no int, type string, first_kind string, last_kind string, x0 double, x1 double, text string, left double, right double, extra int"


def made_lines(rng):
    rows, lists = [], []
    for doc in range(150):
        line = 0
        for page in range(14):
            if rng.random() < 0.05:
                continue
            lists.append((doc, page, rng.random() < 0.2, rng.random() < 0.5))
            for block in range(rng.choice([1, 1, 1, 2])):
                kind = "text" if rng.random() < 0.93 else "image"
                lead = rng.random() < 0.3
                for _ in range(rng.choice([1, 2, 3])):
                    x0 = 90.0 if lead else rng.choice([72.0, 72.0, 72.0, 80.0, 90.0])
                    x1, text = rng.choice([540.0, 540.0, 540.0, 400.0]), rng.choice(["goes on ", "goes on", "ends.", "  "] if rng.random() < 0.5 else ["goes on"])
                    edges = (None, None) if rng.random() < 0.03 else (72.0, 540.0)
                    rows.append((doc, page, block, line, kind, rng.choice(["text"] * 9 + ["table"]), rng.choice(["inline_equation"] * 9 + ["image"]), x0, x1, text, *edges, 1))
                    line += 1
    return rows, lists


def moved_by_hand(rows, lists):
    """{(doc, line): (to page, to block, crosses, block gave all away)} by giving lines over from block to block, page by page."""
    out, books, info = {}, defaultdict(lambda: defaultdict(lambda: defaultdict(list))), {r[:2]: r[2:] for r in lists}
    for r in rows:
        books[r[0]][r[1]][r[2]].append(r)
        out[r[0], r[3]] = (r[1], r[2], False, False)
    for doc, pages in books.items():
        for page in sorted(pages):
            if page - 1 not in pages:
                continue
            last_no, first_no = max(pages[page - 1]), min(pages[page])
            end, start = pages[page - 1][last_no], pages[page][first_no]
            own = [r for r in rows if r[0] == doc and r[1] == page and r[2] == first_no]
            was = [r for r in rows if r[0] == doc and r[1] == page - 1 and r[2] == last_no]
            if was[0][4] != "text" or own[0][4] != "text":
                continue
            if end and start:
                a, b = end[-1], start[0]
                tail = a[9].strip()
                if a[6] in flow.FLOWING and b[5] in flow.FLOWING and None not in (a[11], b[10]) and a[8] == a[11] and b[7] == b[10] and tail and tail[-1] not in flow.STOPS:
                    for r in start:
                        out[doc, r[3]] = (page - 1, last_no, True, True)
                    end.extend(start)
                    start.clear()
            if info[doc, page - 1][1] and not info[doc, page][0]:
                lead = []
                for r in start:
                    if r[10] is None or r[7] <= r[10]:
                        break
                    lead.append(r)
                if lead and len({r[7] for r in lead}) == 1:
                    for r in lead:
                        out[doc, r[3]] = (page - 1, last_no, True, False)
                    end.extend(lead)
                    del start[: len(lead)]
    return out


def test_lines_over_pages(spark):
    rows, lists = made_lines(random.Random(4))
    df = spark.createDataFrame(rows, LINES).repartition(3)
    got = flow.joined_over_pages(df, spark.createDataFrame(lists, "doc_id long, page_idx int, starts_list boolean, ends_list boolean"))
    assert set(df.columns) < set(got.columns)
    found = {(r["doc_id"], r["line_no"]): (r["to_page"], r["to_block"], r["cross_page"], r["lines_deleted"]) for r in got.collect()}
    want = moved_by_hand(rows, lists)
    assert found == want
    assert sum(v[3] for v in want.values()) > 100 and sum(v[2] and not v[3] for v in want.values()) > 50


def test_lines_over_pages_of_nothing(spark):
    lists = spark.createDataFrame([], "doc_id long, page_idx int, starts_list boolean, ends_list boolean")
    assert flow.joined_over_pages(spark.createDataFrame([], LINES), lists).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None, None, None, None)], LINES)
    assert [r["cross_page"] for r in flow.joined_over_pages(one, lists).collect()] == [False]


def test_neighbours_by_extended_edges(spark):
    dets = fx.detections(spark, DIR).where("page_idx < 2 and doc_id < 8").withColumn("x1_ext", F.when(F.col("ord") % 3 == 0, F.col("x1") + 300).when(F.col("ord") % 3 == 1, F.lit(0.0)))
    pages = defaultdict(list)
    for r in dets.collect():
        pages[r["doc_id"], r["page_idx"]].append(r)
    want = {}
    for page, boxes in pages.items():
        for a in boxes:
            seen = []
            for b in sorted(boxes, key=lambda r: r["ord"]):
                meets = (a["y0"] < b["y1"] and b["y0"] < a["y1"]) or (a["y0"], a["y1"]) == (b["y0"], b["y1"])
                crosses = b["x1"] > a["x0"] > b["x0"] and (b["y0"] <= a["y0"] <= b["y1"] or b["y0"] <= a["y1"] <= b["y1"])
                if b is not a and ((b["x1"] <= a["x0"] and meets) or crosses):
                    seen.append(b)
            seen.sort(key=lambda b: b["x1_ext"] or b["x1"], reverse=True)
            want[(*page, a["ord"])] = seen[0]["ord"] if seen else None
    got = neighbours.direct(dets).collect()
    assert {(r["doc_id"], r["page_idx"], r["ord"]): r["left"] for r in got} == want
    assert [r["left"] for r in neighbours.direct(dets.limit(1)).collect()] == [None]
    assert [(r["idx_x"], r["idx_y"]) for r in neighbours.depths(dets.limit(1)).collect()] == [(0, 0)]


@pytest.mark.parametrize("name", ["direct_neighbours", "box_depths", "nearest_text_by_side"])
def test_neighbours_need_no_join(spark, name):
    """Pairs of boxes meet in their page's task: none are written, sorted or held for a whole partition."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["parsed_blocks", "page_status"])
def test_steps_start_where_others_ended(spark, name):
    """Self joins of self joins of whole tables are not planned again by each step that follows."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and plan.count("Join") <= 4


def test_page_status_by_loops(spark):
    """Pages are told by their blocks: unclear ones first, then those with over two blocks side by side in a part of the layout."""
    pages = defaultdict(list)
    for r in QUERIES["parsed_blocks"](spark, DIR).collect():
        pages[r["doc_id"], r["page_idx"]].append((r["layout"], r["label"]))
    want = {}
    for page, blocks in pages.items():
        beside = max([sum(b == (layout, "H") for b in blocks) for layout, _ in blocks])
        reason = "complicated_layout" if any(label == "U" for _, label in blocks) else "too_many_columns" if beside > 2 else None
        want[page] = (len(blocks), reason is not None, reason)
    got = {(r["doc_id"], r["page_idx"]): (r["n_blocks"], r["need_drop"], r["reason"]) for r in QUERIES["page_status"](spark, DIR).collect()}
    assert got == want and len({w[2] for w in want.values()}) > 1
