"""Formulas among characters and split words, against plain versions of the rules."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import inline, segment
from foliant.plans import registry
from foliant.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"


def share_of_smaller(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    least = min((q[2] - q[0]) * (q[3] - q[1]) for q in (a, b))
    return w * h / least if least else 0


def placed_by_hand(spans, formulas):
    """Lines as lists of [kind, content, formula, box], worked out over lists of characters that know the span they are in."""
    lines = defaultdict(list)
    for r in sorted(spans, key=lambda r: (r["block_no"], r["line_no"], r["span_no"])):
        chars = [(c["c"], (c["x0"], c["y0"], c["x1"], c["y1"])) for c in r["chars"]]
        lines[r["block_no"], r["line_no"]].append({"kind": "text", "box": tuple(r["box"]), "chars": chars, "f": None, "latex": None})
    boxes = {(r["block_no"], r["line_no"]): (tuple(r["block_box"]), tuple(r["line_box"])) for r in spans}
    for f in sorted(formulas, key=lambda f: f["ord"]):
        eq = (f["x0"], f["y0"], f["x1"], f["y1"])
        for key in sorted(lines):
            block, line = boxes[key]
            on_height = max(0, min(eq[3], line[3]) - max(eq[1], line[1])) / (eq[3] - eq[1])
            if not (share_of_smaller(eq, block) > 0.6 and (share_of_smaller(eq, line) > 0.6 or on_height > 0.6)):
                continue
            row = lines[key]
            hit = [(i, j) for i, s in enumerate(row) for j, (_, b) in enumerate(s["chars"]) if b[2] >= eq[0] and b[0] <= eq[2]]
            if not hit:
                continue
            under = lambda at: max(0, min(eq[2], row[at[0]]["chars"][at[1]][1][2]) - max(eq[0], row[at[0]]["chars"][at[1]][1][0])) / (row[at[0]]["chars"][at[1]][1][2] - row[at[0]]["chars"][at[1]][1][0])  # noqa: B023, E731
            keep = hit[1:] if under(hit[0]) < 0.51 else hit
            keep = keep[:-1] if keep and under(keep[-1]) < 0.51 else keep
            if not keep:
                continue
            taken = [row[i]["chars"][j] for i, j in keep]
            x0, x1 = min(b[0] for _, b in taken), max(b[2] for _, b in taken)
            a, z = row[hit[0][0]], row[hit[-1][0]]
            head, tail = [c for c in a["chars"] if sum(c[1][::2]) / 2 < x0], [c for c in z["chars"] if sum(c[1][::2]) / 2 > x1]
            left = [s for s in row if not (x0 <= s["box"][0] and s["box"][2] <= x1)]
            formula = {"kind": "inline_equation", "box": (x0, eq[1], x1, eq[3]), "chars": taken, "f": f["ord"], "latex": f["latex"]}
            out = left[: hit[0][0] + 1] + [formula] + left[hit[0][0] + 1 :]
            if a is z:
                new = {**z, "chars": tail}
                seen_end = max(b[2] for _, b in head) if head else z["box"][2]
                if tail:
                    start = min(b[0] for _, b in tail)
                    whole = (start, min(b[1] for _, b in tail), max(b[2] for _, b in tail), max(b[3] for _, b in tail))
                    new["box"] = whole if x1 >= seen_end else (start, *z["box"][1:])
                    out.insert(out.index(formula) + 1, new)
            elif tail:
                z["chars"], z["box"] = tail, (min(b[0] for _, b in tail), *z["box"][1:])
            else:
                out = [s for s in out if s is not z]
            if head:
                a["chars"], a["box"] = head, (a["box"][0], a["box"][1], max(b[2] for _, b in head), a["box"][3])
            else:
                out = [s for s in out if s is not a]
            lines[key] = out
            break
    return [(*key, n, s["kind"], s["latex"] if s["f"] is not None else "".join(c for c, _ in s["chars"]), s["f"], *s["box"]) for key, row in lines.items() for n, s in enumerate(row)]


def test_formulas_against_plain_lists(spark):
    spans, formulas = fx.spans_with_chars(spark, DIR), fx.inline_formulas(spark, DIR)
    pages = defaultdict(lambda: ([], []))
    for n, df in enumerate((spans, formulas)):
        for r in df.collect():
            pages[r["doc_id"], r["page_idx"]][n].append(r)
    want = sorted((*page, *r) for page, (s, f) in pages.items() for r in placed_by_hand(s, f))
    got = sorted(tuple(r) for r in inline.with_inline_formulas(spans, formulas).collect())
    assert [r[:8] for r in got] == [r[:8] for r in want]
    assert all(math.isclose(x, y) for a, b in zip(got, want) for x, y in zip(a[8:], b[8:]))
    assert sum(r[5] == "inline_equation" for r in want) > 500


def test_no_formulas_and_no_spans(spark):
    spans, formulas = fx.spans_with_chars(spark, DIR), fx.inline_formulas(spark, DIR)
    assert inline.with_inline_formulas(spans, formulas.limit(0)).count() == spans.count()
    assert inline.with_inline_formulas(spans.limit(0), formulas).collect() == []


def test_splits_against_all_splits():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab1'") for _ in range(rng.randrange(1, 5))) for _ in range(25)})
    lexicon = segment.Lexicon({w: rng.randrange(1, 200) / 64 for w in words})  # sums without rounding, so that ties are ties
    for _ in range(300):
        piece = "".join(rng.choice("abAB1'") for _ in range(rng.randrange(1, 10)))
        ways = []
        for cuts in itertools.product((False, True), repeat=len(piece) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(piece)]
            parts = [piece[a:b] for a, b in zip([0, *ends], ends)]
            cost = 0.0
            for p in parts:
                cost += lexicon.costs.get(p.lower(), math.inf)
            ways.append((cost, [len(p) for p in parts[::-1]], parts))
        cost, _, parts = min(ways)
        if cost == math.inf:
            continue
        joined = []
        for p in parts[::-1]:
            if joined and p != "'" and (joined[0] == "'s" or (p[-1].isdigit() and joined[0][0].isdigit())):
                joined[0] = p + joined[0]
            else:
                joined.insert(0, p)
        assert lexicon.split(piece) == joined, piece


def test_words_split(spark):
    lexicon = spark.createDataFrame([("this", 1.0), ("is", 1.0), ("run", 2.0), ("together", 2.0), ("'s", 1.0), ("john", 2.0), ("20", 1.0), ("24", 1.0), (None, 1.0)], "word string, cost double")
    rows = [(1, "Thisisruntogether, thisisrun"), (2, "runTogether2024isthis"), (3, None), (4, ""), (5, "thisisruntogetherxthis"), (6, "_thisisrun_together_")]
    df = spark.createDataFrame(rows, "n int, text string")
    got = {r["n"]: r["t"] for r in df.select("n", segment.words_split(spark, F.col("text"), lexicon).alias("t")).collect()}
    assert got[1] == "This is run together, thisisrun" and got[3] is None and got[4] == ""
    assert got[2] == "run Together 2024 is this"
    assert got[6] == "this is run together"
    assert segment.Lexicon({}).split("ab-c'") == ["a", "b", "c", "'"]


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(segment, "LEXICON_WORDS", 2)
    with pytest.raises(ValueError):
        segment.collected(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "word string, cost double"))
    ranked = segment.ranked_lexicon(spark.createDataFrame([("b a b, A c " + "x" * 16,)], "text string"), 2).collect()
    assert {r["word"]: round(r["cost"], 6) for r in ranked} == {"a": round(math.log(math.log(2)), 6), "b": round(math.log(2 * math.log(2)), 6)}


def test_spans_are_dealt_out_once(spark):
    """Characters weigh far more than all else, so no join or window may shuffle them again."""
    plan = inline.with_inline_formulas(fx.spans_with_chars(spark, DIR), fx.inline_formulas(spark, DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "row_number" not in plan


def test_query_deals_out_lines_and_not_their_characters(spark):
    df = registry.QUERIES["inline_formulas"](spark, DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "letters" not in plan and "lefts" not in plan
    want = inline.with_inline_formulas(fx.spans_with_chars(spark, DIR), fx.inline_formulas(spark, DIR))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
