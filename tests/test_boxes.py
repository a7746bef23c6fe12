"""Box functions and page kernels on boxes worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.operators import documents, kernels

CASES = [
    ((0, 0, 10, 10), (0, 0, 10, 10), True, True, 1, 1, 1, 0),
    ((0, 0, 10, 10), (5, 5, 15, 15), True, False, 25 / 175, 0.25, 0.25, 0),
    ((2, 2, 4, 4), (0, 0, 10, 10), True, True, 0.04, 1, 1, 0),
    ((0, 0, 10, 10), (10, 0, 20, 10), True, False, 0, 0, 0, 0),
    ((0, 0, 10, 10), (13, 14, 20, 20), False, False, 0, 0, 0, 5),
    ((0, 0, 10, 10), (12, 0, 20, 10), False, False, 0, 0, 0, 2),
    ((5, 5, 5, 9), (0, 0, 10, 10), True, True, 0, 0, 0, 0),
]


def test_measures(spark):
    df = spark.createDataFrame([tuple(map(float, a + b)) for a, b, *_ in CASES], "x0 double, y0 double, x1 double, y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    a, b = g.box(), g.box("b")
    got = df.select(g.touches(a, b), g.contained(a, b), g.iou(a, b), g.overlap_of_smaller(a, b), g.overlap_of_first(a, b), g.distance(a, b)).collect()
    for row, (_, _, *want) in zip(got, CASES):
        assert list(row) == [pytest.approx(w) for w in want]


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 0, i, s, *map(float, b)) for i, (s, b) in enumerate(rows, 1)], "doc_id long, page_idx int, ord int, score double, x0 double, y0 double, x1 double, y1 double")


def ords(df):
    return sorted(r["ord"] for r in df.collect())


def test_repeated_spans_go_once(spark):
    df = boxes(spark, (0.5, (0, 0, 10, 10)), (0.9, (0, 0, 10, 10)), (0.9, (0, 0, 10, 10)), (0.1, (50, 50, 60, 60)))
    assert ords(kernels.drop_repeated_spans(df)) == [2, 4]


def test_side_by_side_smaller_goes(spark):
    df = boxes(spark, (1.0, (0, 0, 100, 10)), (1.0, (50, 0, 70, 10)), (1.0, (0, 50, 100, 60)))
    assert ords(kernels.drop_until_apart(df)) == [1, 3]


def test_separated_boxes_share_nothing(spark):
    df = boxes(spark, (1.0, (0, 0, 10, 10)), (1.0, (0, 8, 10, 20)), (1.0, (2, 2, 4, 4)))
    got = {r["ord"]: (r["y0"], r["y1"]) for r in kernels.separate(df).collect()}
    assert got == {1: (0, 8.75), 2: (9.25, 20)}


def test_captions_take_nearest_pairs_first(spark):
    df = spark.createDataFrame([(1, 0, 1, 7, 5.0), (1, 0, 1, 8, 1.0), (1, 0, 2, 8, 0.5), (1, 0, 2, 7, 9.0)], "doc_id long, page_idx int, ord int, object int, distance double")
    assert sorted((r["ord"], r["object"]) for r in kernels.assign_captions(df).collect()) == [(1, 7), (2, 8)]


def test_layout_of_two_columns(spark):
    df = boxes(spark, (1.0, (0, 0, 200, 10)), (1.0, (0, 20, 90, 200)), (1.0, (110, 20, 200, 100)), (1.0, (110, 110, 200, 200)))
    got = {r["ord"]: r["layout"] for r in kernels.xy_cut(df).collect()}
    assert sorted(got, key=lambda o: (got[o], o)) == [1, 2, 3, 4] and got[3] == got[4] and len(set(got.values())) == 3
    order = {r["ord"]: r["place"] for r in kernels.reading_order(df).collect()}
    assert sorted(order.values()) == [1, 2, 3, 4]


def test_text_boxes_left_to_right(spark):
    df = boxes(spark, (1.0, (50, 3, 60, 10)), (1.0, (0, 5, 10, 12)), (1.0, (0, 40, 10, 50)))
    got = {r["ord"]: r["place"] for r in kernels.sort_text_boxes(df).collect()}
    assert got == {2: 1, 1: 2, 3: 3}


def test_no_pages(spark):
    none = boxes(spark, (1.0, (0, 0, 1, 1))).where(F.lit(False))
    assert kernels.xy_cut(none).count() == kernels.reading_order(none).count() == 0


def test_position_groups_by_share_of_pages(spark):
    """On 40 pages a box must be met on 10 others, not on 3; on 5 pages on 3."""
    rows = [(1, p, 0, 0.0, 0.0, 10.0, 10.0) for p in range(5)] + [(1, 39, 1, 50.0, 50.0, 60.0, 60.0)] + [(2, p, 0, 0.0, 0.0, 10.0, 10.0) for p in range(4)]
    rows += [(3, p, 0, 0.0, 0.0, 10.0, 10.0) for p in (*range(10), 39)]
    docs = spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert sorted({r["doc_id"] for r in documents.position_groups(docs).collect()}) == [2, 3]


def test_position_groups_of_many_pages_are_those_of_the_sql(spark, tmp_path):
    """The query takes three other pages for enough in a document of 40 pages too, as its SQL does."""
    import duckdb

    from foliant.plans.registry import ORACLES, QUERIES

    text = "\n".join(["a line"] * 32 + [" ".join(["w"] * n) for n in range(1, 288)])
    spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.sql(ORACLES["position_groups"]).fetchall())
    assert len(want) >= 32 and sorted(map(tuple, QUERIES["position_groups"](spark, str(tmp_path)).collect())) == want
