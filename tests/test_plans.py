"""What plans of large queries shuffle and sort, told by the plan itself."""

import re

from foliant.operators import page_rules
from foliant.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_line_texts_deals_lines_and_not_spans(spark):
    """the one shuffle of line_texts comes before lines are cut into spans."""
    text = plan(spark, "line_texts")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    # the plan lists what is done last first
    assert not re.search(r"posexplode\(split\(text#\d+,  , ", text[text.index("Exchange hashpartitioning") :])


def test_watermarks_sort_no_texts(spark):
    """no sort of watermarks holds texts of lines."""
    text = plan(spark, "watermarks")
    assert not [x for x in re.findall(r"\bSort \[.*", text) if "text#" in x]
    assert "ShuffledHashJoin" in text and text.count("SortMergeJoin") <= 1


def test_merged_rules_go_page_by_page(spark):
    """rules come from one kernel over pages; rows and rules as worked out by hand."""
    assert plan(spark, "merged_rules").count("Window") <= 2  # of the fixture
    rows = [(1, 0, 1, 0.0, 10.0, 20.0, 11.0), (1, 0, 2, 22.0, 14.0, 40.0, 15.0), (1, 0, 3, 45.0, 12.0, 50.0, 13.0), (1, 0, 4, 0.0, 20.0, 90.0, 20.0), (1, 0, 5, 0.0, 21.0, 5.0, 25.0), (1, 1, 1, 3.0, 0.0, 9.0, 3.0), (1, 1, 2, 4.0, 0.0, 6.0, 0.0), (1, 1, 3, 13.5, 5.0, 15.0, 6.0)]
    found = page_rules.merged_rules(spark.createDataFrame(rows, "doc_id long, page_idx int, ord int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0.0, 10.0, 40.0, 15.0, 2), (1, 0, 0.0, 20.0, 90.0, 20.0, 1), (1, 0, 45.0, 12.0, 50.0, 13.0, 1), (1, 1, 3.0, 0.0, 15.0, 6.0, 3)]
