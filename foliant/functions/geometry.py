"""Box predicates and measures as Column expressions.

A box is four DOUBLE columns in page points, origin at the top left. box("a") names
the columns a_x0 .. a_y1, box() the plain x0 .. y1. Everything here compiles to
JVM expressions, so joins keep it as a residual condition beside their page keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    """The box of columns with a prefix; one that ends in a dot names a joined side."""
    sep = prefix if not prefix or prefix.endswith(".") else prefix + "_"
    return Box(*(F.col(sep + c) for c in ("x0", "y0", "x1", "y1")))


def area(a: Box) -> Column:
    return (a.x1 - a.x0) * (a.y1 - a.y0)


def center(a: Box) -> tuple[Column, Column]:
    return (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2


def touches(a: Box, b: Box) -> Column:
    """Boxes overlap or share an edge."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def contained(a: Box, b: Box) -> Column:
    """a lies in b, edges included."""
    return (a.x0 >= b.x0) & (a.y0 >= b.y0) & (a.x1 <= b.x1) & (a.y1 <= b.y1)


def partly_overlaps(a: Box, b: Box) -> Column:
    """The boxes touch and a is not inside b."""
    return touches(a, b) & ~contained(a, b)


def common_width(a: Box, b: Box) -> Column:
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)


def common_height(a: Box, b: Box) -> Column:
    return F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def overlap_area(a: Box, b: Box) -> Column:
    """Area of the intersection, 0 if there is none."""
    return F.greatest(common_width(a, b), F.lit(0.0)) * F.greatest(common_height(a, b), F.lit(0.0))


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for disjoint boxes."""
    both = overlap_area(a, b)
    return _ratio(both, area(a) + area(b) - both)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area, 0 if that is 0."""
    return _ratio(overlap_area(a, b), F.least(area(a), area(b)))


def overlap_of_first(a: Box, b: Box) -> Column:
    """Intersection over the area of a, 0 if that is 0."""
    return _ratio(overlap_area(a, b), area(a))


def overlaps_more_than(a: Box, b: Box, share: float = 0.6) -> Column:
    """More than `share` of a lies in b; a box without area never does."""
    return overlap_of_first(a, b) > share


def smaller_is_first(a: Box, b: Box) -> Column:
    """Of two boxes a is the smaller one; of equal ones too."""
    return area(a) <= area(b)


def left_crossing(a: Box, b: Box) -> Column:
    """b sticks out of a's left edge, with one of its y ends within a."""
    return (b.x0 < a.x0) & (a.x0 < b.x1) & (b.x1 < a.x1) & _y_end_inside(a, b)


def right_crossing(a: Box, b: Box) -> Column:
    """b sticks out of a's right edge, with one of its y ends within a."""
    return (a.x0 < b.x0) & (b.x0 < a.x1) & (a.x1 < b.x1) & _y_end_inside(a, b)


def _y_end_inside(a: Box, b: Box) -> Column:
    return b.y0.between(a.y0, a.y1) | b.y1.between(a.y0, a.y1)


def stacked(a: Box, b: Box, slack: float = 2.0) -> Column:
    """The x range of one lies in the other's, give or take slack, and their y ranges meet."""
    inside = lambda p, q: (p.x0 >= q.x0 - slack) & (p.x1 <= q.x1 + slack)
    return (inside(a, b) | inside(b, a)) & (common_height(a, b) >= 0)


def bottoms_onto(a: Box, b: Box, slack: float = 2.0) -> Column:
    """a's lower edge reaches into b by less than slack, with the x ranges stacked."""
    reach = a.y1 - b.y0
    return stacked(a, b, slack) & (reach > 0) & (reach < slack)


def beside_from_left(a: Box, b: Box, share: float = 0.5) -> Column:
    """b starts within a's x range, and their y overlap is at least `share` of either height."""
    height = common_height(a, b)
    enough = (height >= share * (a.y1 - a.y0)) | (height >= share * (b.y1 - b.y0))
    return b.x0.between(a.x0, a.x1) & (height > 0) & enough


def y_overlap_of_lower(a: Box, b: Box) -> Column:
    """Common height over the smaller height."""
    return _ratio(F.greatest(common_height(a, b), F.lit(0.0)), F.least(a.y1 - a.y0, b.y1 - b.y0))


def same_line(a: Box, b: Box, share: float = 0.8) -> Column:
    return y_overlap_of_lower(a, b) > share


def x_overlap_of(a: Box, b: Box) -> Column:
    """Common width over the width of b."""
    return _ratio(F.greatest(common_width(a, b), F.lit(0.0)), b.x1 - b.x0)


def relative_position(a: Box, b: Box) -> dict[str, Column]:
    """Where b lies to a; touching is none of them."""
    return {"left": b.x1 < a.x0, "right": a.x1 < b.x0, "bottom": b.y1 < a.y0, "top": a.y1 < b.y0}


def distance(a: Box, b: Box) -> Column:
    """Gap between two boxes: 0 if they touch, straight along an axis, else from corner to corner."""
    dx = F.greatest(a.x0 - b.x1, b.x0 - a.x1, F.lit(0.0))
    dy = F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def almost(a: Column, b: Column, slack: float = 1e-4) -> Column:
    return F.abs(a - b) <= slack


def same_box(a: Box, b: Box) -> Column:
    return (a.x0 == b.x0) & (a.y0 == b.y0) & (a.x1 == b.x1) & (a.y1 == b.y1)


def is_rule(a: Box, thick: float = 3.0, aspect: float = 30.0) -> Column:
    """A line drawn as a box: one side is thin, or much shorter than the other."""
    w, h = a.x1 - a.x0, a.y1 - a.y0
    return (F.least(w, h) <= thick) | (F.greatest(w, h) >= aspect * F.least(w, h))


def on_side(a: Box, page_width: Column, share: float = 0.2) -> Column:
    """The box lies in the left or right margin of its page."""
    return (a.x1 <= page_width * share) | (a.x0 >= page_width * (1 - share))


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates for the smallest box around a group's boxes."""
    b = box(prefix)
    return [F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1")]


def polygon_box(points: Column) -> list[Column]:
    """x0, y0, x1, y1 of an array of eight numbers, corners clockwise from the top left."""
    at = lambda i: F.get(points, i).cast("double")
    return [at(0).alias("x0"), at(1).alias("y0"), at(4).alias("x1"), at(5).alias("y1")]


def box_polygon(a: Box) -> Column:
    return F.array(a.x0, a.y0, a.x1, a.y0, a.x1, a.y1, a.x0, a.y1)
