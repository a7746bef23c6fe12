"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise, word_count

#: Weights that sources take in turn, in ascending order of name, null last.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of rows (source, size) by capped water-filling.

    The sources share the words of all rows by weight. None gets more than
    max_epochs times its own size; what a clamped source leaves goes to the others
    by weight, until none is above. The sources that end up clamped are the first
    ones in ascending order of cap / weight: a source is clamped if the words that
    the earlier ones leave, shared by the weights from it on, reach its cap. The
    windows here run over one row per source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    cap = F.lit(max_epochs) * F.col("source_size")
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    own = own.withColumn("cap", cap).withColumn("left", left).withColumn("rest", F.sum("weight").over(onward))
    own = own.withColumn("clamped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest"))
    level = F.first(F.when(~F.col("clamped"), F.col("left") / F.col("rest")), ignorenulls=True).over(everything)
    own = own.withColumn("level", level)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return own.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of rows (source, size, draw): source, source_size, target, whole, cut.

    A document is taken whole times, and once more if its draw is not above cut.
    Draws are hexadecimal; sums per source and 4096 slices of them place the cut
    in one slice, and only that slice's draws are put in order.
    """
    slice_ = F.substring("draw", 1, 3)
    per_slice = materialise(sizes.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("size")), "slices")
    targets = source_targets(per_slice, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialise(targets.withColumnRenamed("source", "name"), "targets")
    in_order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = per_slice.withColumn("end", F.sum("size").over(in_order)).withColumn("start", F.col("end") - F.col("size"))
    ends = ends.join(targets, F.col("source").eqNullSafe(F.col("name")))
    # "g" is above any hexadecimal digit: the whole slice is below it
    below = ends.where("end <= goal").groupBy("source").agg(F.max(F.concat("slice", F.lit("g"))).alias("cut"))
    torn = ends.where("start < goal and goal < end").select(F.col("source").alias("name"), F.col("slice").alias("at"), "start", "goal")
    inside = sizes.join(torn, F.col("source").eqNullSafe(F.col("name")) & (slice_ == F.col("at")))
    inside = inside.groupBy("source", "draw", "start", "goal").agg(F.sum("size").alias("size"))
    by_draw = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(by_draw) - F.col("size") / 2
    within = inside.withColumn("middle", middle).where("middle <= goal").groupBy("source").agg(F.max("draw").alias("cut"))
    cuts = below.unionByName(within).groupBy("source").agg(F.max("cut").alias("cut"))
    plan = targets.join(cuts, F.col("name").eqNullSafe(F.col("source")), "left")
    return plan.select(F.col("name").alias("source"), "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = materialise(plan.withColumnRenamed("source", "plan_source"), "plan")
    return join_small(rows, plan, "source", "plan_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken), one row per row of docs.

    size counts the words of text (null: none). A source whose target is r times
    its size repeats each document floor(r) times, and once more those that come
    first in the order of a seeded hash of doc_id, until the middle of the next
    one lies beyond the target: what is taken misses the target by half a document
    at most. epochs is that count and taken = epochs * size. Rows of equal doc_id
    are drawn together. Null sources are one source; null doc_ids draw as the
    empty string. A source without words has target 0. No rows in, no rows out.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialise(sizes, "sizes").withColumn("draw", _draw(seed))
    known = _with_plan(sizes, mixing_plan(sizes.drop("doc_id"), weights, max_epochs))
    epochs = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("long")
    return known.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row as often as mix() takes it, in the columns of docs. Texts are not shuffled."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialise(sizes, "sizes").withColumn("draw", _draw(seed))
    plan = mixing_plan(sizes.drop("doc_id"), weights, max_epochs)
    # one struct keeps columns of docs apart from those added here, whatever their names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "source", _draw(seed).alias("draw"))
    known = _with_plan(rows, plan).withColumn("epochs", (F.col("whole") + (F.col("draw") <= F.col("cut")).cast("long")).cast("int"))
    again = known.select("row", F.explode(F.array_repeat(F.lit(0), F.col("epochs"))))
    return again.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
    FROM documents),
own AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source),
levels AS (
    SELECT source, source_size, weight, 3 * source_size AS cap,
           sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM own WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
targets AS (
    SELECT source, source_size,
           CAST(CASE WHEN remaining * weight >= cap * rest THEN cap
                ELSE weight * (SELECT remaining / rest FROM levels WHERE remaining * weight < cap * rest
                               ORDER BY cap / weight, source NULLS LAST LIMIT 1) END AS DOUBLE) AS target
    FROM levels),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2 AS middle
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
