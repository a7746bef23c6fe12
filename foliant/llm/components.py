"""Connected components, and groups of nodes that share keys, of graphs too large for one machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of edges (a, b) with the smallest node it reaches.

    Large-star and small-star rounds alternate until the edges stay the same,
    when each node but a root has one edge, to its root. A round groups by node
    with map-side partial minima; the joins that follow carry one row per edge,
    and adaptive execution splits those of a hub. Each round ends in the shared
    folder, so that a lost executor costs at most one round.

    Columns a and b may be of any orderable type, the same for both; edges from
    a node to itself and null ends are left out. Returns (node, root), one row
    per node that has an edge; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    seen = _digest(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        edges = materialise(_small_star(_large_star(edges)), "edges")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(x or 0 for x in row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Each edge has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    ups = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return ups.unionByName(own).where("a <> b").distinct()


#: Nodes under a key up to which all pairs are compared at once, and up to which pairs of different components are without further centres.
FEW, CROWDED = 8, 64
#: Rounds in which nodes of keys of more are compared with a few centres, and the centres of a key in each.
ROUNDS, CENTRES = 2, 2
#: Nodes of such keys for each link found in a round from which on the round changes too little to look at components again before the rest.
IDLE = 50
#: Nodes of a key that one task compares with all of them.
BLOCK = 1024


def _apart(placed: DataFrame) -> DataFrame:
    """placed (key, x, root, ...) with c, the nodes of each key, where a key has nodes of different components."""
    seen = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(seen.where("low <> high").select("key", "c"), "key")


def _across(placed: DataFrame, near: Column) -> DataFrame:
    """All pairs (a, b) of near nodes that share a key and are of different components.

    A key's nodes are dealt into blocks of some BLOCK, each of which meets all of the
    key's nodes, so that a large key is the work of many tasks. A join's rows beyond
    its buffer go to disk, and only near pairs are put out.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = placed.select("key", F.pmod(F.xxhash64("x.v"), blocks).cast("int").alias("block"), "x", "root")
    other = placed.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("x").alias("y"), F.col("root").alias("other"))
    found = own.join(other.hint("merge"), ["key", "block"]).where((F.col("x.v") < F.col("y.v")) & (F.col("root") != F.col("other")) & near)
    return found.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))


def _to_centres(placed: DataFrame, near: Column, centres: int, seed: int) -> DataFrame:
    """Pairs (a, b) of each node and those of its keys' centres, chosen by a hash, that are near and of another component."""
    chosen = [F.min_by(F.struct(F.col("x").alias("y"), F.col("root").alias("other")), F.xxhash64(F.lit(seed * 64 + i), "x.v")) for i in range(centres)]
    middle = placed.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("ms")).select("key", F.explode("ms").alias("m")).select("key", "m.y", "m.other")
    found = placed.join(middle, "key").where((F.col("root") != F.col("other")) & near)
    return found.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))


def linked_groups(filed: DataFrame, near: Column, similar: Callable[[DataFrame], DataFrame], few: int | None = None, crowded: int | None = None, told: tuple[DataFrame | Callable[[DataFrame], DataFrame], Column] | None = None) -> DataFrame:
    """(node, root): the components of links between nodes that share a key, for nodes that have a link.

    filed has a row (key, v, ...) of LONGs for each key of each node v, and beside
    them what `near` tells by, of structs x and y of a node's columns but the key.
    Nodes are linked if they are near, which is cheap to tell, and similar, which
    gets pairs (a, b) of nodes and gives those that are.

    A key of up to `few` nodes has all its pairs compared; the nodes of another are
    compared with its first and its last one, and in some rounds those that are not
    of one component yet with further centres. Near copies of one text are one
    component by then, at a cost in proportion to their number. What is left are
    pairs of different components, and of these all that share a key are compared,
    those of a key of over `crowded` nodes block by block. So no pair is lost that
    shares a key. In a key of c nodes that stay apart, this takes time with the square
    of c and memory with none of it.

    told, (rows (v, ...) or what gives those of nodes (v), a condition on structs x and y that
    have these too), settles pairs of crowded keys where they are found, so that only
    links are written. It may see a pair once for each key that the pair shares.

    filed is dealt and sorted by key once: a window looks back over the nodes of a
    small key and to the ends of another, and what goes on are near pairs, and the
    nodes of keys that are not small. A node comes once under a key.
    """
    few, crowded = few or FEW, crowded or CROWDED
    attributes = [c for c in filed.columns if c != "key"]
    by_v = Window.partitionBy("key").orderBy("x.v")
    whole = by_v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = [F.lag("x", i).over(by_v).alias(f"back{i}") for i in range(1, few)]
    met = filed.select("key", F.struct(*attributes).alias("x")).select("key", "x", F.count(F.lit(1)).over(whole).alias("c"), F.first("x").over(whole).alias("low"), F.last("x").over(whole).alias("high"), *back).where("c > 1")
    small = F.array_compact(F.array(*[f"back{i}" for i in range(1, few)])) if few > 1 else F.array("low")
    # the null stands for the node itself under a key that is not small
    others = F.when(F.col("c") <= few, small).otherwise(F.array("low", "high", F.lit(None)))
    met = met.select("key", "x", F.explode(others).alias("y")).where(F.col("y").isNull() | ((F.col("x.v") != F.col("y.v")) & near))
    itself = F.col("y").isNull()
    a, b = F.least("x.v", "y.v"), F.greatest("x.v", "y.v")
    met = materialise(met.select(F.when(itself, F.col("key")).alias("key"), F.when(itself, F.col("x")).alias("x"), F.when(~itself, a).alias("a"), F.when(~itself, b).alias("b")), "met")
    pairs, many = met.where("a is not null").select("a", "b"), met.where("a is null").select("key", "x")
    groups = connected_components(similar(materialise(pairs.distinct(), "pairs")))

    def apart() -> DataFrame:
        placed = many.join(groups, F.col("x.v") == F.col("node"), "left").select("key", "x", F.coalesce("root", "x.v").alias("root"))
        return materialise(_apart(placed), "apart")

    waiting: list[DataFrame] = []

    def links(found: DataFrame) -> int:
        """How many of the pairs found are links, which wait to be joined."""
        found = materialise(found.distinct(), "found")
        more = None if found.isEmpty() else materialise(similar(found), "more")
        n = 0 if more is None else more.count()
        if n:
            waiting.append(more)
        return n

    def joined() -> DataFrame:
        """groups with the links that wait."""
        edges = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        while waiting:
            edges = edges.unionByName(waiting.pop())
        return connected_components(edges)

    level = apart()
    for seed in range(ROUNDS):
        hot = level.where(F.col("c") > crowded)
        n = links(_to_centres(hot, near, CENTRES, seed))
        if n * IDLE <= hot.count():
            break
        groups = joined()
        level = apart()
    across = _across(level.where(F.col("c") <= crowded), near)
    hot = level.where(F.col("c") > crowded)
    if not hot.isEmpty():
        close = near
        if told is not None:
            texts, rule = told
            rows = texts(hot.select("x.v").distinct()) if callable(texts) else texts
            more = [c for c in rows.columns if c != "v"]
            hot = hot.join(rows.withColumnRenamed("v", "told_v"), F.col("x.v") == F.col("told_v"))
            hot = hot.select("key", "c", "root", F.struct(*[F.col(f"x.{c}").alias(c) for c in attributes], *more).alias("x"))
            close = close & rule
        across = across.unionByName(_across(hot, close))
    links(across)
    return joined() if waiting else groups
