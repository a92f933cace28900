"""Drainage and component operators on edge tables.

Paths are followed by pointer doubling: a round joins the pointers with themselves,
so a path of n steps needs log2(n) rounds; each round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import tiles
from quillgrid.operators.spatial import neighbours
from quillgrid.session import apart, cut


def steepest_receivers(grid: DataFrame) -> DataFrame:
    """(cell, receiver) of a grid (cell, r, c, z): the steepest lower of eight neighbours,
    slopes compared as drop squared over distance squared in integers, ties to the first
    direction; null at a pit."""
    return tiles.steepest(grid)


def accumulate(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(cell, total) of nodes (cell, receiver, value): each node's own value and all that
    is upstream of it."""
    return accumulate_all(nodes, ["value"], most_rounds).withColumnRenamed("value", "total")


def accumulate_all(nodes: DataFrame, names: list[str], most_rounds: int = 40) -> DataFrame:
    """(cell, *names) of nodes (cell, receiver, *names): each value summed over the node and
    all that is upstream of it. Doubling: a node sends what it has gathered to its pointer,
    then pointers jump; exact for additive values."""
    at = cut(nodes.select("cell", F.col("receiver").alias("p"), *names))
    for _ in range(most_rounds):
        sent = at.filter("p IS NOT NULL").groupBy(F.col("p").alias("cell")).agg(*(F.sum(n).alias(f"_more_{n}") for n in names))
        jump = at.select(F.col("cell").alias("p"), F.col("p").alias("pp"))
        at = cut(
            at.join(apart(sent), "cell", "left").join(apart(jump), "p", "left")
            .select("cell", F.col("pp").alias("p"), *((F.col(n) + F.coalesce(f"_more_{n}", F.lit(0))).alias(n) for n in names))
        )
        if not at.filter("p IS NOT NULL").head(1):
            return at.select("cell", *names)
    raise RuntimeError("receivers make a cycle, or paths are longer than 2^40")


def roots(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(cell, root, steps): the last node of each node's path."""
    at = cut(nodes.select("cell", F.coalesce("receiver", "cell").alias("root"), F.when(F.col("receiver").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    for _ in range(most_rounds):
        jump = at.select(F.col("cell").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        moved = cut(at.join(apart(jump), "root").select("cell", F.col("next").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("next") != F.col("root")).alias("_m")))
        at = moved.drop("_m")
        if not moved.filter("_m").head(1):
            return at
    raise RuntimeError("receivers make a cycle, or paths are longer than 2^40")


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each connected component. Minimum labels travel
    over the edges and then jump to their label's label."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    at = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(most_rounds):
        offered = both.join(apart(at), both["y"] == at["node"]).groupBy("x").agg(F.min("label").alias("m"))
        low = at.join(apart(offered), at["node"] == offered["x"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("was"))
        low = cut(low)
        hop = low.select(F.col("node").alias("label"), F.col("label").alias("to"))
        at = cut(low.join(apart(hop), "label").select("node", F.col("to").alias("label"), "was"))
        if not at.filter("label != was").head(1):
            return at.select("node", "label")
        at = at.select("node", "label")
    raise RuntimeError("components did not settle")


def dilate(cells: DataFrame, allowed: DataFrame, steps: int) -> DataFrame:
    """Cells (r, c) grown by ``steps`` eight-neighbour steps within ``allowed``."""
    now = cells.select("r", "c").distinct()
    for _ in range(steps):
        grown = neighbours(now, "r", "c", []).select(F.col("_r").alias("r"), F.col("_c").alias("c"))
        now = now.unionByName(grown).distinct().join(allowed.select("r", "c"), ["r", "c"], "left_semi")
    return now


def downstream(nodes: DataFrame, starts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(start, cell, step): all cells that each of ``starts`` (cell) drains through, itself
    at step 0. Doubling: with the pointers of 2^n steps, the first 2^n cells of a path
    give the next 2^n, so a path of any length takes its logarithm in rounds."""
    jump = cut(nodes.filter("receiver IS NOT NULL").select("cell", F.col("receiver").alias("to")))
    path = cut(starts.select(F.col("cell").alias("start"), "cell", F.lit(0).cast("long").alias("step")))
    for n in range(most_rounds):
        ahead = cut(path.join(apart(jump), "cell").select("start", F.col("to").alias("cell"), (F.col("step") + (1 << n)).alias("step")))
        if not ahead.head(1):
            return path
        path = cut(path.unionByName(ahead))
        jump = cut(jump.join(apart(jump.select(F.col("cell").alias("to"), F.col("to").alias("next"))), "to").select("cell", F.col("next").alias("to")))
    raise RuntimeError("receivers make a cycle, or paths are longer than 2^40")
