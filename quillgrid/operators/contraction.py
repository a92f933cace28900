"""Values of forests that are not additive, by pruning: source chains first, whole chains at a time.

A node passes on ``max(0, inflow + add)``. Each round takes every chain of nodes that hangs on
a source and ends below the first node with two donors left. Along a chain the maps
x -> max(m, x + c) are composed by doubling, as the composition of two is one again. Half of
the sources of any forest go with each round, so there are at most as many rounds as the highest
Strahler order, which is the round that takes a node; each round doubles over its longest chain.
No chain, tree or level has to fit a task, and deep forests take no round for each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import apart, written


def settle(nodes: DataFrame, adds: list[str] | None = None) -> DataFrame:
    """(cell, order, and for each name in ``adds``: name_in, name_out) of (cell, receiver, *adds):
    name_in is what the donors pass on in all, name_out is max(0, name_in + name); the order is
    Strahler's. A receiver that is no cell, or null, takes what reaches it out of the forest."""
    adds = adds or []
    live = written(nodes.select("cell", "receiver", *adds, *(F.lit(0).cast(nodes.schema[a].dataType).alias(f"{a}_in") for a in adds)))
    done, order = None, 0
    while count := live.count():
        order += 1
        doubled = 0
        donors = live.filter("receiver IS NOT NULL").groupBy(F.col("receiver").alias("_to")).agg(F.count("*").alias("_k"), F.min("cell").alias("_donor"))
        at = live.join(apart(donors), F.col("cell") == F.col("_to"), "left").drop("_to")
        at = written(at.select("*", F.when(F.col("_k") == 1, F.col("_donor")).alias("_p"), *(F.lit(0).cast(live.schema[a].dataType).alias(f"_m_{a}") for a in adds), *((F.col(f"{a}_in") + F.col(a)).alias(f"_c_{a}") for a in adds)))
        chain = at.select("cell", "_p", F.col("_k").isNull().alias("_source"), *(f"_{x}_{a}" for a in adds for x in "mc"))
        while chain.filter("_p IS NOT NULL").head(1):
            # no chain is longer than there are nodes
            if 1 << doubled > 2 * count:
                raise RuntimeError("receivers make a cycle")
            doubled += 1
            # only what still points may grow; a pointer's own map is composed before its node's
            ahead = chain.select(F.col("cell").alias("_q"), F.col("_p").alias("_next"), F.col("_source").alias("_ends"), *(F.col(f"_{x}_{a}").alias(f"_q{x}_{a}") for a in adds for x in "mc"))
            both = chain.join(apart(ahead), F.col("_p") == F.col("_q"), "left")
            composed = []
            for a in adds:
                m = F.when(F.col("_q").isNotNull(), F.greatest(f"_m_{a}", F.col(f"_qm_{a}") + F.col(f"_c_{a}"))).otherwise(F.col(f"_m_{a}"))
                composed += [m.alias(f"_m_{a}"), (F.col(f"_c_{a}") + F.coalesce(f"_qc_{a}", F.lit(0))).alias(f"_c_{a}")]
            chain = written(both.select("cell", F.col("_next").alias("_p"), F.coalesce("_ends", "_source").alias("_source"), *composed))
        taken = chain.filter("_source").select("cell", *(F.greatest(f"_m_{a}", f"_c_{a}").alias(f"{a}_out") for a in adds))
        # what a chain's node takes in is what its donor, if it is in the chain, passes on
        passed = taken.select(F.col("cell").alias("_q"), *(F.col(f"{a}_out").alias(f"_got_{a}") for a in adds))
        ready = written(at.join(apart(taken), "cell").join(apart(passed), F.col("_p") == F.col("_q"), "left").select(
            "cell", "receiver", F.lit(order).alias("order"), *(x for a in adds for x in ((F.col(f"{a}_in") + F.coalesce(f"_got_{a}", F.lit(0))).alias(f"{a}_in"), F.col(f"{a}_out")))
        ))
        if not ready.head(1):
            raise RuntimeError("receivers make a cycle")
        rest = at.join(apart(ready.select("cell")), "cell", "left_anti")
        sent = ready.groupBy(F.col("receiver").alias("_to")).agg(*(F.sum(f"{a}_out").cast(nodes.schema[a].dataType).alias(f"_more_{a}") for a in adds)) if adds else None
        if sent is not None:
            rest = rest.join(apart(sent), F.col("cell") == F.col("_to"), "left")
        live = written(rest.select("cell", "receiver", *adds, *((F.col(f"{a}_in") + F.coalesce(f"_more_{a}", F.lit(0))).alias(f"{a}_in") for a in adds)))
        ready = ready.drop("receiver")
        done = ready if done is None else done.unionByName(ready)
    if done is None:
        done = nodes.select("cell", F.lit(1).alias("order"), *(x for a in adds for x in (F.col(a).alias(f"{a}_in"), F.col(a).alias(f"{a}_out"))))
    return done
