"""Depressions as a graph of basins, and what cells meet first on their way down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import tiles
from quillgrid.operators.graph import roots, steepest_receivers
from quillgrid.session import apart, written


def filled(grid: DataFrame) -> DataFrame:
    """(cell, filled, depth) of a grid (cell, r, c, z, outlet): the least level at which water
    on a cell reaches an outlet by eight neighbours; null where none can be reached.

    Cells are first gathered into the basins of their pits. Between basins only the lowest
    pass counts, and the level of a basin is the highest pass on the best way out. Each
    round, every group of basins without an outlet joins the group beyond its lowest pass
    (ties by the groups' labels), and its basins' levels rise to that pass. Groups at
    least halve, so the rounds are the logarithm of the basins; no basin has to fit a task.
    """
    land = grid.select("cell", "outlet").withColumnRenamed("outlet", "_out")
    fall = steepest_receivers(grid.select("cell", "r", "c", "z")).join(apart(land), "cell")
    down = roots(fall.select("cell", F.when(~F.col("_out"), F.col("receiver")).alias("receiver"))).select("cell", F.col("root").alias("basin"))
    at = written(grid.join(apart(down), "cell"))
    met = tiles.lowest_passes(at.select("cell", "r", "c", "z", F.col("basin").alias("label"), F.lit(False).alias("low")))
    passes = met.select("a", "b", "w").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    basins = written(at.filter("cell = basin").select("basin", F.col("basin").alias("label"), F.lit(None).cast(grid.schema["z"].dataType).alias("level"), F.col("outlet").alias("open")))
    passes = written(passes)
    while True:
        groups = basins.groupBy("label").agg(F.bool_or("open").alias("open"))
        shut = groups.filter("NOT open").select(F.col("label").alias("a"))
        order = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")
        pick = written(passes.join(shut, "a", "left_semi").groupBy("a").agg(F.min(order).alias("k")).select("a", "k.w", "k.b"))
        if not pick.head(1):
            break
        # two groups that choose each other share one pass: the lesser label leads
        back = pick.select(F.col("a").alias("b"), F.col("b").alias("_back"))
        lead = pick.join(back, "b", "left").select(F.col("a").alias("cell"), F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), None).otherwise(F.col("b")).alias("receiver"))
        whole = groups.select(F.col("label").alias("cell")).join(lead, "cell", "left")
        moved = written(roots(whole).select(F.col("cell").alias("label"), F.col("root").alias("to")))
        raised = pick.select(F.col("a").alias("label"), "w")
        basins = written(basins.join(raised, "label", "left").join(moved, "label").select("basin", F.col("to").alias("label"), F.greatest("level", "w").alias("level"), "open"))
        one, two = (moved.select(F.col("label").alias(x), F.col("to").alias(f"_{x}")) for x in ("a", "b"))
        passes = written(passes.join(one, "a").join(two, "b").filter("_a != _b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.min("w").alias("w")))
    reached = basins.join(groups.withColumnRenamed("open", "_reached"), "label").select("basin", "level", "_reached")
    level = F.when(F.col("_reached"), F.greatest("z", "level"))
    return at.join(apart(reached), "basin").select("cell", level.alias("filled"), (level - F.col("z")).alias("depth"))


def owners(nodes: DataFrame) -> DataFrame:
    """(cell, owner) of nodes (cell, receiver, owner): the first owner met on the way down,
    a cell's own first; null if there is none."""
    ends = roots(nodes.select("cell", F.when(F.col("owner").isNull(), F.col("receiver")).alias("receiver")))
    return ends.join(apart(nodes.select(F.col("cell").alias("root"), "owner")), "root").select("cell", "owner")


#: Why a reach cannot be passed, in the order in which reasons are looked for.
REASONS = {"dry": 1, "obstacle": 6, "slope": 5, "depth": 2, "width": 3, "current": 4}
NO_OUTLET = 7


def navigable(reaches: DataFrame, vessels: list[dict], most_rounds: int = 40) -> DataFrame:
    """(vessel, month, cell, open, limit_reach, reason, route) of reaches (cell, receiver, month,
    length, slope, flow, width, depth, velocity, obstacle, outlet) and vessel classes (vessel,
    min_depth, min_width, max_slope, max_velocity): a reach is open if it and all below it
    let the vessel pass until an outlet. Else the first reach that does not and why
    (``REASONS``, or ``NO_OUTLET`` at an end without outlet); reason 0 and no reach if open.

    A reach has one receiver in all months. Months and classes of a reach stand side by side in one row, so a round
    joins reaches, not their months; rounds are the logarithm of the longest path until all of a
    reach are settled.
    """
    tests = lambda v: {
        "dry": F.col("flow") <= 0, "obstacle": F.col("obstacle"), "slope": F.col("slope") > v["max_slope"], "depth": F.col("depth") < v["min_depth"],
        "width": F.col("width") < v["min_width"], "current": F.col("velocity") > v["max_velocity"],
    }
    onward = -1
    local = lambda v: F.coalesce(*(F.when(tests(v)[k], code) for k, code in REASONS.items()), F.when(F.col("outlet"), 0).when(F.col("receiver").isNull(), NO_OUTLET).otherwise(onward))
    kind = reaches.schema["month"].dataType
    months = sorted(r[0] for r in reaches.select("month").distinct().collect())
    told = reaches.select("cell", "receiver", "month", "length", *(local(v).alias(f"_{k}") for k, v in enumerate(vessels)))
    of = lambda m, c: F.max(F.when(F.col("month") == m, F.col(c)))
    wide = told.groupBy("cell").agg(
        F.min("receiver").alias("_low"), F.max("receiver").alias("_high"), *(of(m, "length").alias(f"_l{j}") for j, m in enumerate(months)),
        *(of(m, f"_{k}").alias(f"_{k}_{j}") for k in range(len(vessels)) for j, m in enumerate(months)),
    )
    one = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.lit("a reach has two receivers")).cast("long"))
    layers = [(v["vessel"], m) for v in vessels for m in months]
    state = lambda k, j: F.when(F.col(f"_{k}_{j}").isNotNull(), F.struct(F.when(F.col(f"_{k}_{j}") != onward, F.col("cell")).alias("stop"), F.col(f"_l{j}").alias("way"), F.col(f"_{k}_{j}").alias("reason")))
    open_ = F.exists("_s", lambda x: x["reason"] == onward)
    at = wide.select("cell", one.alias("p"), F.array(*(state(k, j) for k in range(len(vessels)) for j in range(len(months)))).alias("_s"))
    at = written(at.withColumn("p", F.when(open_, F.col("p"))))
    for _ in range(most_rounds):
        going = at.filter("p IS NOT NULL")
        if not going.head(1):
            break
        ahead = at.select(F.col("cell").alias("p"), F.col("p").alias("_next"), F.col("_s").alias("_t"))
        # what has not met its stop goes on from where the next one begins; a missing reach ends a way without result
        further = lambda a, b: F.when(a["reason"] != onward, a).when(a.isNotNull() & b.isNotNull(), F.struct(b["stop"].alias("stop"), (a["way"] + b["way"]).alias("way"), b["reason"].alias("reason")))
        met = going.join(apart(ahead), "p", "left").select("cell", F.col("_next").alias("p"), F.zip_with("_s", F.coalesce("_t", F.array()), further).alias("_s"))
        at = written(met.withColumn("p", F.when(open_, F.col("p"))).unionByName(at.filter("p IS NULL")))
    else:
        raise RuntimeError("receivers make a cycle, or paths are longer than 2^40")
    names = F.array(*(F.struct(F.lit(v).alias("vessel"), F.lit(m).cast(kind).alias("month")) for v, m in layers)) if layers else None
    if names is None:
        return reaches.limit(0).select(F.lit("").alias("vessel"), "month", "cell", F.lit(False).alias("open"), F.col("cell").alias("limit_reach"), F.lit(0).alias("reason"), F.col("length").alias("route"))
    each = at.select("cell", F.explode(F.filter(F.zip_with("_s", names, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["s"].isNotNull() & (x["s"]["reason"] != onward))).alias("_x")).select("cell", "_x.s.*", "_x.n.*")
    open_ = F.col("reason") == 0
    return each.select("vessel", "month", "cell", open_.alias("open"), F.when(~open_, F.col("stop")).alias("limit_reach"), "reason", F.when(open_, F.col("way")).otherwise(F.lit(0)).alias("route"))
