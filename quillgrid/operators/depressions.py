"""The tree of depressions of a grid, and the lakes that water makes of it.

A pit's basin is a leaf. Two depressions whose lowest pass leads to each other become a node
at that pass; a depression whose lowest pass leads to what already drains to an outlet ends
there. That is the order in which rising water finds the passes: by height, then by the cell
of the pass, then by direction.

The tree is built on the graph of basins in rounds. In a round every depression picks its lowest
pass. Along picks the passes only fall, so the picks make trees of depressions, each ending at
an outlet or at two that picked each other. In the first kind all end at their picks. In
the second, those whose pick lies below the lowest pass out of the tree join in order of
picks; the others wait. Pairs that picked each other at least halve, so the
rounds are the logarithm of the basins, however deep the depression tree is.

Sums over subtrees and ways up the tree go by doubling. Nothing here needs a basin, a lake or a
level of the tree in one task; the driver only learns whether a round found anything.

Cells are integers from 0 to 2^59. Heights, volumes and losses may be integers (then all
results are exact) or doubles. Nodes are named by their pit's cell, or if joined by
-(8 * cell of the pass + direction) - 2; -1 stands for outlets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import graph, tiles
from quillgrid.operators.basins import owners
from quillgrid.operators.contraction import settle
from quillgrid.operators.spatial import neighbours
from quillgrid.operators.statistics import running_totals
from quillgrid.session import written

OUTLET = -1


def pits(grid: DataFrame) -> DataFrame:
    """Adds ``leaf`` to a grid (cell, r, c, z, outlet): the pit below each cell, or ``OUTLET``."""
    land = grid.select(F.col("cell").alias("_cell"), F.col("outlet").alias("_out"))
    # an outlet is lower than anything
    down = graph.steepest_receivers(grid.select("cell", "r", "c", "z"))
    sea = neighbours(grid.filter("outlet"), "r", "c", ["cell"]).groupBy(F.col("_r").alias("_r0"), F.col("_c").alias("_c0")).agg(F.min(F.struct("dir", "cell"))["cell"].alias("_sea"))
    ways = down.join(land, F.col("cell") == F.col("_cell")).join(grid.select(F.col("cell").alias("_cell2"), "r", "c"), F.col("cell") == F.col("_cell2"))
    ways = ways.join(sea, (F.col("r") == F.col("_r0")) & (F.col("c") == F.col("_c0")), "left")
    ways = ways.select("cell", F.when(F.col("_out"), None).otherwise(F.coalesce("receiver", "_sea")).alias("receiver"))
    ends = graph.roots(ways).select(F.col("cell").alias("_cell"), "root").join(land.withColumnRenamed("_cell", "root"), "root")
    return grid.join(ends, F.col("cell") == F.col("_cell")).select(*grid.columns, F.when(F.col("_out"), OUTLET).otherwise(F.col("root")).cast("long").alias("leaf"))


def passes(at: DataFrame) -> DataFrame:
    """(a, b, key, a0, b0): the lowest pass between leaves a and b, in both directions, of
    a grid with leaves; key is (height, cell, direction) of its higher cell."""
    met = tiles.lowest_passes(at.select("cell", "r", "c", "z", F.col("leaf").alias("label"), F.col("outlet").alias("low")))
    key = F.struct("w", "at", "dir")
    met = met.groupBy(F.col("a").alias("leaf"), F.col("b").alias("_leaf")).agg(F.min(key).alias("key"))
    one, two = met.select(F.col("leaf").alias("a"), F.col("_leaf").alias("b"), "key"), met.select(F.col("_leaf").alias("a"), F.col("leaf").alias("b"), "key")
    both = one.unionByName(two).groupBy("a", "b").agg(F.min("key").alias("key")).filter(F.col("a") != OUTLET)
    return both.select("a", "b", "key", F.col("a").alias("a0"), F.col("b").alias("b0"))


def tree(at: DataFrame) -> DataFrame:
    """(node, parent, spill, pass_cell, inside, beyond, base) of a grid with leaves: where a
    depression spills, the cell of that pass, the leaves on both sides of it (``beyond`` is
    ``OUTLET`` towards what has drained before), and the height at which it begins. The parent is null
    for those that spill to what drains; spill too where no way leads to an outlet."""
    links = written(passes(at))
    low = at.filter(F.col("leaf") == F.col("cell"))
    found = written(low.select(F.col("cell").alias("node"), F.col("z").alias("base")))
    tops = written(low.select(F.col("cell").alias("label"), F.col("cell").alias("node")))
    bases, spills = [found], []
    while True:
        pick = written(links.groupBy("a").agg(F.min(F.struct("key", "b", "a0", "b0")).alias("p")).select("a", "p.*"))
        if not pick.head(1):
            break
        back = pick.select(F.col("a").alias("b"), F.col("b").alias("_back"))
        leads = (F.col("_back") == F.col("a")) & (F.col("a") < F.col("b"))
        ways = pick.join(back, "b", "left").select(F.col("a").alias("cell"), F.when(leads, None).otherwise(F.col("b")).alias("receiver"))
        ends = tops.select(F.col("label").alias("cell")).join(ways, "cell", "left").select("cell", "receiver")
        ends = ends.unionByName(ends.sparkSession.createDataFrame([(OUTLET, None)], "cell long, receiver long"))
        of = graph.roots(ends).select(F.col("cell").alias("label"), F.col("root").alias("group"))
        # the lowest pass out of each group of picks
        ga, gb = (of.select(F.col("label").alias(x), F.col("group").alias(f"g{x}")) for x in ("a", "b"))
        out = links.join(ga, "a").join(gb, "b").filter("ga != gb").groupBy(F.col("ga").alias("group")).agg(F.min("key").alias("_rim"))
        member = pick.join(of, F.col("a") == F.col("label")).drop("label").join(tops, F.col("a") == F.col("label")).drop("label").join(out, "group", "left")
        joins = (F.col("group") != OUTLET) & (F.col("_rim").isNull() | (F.col("key") < F.col("_rim")))
        member = written(member.withColumn("joins", joins))
        ended = member.filter(F.col("group") == OUTLET)
        # in order of picks, the leader (whose pick is its partner's too) first
        ranked = member.filter("joins").withColumns({"_w": F.col("key.w"), "_at": F.col("key.at"), "_dir": F.col("key.dir"), "_lead": F.when(F.col("a") == F.col("group"), 0).otherwise(1), "_one": F.lit(1).cast("long")})
        order = [F.col(x) for x in ("_w", "_at", "_dir", "_lead")]
        ranked = written(running_totals(ranked, "group", order, "_one").withColumnRenamed("_before", "rank").drop("_all"))
        joint = (-(F.col("key.at") * 8 + F.col("key.dir")) - 2).alias("joint")
        new = ranked.filter("rank > 0").select("group", "rank", "node", joint, "key", "a0", "b0")
        into = new.select(F.col("joint").alias("parent"), F.col("key.w").alias("spill"), F.col("key.at").alias("pass_cell"), "group", "rank", "a0", "b0", "node")
        mine = into.select("node", "parent", "spill", "pass_cell", F.col("a0").alias("inside"), F.col("b0").alias("beyond"))
        # what has been joined so far is the other child of each join
        so_far = ranked.filter("rank = 0").select("group", F.lit(1).cast("long").alias("rank"), "node").unionByName(new.select("group", (F.col("rank") + 1).alias("rank"), F.col("joint").alias("node")))
        other = into.drop("node").join(so_far, ["group", "rank"]).select("node", "parent", "spill", "pass_cell", F.col("b0").alias("inside"), F.col("a0").alias("beyond"))
        closed = ended.select("node", F.lit(None).cast("long").alias("parent"), F.col("key.w").alias("spill"), F.col("key.at").alias("pass_cell"), F.col("a0").alias("inside"), F.col("b0").alias("beyond"))
        spills += [mine, other, closed]
        bases.append(new.select(F.col("joint").alias("node"), F.col("key.w").alias("base")))
        last = new.groupBy("group").agg(F.max(F.struct("rank", "joint"))["joint"].alias("_top"))
        now = F.when(F.col("group") == OUTLET, OUTLET).when(F.col("joins"), F.col("group")).otherwise(F.col("a")).cast("long")
        moved = member.select(F.col("a").alias("label"), now.alias("to"))
        kept = tops.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to").filter(F.col("label") != OUTLET)
        kept = kept.join(last.withColumnRenamed("group", "label"), "label", "left").groupBy("label").agg(F.max(F.coalesce("_top", "node")).alias("node"))
        tops = written(kept)
        ma, mb = (moved.select(F.col("label").alias(x), F.col("to").alias(f"_{x}")) for x in ("a", "b"))
        links = links.join(ma, "a", "left").join(mb, "b", "left").withColumns({"a": F.coalesce("_a", "a"), "b": F.coalesce("_b", "b")}).filter((F.col("a") != F.col("b")) & (F.col("a") != OUTLET))
        links = written(links.groupBy("a", "b").agg(F.min(F.struct("key", "a0", "b0")).alias("p")).select("a", "b", "p.*"))
    nodes = bases[0]
    for b in bases[1:]:
        nodes = nodes.unionByName(b)
    if not spills:
        none = {"parent": "long", "pass_cell": "long", "inside": "long", "beyond": "long"}
        return nodes.select("node", *(F.lit(None).cast(none.get(c, at.schema["z"].dataType)).alias(c) for c in ("parent", "spill", "pass_cell", "inside", "beyond")), "base")
    over = spills[0]
    for s in spills[1:]:
        over = over.unionByName(s)
    return written(nodes.join(over, "node", "left").select("node", "parent", "spill", "pass_cell", "inside", "beyond", "base"))


def attached(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, leaf, z, node): the lowest depression of the tree above its leaf that floods a
    cell, null if none does. Cells above their leaf's spill climb by jumps of falling powers of two."""
    zs = nodes.select(F.col("node").alias("_n"), F.col("spill").alias("_s"), F.col("parent").alias("_p"))
    cells = at.filter((F.col("leaf") != OUTLET)).join(zs, F.col("leaf") == F.col("_n"))
    low = cells.filter("_s IS NULL OR _s > z").select("cell", "leaf", "z", F.col("leaf").alias("node"))
    high = written(cells.filter("_s <= z").select("cell", "leaf", "z", F.col("leaf").alias("_now"), F.col("_p").alias("node")))
    spill = nodes.select(F.col("node").alias("_to"), F.col("spill").alias("_s"))
    jumps = [written(nodes.filter("parent IS NOT NULL").select("node", F.col("parent").alias("_to")).join(spill, "_to").filter("_s IS NOT NULL"))]
    while jumps[-1].head(1):
        step = jumps[-1]
        far = step.select(F.col("node").alias("_to"), F.col("_to").alias("_to2"), F.col("_s").alias("_s2"))
        jumps.append(written(step.join(far, "_to").select("node", F.col("_to2").alias("_to"), F.col("_s2").alias("_s"))))
    for step in reversed(jumps[:-1]):
        step = step.withColumnRenamed("node", "_now")
        high = written(high.join(step, "_now", "left").select("cell", "leaf", "z", F.when(F.col("_s") <= F.col("z"), F.col("_to")).otherwise(F.col("_now")).alias("_now")))
    parents = nodes.select(F.col("node").alias("_now"), F.col("parent").alias("node"))
    high = high.select("cell", "leaf", "z", "_now").join(parents, "_now").select("cell", "leaf", "z", "node")
    dry = at.filter(F.col("leaf") == OUTLET).select("cell", "leaf", "z", F.lit(None).cast("long").alias("node"))
    return written(low.unionByName(high).unionByName(dry))


def subtree_sums(nodes: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(node, *names): what rows (node, *names) add up to at and below each node."""
    own = values.groupBy("node").agg(*(F.sum(n).alias(n) for n in names))
    all_ = nodes.select(F.col("node").alias("cell"), F.col("parent").alias("receiver")).join(own.withColumnRenamed("node", "cell"), "cell", "left").fillna(0, names)
    return graph.accumulate_all(all_, names).withColumnRenamed("cell", "node")


def budget(at: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(node, runoff, loss, area, volume): the water that falls into a depression, and, when it
    stands at its spill, the net loss of its surface, its area and volume; ``at`` has runoff, loss
    and area of each cell. Loss and volume are null where it never spills."""
    of = cells.select("cell", "leaf", "node").join(at.select("cell", "z", "runoff", "loss", "area"), "cell")
    fallen = of.filter(F.col("leaf") != OUTLET).select(F.col("leaf").alias("node"), "runoff", *(F.lit(0).cast(at.schema[c].dataType).alias(c) for c in ("loss", "area")), (F.lit(0) * F.col("z") * F.col("area")).alias("_za"))
    wet = of.filter("node IS NOT NULL").select("node", F.lit(0).cast(at.schema["runoff"].dataType).alias("runoff"), "loss", "area", (F.col("z") * F.col("area")).alias("_za"))
    sums = subtree_sums(nodes, fallen.unionByName(wet), ["runoff", "loss", "area", "_za"])
    ends = nodes.select("node", "spill")
    spills = F.col("spill").isNotNull()
    return written(sums.join(ends, "node").select("node", "runoff", F.when(spills, F.col("loss")).alias("loss"), "area", F.when(spills, F.col("spill") * F.col("area") - F.col("_za")).alias("volume")))


def cascade(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(node, runoff, loss, water, full, active, passed): where water stands in the long run. A
    depression is full if what reaches it covers its loss at its spill and all within it are full; it is a lake of its own
    (active) if it is a leaf or both its children are full; a full one passes its surplus over its
    pass into the leaf beyond unless its sibling is full too, when both are one lake. ``water`` is
    what reaches a depression from outside it (of two that are one lake, not what the one gave the other).

    First, water between trees: whether a whole tree is full depends on what reaches
    it, not on where, so one contraction settles them all. Then, in each tree, waves: with what has
    reached every leaf, full nodes follow from sums over subtrees; surpluses run over
    the lakes to the next in one contraction; and if that has filled more, once more. Fullness only
    grows, so waves end; their number is how often new lakes fill by what others pass on to them, one after the other.
    """
    n = written(nodes.select("node", "parent", "beyond", F.col("spill").isNotNull().alias("_spills")).join(sums.select("node", "runoff", "loss"), "node"))
    root = written(graph.roots(n.select(F.col("node").alias("cell"), F.col("parent").alias("receiver"))).select(F.col("cell").alias("node"), F.col("root").alias("tree")))
    # between trees: what a whole tree passes on beyond its loss
    tops = n.filter("parent IS NULL").join(root.select(F.col("node").alias("beyond"), F.col("tree").alias("_next")), "beyond", "left")
    whole = tops.filter("_spills").select(F.col("node").alias("cell"), F.col("_next").alias("receiver"), (F.col("runoff") - F.col("loss")).alias("water"), "beyond")
    given = settle(whole.drop("beyond"), ["water"]).join(whole.select("cell", "beyond"), "cell").filter("water_out > 0")
    between = written(given.select(F.col("cell").alias("node"), "beyond", F.col("water_out").alias("q")))
    zero = F.lit(0).cast(n.schema["runoff"].dataType)
    sibling = n.filter("parent IS NOT NULL").select("node", "parent")
    pair = sibling.join(sibling.withColumnRenamed("node", "sibling"), "parent").filter("node != sibling").select("node", "sibling")
    n = written(n.join(pair, "node", "left").withColumn("_was", F.lit(False)))
    flows = between.filter(F.col("beyond") != OUTLET).select("beyond", "q", F.lit(None).cast("long").alias("upto"))
    was = -1
    while True:
        # a flow adds to every node from the leaf it reaches up to, and without, ``upto``
        reached = flows.select(F.col("beyond").alias("node"), "q").unionByName(flows.filter("upto IS NOT NULL").select(F.col("upto").alias("node"), (-F.col("q")).alias("q")))
        more = subtree_sums(n, reached, ["q"]).withColumnRenamed("q", "_q")
        state = n.join(more, "node").withColumn("water", F.col("runoff") + F.col("_q")).withColumn("_enough", F.col("_was") | F.col("_spills") & (F.col("water") >= F.col("loss")))
        state = written(state.drop("_q"))
        # water enough for all of a depression may still have to run over within it: it is full with all below it
        short = subtree_sums(n, state.select("node", F.when(F.col("_enough"), 0).otherwise(1).cast("long").alias("_short")), ["_short"])
        state = written(state.join(short, "node").withColumn("full", F.coalesce(F.col("_enough"), F.lit(False)) & (F.col("_short") == 0)).drop("_enough", "_short"))
        now = state.filter("full").count()
        if now == was:
            break
        was = now
        # what is full stays so, also when the sibling that filled it is one lake with it now
        n = state.select("node", "parent", "beyond", "_spills", "runoff", "loss", "sibling", F.col("full").alias("_was"))
        state = written(with_activity(state))
        unit = owners(state.select(F.col("node").alias("cell"), F.col("parent").alias("receiver"), F.when(F.col("unit"), F.col("node")).alias("owner"))).withColumnsRenamed({"cell": "_leaf", "owner": "_unit"})
        # units of which neither passes on: two that spill into each other, neither of them full
        u = state.filter("unit").join(unit, F.col("beyond") == F.col("_leaf"), "left").withColumnRenamed("_unit", "_next")
        sink = (~F.col("full") & F.coalesce(F.col("sibling") == F.col("_next"), F.lit(False))) | ~F.col("_spills") | F.col("parent").isNull()
        own = u.select(F.col("node").alias("cell"), F.when(~sink, F.col("_next")).alias("receiver"), "water", "loss", "sibling", "beyond", "parent", "full")
        # what has come over passes within the tree is counted anew
        base = subtree_sums(n, between.filter(F.col("beyond") != OUTLET).select(F.col("beyond").alias("node"), "q"), ["q"]).withColumnsRenamed({"node": "cell", "q": "_base"})
        runoff = n.select(F.col("node").alias("cell"), "runoff")
        own = written(own.join(base, "cell").join(runoff, "cell").withColumn("water", F.col("runoff") + F.col("_base") - F.col("loss")))
        passed = settle(own.filter("loss IS NOT NULL").select("cell", "receiver", "water"), ["water"])
        over = own.filter("receiver IS NOT NULL").select("cell", "beyond", "parent").join(passed.filter("water_out > 0").select("cell", F.col("water_out").alias("q")), "cell")
        flows = written(between.filter(F.col("beyond") != OUTLET).select("beyond", "q", F.lit(None).cast("long").alias("upto")).unionByName(over.select("beyond", "q", F.col("parent").alias("upto"))))
    state = with_activity(state)
    surplus = F.when(F.col("full") & F.col("unit"), F.col("water") - F.col("loss")).otherwise(zero)
    return written(state.select("node", "runoff", "loss", "water", "full", "active", surplus.alias("passed")))


def with_activity(state: DataFrame) -> DataFrame:
    """Adds ``active`` (a leaf, or both children full) and ``unit`` (active and not one lake with a full sibling)."""
    kids = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.min("full").alias("_both"))
    full = state.select(F.col("node").alias("_sib"), F.col("full").alias("_full"))
    out = state.join(kids, F.col("node") == F.col("_of"), "left").join(full, F.col("sibling") == F.col("_sib"), "left")
    out = out.withColumn("active", F.coalesce("_both", F.lit(True)))
    return out.withColumn("unit", F.col("active") & ~(F.col("full") & F.coalesce("_full", F.lit(False)))).drop("_of", "_both", "_sib", "_full")


def lakes(at: DataFrame, nodes: DataFrame, cells: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lakes (lake, full, level2, cells, area, volume2, water, evaporation, passed) and
    their cells (cell, lake). A full lake stands at its spill and covers all that its depression
    attaches. Another one covers its children and then cells by height while the loss
    of its surface stays within its water, and stands half way from the last of these to the next.
    Levels and volumes are doubled, so that halves stay integers; lakes without a cell have none
    below their level: their water is lost on less than a cell."""
    final = flow.join(nodes.select("node", F.col("parent").alias("_p")), "node")
    final = with_units(final, nodes).filter("unit").select("node", "full", "water", "loss", "passed")
    final = written(final)
    mine = final.select(F.col("node").alias("cell"), F.lit(True).alias("_f"))
    over = nodes.select(F.col("node").alias("cell"), F.col("parent").alias("receiver")).join(mine, "cell", "left").withColumn("owner", F.when(F.col("_f"), F.col("cell"))).drop("_f")
    own = owners(over).filter("owner IS NOT NULL").withColumnsRenamed({"cell": "node", "owner": "lake"})
    wet = cells.filter("node IS NOT NULL").join(own, "node").join(at.select("cell", "loss", "area"), "cell")
    # of lakes that are not full, cells of the lake's own node go by height
    child_loss = nodes.filter("parent IS NOT NULL").select("node", "parent").join(flow.select("node", "loss"), "node").groupBy(F.col("parent").alias("lake")).agg(F.sum("loss").alias("_below"))
    head = final.select(F.col("node").alias("lake"), "full", "water").join(child_loss, "lake", "left")
    whole = wet.join(head, "lake")
    sure = whole.filter("full OR node != lake").select("cell", "lake", "z", "area", "loss")
    part = running_totals(whole.filter("NOT full AND node = lake").select("cell", "lake", "z", "area", "loss", "water", "_below"), "lake", [F.col("z"), F.col("cell")], "loss")
    part = written(part.withColumn("_in", F.coalesce("_below", F.lit(0)) + F.col("_before") + F.col("loss") <= F.col("water")))
    # losses are not negative, so what is covered comes first
    covered = written(sure.unionByName(part.filter("_in").select("cell", "lake", "z", "area", "loss")))
    edge = part.groupBy("lake").agg(F.max(F.when(F.col("_in"), F.col("z"))).alias("_last"), F.min(F.when(~F.col("_in"), F.col("z"))).alias("_next"))
    sums = covered.groupBy("lake").agg(F.count("*").alias("cells"), F.sum("area").alias("area"), F.sum(F.col("z") * F.col("area")).alias("_za"), F.sum("loss").alias("evaporation"))
    out = final.withColumnRenamed("node", "lake").join(nodes.select(F.col("node").alias("lake"), "spill", "base"), "lake").join(edge, "lake", "left").join(sums, "lake", "left")
    lower = F.greatest("base", F.coalesce("_last", "base"))
    level2 = F.when(F.col("full"), 2 * F.col("spill")).when(F.col("_next").isNotNull(), lower + F.col("_next")).when(F.col("spill").isNotNull(), 2 * F.col("spill")).otherwise(2 * lower + 2)
    out = out.withColumn("level2", level2).fillna(0, ["cells", "area", "evaporation", "_za"])
    out = out.select("lake", "full", "level2", "cells", "area", (F.col("level2") * F.col("area") - 2 * F.col("_za")).alias("volume2"), "water", "evaporation", "passed")
    return out, covered.select("cell", "lake")


def with_units(flow: DataFrame, nodes: DataFrame) -> DataFrame:
    sibling = nodes.filter("parent IS NOT NULL").select("node", "parent")
    pair = sibling.join(sibling.withColumnRenamed("node", "sibling"), "parent").filter("node != sibling").select("node", "sibling")
    return with_activity(flow.withColumnRenamed("_p", "parent").drop("active").join(pair, "node", "left"))
