"""Merkle trees over a table: a tree of its own for each group, and one over their roots.

A record's leaf is the SHA-256 of its columns, each as ``-`` if null or else its UTF-8
byte count, ``:`` and the value. In a tree, leaves go by id; every 8 consecutive nodes become the
SHA-256 of their hex digests, the last run however short, while there are several nodes.

The trees are built by events in ``combineByKey``. An event is a child's digest with its place.
A combiner is the partial parents of a block (a subtree of up to ``SPAN`` leaves): each
gathers indexed children until it has as many as its place and the tree's size ask for; its
digest is then itself an event for its own parent, so whatever is complete resolves before
the shuffle, and what is not (the frontier) is shuffled and merged alike. Whole blocks are the
events of the next round, a ``SPAN``-th as many, until each tree is one block.

Proofs follow the links back: a block hands each of its children the way from there to the root (what
stands left and right of it in its run, level by level), cut out of the block by column
functions. Only leaves get rows of their own; a row holds a block of a tree at most.

Defined results: null ids come first; leaves of equal ids go by digest, and wholly equal rows in any
order, each with a leaf of its own; a null group is a tree, before the others, which go by
their UTF-8 bytes; a lone leaf is its tree's root; an empty table gives no trees and an
empty result. Texts of any length are hashed whole, where they are read. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import numbered, written

#: Nodes of a run, the levels of a block and the leaves below them.
ARITY, LEVELS = 8, 3
SPAN = ARITY**LEVELS
HEX = 64

PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


class Manifest(NamedTuple):
    """``leaves``: tree, size, place, id, leaf, changed, subroot, path (to the root);
    ``subroots``: tree, size, subroot; ``root`` is None for an empty table."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def record_digest(columns: Sequence[Column]) -> Column:
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(one(c) for c in columns)), 256)


def depth_of(width: int) -> int:
    """Levels from the nodes of a block to its top: all, or fewer if it is a whole tree."""
    depth = 0
    while width > 1:
        width, depth = -(-width // ARITY), depth + 1
    return depth


def parent(kids: Sequence[str]) -> str:
    return sha256("".join(kids).encode()).hexdigest()


def climbed(partial: dict, level: int, at: int, digest: str, n: int, depth: int) -> None:
    """An event: a node's digest reaches its parent, and while that is complete, the next one up."""
    while level < depth:
        kids = partial.setdefault((level, at // ARITY), {})
        kids[at % ARITY] = digest
        arity = min(ARITY, -(-n // ARITY**level) - at // ARITY * ARITY)
        if len(kids) < arity:
            return
        del partial[level, at // ARITY]
        digest = parent([kids[k] for k in range(arity)])
        level, at = level + 1, at // ARITY
    partial["top"] = digest


def started(event: tuple) -> tuple:
    return gathered(({}, {}), event)


def gathered(block: tuple, event: tuple) -> tuple:
    """A block's partial parents and items, with one more event (place, leaves of the block, depth, *item)."""
    partial, items = block
    place, n, depth, *item = event
    items[place] = item
    climbed(partial, 0, place, item[0], n, depth)
    partial["shape"] = n, depth
    return block


def merged(one: tuple, two: tuple) -> tuple:
    """Two parts of a block: what is pending in the one goes on as events of the other."""
    one[1].update(two[1])
    for key, kids in two[0].items():
        if isinstance(key, tuple):
            for k, digest in kids.items():
                climbed(one[0], key[0], key[1] * ARITY + k, digest, *two[0]["shape"])
    return one


def levels_of(digests: list[str], depth: int) -> list[list[str]]:
    """The nodes of each level of a block below its top."""
    out = [digests]
    for _ in range(depth - 1):
        out.append([parent(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def blocks(nodes: DataFrame) -> DataFrame:
    """(tree, size, block, n, depth, top, levels, ids, changed) of nodes (tree, size, place, id,
    leaf, changed), ``size`` nodes in each tree. ``levels`` are the hex digests of each level of a
    block, end to end in order of place, ``changed`` those of its leaves (blanks for none)."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("place") / SPAN)
    of_block = F.least(F.lit(SPAN), F.col("size") - block * SPAN)
    rows = nodes.select("tree", "size", block.alias("b"), (F.col("place") % SPAN).cast("int").alias("p"), of_block.cast("int").alias("n"), "leaf", "id", "changed").rdd
    kind = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("size", T.LongType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("depth", T.IntegerType()), T.StructField("top", T.StringType()), T.StructField("levels", T.ArrayType(T.BinaryType())), T.StructField("ids", T.ArrayType(nodes.schema["id"].dataType)), T.StructField("changed", T.BinaryType()),
    ])

    def event(r: tuple) -> tuple:
        tree, size, b, p, n, leaf, name, changed = r
        return (tree, size, b), (p, n, LEVELS if size > SPAN else depth_of(size), leaf, name, changed)

    def whole(x: tuple) -> tuple:
        (tree, size, b), (partial, items) = x
        if len(items) != partial["shape"][0] or len(partial) != 2:
            raise ValueError(f"block {b} of tree {tree!r} lacks nodes")
        order = [items[p] for p in range(len(items))]
        depth = partial["shape"][1]
        levels = [bytearray("".join(x).encode()) for x in levels_of([i[0] for i in order], depth)]
        return tree, size, b, len(order), depth, partial["top"], levels, [i[1] for i in order], bytearray("".join(i[2] or " " * HEX for i in order).encode())

    dealt = rows.map(event).combineByKey(started, gathered, merged, n, lambda key: crc32(repr(key).encode()))
    return written(spark.createDataFrame(dealt.map(whole), kind, verifySchema=False))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of blocks over nodes (tree, size, place, id, leaf, changed), lowest first."""
    none = F.lit(None).cast("string")
    out = [blocks(nodes)]
    while out[-1].filter(F.col("size") > SPAN).head(1):
        up = out[-1].filter(F.col("size") > SPAN)
        out.append(blocks(up.select("tree", F.ceil(F.col("size") / SPAN).alias("size"), F.col("block").alias("place"), none.alias("id"), F.col("top").alias("leaf"), none.alias("changed"))))
    return out


def ways(level: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, size, place, id, leaf, changed, subroot, path) of each node of blocks ``level``, beside
    ``above`` (tree, block, subroot, path), the way on from each block's top. What stands beside
    a node in its run is cut out of its block's levels, by columns."""
    text = lambda data, first, length: F.substring(data, first * HEX + 1, length * HEX).cast("string")
    rows = level.join(above, ["tree", "block"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    own = []
    for k in range(LEVELS):
        at = F.floor(F.col("p") / ARITY**k).cast("int")
        first = at - at % ARITY
        whole = F.ceil(F.col("n") / ARITY**k).cast("int")
        data = F.get("levels", F.lit(k))
        side = F.struct(text(data, first, at - first).alias("left"), text(data, at + 1, F.least(first + ARITY, whole) - at - 1).alias("right"))
        own.append(F.when(F.col("depth") > k, side))
    path = F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), F.col("path"))
    changed = text(F.col("changed"), F.col("p"), F.lit(1))
    return rows.select(
        "tree", "size", (F.col("block") * SPAN + F.col("p")).alias("place"), F.col("ids")[F.col("p")].alias("id"), text(F.col("levels")[0], F.col("p"), F.lit(1)).alias("leaf"),
        F.when(F.trim(changed) != "", changed).alias("changed"), "subroot", path.alias("path"),
    )


def proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``ways`` of the leaves; ``above`` (tree, subroot, path) is the way on from each tree's root."""
    below = None
    for level in reversed(levels):
        tops = level.filter(F.col("size") <= SPAN).select("tree", "block").join(above, "tree")
        if below is not None:
            tops = tops.unionByName(below.select("tree", F.col("place").alias("block"), "subroot", "path"))
        below = ways(level, tops)
        if level is not levels[0]:
            below = written(below)
    return below


def manifest(records: DataFrame) -> Manifest:
    """The trees of ``records`` (tree, id, leaf, changed): ``tree`` is a group's name or null,
    ``leaf`` a hex digest, ``changed`` another one of the same record or null, which is only
    carried to the proofs."""
    spark = records.sparkSession
    named = records.select(F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("")).alias("tree"), "id", "leaf", "changed")
    placed = numbered(named, "tree", [F.col("id").asc_nulls_first(), F.col("leaf")], "place")
    sizes = placed.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("size"))
    levels = grown(placed.join(sizes, F.col("tree") == F.col("_tree")).drop("_tree"))
    one_tree = lambda df: df.filter(F.col("size") <= SPAN)
    tops = one_tree(levels[0]).select("tree", "top", F.col("size").alias("leaves"))
    for level in levels[1:]:
        tops = tops.unionByName(one_tree(level).select("tree", "top", F.lit(None).cast("long").alias("leaves")))
    tops = written(tops.join(sizes, F.col("tree") == F.col("_tree")).select("tree", "top", F.col("_tree").alias("id"), sizes["size"].alias("_leaves")))
    whole = F.lit("").alias("tree")
    none = F.lit(None).cast("string").alias("changed")
    roots = numbered(tops.select(whole, "id", F.col("top").alias("leaf"), none), "tree", [F.col("id")], "place")
    roots = grown(roots.withColumn("size", F.lit(tops.count())))
    top = roots[-1].select("top").head()
    start = spark.createDataFrame([("", "", [])], T.StructType([T.StructField("tree", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("path", PATH)]))
    above = written(proofs(roots, start).select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), "path"))
    name = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    leaves = proofs(levels, above).withColumn("tree", name)
    return Manifest(leaves, tops.select(name.alias("tree"), F.col("_leaves").alias("size"), F.col("top").alias("subroot")), top and top["top"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
