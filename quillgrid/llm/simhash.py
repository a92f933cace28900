"""SimHash near-duplicates: fingerprints, links by multi-index hashing, components.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64
hashes (seed 42) of a text's 3-word shingles, repeats included.

Multi-index hashing: fingerprints are cut into ``segments`` equal parts. Two at
``distance`` or fewer differing bits differ by at most ``distance // segments``
bits in one part, so a table of (part, value) is looked up with the small
Hamming ball around each part's value, and every match is verified on all bits.
Of a pair that differs in a bit, only the side that has 0 there looks it up, so
each pair meets once per part and the ball is half as large.

Equal fingerprints are one node, so groups of exact copies never make pairs.
Nodes, links and labels stay distributed; components come from alternating
minimum-neighbour contraction (see ``components``).

Defined results: a null or blank text has fingerprint zero and links like any
other; a null id keeps its row and never names a component unless the whole
component has none; repeated rows are each returned; long texts are hashed whole,
in bounded pieces; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import LOWER, UPPER, cut, fresh, pick, with_key

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans(UPPER, LOWER)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.translate(CAPITALS).split() if text.isascii() and not _ODD_BLANKS.search(text) else WORD.findall(text.translate(CAPITALS))
    if not words:
        return 0
    runs = [" ".join(words)] if len(words) < shingle else map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(r, seed) for r in runs), dtype="<u8")
    # sums of bits, byte by byte of the little-endian hashes, in bounded pieces
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        piece = hashes[at : at + 65536]
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


#: str.split() also splits at these; the contract does not.
_ODD_BLANKS = regex.compile(r"[\x1c-\x1f]")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(_id, _fp): each row's fingerprint as a signed BIGINT; with ``keyed`` also the
    text's hash, as (_id, _h, _fp). One pass, no shuffle."""
    d = pick(docs, id_col, text_col)
    if keyed:
        d = with_key(d).select("_id", "_h", "_text")
    names = [*d.columns[:-1], "_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(b.num_columns - 1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names)

    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], T.StructField("_fp", T.LongType())]))


def links(nodes: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): distinct fingerprints of ``nodes`` at ``distance`` or fewer bits.

    ``nodes`` has one row per fingerprint ``_fp``. A pair can come more than once.
    """
    bits = 64 // segments
    radius = distance // segments
    mask = (1 << bits) - 1
    # xor masks of the ball; each is used only by the side whose flipped bits are all 0 or, of several, whose lowest is
    flips = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    fp = F.col("_fp")
    parts = F.array(*(F.struct(F.lit(s).alias("part"), F.expr(f"shiftrightunsigned(_fp, {s * bits}) & {mask}L").alias("value")) for s in range(segments)))
    rows = nodes.select(fp, F.explode(parts).alias("p")).select(fp, "p.part", "p.value")
    ball = F.expr(f"filter(array({', '.join(f'{x}L' for x in flips)}), x -> (value & x & -x) = 0)")
    asks = rows.select(F.col("_fp").alias("a"), "part", F.explode(F.transform(ball, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    table = rows.select(F.col("_fp").alias("b"), "part", "value")
    return asks.join(table, ["part", "value"]).filter(
        (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b"))
    ).select("a", "b")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the least node reachable.

    Alternates two steps until nothing changes (large-star and small-star):
    each node's greater neighbours, then its smaller ones, are tied to the
    least neighbour. Both are a grouped minimum joined back, so a node with
    very many neighbours is summed before the shuffle and split by skew joins.
    Every round is written to the shared checkpoint folder.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(rounds):
        # large star: tie greater neighbours of n (and n's smaller side via the mirrored rows) to min(N(n) + n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: n's smaller neighbours and n itself to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (
            big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        )
        nxt = cut(nxt)
        moved = nxt.join(e, ["u", "v"], "left_anti").limit(1).count() or e.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        e = nxt
        if not moved:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds on {spark.version}")


def rooted(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """``nodes`` (_fp, _least) with ``_root``, the least fingerprint linked to each."""
    tied = components(links(nodes.select("_fp"), distance, segments))
    return nodes.join(tied, nodes["_fp"] == tied["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, segments: int = 2, shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits), component_id (the least id
    among all rows whose fingerprints are linked, in any number of steps)."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = marked.groupBy("_fp").agg(F.min("_id").alias("_least"))
    named = rooted(nodes, distance, segments)
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    of = named.join(least, "_root").select("_fp", "_component")
    return marked.join(of, "_fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, segments: int = 2, shingle: int = 3, seed: int = 42
) -> DataFrame:
    """One row of each component of ``docs``, all columns: that with the least id (a
    null id last), then the least hash of the text. Components are told by their
    fingerprints and rows by id and text, so rows without an id or with a shared one
    count each for itself. Of rows that agree in both, one stays."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed, keyed=True))
    rows = marked.groupBy("_fp", "_id", "_h").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_h", "_n")
    nodes = cut(rows.groupBy("_fp").agg(F.min(order).alias("_least")))
    best = rooted(nodes, distance, segments).groupBy("_root").agg(F.min("_least").alias("_k"))
    id_name, hash_name, n_name, row_hash = fresh(docs.columns, "_kept", "_kept_h", "_n", "_row_h")
    found = cut(best.select(F.col("_k._id").alias(id_name), F.col("_k._h").alias(hash_name), F.col("_k._n").alias(n_name)))
    digest = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(F.col(id_name)) & (digest == F.col(hash_name))
    once = docs.join(found.filter(F.col(n_name) == 1), same, "left_semi")
    many = found.filter(F.col(n_name) > 1)
    if not many.head(1):
        return once
    repeated = docs.join(many, same, "left_semi").withColumn(row_hash, digest)
    return once.unionByName(repeated.dropDuplicates([id_col, row_hash]).drop(row_hash))
