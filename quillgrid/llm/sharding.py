"""Shards by weighted rendezvous hashing of stable record keys.

A record draws a number in (0, 1) for each shard from its key and the shard's own
number, and goes to the shard of the highest -weight / ln(draw); ties go to the higher
draw, then to the lower shard. Nothing else decides, so:

* a new shard takes records only into itself, and a shard that goes gives up only its own;
* a greater weight of one shard only moves records into it;
* a shard's expected part of the distinct keys is its part of all weights.

A record's shard needs no table and no shuffle. Work grows with rows times shards.

Defined results: a key is its columns' texts, each with its length before it, nulls as
``-``; rows of one key, null keys included, are in one shard whatever their number, as
the law asks, but no task has to hold them. A null or empty text has 0 bytes, so
size 1 and CRC 0; texts of any length are only measured. Slots go by key, then CRC and
size (nulls first); wholly equal rows take slots in any order. An empty table gives an
empty result. Other columns stay, whatever their names, in ``assign``, and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import fresh, numbered

#: Hex digits of a draw: 52 bits, so that draws are exact in doubles.
DIGITS = 13


def key_text(columns: Sequence[Column]) -> Column:
    """One text for the values of ``columns``; different values, different texts."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*(one(c) for c in columns))


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key text among ``weights`` (shard number: weight above 0)."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be above 0, and at least one")
    shards = F.array(*(F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())))

    def bid(s: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), s["shard"].cast("string"))), 1, DIGITS), 16, 10).cast("long")
        unit = (drawn + 0.5) / float(1 << 4 * DIGITS)
        return F.struct((-s["weight"] / F.log(unit)).alias("score"), drawn.alias("drawn"), (-s["shard"]).alias("minus"))

    return -F.array_max(F.transform(shards, bid))["minus"]


def assign(df: DataFrame, key_cols: Sequence[str], weights: Mapping[int, float], name: str = "shard") -> DataFrame:
    """``df`` with each row's shard as the column ``name`` (which ``df`` must not have)."""
    return df.withColumn(name, shard_of(key_text([F.col(f"`{c}`") for c in key_cols]), weights))


def moved(df: DataFrame, key_cols: Sequence[str], old: Mapping[int, float], new: Mapping[int, float]) -> DataFrame:
    """(was, now, n_rows): how many rows go from which shard to which."""
    key = key_text([F.col(f"`{c}`") for c in key_cols])
    return df.select(shard_of(key, old).alias("was"), shard_of(key, new).alias("now")).groupBy("was", "now").agg(F.count("*").alias("n_rows"))


def layout(
    docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: the id, size (bytes of the text and 1), text_crc32, law, shard,
    slot and, with ``grown`` weights, grown_shard (null without).

    Texts are read once and not shuffled: what is dealt by range for the slots are ids,
    sizes and CRCs.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = key_text([F.col("_id")])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(key, weights), "grown_shard": shard_of(key, grown) if grown else F.lit(None).cast("int")})
    placed = numbered(rows, "shard", [F.col("_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot")
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, folder: str, key_cols: Sequence[str], weights: Mapping[int, float], partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet under ``folder``, a folder for each shard, rows in order of
    key within a file; a shard is as many files as ranges of keys met it. Returns the
    table as read back, with the column ``shard`` (``_shard`` where ``df`` has one)."""
    spark = df.sparkSession
    shard, key = fresh(df.columns, "shard", "_key")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = assign(df, key_cols, weights, shard).withColumn(key, key_text([F.col(f"`{c}`") for c in key_cols]))
    schema = out.drop(key).schema
    # the text's hash tells rows of one hot key apart, so that ranges can split it
    spread = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))))
    out.repartitionByRange(n, shard, key, spread).sortWithinPartitions(shard, key).drop(key).write.partitionBy(shard).parquet(folder)
    return spark.read.schema(schema).parquet(folder)
