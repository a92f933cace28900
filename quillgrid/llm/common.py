"""What several text operators share: row keys, byte words, written checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import cut as cut
from quillgrid.session import written as written

#: Fixed value: the ASCII capitals and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` is much faster and says the
    same of ASCII texts; others go through ``translate``."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, separators: str) -> Column:
    """The maximal runs of characters outside ``separators`` (a regex class)."""
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under names of our own; any
    other column, whatever its name, stays out of the way."""
    return df.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    )


def with_key(df: DataFrame) -> DataFrame:
    """Adds ``_h``; (_id, _h) names a row's id and text. Rows that agree in
    both are the same document repeated and get the same results."""
    return df.withColumn("_h", F.xxhash64("_text"))


def same_key(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("_id", "_h")) -> Column:
    """Null-safe equality on the key columns (a null id is a value)."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names`` with underscores put before them until none is among ``columns``, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def numbered(df: DataFrame, group: str, order: list, name: str = "_i") -> DataFrame:
    """Adds ``name``, a row's gapless place from 0 within its ``group`` by ``order``; rows
    that ``order`` doesn't tell apart are placed by their place in the written table.

    The narrow rows are written first, so that what made them runs once, then dealt by
    range of group, order and place: a group, or a row repeated any number of times, may
    be larger than a task. A task's sorted rows are numbered as they stand; where each
    (group, task) begins is told by their counts, of which there are as many as tasks and groups.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stands = written(df).withColumn("_at", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("_at")]
    dealt = written(stands.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_task", F.shiftright("_at", 33))
    runs = dealt.groupBy(F.col(group).alias("_g"), F.col("_task").alias("_t")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_g", "_t", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = dealt.join(runs, dealt[group].eqNullSafe(runs["_g"]) & (dealt["_task"] == runs["_t"]))
    return placed.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
