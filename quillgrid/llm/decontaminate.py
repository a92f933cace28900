"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item (an item of fewer
words is one window). Of the hashes of a text's ``gram``-word runs, the least
in each sliding window of ``span - gram + 1`` runs is its fingerprint; texts
that share ``span`` words share one of those least hashes, so none is missed.

1. Fingerprints of the documents meet those of the benchmark (semi join).
2. In documents with a meeting fingerprint, each place of that hash is extended
   to the windows that hold it, and those are compared as words.

The benchmark side of each join is broadcast only while it has at most
``broadcast_rows`` rows; beyond that both sides are shuffled by hash.

Defined results: a null text has no words and a row of its own; an item
without words has no window; rows repeated in ``docs`` are each returned;
a repeated item_id counts once; a null item_id counts as the empty string;
an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import ascii_lower, pick, same_key, split_words, with_key

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _grams(size: int) -> str:
    """Hashes of all runs of ``size`` words of ``_words``."""
    run = ", ".join(f"_words[i + {k}]" for k in range(size))
    return f"IF(size(_words) < {size}, array(), transform(sequence(0, size(_words) - {size}), i -> xxhash64({run})))"


def _least(width: int) -> str:
    """The distinct least hashes of the sliding windows over ``_grams``."""
    return f"array_distinct(transform(sequence(0, size(_grams) - {width}), i -> array_min(slice(_grams, i + 1, {width}))))"


def _window(start: str, size: str) -> str:
    return f"array_join(slice(_words, {start} + 1, {size}), ' ')"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", span: int = 10, gram: int = 5, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = with_key(pick(docs, id_col, text_col))
    hit = hits(d, benchmark, item_col, item_text_col, span, gram, broadcast_rows)
    base = d.select("_id", "_h", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    return base.join(hit, same_key(base, hit), "left").select(
        base["_id"].alias(id_col), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 10, gram: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = with_key(pick(docs, id_col, text_col))
    hit = hits(d, benchmark, "item_id", "text", span, gram, broadcast_rows).select("_id", "_h")
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(text) == hit["_h"]), "left_anti")


def hits(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, span: int, gram: int, broadcast_rows: int) -> DataFrame:
    """(_id, _h, n_hit, n_items, items_sha256) of the documents ``texts`` (_id, _h, _text) with a hit."""
    width = span - gram + 1
    d = texts.withColumn("_words", words_of(F.col("_text"))).drop("_text")
    items = pick(benchmark, item_col, item_text_col).select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_item"), words_of(F.col("_text")).alias("_words")
    ).filter(F.size("_words") > 0).withColumn("_len", F.least(F.size("_words"), F.lit(span)))

    # windows of the items, each with the items that hold it
    windows = (
        items.select("_item", "_len", F.explode(F.expr(f"transform(sequence(0, size(_words) - _len), i -> {_window('i', '_len')})")).alias("_window"))
        .groupBy("_window", "_len").agg(F.collect_set("_item").alias("_items"))
    )
    shape = windows.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("_len") < span, F.col("_len"))).alias("short")).first()
    small = lambda x: F.broadcast(x) if shape["n"] <= broadcast_rows else x

    marks = (
        items.filter(F.size("_words") >= span).withColumn("_grams", F.expr(_grams(gram)))
        .select(F.explode(F.expr(_least(width))).alias("_g")).distinct()
    )
    found = (
        d.filter(F.size("_words") >= span).withColumn("_grams", F.expr(_grams(gram)))
        .select("_id", "_h", F.explode(F.expr(_least(width))).alias("_g"))
        .join(small(marks), "_g", "left_semi").select("_id", "_h", F.lit(gram).alias("_len"), "_g")
    )
    # items shorter than a span: all runs of just that many words, by hash
    for n in sorted(shape["short"]):
        heads = items.filter(F.size("_words") == n).select(F.expr(f"({_grams(n)})[0]").alias("_g")).distinct()
        found = found.unionByName(
            d.select("_id", "_h", F.explode(F.array_distinct(F.expr(_grams(n)))).alias("_g"))
            .join(small(heads), "_g", "left_semi").select("_id", "_h", F.lit(-n).alias("_len"), "_g")
        )
    found = found.groupBy("_id", "_h").agg(F.collect_set(F.struct("_len", "_g")).alias("_found"))

    # texts are dealt, not their words, and cut again where a fingerprint met
    near = texts.join(found.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")))
    near = near.select("_id", "_h", "_found", words_of(F.col("_text")).alias("_words"))
    starts = [
        # places of a met fingerprint, and back from each to every window start that holds it
        f"""IF(size(_words) < {span}, array(), flatten(transform(filter(transform({_grams(gram)}, (g, i) -> struct(g, i)),
            x -> array_contains(_met, x.g)), x -> transform(sequence(greatest(x.i - {width - 1}, 0), least(x.i, size(_words) - {span})),
            s -> struct(s AS s, {span} AS n)))))"""
    ] + [
        f"transform(filter(transform({_grams(n)}, (g, i) -> struct(g, i)), x -> array_contains(_found, struct({-n} AS _len, x.g AS _g))), x -> struct(x.i AS s, {n} AS n))"
        for n in sorted(shape["short"])
    ]
    candidates = (
        near.withColumn("_met", F.expr(f"transform(filter(_found, x -> x._len = {gram}), x -> x._g)"))
        .withColumn("_starts", F.expr(f"array_distinct(concat({', '.join(starts)}))"))
        .select("_id", "_h", F.explode(F.expr(f"transform(_starts, x -> struct(x.s AS s, x.n AS n, {_window('x.s', 'x.n')} AS w))")).alias("_c"))
        .select("_id", "_h", F.col("_c.s").alias("_s"), F.col("_c.n").alias("_len"), F.col("_c.w").alias("_window"))
    )
    return (
        candidates.join(small(windows), ["_window", "_len"])
        .groupBy("_id", "_h")
        .agg(
            F.collect_set(F.struct("_s", "_len")).alias("_at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_ids"),
        )
        .select(
            "_id", "_h",
            F.expr("CAST(size(array_distinct(flatten(transform(_at, x -> sequence(x._s, x._s + x._len - 1))))) AS BIGINT)").alias("n_hit"),
            F.size("_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"),
        )
    )
