"""Exact substring dedup: every byte inside a string of ``length`` bytes that
also starts elsewhere (other documents or the same one) is removed.

Shards. A window is a string of ``length`` bytes; its anchor is the last of the
least-hashed ``GRAM``-byte grams in it. The anchor depends on the window's bytes
alone, so equal windows have equal anchors at equal places. Consecutive windows
with one anchor make a segment. Segments are dealt by anchor, so that all
occurrences of a window meet:

* anchors that occur once are unique, and so are their windows;
* segments that occur whole (told by 96 bits of hash) more than once are repeated,
  whatever their number: copies are counted, not compared;
* the distinct segments of the other anchors go on to the merge.

Keys with over a thousandth of the rows are at most a thousand; joins with them are
broadcast, so no task holds all copies of a common passage.

Merge. A segment is a string over cells of 8 bytes that start at multiples of 8
from its anchor. Segments are spread over shards, each shard's Burrows-Wheeler
transform is built, and the transforms are merged by iterative interleave
refinement: a pass deals the current interleave into buckets by the transforms'
symbols and so sorts by one more cell; block boundaries that open in pass h have
a common prefix of h cells. No suffix of one shard is compared with another's.
After ``length // 8 - 1`` passes the blocks are the repeated intervals; a window is
its block's cells with up to 8 bytes at the two ends, which are compared as they are.

Memory of a task is bounded by ``BATCH`` bytes of segments and the longest group
of one anchor. Groups of more than ``hot_segments`` distinct segments don't go
to one task: their windows are counted one by one by 128-bit hash.

Repeated rows (same id, same text) repeat each other whole: their spans are known
from their number, and only one of them goes on to the segments. No task gathers
the rows of one key, however many there are.

Defined results: a null text is empty; documents shorter than ``length`` keep all
bytes; repeated rows keep nothing if they have as much; a null id is a value; an empty table gives
an empty result; other columns are not read. Spans are joined before they are
collected, so a long periodic text, which has a segment at each byte, ends as one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import pick, with_key
from quillgrid.session import checkpoint_root

GRAM, CELL, BATCH, SHARDS, SHAPE = 32, 8, 3_000_000, 4, 1 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of ``data`` as one big-endian number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)


def segments(data: bytes, length: int) -> tuple[np.ndarray, ...] | None:
    """For each segment: first window start, ``SHAPE`` times the number of further
    starts plus the anchor's place from the first, anchor hash, segment hash (64 and 32 bits)."""
    if len(data) < length:
        return None
    w = words_at(np.frombuffer(data, np.uint8))
    n = len(data) - GRAM + 1
    g = sum(w[8 * k : 8 * k + n] * ODD[k] ^ w[8 * k : 8 * k + n] >> np.uint64(29) for k in range(GRAM // 8))
    g = (g ^ g >> np.uint64(32)) * ODD[0]
    g ^= g >> np.uint64(29)
    low = np.uint64(0xFFFFFFFF)
    least = g >> np.uint64(32) << np.uint64(32) | low - np.arange(n, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (low - (least & low)).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(starts[1:], len(place)) - 1
    at = place[starts]
    digest = xxhash.xxh3_128_digest
    whole = np.frombuffer(b"".join(digest(data[a : b + length]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64).reshape(-1, 2)
    return starts, (ends - starts) * SHAPE + at - starts, g[at].view(np.int64), whole[:, 0], whole[:, 1] >> 32


def sort_suffixes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the strings in ``symbols`` (each ended by a 0; ended
    strings sort by their number), by prefix doubling within one shard."""
    n = len(symbols)
    string = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = np.where(symbols == 0, string, symbols.astype(np.int64) + len(starts))
    _, rank = np.unique(first, return_inverse=True)
    last = np.append(starts[1:], n)[string] - 1
    step = 1
    while True:
        follow = np.minimum(np.arange(n) + step, last)
        key = rank.astype(np.int64) * n + rank[follow]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        rank = new
        if rank.max() == n - 1:
            return order
        step *= 2


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards' transforms. ``shards``: for each the symbols of its strings
    (dense, each string ended by a 0) and the strings' starts.

    Returns (class, lcp): for each symbol of the shards one after another, the
    block of its suffix after ``depth`` passes; and per place of the interleave the
    pass in which its boundary opened, which is the common prefix with the place before.
    """
    orders, transforms, ended = [], [], []
    for symbols, starts in shards:
        order = sort_suffixes(symbols, starts)
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[starts] = 0
        orders.append(order)
        transforms.append(before[order])
        ended.append(len(starts))
    sizes = [len(o) for o in orders]
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    transform = np.concatenate(transforms)
    n, n_ended = len(which), sum(ended)
    at = np.concatenate([np.arange(e) + s for e, s in zip(ended, np.cumsum([0, *sizes[:-1]]), strict=True)])
    head = which[at]
    # interleave by no symbol at all: shard after shard, one block
    block = np.zeros(n, np.int64)
    lcp = np.full(n, depth, np.int64)
    for h in range(1, depth + 1):
        taken = np.empty(n, np.int64)
        taken[np.argsort(which, kind="stable")] = np.arange(n)
        symbol = transform[taken]
        dealt = np.argsort(symbol, kind="stable")
        dealt = dealt[np.count_nonzero(symbol == 0) :]
        s, b = symbol[dealt], block[dealt]
        opened = np.ones(n, bool)
        opened[n_ended + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        which = np.concatenate([head, which[dealt]])
        block = np.cumsum(opened) - 1
        lcp[opened & (lcp >= h)] = h - 1
    taken = np.empty(n, np.int64)
    taken[np.argsort(which, kind="stable")] = np.arange(n)
    place = np.concatenate([o + s for o, s in zip(orders, np.cumsum([0, *sizes[:-1]]), strict=True)])
    classes = np.empty(n, np.int64)
    classes[place[taken]] = block
    return classes, lcp


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners (0, 0, 1, 1, 1) and places (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_windows(texts: list[bytes], anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment (its bytes, its anchor's place in it), the window starts whose
    window occurs again among the segments."""
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + bytes(length + 16), np.uint8)
    word = words_at(data)
    phase = anchors % CELL
    cells = (sizes - phase) // CELL
    owner, k = spread(cells)
    values = word[base[owner] + phase[owner] + CELL * k]
    _, dense = np.unique(values, return_inverse=True)
    # strings with their ends, dealt over the shards in runs
    first = np.cumsum(cells + 1) - (cells + 1)
    symbols = np.zeros(int((cells + 1).sum()), np.int64)
    symbols[first[owner] + k] = dense + 1
    bounds = np.unique(np.linspace(0, len(texts), min(SHARDS, len(texts)) + 1).astype(int))
    ends = np.append(first, len(symbols))
    shards = [(symbols[ends[a] : ends[b]], first[a:b] - ends[a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    classes, _ = merge(shards, length // CELL - 1)
    # windows: up to 7 bytes, whole cells, the rest of 8 bytes
    owner, p = spread(sizes - length + 1)
    q = phase[owner] + (p - phase[owner] + CELL - 1) // CELL * CELL
    lead = (q - p).astype(np.uint64)
    block = classes[first[owner] + (q - phase[owner]) // CELL]
    eight = np.uint64(8)
    at = base[owner] + p
    left = np.where(lead > 0, word[at] >> np.minimum((eight - lead) * eight, np.uint64(63)), np.uint64(0))
    right = word[at + lead.astype(np.int64) + length - CELL] >> np.minimum(lead * eight, np.uint64(63))
    ends8 = np.where(lead > 0, left << np.minimum((eight - lead) * eight, np.uint64(63)), np.uint64(0)) | right
    key = block * CELL + lead.astype(np.int64)
    order = np.lexsort((ends8, key))
    same = (key[order][1:] == key[order][:-1]) & (ends8[order][1:] == ends8[order][:-1])
    hit = np.zeros(len(order), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out = [np.zeros(0, np.int64)] * len(texts)
    if hit.any():
        o, s = owner[hit], p[hit]
        cut = np.flatnonzero(np.diff(o)) + 1
        for part, who in zip(np.split(s, cut), o[np.append(0, cut)].tolist(), strict=True):
            out[who] = part
    return out


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans covered by windows at the given ascending starts (touching ones joined)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    a, b = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + length
    return list(zip(a.tolist(), b.tolist(), strict=True))


def written(df: DataFrame, name: str) -> DataFrame:
    folder = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_common(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row for each key with its count
    ``n`` among ``rows``. At most 1,000 keys have over a thousandth of the rows: those
    are broadcast, the others dealt by key."""
    many = F.broadcast(keys.filter(F.col("n") * 1000 > total))
    few = rows.join(many.select(*on), on, "left_anti").join(keys.filter(F.col("n") * 1000 <= total), on)
    return rows.join(many, on).unionByName(few)


def repeated_spans(keyed: DataFrame, length: int = 200, hot_segments: int = 20_000) -> DataFrame:
    """(_id, _h, start, stop): covering spans, some of them overlapping, of the
    documents ``keyed`` (_id, _h, _text)."""
    key_fields = [keyed.schema["_id"], T.StructField("_h", T.LongType())]
    place = [T.StructField(c, T.LongType()) for c in ("first", "shape")]
    found_schema = T.StructType([*key_fields, *place, *(T.StructField(c, T.LongType()) for c in ("anchor", "whole", "whole2"))])
    found_names = found_schema.names

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for r in range(b.num_rows):
                if (s := segments(b.column(2)[r].as_py().encode(), length)) is not None:
                    rows.append(np.full(len(s[0]), r))
                    parts.append(s)
            if rows:
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))], found_names)

    found = written(keyed.select("_id", "_h", "_text").mapInArrow(find, found_schema), "segments")
    whole = F.struct("whole", "whole2")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min(whole).alias("w1"), F.max(whole).alias("w2")).filter("n > 1")
    anchors = written(anchors.select("anchor", "n", (F.col("w1") == F.col("w2")).alias("uniform")), "anchors")
    again = written(with_common(found, anchors, ["anchor"], found.count()).drop("n"), "again")
    mixed = again.filter("NOT uniform")
    spans = lambda df: df.select("_id", "_h", F.col("first").alias("start"), F.expr(f"first + shape div {SHAPE} + {length}").alias("stop"))

    same = ["anchor", "whole", "whole2"]
    distinct = mixed.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("_id", "_h", "first", "shape")).alias("one"))
    distinct = written(distinct.select(*same, "n", "one.*"), "distinct")
    copied = with_common(mixed, distinct.filter("n > 1").select(*same, "n"), same, mixed.count())
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > hot_segments).select("anchor")

    # the distinct segments' bytes, cut from their documents
    asked = distinct.groupBy("_id", "_h").agg(F.collect_list(F.struct("anchor", "first", "shape")).alias("_asked"))
    texts = keyed.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "_text")
    sliced_schema = T.StructType([*key_fields, *place, T.StructField("anchor", T.LongType()), T.StructField("segment", T.BinaryType())])
    sliced_names = sliced_schema.names

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for r in range(b.num_rows):
                data = b.column(3)[r].as_py().encode()
                for x in b.column(2)[r].as_py():
                    rows.append(r)
                    out.append((x["first"], x["shape"], x["anchor"], data[x["first"] : x["first"] + x["shape"] // SHAPE + length]))
            if rows:
                r = pa.array(rows)
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.binary(),), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), *columns], sliced_names)

    sliced = asked.join(texts, asked["_id"].eqNullSafe(texts["_id2"]) & (asked["_h"] == texts["_h2"])).select("_id", "_h", "_asked", "_text").mapInArrow(slices, sliced_schema)
    has_hot = bool(hot.head(1))
    if has_hot:
        sliced = written(sliced, "sliced")
    ordinary = sliced.join(hot, "anchor", "left_anti").select(*sliced_names) if has_hot else sliced
    span_schema = T.StructType([*key_fields, T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    span_names = span_schema.names

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of one anchor, about BATCH bytes at a time."""
        held: list[tuple] = []
        size, kind = 0, None

        def done() -> pa.RecordBatch:
            hits = repeated_windows([x[5] for x in held], np.array([x[3] % SHAPE for x in held]), length)
            rows = [(x[0], x[1], x[2] + a, x[2] + b) for x, w in zip(held, hits, strict=True) for a, b in runs(w, length)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.int64(), pa.int64(), pa.int64()))], span_names)

        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > BATCH and held[-1][4] != row[4]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield done()

    merged = ordinary.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(judge, span_schema)
    out = spans(again.filter("uniform")).unionByName(spans(copied)).unionByName(merged)
    if has_hot:
        window_schema = T.StructType([*key_fields, T.StructField("start", T.LongType()), T.StructField("hash", T.BinaryType())])
        window_names = window_schema.names

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, starts, hashes = [], [], []
                for r, (first, text) in enumerate(zip(b.column("first").to_pylist(), b.column("segment").to_pylist(), strict=True)):
                    for p in range(len(text) - length + 1):
                        rows.append(r)
                        starts.append(first + p)
                        hashes.append(xxhash.xxh3_128_digest(text[p : p + length]))
                r = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_id").take(r), b.column("_h").take(r), pa.array(starts, pa.int64()), pa.array(hashes, pa.binary())], window_names)

        each = sliced.join(hot, "anchor", "left_semi").select(*sliced_names).mapInArrow(windows, window_schema)
        twice = each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
        out = out.unionByName(each.join(twice, "hash").select("_id", "_h", "start", (F.col("start") + length).alias("stop")))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot_segments: int = 20_000) -> DataFrame:
    """Per row of ``docs``: the id, n_bytes, n_removed, n_spans, kept_sha256, and
    kept_text (the remaining bytes; a character of which only a part remains is left out)."""
    keyed = with_key(pick(docs, id_col, text_col))
    return _removed(keyed, id_col, length, hot_segments)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = 200) -> DataFrame:
    """``docs`` with the remaining text in place of each text, and its code points in
    ``chars_col`` where there is such a column; all rows and columns stay."""
    others = [c for c in docs.columns if c != text_col]
    keyed = with_key(docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")
    ))
    out = _removed(keyed, "_id", length, 20_000)
    values = {c: F.col("_row").getField(c) for c in others} | {text_col: F.col("kept_text")}
    if chars_col in values:
        values[chars_col] = F.char_length("kept_text").cast(docs.schema[chars_col].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))


def without_copies(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id and text no other row has, and the other rows (None: there are none)."""
    key = F.struct("_id", "_h").alias("_key")  # nulls in a struct are equal
    copied = written(keyed.groupBy("_id", "_h").agg(F.count("*").alias("_n")).filter("_n > 1").select(key, "_n"), "copied")
    if not copied.head(1):
        return keyed, None
    total = keyed.count()
    # the keys of more than a thousandth of the rows, at most a thousand, are broadcast
    many, few = F.broadcast(copied.filter(F.col("_n") * 1000 > total)), copied.filter(F.col("_n") * 1000 <= total)
    rows = keyed.select("*", key)
    rest = rows.join(many, "_key", "left_anti")
    copies = rows.join(many, "_key", "left_semi").unionByName(rest.join(few, "_key", "left_semi"))
    return rest.join(few, "_key", "left_anti").drop("_key"), copies.drop("_key")


def _removed(keyed: DataFrame, id_name: str, length: int, hot_segments: int) -> DataFrame:
    single, copies = without_copies(keyed)
    judged = single.select("_id", "_h", "_text")
    if copies is not None:
        judged = judged.unionByName(copies.groupBy("_id", "_h").agg(F.first("_text").alias("_text")))
    # spans that touch are one before any are collected
    in_order = Window.partitionBy("_id", "_h").orderBy("start", "stop")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = repeated_spans(judged, length, hot_segments).withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_id", "_h", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    spans = spans.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    carried = [c for c in keyed.columns if c == "_row"]
    joined = single.join(spans, single["_id"].eqNullSafe(spans["_id2"]) & (single["_h"] == spans["_h2"]), "left").select("_id", "_text", "_spans", *carried)
    if copies is not None:
        size = F.octet_length("_text").cast("long")
        whole = F.when(size >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop"))))
        joined = joined.unionByName(copies.select("_id", "_text", whole.alias("_spans"), *carried))
    schema = T.StructType([
        T.StructField(id_name, keyed.schema["_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()), *(keyed.schema[c] for c in carried),
    ])
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, covered in zip(b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                kept, at, n, stop = [], 0, 0, -1
                for s in sorted((x["start"], x["stop"]) for x in covered.as_py() or ()):
                    if s[0] > stop:
                        kept.append(data[at : s[0]])
                        n += 1
                    stop = at = max(stop, s[1])
                kept.append(data[at:])
                rest = b"".join(kept)
                for x, v in zip(out, (len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds), *b.columns[3:]], names)

    return joined.mapInArrow(apply, schema)
