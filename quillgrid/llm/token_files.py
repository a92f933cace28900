"""Token-ID files: one wavelet matrix per shard.

File format (all integers little-endian):

    header   magic b"QGWM", version u8 = 2, levels u8, 2 zero bytes, n_tokens u64,
             first_token u64, first_document u64 (both counted within the part),
             end_id u32, n_marks u32, marks_size u32, 4 zero bytes
    marks    zstandard frame of n_marks bits: for each occurrence of end_id in the
             file, in order, whether a document ends there (the end id may well be
             an ordinary token of a text)
    levels   for each level from the highest bit down: n_zeros u64; the number of
             ones before each block, u32; the size in bytes of each block, u32
    blocks   for each level, each block: a zstandard frame of ``BLOCK`` bits, packed
             low bit first (the last block of a level padded to whole 64-bit words)

At each level tokens with bit 0 go before those with bit 1, keeping order. Blocks
are compressed one by one: token access, counting and occurrence lookup open one
block for each level they pass, and never the whole file. The number of levels
is that of the bits of the greatest id of the vocabulary.

``write_token_files`` lays documents out in ascending id order over shards of just
``shard_tokens`` tokens (the last of a part may have fewer), so documents span
shards, and appends ``end_id`` to each. The files are values of a binary column, so
that Spark's committers write them to any store; beside each stand the ids of the
documents that end in it. ``read_token_files`` takes all else from the files.

Defined results: a null or empty text is the end id alone; null ids come first;
rows of one id are ordered by a hash of their text, and repeated rows are each laid
out; an empty table gives no files and no rows; other columns are not read. A
document of any length is spread over shards; in memory a task has one block of
texts, one shard and the ids of one text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.bpe import by_row, loaded
from quillgrid.llm.common import pick, with_key

MAGIC, VERSION, BLOCK = b"QGWM", 2, 1 << 16
HEADER = "<4sBBxxQQQIIIxxxx"


def packed(bits: np.ndarray) -> bytes:
    out = np.packbits(bits, bitorder="little").tobytes()
    return out + bytes(-len(out) % 8)


def build(ids: np.ndarray, levels: int = 16, end_id: int = 0, ends: np.ndarray | None = None, first_token: int = 0, first_document: int = 0) -> bytes:
    """The file of a sequence of ids; ``ends``: the places at which documents end."""
    if levels > 32 or (len(ids) and (int(ids.max()) >> levels or int(ids.min()) < 0)):
        raise ValueError(f"ids do not fit {levels} levels")
    press = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(1, write_content_size=1, write_checksum=0, write_dict_id=0)).compress
    row, n = ids.astype(np.uint16 if levels <= 16 else np.uint32), len(ids)
    places = np.flatnonzero(row == end_id)
    marked = np.zeros(len(places), bool)
    if ends is not None and len(ends):
        marked[np.searchsorted(places, ends)] = True
    marks = press(packed(marked))
    out = [struct.pack(HEADER, MAGIC, VERSION, levels, n, first_token, first_document, end_id, len(places), len(marks)), marks]
    blocks: list[bytes] = []
    for level in range(levels - 1, -1, -1):
        ones = (row >> level & 1).astype(bool)
        cut = range(0, n, BLOCK)
        before = [0, *accumulate(int(np.count_nonzero(ones[k : k + BLOCK])) for k in cut)]
        made = [press(packed(ones[k : k + BLOCK])) for k in cut]
        out += [struct.pack("<Q", n - before[-1]), np.array(before[:-1], "<u4").tobytes(), np.array([len(x) for x in made], "<u4").tobytes()]
        blocks += made
        row = np.concatenate([row[~ones], row[ones]])
    return b"".join(out + blocks)


class WaveletMatrix:
    """Reads one file: all tokens, one token, counts and places of a token."""

    def __init__(self, blob: bytes):
        magic, version, self.levels, self.n, self.first_token, self.first_document, self.end_id, self.n_marks, size = struct.unpack_from(HEADER, blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        self.blob, self.opened = blob, {}
        self._open = zstandard.ZstdDecompressor().decompress
        self._marks, at = (struct.calcsize(HEADER), size), struct.calcsize(HEADER) + size
        n_blocks = -(-self.n // BLOCK)
        self.zeros, self.before, sizes = [], [], []
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.before.append(np.frombuffer(blob, "<u4", n_blocks, at + 8))
            sizes.append(np.frombuffer(blob, "<u4", n_blocks, at + 8 + 4 * n_blocks))
            at += 8 + 8 * n_blocks
        self.places = []
        for s in sizes:
            edges = at + np.append(0, np.cumsum(s, dtype=np.int64))
            self.places.append(edges)
            at = int(edges[-1])

    def inflate(self, level: int, block: int) -> np.ndarray:
        a, b = self.places[level][block : block + 2].tolist()
        return np.frombuffer(self._open(self.blob[a:b]), "<u8")

    def words(self, level: int, block: int) -> np.ndarray:
        """The words of one block; the last opened block of each level is held."""
        held = self.opened.get(level)
        if held is None or held[0] != block:
            held = self.opened[level] = (block, self.inflate(level, block))
        return held[1]

    def bit(self, level: int, i: int) -> int:
        block, inside = divmod(i, BLOCK)
        return int(self.words(level, block)[inside // 64]) >> inside % 64 & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        if i == self.n:
            return self.n - self.zeros[level]
        block, inside = divmod(i, BLOCK)
        word, bit = divmod(inside, 64)
        words = self.words(level, block) if inside else None
        out = int(self.before[level][block])
        if word:
            out += int(np.bitwise_count(words[:word]).sum(dtype=np.int64))
        return out + (int(words[word]) & (1 << bit) - 1).bit_count() if bit else out

    def select_bit(self, level: int, k: int, one: int) -> int:
        """The place of the bit number ``k`` (from 0) that is ``one``: its block by
        the counts, its word by the words' counts, then the word's bits."""
        before = self.before[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        words = self.words(level, block)
        counts = np.bitwise_count(words if one else ~words).astype(np.int64)
        upto, k = np.cumsum(counts), k - int(before[block])
        word = int(np.searchsorted(upto, k, "right"))
        k -= int(upto[word] - counts[word])
        value = int(words[word]) if one else ~int(words[word]) & (1 << 64) - 1
        for _ in range(k):
            value &= value - 1
        return block * BLOCK + word * 64 + (value & -value).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            one, r = self.bit(level, i), self.rank1(level, i)
            i = self.zeros[level] + r if one else i - r
            value = value << 1 | one
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """How often ``token`` is among the first ``upto`` tokens."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the occurrence number ``k`` (from 0) of ``token``."""
        lo, hi = self._range(token, self.n) if not token >> self.levels else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.select_bit(level, at - self.zeros[level] if one else at, one)
        return at

    def marks(self) -> np.ndarray:
        """For each occurrence of the end id, whether a document ends there."""
        at, size = self._marks
        raw = np.frombuffer(self._open(self.blob[at : at + size]), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n_marks].astype(bool)

    def document_end(self, d: int) -> int:
        """The place of the end of the document number ``d`` (from 0) that ends in this file."""
        return self.select(self.end_id, int(np.flatnonzero(self.marks())[d]))

    def tokens(self) -> np.ndarray:
        """All tokens in order, by undoing the levels from the lowest bit up."""
        row = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            words = [self.inflate(level, k) for k in range(len(self.before[level]))]
            raw = np.concatenate(words).view(np.uint8) if words else np.zeros(0, np.uint8)
            ones = np.unpackbits(raw, bitorder="little")[: self.n].astype(bool)
            out, z = np.empty_like(row), self.zeros[level]
            out[~ones] = row[:z]
            out[ones] = row[z:] | row.dtype.type(1 << (self.levels - 1 - level))
            row = out
        return row

    def ends(self, tokens: np.ndarray) -> np.ndarray:
        """All places at which documents end, beside all tokens."""
        return np.flatnonzero(tokens == self.end_id)[self.marks()]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    shard_tokens: int = 1_000_000, partitions: int | None = None,
) -> DataFrame:
    """Writes the files under ``folder`` and returns them as read back from there:
    part, n_tokens, the ids of the documents that end in the file, and the file.

    Rows are dealt by ranges of (id, hash of the text), so that equal ids do not
    meet in one task; null ids come first, ties are ordered by the hash. Each
    part is sorted, encoded and cut into shards while it streams by.
    """
    spark = docs.sparkSession
    d = with_key(pick(docs, id_col, text_col))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("_id").asc_nulls_first(), F.col("_h"))
    kind = d.schema["_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("file", T.BinaryType()),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(tokenizer), TaskContext.get().partitionId()
        levels = max(bpe.n_ids - 1, end_id, 1).bit_length()
        held: list[np.ndarray] = []
        ids: list = []
        ends: list[int] = []
        first = documents = size = 0

        def shard(arrow_kind: pa.DataType) -> pa.RecordBatch:
            blob = build(np.concatenate(held), levels, end_id, np.array(ends, np.int64), first, documents)
            row = ([part], pa.int32()), ([size], pa.int64()), ([ids], pa.list_(arrow_kind)), ([blob], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in row], names)

        for b in batches:
            arrow_kind = b.schema.field(0).type
            for name, row in zip(b.column(0).to_pylist(), by_row(bpe.encode(b.column(1))), strict=True):
                row = np.append(row, np.uint32(end_id))
                while size + len(row) > shard_tokens:
                    held.append(row[: shard_tokens - size])
                    row, size = row[shard_tokens - size :], shard_tokens
                    yield shard(arrow_kind)
                    first, documents = first + size, documents + len(ids)
                    held, ids, ends, size = [], [], [], 0
                held.append(row)
                size += len(row)
                ids.append(name)
                ends.append(size - 1)
        if size:
            yield shard(arrow_kind)

    dealt = d.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, schema).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def joined_crc(a: int, b: int, size: int) -> int:
    """The CRC-32 of two runs of bytes end to end, the second of ``size`` bytes:
    the CRC is affine in its bytes, so zeros may stand in for the second run."""
    zeros = bytes(size)
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: the id, start, n_tokens, ids_crc32, all from the files.

    Each shard is read on its own and gives a row for each document or part of one
    in it; parts of a document that spans shards meet by its number. Where each
    part of the table starts is known from one sum for each part, of which there
    are as many as the writer had tasks.
    """
    starts, at = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        starts[r["part"]], at = at, at + r["n"]
    kind = files.schema["ids"].dataType.elementType
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    found_schema = T.StructType([T.StructField("part", T.IntegerType()), *longs("document"), T.StructField("_id", kind), T.StructField("ended", T.BooleanType()), *longs("start", "size", "crc")])
    found_names = found_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ids, blob in zip(*(b.column(c) for c in ("part", "ids", "file")), strict=True):
                shard = WaveletMatrix(blob.as_py())
                tokens = shard.tokens()
                edges = np.append(0, shard.ends(tokens) + 1)
                n_ended = len(edges) - 1
                if edges[-1] < shard.n:  # the last document goes on in the next shard
                    edges = np.append(edges, shard.n)
                raw, n = tokens.astype("<u4").tobytes(), len(edges) - 1
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                names_of = pa.concat_arrays([ids.values, pa.nulls(n - n_ended, ids.values.type)])
                columns = np.full(n, part.as_py(), np.int32), shard.first_document + np.arange(n), None, np.arange(n) < n_ended, starts[part.as_py()] + shard.first_token + edges[:-1], np.diff(edges), np.array(crcs, np.int64)
                yield pa.RecordBatch.from_arrays([names_of if x is None else pa.array(x) for x in columns], found_names)

    found = files.select("part", "ids", "file").mapInArrow(run, found_schema)
    whole = found.groupBy("part", "document").agg(
        F.max(F.when(F.col("ended"), F.struct("_id"))).alias("_of"), F.min("start").alias("start"), F.sum("size").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "size", "crc"))).alias("_parts"),
    )
    schema = T.StructType([T.StructField(id_col, kind), *longs("start", "n_tokens", "ids_crc32")])
    names = schema.names

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for parts in b.column(3).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["size"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], names)

    return whole.select(F.col("_of._id"), "start", "n_tokens", "_parts").mapInArrow(joined, schema)
