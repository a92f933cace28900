"""Byte-level BPE by a pair occurrence index.

The texts of a partition are taken a block at a time, as bytes. The tokenizer's
pattern is applied to a whole block at once: bytes get the class of their
character, and pieces begin where classes change. The block's distinct pieces are
laid out as one sequence of symbols. An index maps each adjacent pair to all its
positions; the active pairs are taken in ascending rank, every position of the
pair is merged, and the lists of the pairs that this makes or breaks are updated.
A merge's product only occurs in pairs of later rank, so one ascending pass is the
same as merging each piece on its own.

The tokenizer's file must be readable on executors; it is never trained here.

Defined results: a null text is the empty text (no ids, decoded empty); repeated
rows are each returned; an empty table gives an empty result; other columns are not
read. Texts are processed whole. A text longer than ``BLOCK`` bytes is cut before
single blanks between two other characters, where a piece always begins, so memory
is bounded by ``BLOCK`` and the longest piece (which must be under 1 GB).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgrid.llm.common import pick

#: Bytes of text whose pieces are indexed together.
BLOCK = 5 << 20
#: Classes of characters in the pattern of byte-level BPE:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Only of these are the classes sure; beyond them, libraries' Unicode tables may
#: differ, and the tokenizer's own cutter is asked.
SURE = (range(0x250), range(0x2010, 0x2028), (0x20AC,))
#: What may follow an apostrophe that begins a piece.
AFTER_APOSTROPHE = ("s", "t", "re", "ve", "m", "ll", "d")
ODD = np.uint64(0x9E3779B97F4A7C15)


def class_table() -> np.ndarray:
    out = np.full(0x110000, UNSURE, np.uint8)
    kinds = [(SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}"))]
    for codes in SURE:
        for c in codes:
            out[c] = next((k for k, r in kinds if r.match(chr(c))), OTHER)
    return out


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of the given starts and sizes, one run after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 30 else np.int64
    return np.repeat((starts - ends + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)


class PairIndexBpe:
    """Encodes and decodes with the merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))).encode()) if self.special else None
        self.may_cut = not any(" " in s for s in self.special)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: by rank: the pair as one integer, and the product
        self.pair = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], dtype=np.int64)
        self.product = [vocab[x + y] for x, y in pairs]
        self.by_pair = np.argsort(self.pair).astype(np.int32)
        self.sorted_pairs = self.pair[self.by_pair]
        codes = self.of_byte.astype(np.int64)
        self.byte_rank = self.ranks(np.repeat(codes, 256), np.tile(codes, 256)).reshape(256, 256)
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        bytes_of: list[bytes] = [b""] * self.n_ids
        for s, i in vocab.items():
            bytes_of[i] = bytes(letters[c] for c in s)
        for s, i in self.special.items():
            bytes_of[i] = s.encode()
        self.size_of = np.array([len(x) for x in bytes_of], np.int64)
        self.first_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.classes = class_table()
        self.cutter = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.sorted_pairs, code)
        return np.where(self.sorted_pairs.take(at, mode="clip") == code, self.by_pair.take(at, mode="clip"), np.int32(-1))

    # ---- cutting

    def byte_classes(self, data: np.ndarray) -> np.ndarray:
        """Each byte's class, that of its character."""
        out = self.classes[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) for k in range(4)]
            low = [x & 0x3F for x in b]
            code = np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | low[1], np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
            kind = self.classes[np.minimum(code, 0x10FFFF)]
            for k in range(4):
                long = b[0] >= (0, 0xC0, 0xE0, 0xF0)[k]
                out[lead[long] + k] = kind[long]
        return out

    def piece_starts(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The places where pieces begin, and (place, id) of the special tokens.
        ``texts``: where each text that is not empty begins."""
        n = len(data)
        fresh = np.zeros(n + 4, bool)  # no piece goes across these
        fresh[texts] = fresh[n] = True
        special: list[tuple[int, int]] = []
        whole: list[slice] = []
        raw = data.tobytes()
        if self.special_re and self.special_re.search(raw):
            for a, b in zip(texts.tolist(), [*texts[1:].tolist(), n], strict=True):
                for m in self.special_re.finditer(raw, a, b):
                    special.append((m.start(), self.special[m[0].decode()]))
                    fresh[m.start()] = fresh[m.end()] = True
                    whole.append(slice(m.start() + 1, m.end()))
        kind = np.full(n + 4, 255, np.uint8)
        kind[:n] = self.byte_classes(data)
        padded = np.zeros(n + 4, np.uint8)
        padded[:n] = data
        run = fresh.copy()
        run[1:n] |= kind[1:n] != kind[: n - 1]
        first = run.copy()
        # the last of a row of white space that something follows stands alone, or a blank joins what follows
        after = np.flatnonzero(run[1:n] & (kind[: n - 1] == SPACE) & ~fresh[1:n]) + 1
        first[after - 1 - (padded[after - 1] >= 0x80)] = True
        first[after[padded[after - 1] == 0x20]] = False
        # an apostrophe alone that begins a piece, and letters after it
        mark = np.flatnonzero(padded[:n] == 0x27)
        mark = mark[first[mark] & run[mark + 1] & ~fresh[mark + 1] & (kind[mark + 1] == LETTER)]
        a, b = padded[mark + 1], padded[mark + 2]
        size = np.zeros(len(mark), np.int64)
        for s in AFTER_APOSTROPHE:
            hit = a == ord(s[0])
            if len(s) == 2:
                hit &= (b == ord(s[1])) & ~fresh[mark + 2]
            size[hit] = len(s)
        mark, size = mark[size > 0], size[size > 0]
        first[mark + 1] = False
        first[mark + 1 + size] = True
        for inside in whole:
            first[inside] = False
        unsure = np.flatnonzero(kind[:n] == UNSURE)
        if len(unsure):
            bounds = np.flatnonzero(fresh[: n + 1])
            taken = {k for k, _ in special}
            for k in np.unique(np.searchsorted(bounds, unsure, "right") - 1).tolist():
                a, b = int(bounds[k]), int(bounds[k + 1])
                if a not in taken:
                    first[a:b] = False
                    first[a + self.asked(raw[a:b].decode())] = True
        return np.flatnonzero(first[:n]), special

    def asked(self, text: str) -> np.ndarray:
        """Where pieces begin (in bytes), by the tokenizer's own cutter."""
        if self.cutter is None:
            from tokenizers import pre_tokenizers

            self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.cumsum(sizes) - sizes
        return at[[x for _, (x, _) in self.cutter.pre_tokenize_str(text)]]

    # ---- merging

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the given pieces of ``data`` together: their ids, and how many each has.

        ``where`` is the index: rank of an active pair -> lists of its positions.
        A symbol stands at the place of its first byte, so the next one is its length
        away; ``back`` is the way to the one before. Pieces stand apart by an end.
        """
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        inner = np.ones(n, bool)
        inner[ends] = False
        raw = data[ragged(starts, sizes)]
        end, gone = self.n_ids, self.n_ids + 1
        sym = np.full(n, end, np.uint16 if gone < 1 << 16 else np.uint32)
        sym[inner] = self.of_byte[raw]
        back = np.ones(n, np.uint8 if int(self.size_of.max()) < 256 else np.uint32)
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(rank: np.ndarray, at: np.ndarray) -> None:
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return
            rank, at = rank[some], at[some]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for x, y, r in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist()):  # noqa: B905
                held = where.get(r)
                if held is None:
                    where[r] = [at[x:y]]
                    heapq.heappush(heap, r)
                else:
                    held.append(at[x:y])

        both = np.flatnonzero(inner[:-1] & inner[1:])
        behind = both - np.cumsum(~inner, dtype=np.int32)[both]  # place in ``raw``
        put(self.byte_rank[raw[behind], raw[behind + 1]], both)
        del inner, both, behind, raw
        while heap:
            r = heapq.heappop(heap)
            lists = where.pop(r)
            code, product = int(self.pair[r]), self.product[r]
            a, b = code >> 32, code & 0xFFFFFFFF
            left, whole = int(self.size_of[a]), int(self.size_of[product])
            i = np.concatenate(lists) if len(lists) > 1 else lists[0]
            i = i[(sym.take(i) == a) & (sym.take(i + left) == b)]  # else an earlier merge took a part
            if not len(i):
                continue
            if len(lists) > 1 or a == b:
                i = np.unique(i)
                if a == b:
                    i = i[self.apart(i, left)]
            k = i + whole
            sym[i] = product
            sym[i + left] = gone
            back[k] = whole
            h = i - back.take(i)
            # a pair with an end has no rank; before a piece's first symbol stands the end of the piece before
            one = np.full(len(i), product, np.int64)
            put(self.ranks(np.concatenate([one, sym.take(h)]), np.concatenate([sym.take(k), one])), np.concatenate([i, h]))
        live = sym < end
        counts = np.add.reduceat(live, np.append(0, ends[:-1] + 1), dtype=np.int32)
        return sym[live].astype(np.uint32), counts

    @staticmethod
    def apart(i: np.ndarray, size: int) -> np.ndarray:
        """Of a pair of equal symbols, every other place of a row of them, from the left."""
        follows = np.append(False, i[1:] - i[:-1] == size)
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
        return (np.arange(len(i)) - run) % 2 == 0

    # ---- texts

    def distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, of): the numbers of one piece of each kind, and each piece's kind.
        Pieces of up to 16 bytes are told by two words that hold them, longer ones by
        a hash; either way kinds come from a 64-bit key and are then compared whole."""
        padded = np.append(data, np.zeros(16, np.uint8))
        word = np.ndarray(len(data) + 8, "<u8", padded, 0, (1,))
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        held = [word[starts + 8 * k] for k in range(2)]
        for k in range(2):
            unused = np.clip(8 * (k + 1) - sizes, 0, 8).astype(np.uint64) * np.uint64(8)
            held[k] &= np.where(unused < 64, every >> np.minimum(unused, np.uint64(63)), np.uint64(0))
        long = np.flatnonzero(sizes > 16)
        if len(long):
            at = ragged(starts[long], sizes[long])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
            powers = np.cumprod(np.full(256, ODD, np.uint64))
            held[1][long] ^= np.add.reduceat(powers[inside & 255] * (data[at] + np.uint64(1)), np.cumsum(sizes[long]) - sizes[long])
        h = (held[0] ^ held[0] >> np.uint64(32)) * ODD + held[1]
        h = (h ^ h >> np.uint64(29)) * ODD + sizes.astype(np.uint64)
        of = pa.array(h).dictionary_encode().indices.to_numpy().copy()
        which = np.empty(int(of.max()) + 1, np.int32)
        which[of[::-1]] = np.arange(len(of), dtype=np.int32)[::-1]
        model = which[of]
        same = (sizes == sizes[model]) & (held[0] == held[0][model]) & (held[1] == held[1][model])
        if len(long):
            alike = long[same[long]]
            if len(alike):
                at = ragged(starts[alike], sizes[alike])
                other = ragged(starts[model[alike]], sizes[alike])
                same[alike] = np.logical_and.reduceat(data[at] == data[other], np.cumsum(sizes[alike]) - sizes[alike])
        odd = np.flatnonzero(~same).astype(np.int32)
        if len(odd):  # a key shared by two kinds: such pieces count each for itself
            of[odd] = len(which) + np.arange(len(odd))
            which = np.append(which, odd)
        return which, of

    def encode_block(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand one after another in ``data``, and how many each has."""
        counts = np.zeros(len(sizes), np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), counts
        texts = (np.cumsum(sizes) - sizes)[sizes > 0]
        starts, special = self.piece_starts(data, texts)
        starts = starts.astype(np.int32)
        lengths = np.diff(np.append(starts, np.int32(len(data))))
        which, of = self.distinct(data, starts, lengths)
        ids, n_ids = self.merge(data, starts[which], lengths[which])
        first = np.cumsum(n_ids, dtype=np.int32) - n_ids
        if special:
            at = of[np.searchsorted(starts, [k for k, _ in special])]
            ids, first[at], n_ids[at] = np.append(ids, np.array([x for _, x in special], np.uint32)), len(ids) + np.arange(len(special)), 1
        per_piece = n_ids[of]
        counts[sizes > 0] = np.add.reduceat(per_piece, np.searchsorted(starts, texts), dtype=np.int64)
        return ids[ragged(first[of], per_piece)], counts

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows of a column without nulls, about ``BLOCK`` bytes each: all their ids
        (unsigned 32-bit), and how many each row has."""
        wide = pa.types.is_large_string(column.type)
        _, places, raw = column.buffers()
        at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
            part = data[at[row] : at[stop]]
            if stop == row + 1 and len(part) > BLOCK:
                found = [self.encode_block(x, np.array([len(x)])) for x in self.parts(part)]
                yield np.concatenate([x for x, _ in found]), sum(c for _, c in found)
            else:
                yield self.encode_block(part, np.diff(at[row : stop + 1]))
            row = stop

    def parts(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in parts that begin with a blank between two other characters."""
        while len(data) > BLOCK and self.may_cut:
            cut, look = 0, BLOCK
            while not cut and look < len(data):
                near = data[look - 1 : look + BLOCK + 1]
                blank = (near == 0x20) | (near < 0x21) | (near >= 0x80)
                place = np.flatnonzero((near[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:])
                cut, look = (look + int(place[0]), look) if len(place) else (0, look + BLOCK)
            if not cut:
                break
            yield data[:cut]
            data = data[cut:]
        yield data

    def decode(self, ids: np.ndarray) -> str:
        return self.all_bytes[ragged(self.first_of[ids], self.size_of[ids])].tobytes().decode("utf-8", "replace")


def file_of(tokenizer: str) -> str:
    """A tokenizer's file on this machine: a path, or the name of a public tokenizer."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def loaded(tokenizer: str) -> PairIndexBpe:
    """One tokenizer for each worker process and name."""
    held = sys.__dict__.setdefault("_quillgrid_bpe", {})
    if tokenizer not in held:
        held[tokenizer] = PairIndexBpe(file_of(tokenizer))
    return held[tokenizer]


def by_row(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    for ids, counts in blocks:
        at = 0
        for n in counts.tolist():
            yield ids[at : at + n]
            at += n


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256, and with
    ``keep_ids`` the ids as a column. One pass, no shuffle."""
    d = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for ids in by_row(bpe.encode(b.column(1))):
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if keep_ids:
                    rows[3].append(ids.astype(np.int32))
            out = [b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[3], pa.list_(pa.int32()))] * keep_ids, names)

    schema = T.StructType([
        T.StructField(id_col, d.schema["_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    names = schema.names
    return d.mapInArrow(run, schema)
