"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the windows of ordinary texts, one on
the stretches of toxic texts that set them apart: a run of ``GRAM`` bytes, anywhere
in a text, is distinctive if more toxic texts hold it than chance allows, given how
many ordinary ones do (``CHANCE`` standard deviations over that rate; of those the
``MOST`` furthest from it, as a dictionary of 2 KB holds no more). A text is cut into windows of words; each is compressed with the ordinary
dictionary and again with the toxic one beside it. The bytes that the second saves
are a window's gain. A text's three greatest gains, the mean gain, the share of
windows with a clear gain and the logarithm of their number go through a logistic
curve; its value is the score.

Calibration is out of sample: each toxic text is measured with a dictionary of the
other folds' texts, and the ordinary texts with one that none of them trained. The
curve is then moved so that ``FALSE_ALARMS`` of those ordinary texts score 0.5 or more.

Learning takes a bounded sample: of each label at most ``per_class`` (ordinary:
twice that) texts of at most ``sample_bytes`` bytes, those with the least hash
of their id. Scoring reads every whole text, in one pass without a shuffle, and
neither label, language, source nor id is an input of a score.

Defined results: a null or blank text has no window, all features zero, and the
score the calibration gives that. Repeated rows are each scored, alike; a long text
has more windows, each of at most ``WINDOW_BYTES`` bytes. Of an empty table the result
is empty. Without learnable texts of both labels every score is the share of label 1
(0 if there is no label). Other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import pick

WINDOW_WORDS, WINDOW_BYTES, LEVEL = 24, 4096, 9
GRAM, CHANCE, MOST, LEAST_TEXTS, FOLDS, FALSE_ALARMS = 7, 6.0, 1024, 3, 4, 0.01
FEATURES = 6


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the calibration."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    bias: float


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    out = []
    for i in range(0, len(words), WINDOW_WORDS):
        w = " ".join(words[i : i + WINDOW_WORDS]).encode()
        out += [w] if len(w) <= WINDOW_BYTES else [w[k : k + WINDOW_BYTES] for k in range(0, len(w), WINDOW_BYTES)]
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    """Once for each worker process and model."""
    held = sys.__dict__.setdefault("_quillgrid_toxicity", {})
    if model not in held:
        held.clear()
        held[model] = compressor(model.ordinary), compressor(model.toxic + model.ordinary)
    return held[model]


def features(text: str, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    a, b = (c.compress for c in pair)
    gains = np.array([len(a(w)) - len(b(w)) for w in windows(text)], dtype=float)
    if not len(gains):
        return np.zeros(FEATURES)
    top = np.sort(gains)[::-1][:3]
    top = np.append(top, np.full(3 - len(top), top[-1]))
    return np.array([*top, gains.mean(), (gains >= 4).mean(), math.log(len(gains))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[tuple[float, ...], float]:
    """Newton's method with a small ridge on the weights."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def trained(size: int, samples: list[bytes], segment: int, gram: int) -> bytes:
    """A dictionary's content; of too few samples for the trainer, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=gram, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def as_bytes(text: str) -> bytes:
    return f" {' '.join(text.lower().split())} ".encode()


def runs(data: bytes) -> np.ndarray:
    """Each run of ``GRAM`` bytes as a number, in order."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(max(0, len(data) - GRAM + 1), "<u8", padded, 0, (1,))
    return words & np.uint64((1 << 8 * GRAM) - 1)


def stretches(data: bytes, chosen: np.ndarray) -> bytes:
    """The parts of a text that chosen runs cover, a blank before each."""
    at = np.flatnonzero(np.isin(runs(data), chosen))
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) > GRAM) + 1
    first, last = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + GRAM
    return b"".join(b" " + data[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True))


def texts_with(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of some texts, and how many of the texts hold each."""
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fit(toxic: list[str], ordinary: list[str], ordinary_size: int = 112_640, toxic_size: int = 2048, share: float = 0.0) -> Model:
    """The ordinary dictionary from every other ordinary text, the toxic one from all
    toxic texts; calibration as the module says."""
    if len(toxic) < 4 or len(ordinary) < 4:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0,) * FEATURES, float(np.log(share / (1 - share))))
    plain = trained(ordinary_size, [w for x in ordinary[::2] for w in windows(x)], 48, 8)
    texts = [as_bytes(x) for x in toxic]
    found = [np.unique(runs(x)) for x in texts]
    usual, usual_in = texts_with([np.unique(runs(as_bytes(x))) for x in ordinary[::2]])
    usual, usual_in = np.append(usual, ~np.uint64(0)), np.append(usual_in, 0)  # no run has that number

    def dictionary(rows: list[int]) -> bytes:
        held, n = texts_with([found[i] for i in rows])
        held, n = held[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
        at = np.searchsorted(usual, held)
        expected = np.where(usual[at] == held, usual_in[at], 0) * (len(rows) / len(ordinary[::2]))
        beyond = (n - expected) / np.sqrt(expected + 1)
        order = np.lexsort((held, -beyond))
        chosen = held[order[beyond[order] > CHANCE][:MOST]]
        return trained(toxic_size, [stretches(texts[i], chosen) for i in rows], 16, 6)

    a, rows = compressor(plain), list(range(len(toxic)))
    measured: list[np.ndarray] = []
    for k in range(FOLDS):
        b = compressor(dictionary([i for i in rows if i % FOLDS != k]) + plain)
        measured += [features(toxic[i], (a, b)) for i in rows[k::FOLDS]]
    model = Model(plain, dictionary(rows), (0.0,) * FEATURES, 0.0)
    pair = compressors(model)
    apart = np.array([features(x, pair) for x in ordinary[1::2]])
    x = np.vstack([np.array(measured), apart])
    y = np.append(np.ones(len(toxic)), np.zeros(len(apart)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, bias = logistic((x - mean) / spread, y)
    weights = np.array(weights) / spread
    bias -= float(weights @ mean)
    bias -= float(np.quantile(apart @ weights + bias, 1 - FALSE_ALARMS, method="higher"))
    return Model(model.ordinary, model.toxic, tuple(map(float, weights)), bias - 1e-9)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    modulus: int = 5, remainder: int = 0, per_class: int = 1500, sample_bytes: int = 65536,
) -> Model:
    """Fits on a bounded sample of the rows that aren't held out."""
    named = labels.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_y")).filter(
        F.col("_lid").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_lid"), modulus, remainder)
    )
    share = named.agg(F.avg("_y").alias("m")).first()["m"] or 0.0
    order = (F.xxhash64("_lid"), F.col("_lid"))
    chosen = named.filter("_y = 1").orderBy(*order).limit(per_class).unionByName(named.filter("_y = 0").orderBy(*order).limit(2 * per_class)).distinct()
    rows = (
        pick(docs, id_col, text_col).filter(F.octet_length("_text") <= sample_bytes)
        .join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_lid", "_y", "_text").distinct().orderBy("_lid", "_text").limit(4 * per_class).collect()
    )
    return fit([r["_text"] for r in rows if r["_y"] == 1], [r["_text"] for r in rows if r["_y"] == 0], share=share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: the id, ``score`` and ``predicted``."""
    d = pick(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, d.schema["_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, weights = compressors(model), np.array(model.weights)
        for b in batches:
            x = np.array([features(t.as_py(), pair) for t in b.column(1)]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    return d.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``. One pass."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, weights = compressors(model), np.array(model.weights)
        for b in batches:
            x = np.array([features(t.as_py() or "", pair) for t in b.column(at)]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -500, 500)))
            keep = b.filter(pa.array(s < threshold))
            yield pa.RecordBatch.from_arrays(keep.columns, names)

    return docs.mapInArrow(run, docs.schema)
