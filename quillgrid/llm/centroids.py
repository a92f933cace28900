"""Centroid clustering of integer vectors by sort-means.

Each round orders, for every centroid, all centroids by their distance from it. A vector
is compared with the centroid of its previous assignment first, and then with the others
in that one's order, until one is strictly farther from it than twice the vector's current
distance: by the triangle inequality no later one can be nearer or as near. Ties go to
the smaller number, and since only strictly farther ones are skipped, none is missed.

Vectors are quantised to integers, so distances, sums and the floors of means are exact and
the result doesn't depend on how the rows are dealt. A round is one pass over the
vectors, written with their assignments to the shared folder and summed there with
partial sums before the shuffle: no cluster has to fit a task. What goes to the driver and
out with the tasks is the table of centroids, of ``k`` rows.

Defined results: vectors that are null, of another length, or with a null or non-finite
component are left out; components beyond ``LIMIT`` in magnitude are held at it. The first
centroids are the ``k`` vectors of the least digests, ties by id and components; with fewer
vectors there are as many centroids. Null ids have the digest of an empty decimal; repeated
rows are vectors each. An empty table gives an empty result; other columns are not read. Sums of distances beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import discard, written

#: The largest magnitude of a component: squared distances of 64 such fit a long.
LIMIT = 1 << 27


def quantised(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """(_id, _v) of the vectors of ``size`` finite components: floor(scale * x), x as double."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) == size) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    held = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return vectors.filter(sound).select(F.col(f"`{id_col}`").alias("_id"), F.transform(v, held).alias("_v"))


def nearest(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's centroid and squared distance, and how many distances were worked out."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    best, least = previous.copy(), np.empty(len(vectors), np.int64)
    worked = 0
    for a in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == a)
        x = vectors[rows]
        current = ((x - centroids[a]) ** 2).sum(axis=1)
        number, low = np.full(len(rows), a), current.copy()
        worked += len(rows)
        live = np.arange(len(rows))
        for j in np.argsort(between[a], kind="stable").tolist():
            if j == a:
                continue
            # strictly beyond twice the current distance: D > 4 d in squares, without overflow
            live = live[-(-between[a, j] // 4) <= current[live]]
            if not len(live):
                break
            d = ((x[live] - centroids[j]) ** 2).sum(axis=1)
            worked += len(live)
            nearer = (d < low[live]) | (d == low[live]) & (j < number[live])
            low[live[nearer]], number[live[nearer]] = d[nearer], j
        best[rows], least[rows] = number, low
    return best, least, worked


def moved_to(sums: list, count: int) -> list[int]:
    return [int(s) // count for s in sums]


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 256.0, salt: str = "2:",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every sound vector after ``rounds`` of moving the centroids
    and a last assignment, and the final centroids."""
    v = written(quantised(vectors, id_col, vector_col, size, scale))
    seed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = v.withColumn("_seed", seed).orderBy("_seed", F.col("_id").asc_nulls_first(), "_v").limit(k).collect()
    centroids = [list(r["_v"]) for r in first]
    kinds = T.StructType([v.schema["_id"], v.schema["_v"], T.StructField("_c", T.IntegerType(), False)])
    last_kinds = T.StructType([v.schema["_id"], T.StructField("_c", T.IntegerType(), False), T.StructField("_d", T.LongType(), False)])

    def assigned(df: DataFrame, table: list[list[int]], last: bool) -> DataFrame:
        schema = last_kinds if last else kinds
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.array(table, np.int64)
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
                if len(x):
                    best, least, _ = nearest(x, b.column(2).to_numpy(zero_copy_only=False), at)
                    c = pa.array(best.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), c, pa.array(least)] if last else [b.column(0), b.column(1), c], names)

        return df.mapInArrow(run, schema)

    now = v.withColumn("_c", F.lit(0))
    for _ in range(rounds if centroids else 0):
        ahead = written(assigned(now, centroids, False))
        discard(now)
        now = ahead
        for r in now.groupBy("_c").agg(F.count("*").alias("n"), *(F.sum(F.col("_v")[i].cast("long")).alias(f"s{i}") for i in range(size))).collect():
            centroids[r["_c"]] = moved_to(r[2:], r["n"])
    if centroids:
        out = written(assigned(now, centroids, True))
        discard(now)
    else:
        out = now.select("_id", "_c", F.lit(0).cast("long").alias("_d"))
    return out.select(F.col("_id").alias(id_col), F.col("_c").alias("cluster"), F.col("_d").alias("distance")), centroids


def summed(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256. The table that is
    broadcast has a row for each centroid."""
    held = lambda n: n if n < 1 << 63 else None
    sums = {r["cluster"]: int(r["_s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s")).collect()}
    total = held(sum(sums.values()))
    rows = [(k, held(sums.get(k, 0)), total, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    per = assigned.sparkSession.createDataFrame(rows, "_k int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), F.col("cluster") == F.col("_k")).drop("_k")
