"""Operators 11 to 13: sharding, Merkle manifests, centroids."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import centroids, merkle, sharding
from quillgrid.llm.common import numbered
from tests.llm import edges


def test_numbered_has_no_gaps_in_hot_groups(spark):
    rows = [("a" if k % 3 else None, k % 5) for k in range(5000)] + [("a", 1)] * 3000
    out = numbered(spark.createDataFrame(rows, "g string, v int"), "g", ["v"], "at").collect()
    for g in ("a", None):
        mine = sorted((r["at"], r["v"]) for r in out if r["g"] == g)
        assert [x for x, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


# ---- 11 sharding


def drawn(key, shard):
    return int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16)


def test_layout_matches_brute_force_on_hard_rows(spark):
    weights, more = dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0)
    docs = edges.table(spark)
    out = sharding.layout(docs, weights, more).collect()
    expected = []
    for name, text, _ in edges.ROWS:
        key = "-" if name is None else f"{len(str(name))}:{name}"
        data = (text or "").encode()
        pick = lambda n, k=key: max(range(n), key=lambda s: (drawn(k, s), -s))
        expected.append((name, len(data) + 1, zlib.crc32(data), pick(8), pick(9)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r["size"], r.text_crc32, r["shard"], r.grown_shard)) for r in out)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r.grown_shard in (r["shard"], 8) for r in out)
    assert sharding.layout(edges.empty(spark), weights).count() == 0


def test_weights_share_out_keys_and_move_few(spark):
    df = spark.range(20_000)
    weights = {0: 1.0, 3: 2.0, 7: 5.0}
    got = {r["shard"]: r["count"] for r in sharding.assign(df, ["id"], weights).groupBy("shard").count().collect()}
    for s, w in weights.items():
        assert abs(got[s] / 20_000 - w / 8) < 0.015
    moves = sharding.moved(df, ["id"], weights, weights | {9: 2.0}).collect()
    assert all(r.now in (r.was, 9) for r in moves)
    assert abs(sum(r.n_rows for r in moves if r.now == 9) / 20_000 - 0.2) < 0.015
    heavier = sharding.moved(df, ["id"], weights, weights | {3: 4.0}).collect()
    assert all(r.now in (r.was, 3) for r in heavier)
    gone = sharding.moved(df, ["id"], weights, {0: 1.0, 7: 5.0}).collect()
    assert all(r.was == r.now or r.was == 3 for r in gone)


def test_written_shards_read_back(spark, tmp_path):
    docs = edges.table(spark).withColumn("shard", F.lit("mine"))
    out = sharding.write_shards(docs, str(tmp_path / "shards"), ["doc_id", "lang"], dict.fromkeys(range(3), 1.0))
    assert out.columns == [*docs.columns, "_shard"]
    assert sorted(map(repr, out.drop("_shard").collect())) == sorted(map(repr, docs.collect()))
    expected = sharding.assign(docs.drop("shard"), ["doc_id", "lang"], dict.fromkeys(range(3), 1.0))
    assert sorted(repr((r.doc_id, r["shard"])) for r in expected.collect()) == sorted(repr((r.doc_id, r["_shard"])) for r in out.collect())


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        sharding.shard_of(None, {0: 0.0})


# ---- 12 Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """The root, and for each leaf the siblings on its way up."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            ways[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [h("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], ways


def plain_manifest(records):
    trees = {}
    for tree, name, leaf, _ in records:
        trees.setdefault(tree, []).append((name is not None, name or 0, leaf))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = {t: plain_tree([x[2] for x in sorted(trees[t])]) for t in order}
    root, up = plain_tree([made[t][0] for t in order])
    out = []
    for t, way in zip(order, up, strict=True):
        for (_, _, leaf), own in zip(sorted(trees[t]), made[t][1], strict=True):
            out.append((t, leaf, made[t][0], own + way))
    return root, out


@pytest.mark.parametrize("sizes", [[1], [8], [513], [9, 1, 4097, 512], [1] * 10])
def test_manifest_matches_a_plain_tree(spark, sizes):
    random.seed(sum(sizes))
    names = [None, "", "b", "é", "zz", "a", "B", "c", "d", "e"]
    records = [(names[g], k // 2 if k % 7 else None, h(f"{g}/{k // 3}"), None if k % 3 else h(f"x{g}/{k}")) for g, n in enumerate(sizes) for k in range(n)]
    random.shuffle(records)
    made = merkle.manifest(spark.createDataFrame(records, "tree string, id long, leaf string, changed string"))
    root, expected = plain_manifest(records)
    assert made.root == root
    rows = made.leaves.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert all(r.folded == root for r in rows)
    assert sorted((repr(r.tree), r.leaf, r.subroot, [tuple(x) for x in r.path]) for r in rows) == sorted((repr(t), *x) for t, *x in expected)
    assert all(r.proof == h("".join(a + b for a, b in r.path)) for r in rows)
    assert sorted(repr((r.id, r.leaf, r.changed)) for r in rows) == sorted(repr(x[1:]) for x in records)
    assert sorted(repr((r.tree, r["size"])) for r in made.subroots.collect()) == sorted(repr((names[g], n)) for g, n in enumerate(sizes))


def test_events_of_a_block_resolve_in_any_order_and_split():
    random.seed(3)
    for n in (1, 2, 8, 9, 100, 511, 512):
        for depth in {merkle.depth_of(n), merkle.LEVELS}:
            digests = [h(str(k)) for k in range(n)]
            level = digests
            for _ in range(depth):
                level = [merkle.parent(level[k : k + 8]) for k in range(0, len(level), 8)]
            events = [(k, n, depth, d, k, None) for k, d in enumerate(digests)]
            random.shuffle(events)
            parts = [p for p in (events[0::3], events[1::3], events[2::3]) if p]
            made = None
            for part in parts:
                block = merkle.started(part[0])
                for e in part[1:]:
                    block = merkle.gathered(block, e)
                made = block if made is None else merkle.merged(made, block)
            assert made[0]["top"] == level[0] and set(made[0]) == {"top", "shape"} and len(made[1]) == n


def test_manifest_takes_hard_rows(spark):
    docs = edges.table(spark)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    ask = lambda df: merkle.manifest(df.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), merkle.record_digest(columns).alias("leaf"), F.lit(None).cast("string").alias("changed")))
    made = ask(docs)
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    expected = [h("".join(map(part, (i, "y", lang, None if t is None else len(t), t)))) for i, t, lang in edges.ROWS]
    assert sorted(r.leaf for r in made.leaves.collect()) == sorted(expected)
    empty = ask(docs.limit(0))
    assert empty.root is None and empty.leaves.count() == 0 and empty.subroots.count() == 0


# ---- 13 centroids


def plain_means(rows, k, rounds, size, scale, salt):
    kept = []
    for name, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((name, [max(min(int(np.floor(float(x) * scale)), centroids.LIMIT), -centroids.LIMIT) for x in v]))
    digest = lambda name: h(salt + ("" if name is None else str(name)))
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[0] is not None, r[0] or 0, r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in set(found):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f == j]
            at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(name, near(v)[1], near(v)[0]) for name, v in kept], at


def test_clusters_match_plain_means(spark):
    random.seed(5)
    base = [[random.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = [(k, [x + random.choice([0, 0, 0.01, 0.3]) for x in random.choice(base)]) for k in range(300)]
    rows += rows[:20] + [(None, base[0])] * 40
    rows += [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 4), (1003, [1.0, None, 0.0, 0.0]), (1004, [float("inf")] * 4), (1005, []), (1006, [3e38, -3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, _id string, _v int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for k, rounds in ((7, 3), (1, 2), (1000, 2), (7, 0)):
        found, at = centroids.cluster(df, k, rounds, size=4)
        expected, expected_at = plain_means(rows, k, rounds, 4, 256.0, "2:")
        assert at == expected_at
        assert sorted(map(repr, expected)) == sorted(repr((r.vec_id, r.cluster, r.distance)) for r in found.collect())
    total = centroids.summed(found, at).collect()
    assert {r.inertia for r in total} == {sum(x[2] for x in expected)} and all(r.centroid_sha256 == h(",".join(map(str, at[r.cluster]))) for r in total)


def test_no_sound_vector_gives_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for rows in (df, df.limit(0)):
        found, at = centroids.cluster(rows)
        assert at == [] and centroids.summed(found, at).count() == 0


def test_sorted_scan_skips_centroids_and_keeps_ties():
    random.seed(8)
    at = np.array([[x * 1000, 0] for x in range(30)], np.int64)
    v = np.array([[random.randrange(30) * 1000 + random.randrange(-60, 60), random.randrange(60)] for _ in range(500)] + [[500, 0], [1500, 7]], np.int64)
    d = ((v[:, None, :] - at[None]) ** 2).sum(axis=2)
    best, least, worked = centroids.nearest(v, d.argmin(axis=1), at)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    assert worked < 5 * len(v)
    best, least, _ = centroids.nearest(v, np.full(len(v), 29), at)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
