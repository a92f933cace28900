import random

import numpy as np
from pyspark.sql import functions as F

from quillgrid.operators import apportion, graph, raster, routing, spatial
from quillgrid.operators import statistics as st


def test_apportion_is_exact(spark):
    random.seed(5)
    rows = [(p, c, random.randrange(0, 50) if p else 0, 997 + p) for p in range(6) for c in range(random.randrange(1, 30))]
    out = apportion.apportion(spark.createDataFrame(rows, "parent long, child long, weight long, total long"), "parent", "child", "weight", "total").collect()
    for p in range(6):
        got = {r.child: r.share for r in out if r.parent == p}
        assert sum(got.values()) == 997 + p
        w = {c: x for q, c, x, _ in rows if q == p}
        w = w if sum(w.values()) else dict.fromkeys(w, 1)
        s = sum(w.values())
        want = {c: (997 + p) * x // s for c, x in w.items()}
        left = 997 + p - sum(want.values())
        for c in sorted((c for c in w if (997 + p) * w[c] % s), key=lambda c: (-((997 + p) * w[c] % s), c))[:left]:
            want[c] += 1
        assert got == want


def chain(spark, n):
    return spark.createDataFrame([(k, k - 1 if k % 500 else None, 1) for k in range(n)], "cell long, receiver long, value long")


def test_long_paths(spark):
    nodes = chain(spark, 1000)
    total = {r.cell: r.total for r in graph.accumulate(nodes).collect()}
    assert all(total[k] == 500 - k % 500 for k in range(1000))
    found = {r.cell: (r.root, r.steps) for r in graph.roots(nodes).collect()}
    assert all(found[k] == (k // 500 * 500, k % 500) for k in range(1000))


def test_components_of_a_path_and_singles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (*range(10, 61), 100, 101, 200)], "node long")
    got = {r.node: r.label for r in graph.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(10, 61), 10), 100: 100, 101: 100, 200: 200}


def test_nearest_matches_brute_force(spark):
    random.seed(2)
    pts = [(k, random.randrange(300), random.randrange(300)) for k in range(200)]
    asks = [(k, random.randrange(300), random.randrange(300)) for k in range(20)]
    got = spatial.nearest_k(spark.createDataFrame(asks, "qid long, qx long, qy long"), spark.createDataFrame(pts, "pid long, x long, y long"), 4, 16).collect()
    for q, qx, qy in asks:
        want = sorted(((x - qx) ** 2 + (y - qy) ** 2, p) for p, x, y in pts)[:4]
        assert sorted((r.d2, r.pid) for r in got if r.qid == q) == want


def test_quantiles_hold_their_ends(spark):
    df = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 3, 2), ("b", 7, 1, 3)], "g string, v long, w long, t long")
    got = {(r.g, r.p): r.quantile for r in st.weighted_quantiles(df, "g", "v", "w", "t", [0.0, 0.5, 1.0]).collect()}
    # points of a: 1 at 0.125, 2 at 0.625
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 1.75, ("a", 1.0): 2.0, ("b", 0.0): 7.0, ("b", 0.5): 7.0, ("b", 1.0): 7.0}


def test_steepest_ties_take_the_first_direction(spark):
    g = spark.createDataFrame([(r * 3 + c, r, c, 5 if (r, c) == (1, 1) else 1) for r in range(3) for c in range(3)], "cell long, r long, c long, z long")
    got = {r.cell: r.receiver for r in graph.steepest_receivers(g).collect()}
    assert got[4] == 1 and got[0] is None


def test_empty_tables(spark):
    e = spark.createDataFrame([], "cell long, receiver long, value long")
    assert graph.accumulate(e).count() == 0 and graph.roots(e).count() == 0
    assert st.block_mean(spark.createDataFrame([], "r long, c long, z long"), "r", "c", "z", 4).count() == 0
    assert graph.dilate(spark.createDataFrame([], "r long, c long"), spark.createDataFrame([(1, 1)], "r long, c long"), 2).count() == 0
    assert F is not None


def test_kernels():
    import numpy as np

    from quillgrid.operators import lines

    assert lines.non_increasing(np.array([3.0, 1.0, 2.0, 2.0, 5.0])).tolist() == [3.0, 2.5, 2.5, 2.5, 2.5]
    xy = np.array([[0, 0], [1, 0.1], [2, 5], [3, 0.1], [4, 0]], float)
    assert lines.simplified(xy, 1.0).tolist() == [True, False, True, False, True]
    assert lines.simplified(np.array([[0, 0], [1, 0.1], [2, 0]], float), 1.0).tolist() == [True, False, True]


def test_running_totals_of_one_large_group(spark):
    random.seed(7)
    rows = [("a" if k % 10 else None, random.randrange(50), random.randrange(9), k) for k in range(500)]
    got = st.running_totals(spark.createDataFrame(rows, "g string, o long, v long, k long"), "g", [F.col("o").desc(), F.col("k")], "v").collect()
    assert len(got) == 500
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (-r.o, r.k)):
            assert r["_before"] == total and r["_all"] == sum(x[2] for x in rows if x[0] == g)
            total += r.v


def test_far_points_are_found(spark):
    pts = spark.createDataFrame([(k, 10_000 + k, -10_000) for k in range(6)], "pid long, x long, y long")
    asks = spark.createDataFrame([(0, 0, 0), (1, 10_002, -10_000)], "qid long, qx long, qy long")
    got = spatial.nearest_k(asks, pts, 4, 16).collect()
    assert sorted((r.qid, r["rank"], r.pid) for r in got) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 3), (1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 4, 0)]
    assert spatial.nearest_k(asks, pts.filter("pid < 2"), 4, 16).count() == 4


def test_orders_of_long_chains_and_trees(spark):
    n = 10_000
    rows = [(k, k + 1 if k + 1 < n else None) for k in range(n)]
    got = routing.strahler(spark.createDataFrame(rows, "cell long, receiver long")).collect()
    assert len(got) == n and {r.order for r in got} == {1}
    random.seed(9)
    receiver = {k: random.choice([None, *range(max(0, k - 4), k)]) if k else None for k in range(300)}
    order = {}
    for k in sorted(receiver, reverse=True):
        given = sorted((order[d] for d in receiver if receiver[d] == k), reverse=True)
        order[k] = 1 if not given else given[0] + (len(given) > 1 and given[0] == given[1])
    got = routing.strahler(spark.createDataFrame(list(receiver.items()), "cell long, receiver long")).collect()
    assert {r.cell: r.order for r in got} == order


def test_long_way_down(spark):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(3000)], "cell long, receiver long")
    got = graph.downstream(nodes, spark.createDataFrame([(2999,), (4,)], "cell long")).collect()
    assert sorted((r.start, r.step, r.cell) for r in got) == [(4, k, 4 - k) for k in range(5)] + [(2999, k, 2999 - k) for k in range(3000)]


def test_windows_without_a_view_keep_the_value(spark):
    g = spark.createDataFrame([(r, c, r * 10 + c) for r in range(8) for c in range(8)], "r long, c long, z long")
    assert all(abs(x.fused - (x.r * 10 + x.c)) < 1e-9 for x in st.window_fusion(g, "r", "c", "z", 4, 2).collect())


def test_poisson_counts_have_no_cut_tail(spark):
    import math

    from quillgrid.functions import keys

    def plain(u, lam):
        p = c = math.exp(-lam)
        k = 0
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        return k

    rows = [(u, lam) for lam in (0.5, 4.0, 45.0, 200.0, 600.0) for u in (0.0, 0.3, 0.9, 0.999999, 1 - 2**-40)]
    got = spark.createDataFrame(rows, "u double, lam double").select("u", "lam", keys.poisson(F.col("u"), F.col("lam")).alias("k")).collect()
    assert all(r.k == plain(r.u, r.lam) for r in got) and max(r.k for r in got) > 700


def test_water_closes(spark):
    """Rain is what evaporates, runs off and stays in the stores."""
    from quillgrid.operators import monthly

    random.seed(3)
    rows = [(k, [random.uniform(-20, 25) for _ in range(12)], [random.uniform(0, 200) for _ in range(12)], [random.uniform(0, 150) for _ in range(12)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, t array<double>, p array<double>, e array<double>")
    args = F.col("t"), F.col("p"), F.col("e")
    for r in df.select("p", monthly.water_year(*args, 1).alias("y"), monthly.periodic_year(*args).alias("s")).collect():
        assert abs(sum(r.p) - r.y.aet - r.y.runoff - r.y.snow - r.y.soil - r.y.gw) < 1e-6
        assert r.s.change < 1e-3 and abs(sum(r.p) - r.s.aet - r.s.runoff) < 2e-3


def test_stencils_and_distances_take_gaps(spark):
    """A grid with holes beside plain loops over the cells that there are."""
    random.seed(11)
    h, w = 9, 13
    z = {(r, c): random.randrange(100) for r in range(h) for c in range(w) if random.random() < 0.7}
    grid = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z long")
    back = {"reflect": lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n)), "nearest": lambda i, n: max(0, min(n - 1, i)), "wrap": lambda i, n: i % n}
    for modes, sigmas in ((("reflect", "nearest"), {"a": 0.8, "b": 3.0}), (("nearest", "wrap"), {"a": 1.5})):
        got = {(r.r, r.c): r for r in raster.gaussian(grid, sigmas, h, w, modes=modes).collect()}
        assert set(got) == set(z)
        for name, sigma in sigmas.items():
            t = raster.taps(sigma)
            now = dict(z)
            for axis in (0, 1):
                nxt = {}
                for (r, c), _ in now.items():
                    s = ws = 0.0
                    for k, x in enumerate(t):
                        k -= len(t) // 2
                        at = (back[modes[0]](r + k, h), c) if axis == 0 else (r, back[modes[1]](c + k, w))
                        if at in now:
                            s, ws = s + x * now[at], ws + x
                    nxt[r, c] = s / ws
                now = nxt
            assert all(abs(got[p][name] - v) < 1e-9 for p, v in now.items())
    deep = [p for p, v in z.items() if v < 8]
    for wrap in (True, False):
        across = lambda d, wrap=wrap: min(abs(d), w - abs(d)) if wrap else abs(d)
        expected = {(r, c): min((r - a) ** 2 + across(c - b) ** 2 for a, b in deep) for r, c in z}
        got = {(r.r, r.c): r.d2 for r in raster.squared_distance(grid, grid["z"] < 8, w, wrap).collect()}
        assert got == expected
    assert {r.d2 for r in raster.squared_distance(grid, grid["z"] < 0, w).collect()} == {None}


def test_envelope_matches_all_pairs():
    random.seed(12)
    for _ in range(200):
        n = random.randrange(1, 30)
        g = np.array([random.choice([-1, 0, 1, 4, 9, 25, 400]) for _ in range(n)], np.int64)
        for wrap in (True, False):
            across = lambda d, n=n, wrap=wrap: min(abs(d), n - abs(d)) if wrap else abs(d)
            expected = [min((int(g[k]) + across(k - i) ** 2 for k in range(n) if g[k] >= 0), default=-1) for i in range(n)]
            assert raster.envelope(g, wrap).tolist() == expected
