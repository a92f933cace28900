"""Fronts, receivers across flats, and several ways down, beside plain sweeps."""

import heapq
import random
from collections import deque

from quillgrid.operators import drainage

STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def plain_front(zone, starts):
    d, queue = dict(starts), deque(sorted(starts, key=starts.get))
    while queue:
        r, c = queue.popleft()
        for a, b in STEPS:
            p = (r + a, c + b)
            if p in zone and zone[p] == zone[r, c] and d.get(p, 1 << 60) > d[r, c] + 1:
                d[p] = d[r, c] + 1
                queue.append(p)
    return d


def test_receivers_cross_flats_whatever_the_tiles(spark):
    random.seed(21)
    h, w = 19, 23
    z = {(r, c): random.choice([5, 5, 5, 6, 7]) for r in range(h) for c in range(w) if random.random() < 0.95}
    out = {p for p in z if random.random() < 0.02} | {min(z)}
    # only surfaces without pits: lift what no way leads out of
    level = {p: 0 for p in out}
    ahead = deque(out)
    while ahead:
        p = ahead.popleft()
        for a, b in STEPS:
            q = (p[0] + a, p[1] + b)
            if q in z and level.get(q, 99) > max(level[p], z[q]):
                level[q] = max(level[p], z[q])
                ahead.append(q)
    rows = [(r * w + c, r, c, 0 if (r, c) in out else level.get((r, c), z[r, c]), (r, c) in out) for r, c in z]
    name = {(x[1], x[2]): x for x in rows}
    near = lambda p: [(k, name[p[0] + a, p[1] + b]) for k, (a, b) in enumerate(STEPS) if (p[0] + a, p[1] + b) in name]
    steep = {}
    for p, x in name.items():
        fall = [((x[3] - y[3]) ** 2 * (2 if k % 2 == 0 else 1), -k, y[0]) for k, y in near(p) if y[3] < x[3]]
        steep[p] = None if x[4] or not fall else max(fall)[2]
    flat = {p: name[p][3] for p in name if steep[p] is None and not name[p][4]}
    towards = plain_front(flat, {p: 1 for p in flat if any(y[3] == flat[p] and (y[1], y[2]) not in flat for _, y in near(p))})
    away = plain_front(flat, {p: 1 for p in flat if any(y[3] > flat[p] for _, y in near(p))})
    mask = {p: 2 * towards[p] - away.get(p, 0) for p in towards}
    expected = {}
    for p, x in name.items():
        expected[x[0]] = steep[p]
        if p in mask:
            ways = [((0, 0, k % 2, k), y[0]) if (y[1], y[2]) not in flat else ((1, mask[y[1], y[2]], k % 2, k), y[0]) for k, y in near(p) if y[3] == x[3] and ((y[1], y[2]) not in flat or mask[y[1], y[2]] < mask[p])]
            expected[x[0]] = min(ways)[1]
    surface = spark.createDataFrame(rows, "cell long, r long, c long, z long, outlet boolean")
    got = {x.cell: x.receiver for x in drainage.receivers(surface, 5).collect()}
    assert got == expected
    for cell in got:
        seen = set()
        while got[cell] is not None:
            assert cell not in seen
            seen.add(cell)
            cell = got[cell]
    reached = {x[0] for p, x in name.items() if p in level}
    ends = {x[0] for x in rows if x[4]}
    assert all(got[c] is not None or c in ends for c in reached)


def test_shared_flow_matches_one_sweep(spark):
    random.seed(22)
    h, w = 17, 22
    z = {(r, c): random.randrange(40) + 3 * r for r in range(h) for c in range(w) if random.random() < 0.93}
    value = {p: random.randrange(6) for p in z}
    flow = {p: float(v) for p, v in value.items()}
    for p in sorted(z, key=lambda p: -z[p]):
        falls = [((p[0] + a, p[1] + b), (a * a + b * b) ** 0.5) for a, b in STEPS if z.get((p[0] + a, p[1] + b), z[p]) < z[p]]
        slopes = [((z[p] - z[q]) / d) ** 1.1 for q, d in falls]
        for (q, _), s in zip(falls, slopes, strict=True):
            flow[q] += flow[p] * s / sum(slopes)
    grid = spark.createDataFrame([(r, c, v, value[r, c]) for (r, c), v in z.items()], "r long, c long, z long, value long")
    for tile in (4, 64):
        got = {(x.r, x.c): x.flow for x in drainage.multiple_flow(grid, 1.1, tile).collect()}
        assert set(got) == set(z) and all(abs(got[p] - v) < 1e-9 for p, v in flow.items())
    assert drainage.multiple_flow(grid.limit(0)).count() == 0


def test_cheapest_ways_equal_dijkstra(spark):
    random.seed(23)
    h, w = 15, 18
    cost = {(r, c): random.choice([1, 1, 2, 9]) for r in range(h) for c in range(w) if random.random() < 0.8}
    starts = set(random.sample(sorted(cost), 3))
    far, heap = {}, [(0, p) for p in starts]
    while heap:
        d, p = heapq.heappop(heap)
        if p in far:
            continue
        far[p] = d
        for a, b in STEPS:
            q = (p[0] + a, p[1] + b)
            if q in cost:
                heapq.heappush(heap, (d + (cost[p] + cost[q]) * (7 if a and b else 5), q))
    cells = spark.createDataFrame([(r * w + c, r, c, v, (r, c) in starts) for (r, c), v in cost.items()], "cell long, r long, c long, cost long, start boolean")
    got = {x.cell: x for x in drainage.cheapest(cells, 4).collect()}
    assert {k: x.distance for k, x in got.items()} == {r * w + c: far.get((r, c)) for r, c in cost}
    for (r, c) in far:
        x = got[r * w + c]
        if (r, c) in starts:
            assert x.previous is None
            continue
        p = divmod(x.previous, w)
        assert max(abs(p[0] - r), abs(p[1] - c)) == 1
        assert far[p] + (cost[p] + cost[r, c]) * (7 if p[0] != r and p[1] != c else 5) == x.distance
