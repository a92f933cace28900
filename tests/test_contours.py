"""Contour rings beside a walker, and what their areas add up to."""

import random

from quillgrid.operators import contours


def test_rings_close_and_match_a_walker(spark):
    random.seed(31)
    h, w = 11, 14
    z = {(r, c): random.randrange(0, 40) for r in range(h) for c in range(w) if random.random() < 0.95}
    grid = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z long")
    at = {tuple(x.edge): x for x in contours.steps(grid, 19.5).collect()}
    crossed = set()
    for r in range(-1, h + 1):
        for c in range(-1, w + 1):
            for down in (False, True):
                a, b = z.get((r, c), 0), z.get((r + down, c + (not down)), 0)
                if (a > 19.5) != (b > 19.5):
                    crossed.add((r, c, down))
    assert set(at) == crossed and {tuple(x.next) for x in at.values()} == crossed
    left, expected = set(at), {}
    while left:
        e = first = min(left)
        ring = []
        while True:
            ring.append(e)
            left.discard(e)
            e = tuple(at[e].next)
            if e == first:
                break
        expected[first] = ring
    points = contours.rings(grid, 19.5)
    got = {}
    for x in sorted(points.collect(), key=lambda x: x.place):
        got.setdefault(tuple(x.ring), []).append(tuple(x.edge))
    assert got == expected
    area = {tuple(x.ring): x.area for x in contours.areas(points).collect()}
    for k, ring in expected.items():
        p = [(at[e].x, at[e].y) for e in ring]
        plain = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
        assert abs(area[k] - plain) < 1e-9
    assert contours.rings(grid, 100.0).count() == 0


def test_a_hill_with_a_hole_has_two_rings(spark):
    rows = [(r, c, 10 if 1 <= r <= 5 and 1 <= c <= 5 and (r, c) != (3, 3) else 0) for r in range(7) for c in range(7)]
    got = sorted(x.area for x in contours.areas(contours.rings(spark.createDataFrame(rows, "r long, c long, z long"), 5.0)).collect())
    assert len(got) == 2 and got[0] < 0 < got[1]
    assert abs(got[1] - 24.5) < 1e-9 and abs(got[0] + 0.5) < 1e-9


def test_rings_run_through_tiles(spark):
    """A winding ring, rings within a tile, holes, gaps, heights that are null and places below 0: small tiles give
    what one walks along the steps, and one tile gives the same."""
    random.seed(5)
    z = {(r, c): 9.0 if r % 2 == 0 or c == (19 if r % 4 == 1 else 0) else 0.0 for r in range(20) for c in range(20)}
    z |= {(r, c): random.choice([0.0, 1.5, 7.0, 9.25, None]) for r in range(22, 40) for c in range(20) if random.random() < 0.9}
    z |= {(r, 30): 9.0 for r in range(23)}
    grid = spark.createDataFrame([(r - 13, c - 6, v) for (r, c), v in z.items()], "r long, c long, z double")
    at = {tuple(x.edge): x for x in contours.steps(grid, 4.0).collect()}
    left, expected = set(at), {}
    while left:
        e = first = min(left)
        k = 0
        while e != first or k == 0:
            expected[e] = (first, k, tuple(at[e].next), at[e].x, at[e].y)
            left.discard(e)
            e, k = tuple(at[e].next), k + 1
    assert max(x[1] for x in expected.values()) > 400
    for tile in (1, 5, 256):
        points = contours.rings(grid, 4.0, tile=tile)
        rows = points.collect()
        assert len(rows) == len(expected)
        assert {tuple(x.edge): (tuple(x.ring), x.place, tuple(x.next), x.x, x.y) for x in rows} == expected
        for x in contours.areas(points).collect():
            p = [(at[e].x, at[e].y) for e, v in expected.items() if v[0] == tuple(x.ring)]
            assert len(p) == x.points and abs(x.area - sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2) < 1e-9
