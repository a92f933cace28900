"""Depression trees, the fill-spill cascade and lakes beside plain sequential forms."""

import random

import pytest
from quillgrid.operators import contraction, depressions, graph

STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def grid_of(kind, h, w, seed, below=0, first=0):
    random.seed(seed)
    rows = []
    for r in range(h):
        for c in range(w):
            z = {"rough": random.randrange(60), "flat": random.randrange(4), "bowl": 3 * (abs(r - h // 2) + abs(c - w // 2)) + random.randrange(3), "steps": (r * 7 + c * 3) % 11}[kind]
            out = kind != "bowl" and random.random() < 0.03
            rows.append((first + r * w + c, below + r, c, -5 if out else z, out, random.randrange(5), random.choice([0, 0, 2, 9, 30]), 1 + random.randrange(3)))
    return rows


def grids():
    """Several kinds of land, apart from each other, in one table."""
    out = []
    for k, (kind, h, w) in enumerate([("rough", 14, 17), ("rough", 22, 12), ("flat", 12, 12), ("bowl", 13, 13), ("steps", 9, 15)]):
        out += grid_of(kind, h, w, k + 1, 40 * k, 1000 * k)
    return out


SCHEMA = "cell long, r long, c long, z long, outlet boolean, runoff long, loss long, area long"


def plain(rows):
    """Sweeps cells by height and index: leaves, merges with their children, and what each leaf is beside."""
    at = {(x[1], x[2]): x for x in rows}
    cell = {x[0]: x for x in rows}
    near = lambda x: [(k, at[x[1] + a, x[2] + b]) for k, (a, b) in enumerate(STEPS) if (x[1] + a, x[2] + b) in at]
    label, top, up, node = {}, {}, {}, {}
    info = {}
    find = lambda n: n if n == -1 or n not in up else find(up[n])
    order = sorted((x for x in rows if not x[4]), key=lambda x: (x[3], x[0]))
    swept = {x[0] for x in rows if x[4]}
    for x in swept:
        label[x] = -1
    for x in order:
        fall = [((x[3] - y[3]) ** 2 * (2 if k % 2 == 0 else 1), -k, y[0]) for k, y in near(x) if y[3] < x[3]]
        sea = [y[0] for k, y in near(x) if y[4]]
        if fall or sea:
            label[x[0]] = label[max(fall)[2]] if fall else -1
        else:
            label[x[0]] = x[0]
            info[x[0]] = {"base": x[3], "kids": (), "parent": None, "spill": None, "pass": None, "inside": None, "beyond": None}
        swept.add(x[0])
        for k, y in near(x):
            if y[0] not in swept or y[0] == x[0]:
                continue
            a, b = find(label[x[0]]), find(label[y[0]])
            if a == b:
                continue
            sides = {a: (label[x[0]], label[y[0]]), b: (label[y[0]], label[x[0]])}
            mine = [n for n in (a, b) if n != -1]
            joint = None if -1 in (a, b) else -(8 * x[0] + k) - 2
            if joint:
                info[joint] = {"base": x[3], "kids": (a, b), "parent": None, "spill": None, "pass": None, "inside": None, "beyond": None}
            for n in mine:
                info[n] |= {"spill": x[3], "pass": x[0], "inside": sides[n][0], "beyond": sides[n][1], "parent": joint}
                up[n] = joint if joint else -1
    return cell, label, info


def climb(info, n):
    while n is not None:
        yield n
        n = info[n]["parent"]


def parcels(cell, label, info):
    """Budgets by walking up, and the cascade a unit of water at a time."""
    runoff, loss = dict.fromkeys(info, 0), dict.fromkeys(info, 0)
    area, za, node_of = dict.fromkeys(info, 0), dict.fromkeys(info, 0), {}
    for i, x in cell.items():
        n = label[i]
        node_of[i] = None
        if n == -1:
            continue
        for m in climb(info, n):
            runoff[m] += x[5]
        node_of[i] = next((m for m in climb(info, n) if info[m]["spill"] is None or info[m]["spill"] > x[3]), None)
        for m in climb(info, node_of[i]) if node_of[i] is not None else ():
            loss[m] += x[6]
            area[m] += x[7]
            za[m] += x[3] * x[7]
    room = {n: (float("inf") if v["spill"] is None else loss[n] - sum(loss[k] for k in v["kids"])) for n, v in info.items()}
    held = dict.fromkeys(info, 0)
    full = lambda n: held[n] >= room[n] and all(full(k) for k in info[n]["kids"])
    other = {k: info[n]["kids"][1 - i] for n in info for i, k in enumerate(info[n]["kids"])}
    to_sea = 0
    for i, x in cell.items():
        if label[i] == -1:
            continue
        for _ in range(x[5]):
            n = label[i]
            while n != -1:
                while full(n) and n in other and full(other[n]):
                    n = info[n]["parent"]
                if not full(n):
                    held[n] += 1
                    break
                n = info[n]["beyond"]
            to_sea += n == -1
    inside = {n: 0 for n in info}
    for n in info:
        for m in climb(info, n):
            inside[m] += held[n]
    return runoff, loss, area, za, node_of, {n: full(n) for n in info}, inside, to_sea, other


def test_cascade_matches_parcels(spark):
    rows = grids()
    cell, label, info = plain(rows)
    at = depressions.written(depressions.pits(spark.createDataFrame(rows, SCHEMA)))
    assert {r.cell: r.leaf for r in at.collect()} == label
    nodes = depressions.tree(at)
    assert {r.node: (r.parent, r.spill, r.pass_cell, r.inside, r.beyond, r.base) for r in nodes.collect()} == {n: (v["parent"], v["spill"], v["pass"], v["inside"], v["beyond"], v["base"]) for n, v in info.items()}
    runoff, loss, area, za, node_of, full, inside, to_sea, other = parcels(cell, label, info)
    cells = depressions.attached(at, nodes)
    assert {r.cell: r.node for r in cells.collect()} == node_of
    sums = depressions.budget(at, nodes, cells)
    spill = {n: v["spill"] for n, v in info.items()}
    assert {r.node: (r.runoff, r.loss, r.area, r.volume) for r in sums.collect()} == {n: (runoff[n], None if spill[n] is None else loss[n], area[n], None if spill[n] is None else spill[n] * area[n] - za[n]) for n in info}
    flow = depressions.cascade(nodes, sums)
    got = {r.node: r for r in flow.collect()}
    assert {n: r.full for n, r in got.items()} == full
    lakes = {n for n, v in info.items() if all(full[k] for k in v["kids"]) and not (full[n] and n in other and full[other[n]])}
    found, covered = depressions.lakes(at, nodes, cells, flow)
    found = {r.lake: r for r in found.collect()}
    assert set(found) == lakes
    for n in lakes:
        # a lake keeps what it loses and passes on the rest
        assert found[n].water - found[n].passed == inside[n] and (found[n].passed == 0 or full[n])
    assert sum(found[n].passed for n in lakes if info[n]["parent"] is None and info[n]["beyond"] == -1) <= to_sea
    assert sum(inside[n] for n in lakes) + to_sea == sum(x[5] for x in rows if label[x[0]] != -1)
    wet = {}
    for r in covered.collect():
        wet.setdefault(r.lake, set()).add(r.cell)
    for n in lakes:
        own = sorted((cell[i][3], i) for i in cell if node_of[i] == n)
        below = {i for i in cell if node_of[i] not in (None, n) and n in climb(info, node_of[i])}
        if full[n]:
            cover, level2 = below | {i for _, i in own}, 2 * spill[n]
        else:
            lost, k = sum(loss[m] for m in info[n]["kids"]), 0
            while k < len(own) and lost + cell[own[k][1]][6] <= inside[n]:
                lost += cell[own[k][1]][6]
                k += 1
            cover = below | {i for _, i in own[:k]}
            low = max(info[n]["base"], own[k - 1][0] if k else info[n]["base"])
            level2 = low + own[k][0] if k < len(own) else 2 * spill[n] if spill[n] is not None else 2 * low + 2
        assert wet.get(n, set()) == cover and found[n].level2 == level2 and found[n].cells == len(cover), n


def test_water_that_is_enough_for_a_depression_still_has_to_fill_what_lies_in_it(spark):
    """P holds A and B, B holds C and D, D holds E and F; all water falls on A and runs E, F, D, C."""
    parent = {"P": None, "A": "P", "B": "P", "C": "B", "D": "B", "E": "D", "F": "D"}
    beyond = {"P": None, "A": "E", "B": "A", "C": "E", "D": "C", "E": "F", "F": "E"}
    loss = {"P": 11, "A": 0, "B": 11, "C": 5, "D": 6, "E": 3, "F": 3}
    number = {n: k + 1 for k, n in enumerate(parent)}
    nodes = spark.createDataFrame([(number[n], number.get(p), number.get(beyond[n], depressions.OUTLET), 9) for n, p in parent.items()], "node long, parent long, beyond long, spill long")
    sums = spark.createDataFrame([(number[n], 20 if n in "PA" else 0, loss[n]) for n in parent], "node long, runoff long, loss long")
    got = {r.node: r for r in depressions.cascade(nodes, sums).collect()}
    assert all(r.full for r in got.values())
    assert {n: got[number[n]].passed for n in parent} == {n: 9 if n == "P" else 0 for n in parent}


def test_empty_grid(spark):
    at = depressions.pits(spark.createDataFrame([], SCHEMA))
    nodes = depressions.tree(at)
    assert nodes.count() == 0 and depressions.attached(at, nodes).count() == 0


def test_settle_matches_a_plain_walk(spark):
    """A random tree, a chain and a comb as one forest."""
    random.seed(6)
    n = 240
    to = lambda k: None if k in (0, 80, 160) else random.randrange(k) if k < 80 else k - 1 if k < 160 else k - 2 if k % 2 == 0 else k - 1
    rows = [(k, to(k), random.randrange(-20, 20), random.randrange(-3, 40)) for k in range(n)]
    into, best = {k: [0, 0] for k in range(n)}, {k: [] for k in range(n)}
    order, out = {}, {}
    for k, p, a, b in reversed(rows):
        out[k] = [max(0, into[k][0] + a), max(0, into[k][1] + b)]
        top = max(best[k], default=1)
        order[k] = top + (best[k].count(top) > 1)
        if p is not None:
            into[p] = [x + y for x, y in zip(into[p], out[k], strict=True)]
            best[p].append(order[k])
    got = contraction.settle(spark.createDataFrame(rows, "cell long, receiver long, a long, b long"), ["a", "b"]).collect()
    assert {r.cell: (r.order, r.a_in, r.b_in, r.a_out, r.b_out) for r in got} == {k: (order[k], *into[k], *out[k]) for k in range(n)}


def test_settle_refuses_a_cycle(spark):
    with pytest.raises(RuntimeError):
        contraction.settle(spark.createDataFrame([(1, 2), (2, 1)], "cell long, receiver long")).count()
    assert contraction.settle(spark.createDataFrame([], "cell long, receiver long")).count() == 0


def test_accumulate_all_sums_each_value(spark):
    rows = [(k, (k - 1) // 2 if k else None, 1, k) for k in range(50)]
    got = {r.cell: (r.a, r.b) for r in graph.accumulate_all(spark.createDataFrame(rows, "cell long, receiver long, a long, b long"), ["a", "b"]).collect()}
    kids = lambda k: [k] + [x for j in (2 * k + 1, 2 * k + 2) if j < 50 for x in kids(j)]
    assert got == {k: (len(kids(k)), sum(kids(k))) for k in range(50)}
