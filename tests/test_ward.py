import numpy as np
import pytest

from treeloom.operators import clusters as C
from treeloom.operators import ward as W


def _frame(spark, groups):
    rows = [(g, i, r.tolist()) for g, x in groups.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "g long, id long, vec array<double>")


def _groups(dim=3):
    rng = np.random.default_rng(17)
    near = np.concatenate([rng.normal(size=(90, dim)) + 9 * rng.normal(size=dim) for _ in range(5)])
    return {1: near, 2: rng.normal(size=(500, dim)), 3: np.repeat(rng.integers(0, 4, (40, dim)).astype(float), 3, axis=0), 4: rng.normal(size=(7, dim)), 5: rng.normal(size=(2, dim)), 6: np.ones((5, dim)), 7: np.ones((1, dim))}


def _parts(labels):
    out = {}
    for i, c in enumerate(labels):
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("tail", [60, W.TAIL])
def test_cuts_are_those_of_merges_one_by_one(spark, monkeypatch, tail):
    monkeypatch.setattr(W, "BLOCK", 32)
    groups = _groups()
    got = {}
    for r in W.cuts(_frame(spark, groups), 6, tail=tail).collect():
        got.setdefault(r.g, {})[r.id] = r.labels
    assert {g: len(v) for g, v in got.items()} == {g: len(x) for g, x in groups.items()}
    for g in (1, 2, 4):  # without equal costs
        want = C.ward_cuts(groups[g], min(6, len(groups[g])))
        for k in range(2, min(6, len(groups[g])) + 1):
            assert _parts([got[g][i][k - 2] for i in range(len(groups[g]))]) == _parts(want[k]), (g, k)
    assert all(len(v) == 5 and len({x[4] for x in got[3].values()}) == 6 for v in got[3].values())
    assert got[5] == {0: [0], 1: [1]} and got[7] == {0: []} and list(got[6].values()) == [[]] * 5


def test_cuts_of_rows():
    for x in (_groups()[2][:200], _groups(1)[4], np.array([[0.0], [1.0], [10.0], [12.0], [40.0]])):
        want, got = C.ward_cuts(x, 9), W.rows_cuts(x, 9)
        assert set(want) == set(got) and all((want[k] == got[k]).all() for k in want)


def test_heights(spark):
    x = _groups()[2]
    tree = W.tree_of(_frame(spark, {0: x}), tail=120).collect()
    assert len(tree) == len(x) - 1 and len({r.hi for r in tree}) == len(x) - 1
    # what all merges add is the squared error of the whole
    assert abs(sum(r.height for r in tree) - ((x - x.mean(0)) ** 2).sum()) < 1e-6
    assert sorted(r.height for r in tree) == pytest.approx(sorted(m[2] for m in W.merges(np.arange(len(x)), np.ones(len(x)), x)))


def test_best(spark):
    groups = _groups()
    groups[8] = np.zeros((0, 3))
    frame = _frame(spark, groups).union(spark.createDataFrame([(None, 1, [1.0] * 3), (1, None, [1.0] * 3), (1, 999, None)], "g long, id long, vec array<double>"))
    rows = W.best(frame, 8, tail=100).collect()
    assert len(rows) == sum(map(len, groups.values()))
    one = [r for r in sorted(rows, key=lambda r: r.id) if r.g == 1]
    assert _parts([r.cluster for r in one]) == [list(range(90 * c, 90 * c + 90)) for c in range(5)] and one[0].silhouette > 0.8
    assert {(r.cluster, r.silhouette) for r in rows if r.g == 7} == {(0, 0.0)}
    assert W.best(frame.where("false")).count() == 0


def test_merges_inside_cells_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL", 60)
    rng = np.random.default_rng(5)
    groups = {1: np.concatenate([rng.normal(size=(120, 4)) * 0.2 + 5 * rng.normal(size=4) for _ in range(5)]), 2: rng.normal(size=(300, 4))}
    seen = []
    inside = W._inside_cells
    monkeypatch.setattr(W, "_inside_cells", lambda *a: seen.append(inside(*a)) or seen[-1])
    got = {}
    for r in W.tree_of(_frame(spark, groups), tail=80).collect():
        got.setdefault(r.g, {})[r.lo, r.hi] = r.height
    assert sum(n for _, _, n, _ in seen) > 300  # most merges need no round over all
    for g, x in groups.items():
        want = {(lo, hi): h for lo, hi, h, _ in W.merges(np.arange(len(x)), np.ones(len(x)), x)}
        assert set(got[g]) == set(want) and all(abs(got[g][k] - want[k]) < 1e-9 * (1 + want[k]) for k in want)


def test_nearest_of_many_is_exact():
    rng = np.random.default_rng(9)
    # far from zero, near copies and equal gaps, sizes that differ much
    x = np.concatenate([rng.normal(size=(900, 5)), rng.integers(0, 4, (700, 5)).astype(float)]) * 0.01
    x = np.unique(np.concatenate([x, x[:600] + 1e-9 * rng.normal(size=(600, 5))]), axis=0) + 37.0
    x, size, ids = x[W._side_by_side(x)], rng.integers(1, 900, len(x)).astype(float), rng.permutation(len(x)) * 3
    for part in (np.arange(len(x)), np.flatnonzero(rng.random(len(x)) < 0.2)):
        got = W._nearest_of_many(ids[part], size[part], x[part], ids, size, x, None)
        for k, i in enumerate(part.tolist()):
            cost = W._exact(x[[i] * len(x)], size[[i] * len(x)], x, size)
            cost[i] = np.inf
            want = min((c, min(ids[i], ids[j]), max(ids[i], ids[j])) for j, c in enumerate(cost.tolist()))
            assert (got[0][k], got[1][k], got[2][k]) == want
    near = W._nearest_of_many(ids, size, x, ids, size, x, None)[0]
    assert np.isinf(W._nearest_of_many(ids, size, x, ids, size, x, near * 0.99)[0][near > 0]).all()


def test_bounds_of_blocks_are_under_all_costs():
    rng = np.random.default_rng(12)
    x, size = rng.normal(size=(700, 6)), rng.integers(1, 50, 700).astype(float)
    one, two = (W._Block(0, c, 0, c, size[s], x[s].astype(np.float32)) for c, s in enumerate((slice(0, 300), slice(300, 700))))
    W._bounds_between(one, two)
    costs = W._costs(x[:300], size[:300], x[300:], size[300:])
    for bound, least in ((one.bound, costs.min(1)), (two.bound, costs.min(0))):
        assert (bound <= least).all() and (bound > least * 0.999 - 1e-3).all()


def test_merges_inside_a_cell_are_a_part_of_all_merges():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 2))
    every = {(lo, hi): h for lo, hi, h, _ in W.merges(np.arange(400), np.ones(400), x)}
    inside = np.flatnonzero(x[:, 0] < 0)
    outside = np.flatnonzero(x[:, 0] >= 0)
    bound = W._costs(x[inside], np.ones(len(inside)), x[outside], np.ones(len(outside))).min(1)
    (lo, hi, height, _), (ids, size, _) = W.merges_inside(inside, np.ones(len(inside)), x[inside], bound)
    assert all(abs(every[a, b] - h) < 1e-9 for a, b, h in zip(lo.tolist(), hi.tolist(), height.tolist()))
    assert len(ids) == len(inside) - len(lo) and size.sum() == len(inside) and len(lo) > 120


def test_rounds_over_parts(spark, monkeypatch):
    for name, value in (("LEAST", 40), ("BLOCK", 16), ("PARTS", 3), ("CELL", 10_000)):
        monkeypatch.setattr(W, name, value)
    # nothing merges inside cells
    monkeypatch.setattr(W, "_inside_cells", lambda large, sizes, step, seed, ws: (_gone(large, ws), None, 0, step))
    groups = _groups()
    got = {}
    for r in W.tree_of(_frame(spark, {g: groups[g] for g in (1, 2, 3)}), tail=200).collect():
        got.setdefault(r.g, {})[r.lo, r.hi] = r.height
    for g in (1, 2):
        want = {(lo, hi): h for lo, hi, h, _ in W.merges(np.arange(len(groups[g])), np.ones(len(groups[g])), groups[g])}
        assert set(got[g]) == set(want) and all(abs(got[g][k] - want[k]) < 1e-9 * (1 + want[k]) for k in want)
    assert len(got[3]) == len(groups[3]) - 1


def _gone(large, ws):
    return ws.save(large.limit(0), "nothing")


def test_used_tables_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "CELL", 60)
    monkeypatch.setattr("treeloom.sources.scratch.shared_folder", lambda spark: str(tmp_path))
    W.tree_of(_frame(spark, {2: _groups()[2]}), tail=80).collect()
    left = {p.name.split("-")[1] for p in tmp_path.glob("ward-*/*")}
    assert "tree" in left and not left & {"vectors", "cells", "active", "large", "nearest", "heads"}
