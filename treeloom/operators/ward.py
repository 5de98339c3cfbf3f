"""Ward's hierarchical clustering of groups of any size.

The merge that adds least to the squared error comes first. Ward's measure is reducible: two clusters
that are nearest to each other stay so until they merge, whatever merges elsewhere. So all such pairs merge in
one round, all groups at once, and the tree is the same as if they merged one by one. A cluster's nearest one stays so too until
that one merges, so a round asks again only for new clusters and for those that lost theirs. Parts of a group meet
two in a task, so a round shuffles each cluster once for each part. Groups with few clusters left end in one task each, all at the end.

Before that, planes part a group into cells. A bound for each cluster, under the cost of a merge with anything in other cells, comes from products
in single precision, less what they may be off by, each pair of cells once. Merges outside don't lower it (reducible again), and that of a merged cluster
follows from those of its halves, so pairs inside a cell merge step after step while they are under their
bounds, in one round for all cells. Planes lie elsewhere each time. Rounds as above follow only where that merges little.

Equal vectors are one cluster from the start. The cuts of a tree take its costliest merges away; what is left is
followed to its roots by doubling steps. Cuts are scored in one pass by the silhouette of squared distances, which sums of clusters give.

Cases: rows without group, id or usable vector are left out; a group's vectors are of one length; ids of a group are unique;
equal costs: pairs of smaller ids first; a group of one row has one cluster and the score 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.vector import usable
from treeloom.sources.scratch import Scratch, together

#: Clusters of a cell, about; rows that planes are laid by, at most; cells of a large group.
CELL, PLANED, LARGER = 16_000, 32_768, 16
#: Parts of a group's cells, two of which meet in a task; clusters of a part at least and at most.
PARTS, LEAST, MEETING = 8, 24_000, 200_000
#: Share of clusters that must merge inside cells for that to be tried again at once, and rounds to the next trial else.
WORTH, PAUSE = 0.05, 4
#: Clusters of a group that end in one task; members of a block.
TAIL, BLOCK = 48_000, 1024
#: Pairs that are compared in double precision at once, and clusters of a block inside a task.
FEW, SIDE = 1 << 16, 1024
#: Rows that are scored beside one copy of their group's model.
SCORED = 20_000


def _costs(x: np.ndarray, size: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What merging each of x with each of y adds to the squared error."""
    gap = (-2 * x) @ y.T
    gap += (x * x).sum(1)[:, None]
    gap += (y * y).sum(1)[None]
    np.maximum(gap, 0, out=gap)
    gap /= (1 / size)[:, None] + (1 / sizes)[None]
    return gap


class _Short:
    """Products of one set of rows with another in single precision, which give gaps that are never over the true ones."""

    def __init__(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, sizes: np.ndarray):
        mid = y.mean(0)
        self.a, self.b = x - mid, y - mid
        # lengths of about one, as squares of large numbers don't fit
        self.unit = max(float(np.abs(self.a).max()), float(np.abs(self.b).max())) or 1.0
        self.a, self.b = self.a / self.unit, self.b / self.unit
        # what products of these lengths, and dividing them by sizes, may be off by
        self.less = 1 - (x.shape[1] + 8) * 2.0**-22
        one = np.ones((len(x), 1))
        self.left = np.concatenate([-2 * self.a, self.less * (self.a * self.a).sum(1)[:, None], one], 1).astype(np.float32)
        self.right = np.concatenate([self.b, np.ones((len(y), 1)), self.less * (self.b * self.b).sum(1)[:, None]], 1).T.astype(np.float32, order="C")
        self.inverse, self.inverses = (1 / size).astype(np.float32), (1 / sizes).astype(np.float32)

    def under(self, rows, columns: slice) -> np.ndarray:
        """Costs of merges, by ``unit`` squared, that the true ones reach at least."""
        out = self.left[rows] @ self.right[:, columns]
        out /= self.inverse[rows][:, None] + self.inverses[columns][None]
        return out


def _exact(x, size, y, sizes) -> np.ndarray:
    """Costs of merges of rows side by side, the same from both sides."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap) * (size * sizes) / (size + sizes)


def _nearest(ids, size, x, ids_b, sizes, y, known=None):
    """(cost, lo, hi) of each of x with its nearest of y (itself left out), if that is no farther than ``known``.

    Products find the candidates, differences give their costs, which are then the same from both sides.
    """
    if len(x) * len(y) > FEW:
        return _nearest_of_many(ids, size, x, ids_b, sizes, y, known)
    d = _costs(x, size, y, sizes)
    _, own, same = np.intersect1d(ids, ids_b, assume_unique=True, return_indices=True)
    d[own, same] = np.inf
    low = d.min(1, initial=np.inf) if known is None else np.minimum(d.min(1, initial=np.inf), known)
    # what products of these lengths may be off by
    off = 1e-9 * low + 1e-12 * ((x * x).sum(1) + (y * y).sum(1).max(initial=0)) * size
    row, col = np.nonzero(d <= np.minimum(low + off, np.finfo(float).max)[:, None])
    cost = _exact(x[row], size[row], y[col], sizes[col])
    out = np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    _least(out, row, cost, np.minimum(ids[row], ids_b[col]), np.maximum(ids[row], ids_b[col]))
    return out


def _least(out: tuple, row, cost, lo, hi) -> None:
    """Takes the least (cost, lo, hi) of each row over into what is known."""
    order = np.lexsort((hi, lo, cost, row))
    order = order[np.flatnonzero(np.append(True, np.diff(row[order]) != 0))] if len(row) else order
    row, cost, lo, hi = row[order], cost[order], lo[order], hi[order]
    low, first, second = (c[row] for c in out)
    better = (cost < low) | ((cost == low) & ((lo < first) | ((lo == first) & (hi < second))))
    for target, source in zip(out, (cost, lo, hi)):
        target[row[better]] = source[better]


_LARGE = float(np.finfo(np.float32).max)


def _above(x: np.ndarray) -> np.ndarray:
    """Numbers of single precision that aren't under those of double precision."""
    return np.nextafter(np.minimum(x, _LARGE).astype(np.float32), np.float32(_LARGE))


def _nearest_of_many(ids, size, x, ids_b, sizes, y, known):
    """The same for many: blocks of y, the nearest ones first, as long as they can hold something nearer. Rows that lie together come one after another."""
    out = np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    best = np.full(len(x), np.inf) if known is None else known.astype(float)
    _, mine, same = np.intersect1d(ids, ids_b, assume_unique=True, return_indices=True)
    own = np.full(len(x), -1)
    own[mine] = same
    short = _Short(x, size, y, sizes)
    unit = short.unit**2
    starts = np.arange(0, len(y), SIDE)
    n = np.diff(np.append(starts, len(y)))
    mids = np.add.reduceat(short.b, starts) / n[:, None]
    radius = np.sqrt(np.maximum.reduceat(((short.b - np.repeat(mids, n, 0)) ** 2).sum(1), starts)) * (1 + 1e-9)
    low = np.minimum.reduceat(sizes, starts)
    for k in range(0, len(x), 256):
        rows = np.arange(k, min(k + 256, len(x)))
        a, s = short.a[rows], size[rows][:, None]
        gap = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (mids * mids).sum(1)[None] - 2 * (a @ mids.T), 0))
        apart = np.maximum(0, gap * (1 - 1e-7) - 1e-7 - radius[None])
        apart = apart * apart * (s * low[None]) / (s + low[None])
        for j in np.argsort(gap.sum(0)).tolist():
            need = rows[apart[:, j] <= best[rows] / unit]
            if not len(need):
                continue
            columns = slice(int(starts[j]), int(starts[j] + n[j]))
            d = short.under(need, columns)
            inside = np.flatnonzero((own[need] >= columns.start) & (own[need] < columns.stop))
            d[inside, own[need[inside]] - columns.start] = np.inf
            first = d.argmin(1)
            may = np.flatnonzero(d[np.arange(len(d)), first] <= np.minimum(best[need] / unit, _LARGE))
            if not len(may):
                continue
            r, c = need[may], first[may] + columns.start
            best[r] = np.minimum(best[r], _exact(x[r], size[r], y[c], sizes[c]))
            if 4 * len(may) < len(need):
                d, need = d[may], r
            row, col = np.divmod(np.flatnonzero(d <= _above(best[need] / unit)[:, None]), d.shape[1])
            for at in range(0, len(row), 1 << 16):  # many that are nearly equal
                r, c = need[row[at : at + (1 << 16)]], col[at : at + (1 << 16)] + columns.start
                cost = _exact(x[r], size[r], y[c], sizes[c])
                _least(out, r, cost, np.minimum(ids[r], ids_b[c]), np.maximum(ids[r], ids_b[c]))
            best[need] = np.minimum(best[need], out[0][need])
    if known is not None:
        out[0][out[0] > known] = np.inf
    return out


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """An order of rows in which those that lie together come one after another: halves by the widest component."""
    open_, out = [np.arange(len(x))], []
    while open_:
        p = open_.pop()
        if len(p) <= SIDE:
            out.append(p)
            continue
        y = x[p]
        half = np.argpartition(y[:, int(y.var(0).argmax())], len(p) // 2)
        open_ += [p[half[len(p) // 2 :]], p[half[: len(p) // 2]]]
    return np.concatenate(out)


def _agglomerated(ids: np.ndarray, size: np.ndarray, x: np.ndarray, bound: np.ndarray | None, step: int) -> tuple[list[tuple], tuple]:
    """((lo, hi, height, step) arrays of merges, (ids, size, x) of what is left): reciprocal nearest pairs merge, round by round, while both are under their bounds."""
    out = []
    order = np.argsort(ids)
    ids, size, x = ids[order], size[order].astype(float), x[order].astype(float)
    whole = bound is None
    bound = np.full(len(ids), np.inf) if whole else bound[order] * (1 - 1e-9)
    # clusters go by their rank, in an order of place
    line = _side_by_side(x) if len(ids) else np.zeros(0, np.int64)
    cost, other, stale = np.zeros(len(ids)), np.arange(len(ids)), bound > 0
    cost[~stale] = np.inf
    while len(line) > 1:
        ask = line[stale[line]]
        for k in range(0, len(ask), 1 << 14):
            part = ask[k : k + (1 << 14)]
            low, lo, hi = _nearest(part, size[part], x[part], line, size[line], x[line])
            cost[part], other[part] = low, lo + hi - part
        stale[ask] = False
        a = line[cost[line] < bound[line]]
        b = other[a]
        a = a[(a < b) & (other[b] == a) & (cost[b] < bound[b])]
        if not len(a):
            if not whole:
                break
            stale[line] = True  # equal costs: choose anew by the smaller ids
            continue
        b, step = other[a], step + 1
        out.append((ids[a], ids[b], cost[a], np.full(len(a), step)))
        total = size[a] + size[b]
        x[a] = (x[a] * size[a][:, None] + x[b] * size[b][:, None]) / total[:, None]
        if not whole:
            # what a merge of both with anything outside, of size 1 at least, costs at least, by the costs of merges of each with it
            one = ((size[a] + 1) * bound[a] + (size[b] + 1) * bound[b] - cost[a]) / (total + 1)
            bound[a] = np.minimum(one, bound[a] + bound[b] - cost[a]) * (1 - 1e-12)
        size[a] = total
        gone, dead = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        gone[a] = gone[b] = dead[b] = True
        # who reached its bound may know somebody who is gone
        stale[line] = gone[line] | (gone[other[line]] & (cost[line] < bound[line]))
        line = line[~dead[line]]
    line = np.sort(line)
    return out, (ids[line], size[line], x[line])


def _columns(found: list[tuple]) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def merges(ids: np.ndarray, size: np.ndarray, x: np.ndarray, step: int = 0) -> list[tuple[int, int, float, int]]:
    """(lo, hi, height, step) of all merges of some clusters, round by round."""
    return list(zip(*(c.tolist() for c in _columns(_agglomerated(ids, size, x, None, step)[0]))))


def rows_cuts(x: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Labels of the cuts of some rows into 2 to ``most`` clusters, numbered in order of their first rows."""
    n = len(x)
    found = sorted(merges(np.arange(n), np.ones(n), np.asarray(x, float)), key=lambda m: (m[2], m[3], m[0], m[1]))
    head, out = np.arange(n), {}
    for groups, (lo, hi, _, _) in zip(range(n, 1, -1), found):
        if groups <= most:
            out[groups] = np.unique(head, return_inverse=True)[1]
        head[head == head[hi]] = head[lo]
    return out


# --- merges inside cells ------------------------------------------------------------------


def _planes(x: np.ndarray, cells: int, rng, first: int = 0) -> tuple | int:
    """Planes that part rows into at most ``cells`` cells as (direction, place, lower, upper), each through a wide direction of its rows; a cell is its number, from ``first``."""
    if cells < 2 or len(x) < 4:
        return first
    _, values, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    way = (rng.normal(size=len(values)) * values**2) @ axes
    share = rng.uniform(0.4, 0.6)
    along = x @ way
    at = float(np.quantile(along, share))
    low = along < at
    if low.all() or not low.any():
        return first
    few = min(max(1, round(cells * share)), cells - 1)
    return way, at, _planes(x[low], few, rng, first), _planes(x[~low], cells - few, rng, first + few)


def _celled(planes: dict[int, tuple | int]):
    def place(x, node, rows, cell):
        if not isinstance(node, tuple):
            cell[rows] = node
            return
        way, at, lower, upper = node
        under = x[rows] @ way < at
        place(x, lower, rows[under], cell)
        place(x, upper, rows[~under], cell)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, group, cell = _rows(batch), batch["g"].to_numpy(), np.zeros(batch.num_rows, np.int32)
                for g in np.unique(group).tolist():
                    place(x, planes[g], np.flatnonzero(group == g), cell)
                yield batch.append_column("cell", pa.array(cell))

    return run


_CELLS = "g long, cell int, at int, ids binary, sizes binary, data binary, short binary, part int, meets array<int>"


def _cell_blocks(frames: dict[int, tuple], parts: dict[int, tuple]):
    """Rows that come ordered by cell as blocks of what lies together.

    Beside the vectors stand short ones, in single precision from a group's middle and by its unit (``frames``). ``parts`` are
    (first cell, cells, parts, first task) of a group; a block meets all parts of its group, each pair of parts in one task.
    """

    def run(batches):
        for (g, cell), (ids, size, x) in _stretches(batches, ("g", "cell"), ("id", "size")):
            (middle, unit), (first, cells, n, task) = frames[g], parts[g]
            part = (cell - first) * n // cells
            meets = [task + max(part, p) * (max(part, p) + 1) // 2 + min(part, p) for p in range(n)]
            order = _side_by_side(x)
            for at in range(0, len(order), SIDE):
                o = order[at : at + SIDE]
                short = ((x[o] - middle) / unit).astype(np.float32)
                row = {"g": [g], "cell": pa.array([cell], pa.int32()), "at": pa.array([at], pa.int32()), "ids": [ids[o].tobytes()], "sizes": [size[o].tobytes()], "data": [x[o].tobytes()], "short": [short.tobytes()]}
                yield pa.RecordBatch.from_pydict(row | {"part": pa.array([part], pa.int32()), "meets": pa.array([meets], pa.list_(pa.int32()))})

    return run


class _Block:
    """A block's short vectors, ready for products, and its bounds so far."""

    def __init__(self, g, cell, at, part, size, x):
        self.g, self.cell, self.at, self.part, self.low = g, cell, at, part, size.min()
        y = x.astype(float)
        self.mid = y.mean(0)
        self.radius = float(np.sqrt(((y - self.mid) ** 2).sum(1).max()))
        square = (1 - (x.shape[1] + 8) * 2.0**-22) * (y * y).sum(1)[:, None]
        one = np.ones((len(x), 1))
        self.left = np.concatenate([-2 * y, square, one], 1).astype(np.float32)
        self.right = np.concatenate([y, one, square], 1).T.astype(np.float32, order="C")
        self.inverse = (1 / size).astype(np.float32)
        self.bound = np.full(len(x), np.inf, np.float32)


def _bounds_between(one: _Block, two: _Block) -> None:
    """Lowers the bounds of two blocks to what merges of one's clusters with the other's cost at least."""
    apart = max(0.0, float(np.sqrt(((one.mid - two.mid) ** 2).sum())) * (1 - 1e-6) - (one.radius + two.radius) * (1 + 1e-6))
    if apart * apart * (one.low * two.low) / (one.low + two.low) >= max(one.bound.max(), two.bound.max()):
        return
    for k in range(0, len(one.left), 256):
        cost = one.left[k : k + 256] @ two.right
        cost /= one.inverse[k : k + 256, None] + two.inverse[None]
        np.minimum(one.bound[k : k + 256], cost.min(1), out=one.bound[k : k + 256])
        np.minimum(two.bound, cost.min(0), out=two.bound)


def _stretches(batches, keys: tuple, columns: tuple):
    """(key, arrays of the columns and the vectors) of rows that come ordered by their keys."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy() for c in keys], 1)
        arrays = [*(batch[c].to_numpy() for c in columns), _rows(batch)]
        ends = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
        for at, end in zip([0, *ends], [*ends, len(key)]):
            if held and tuple(key[at].tolist()) != now:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = tuple(key[at].tolist())
            held.append([c[at:end] for c in arrays])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _outside(units: dict[int, float]):
    """(cell, at, bounds) of blocks that come by task: for their clusters the bounds by the other cells of the two parts that meet in it."""

    def out(blocks):
        diagonal = len({b.part for b in blocks}) == 1
        pairs = [(float(((one.mid - two.mid) ** 2).sum()), i, j) for i, one in enumerate(blocks) for j, two in enumerate(blocks[:i]) if (one.cell != two.cell if diagonal else one.part != two.part)]
        for _, i, j in sorted(pairs):
            _bounds_between(blocks[i], blocks[j])
        for b in blocks:
            bound = np.maximum(b.bound.astype(float) * units[b.g] ** 2, 0)
            yield pa.RecordBatch.from_pydict({"cell": pa.array([b.cell], pa.int32()), "at": pa.array([b.at], pa.int32()), "bounds": [bound.tobytes()]})

    def run(batches):
        now, blocks = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != now and blocks:
                    yield from out(blocks)
                    blocks = []
                now = r["task"]
                size = np.frombuffer(r["sizes"], np.float64)
                blocks.append(_Block(r["g"], r["cell"], r["at"], r["part"], size, np.frombuffer(r["short"], np.float32).reshape(len(size), -1)))
        if blocks:
            yield from out(blocks)

    return run


def merges_inside(ids: np.ndarray, size: np.ndarray, x: np.ndarray, bound: np.ndarray, step: int = 0):
    """((lo, hi, height, step) arrays of merges, (ids, size, x) of what is left) of a cell's clusters: all merges that nothing outside can change.

    No merge of a cluster with anything outside costs less than its ``bound``, so both sides of a merge must be under theirs. Nearest costs
    never fall: a cluster that reached its bound is not asked again.
    """
    found, left = _agglomerated(ids, size, x, bound, step)
    return _columns(found), left


_INSIDE = "g long, lo long, hi long, height double, step int, id long, size double, vec array<double>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _merged_inside(step: int):
    """Merges of cells, whose blocks come one after another, each before its bounds, and their clusters that are left."""
    names = [c.split()[0] for c in _INSIDE.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))

    def rows(n, columns):
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    def out(g, held):
        ids, size, x, bound = (np.concatenate(c) for c in zip(*held))
        found, (ids, size, x) = merges_inside(ids, size, x, bound, step)
        for at in range(0, len(found[0]), 2000):
            part = [pa.array(c[at : at + 2000]) for c in found]
            yield rows(len(part[0]), {"g": pa.array(np.full(len(part[0]), g))} | dict(zip(names[1:5], part)))
        for at in range(0, len(ids), 2000):
            part = slice(at, at + 2000)
            yield rows(len(ids[part]), {"g": pa.array(np.full(len(ids[part]), g)), "id": pa.array(ids[part]), "size": pa.array(size[part]), "vec": _lists(x[part])})

    def run(batches):
        now, of, held = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != now and held:
                    yield from out(of, held)
                    held = []
                now = r["cell"]
                if r["kind"]:
                    np.minimum(held[-1][3], np.frombuffer(r["bounds"], np.float64), out=held[-1][3])
                    continue
                of, ids = r["g"], np.frombuffer(r["ids"], np.int64)
                held.append((ids, np.frombuffer(r["sizes"], np.float64), np.frombuffer(r["data"], np.float64).reshape(len(ids), -1), np.full(len(ids), np.inf)))
        if held:
            yield from out(of, held)

    return run


def _inside_cells(large: DataFrame, sizes: dict[int, int], step: int, seed: int, ws: Scratch) -> tuple[DataFrame, DataFrame, int, int]:
    """(clusters that are left, merges, their number, last step) of groups of clusters (g, id, size, vec) of known sizes."""
    total, rng = sum(sizes.values()), np.random.default_rng(seed)
    some: dict[int, list] = {g: [] for g in sizes}
    # planes only deal the rows out: any will do
    share = min(1.0, min(PLANED, max(64 * total // CELL, 4096)) / total)
    for r in large.where(F.pmod(F.xxhash64("g", "id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share).select("g", "vec").collect():
        some[r["g"]].append(r["vec"])
    planes, frames, parts, cells, tasks = {}, {}, {}, 0, 0
    for g, n in sorted(sizes.items()):
        x = np.array(some[g]) if some[g] else np.zeros((1, 1))
        # a pass compares all pairs, so cells of a large group may be large
        k = -(-n // max(CELL, min(n // LARGER, TAIL)))
        p = _parts(n, k)
        planes[g], frames[g], parts[g] = _planes(x, k, rng, cells), (x.mean(0), float(np.abs(x - x.mean(0)).max()) or 1.0), (cells, k, p, tasks)
        cells, tasks = cells + k, tasks + p * (p + 1) // 2
    dealt = large.select("g", "id", "size", "vec").mapInArrow(_celled(planes), "g long, id long, size double, vec array<double>, cell int")
    # tasks are by number, as comparing is long work on few bytes
    dealt = dealt.repartitionById(cells, "cell").sortWithinPartitions("cell", "id").mapInArrow(_cell_blocks(frames, parts), _CELLS)
    dealt = ws.save(dealt, "cells")
    meeting = dealt.select("g", "cell", "at", "part", "sizes", "short", F.explode("meets").alias("task"))
    meeting = meeting.repartitionById(tasks, "task").sortWithinPartitions("task", "cell", "at")
    bounds = meeting.mapInArrow(_outside({g: unit for g, (_, unit) in frames.items()}), "cell int, at int, bounds binary")
    known = dealt.select("g", "cell", "at", "ids", "sizes", "data").withColumn("kind", F.lit(0)).unionByName(bounds.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    done = known.repartitionById(cells, "cell").sortWithinPartitions("cell", "at", "kind").mapInArrow(_merged_inside(step), _INSIDE)
    done = ws.save(done, "inside")
    ws.drop(dealt)
    found = done.where("id IS NULL").select("g", "lo", "hi", "height", "step")
    n, last = found.agg(F.count("*"), F.max("step")).first()
    left = done.where("id IS NOT NULL").select("g", "id", "size", "vec")
    left._path = done._path
    return left, found, n, last or step


# --- a round over large groups ------------------------------------------------------------


def _rows(batch, name: str = "vec") -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


_NEAR = "g long, id long, cost double, lo long, hi long"


def _round_blocks(batches):
    """Rows that come ordered by group and part as blocks."""
    for (g, part), (ids, size, stale, parts, task, x) in _stretches(batches, ("g", "part"), ("id", "size", "stale", "parts", "task")):
        meets = [int(task[0]) + max(part, p) * (max(part, p) + 1) // 2 + min(part, p) for p in range(int(parts[0]))]
        for at in range(0, len(ids), BLOCK):
            o = slice(at, at + BLOCK)
            row = {"g": [g], "part": pa.array([part], pa.int32()), "ids": [ids[o].tobytes()], "sizes": [size[o].tobytes()], "data": [x[o].tobytes()], "stale": [stale[o].tobytes()]}
            yield pa.RecordBatch.from_pydict(row | {"meets": pa.array([meets], pa.list_(pa.int32()))})


def _nearest_rows(batches):
    """(g, id, cost, lo, hi) of blocks that come by task: for those of two parts of a group who ask, the nearest of the other part; of one part that meets itself, of this."""

    def out(g, parts):
        held = [tuple(np.concatenate(c) for c in zip(*blocks)) for blocks in parts.values()]
        for one, two in [(held[0], held[0])] if len(held) == 1 else [(held[0], held[1]), (held[1], held[0])]:
            ask = np.flatnonzero(one[3])
            for k in range(0, len(ask), 1 << 14):
                o = ask[k : k + (1 << 14)]
                cost, lo, hi = _nearest(one[0][o], one[1][o], one[2][o], *two[:3])
                fine = np.isfinite(cost)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(fine.sum()), g)), *(pa.array(c[fine]) for c in (one[0][o], cost, lo, hi))], names=["g", "id", "cost", "lo", "hi"])

    now, of, parts = None, None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["task"] != now and parts:
                yield from out(of, parts)
                parts = {}
            now, of = r["task"], r["g"]
            ids = np.frombuffer(r["ids"], np.int64)
            parts.setdefault(r["part"], []).append((ids, np.frombuffer(r["sizes"], np.float64), np.frombuffer(r["data"], np.float64).reshape(len(ids), -1), np.frombuffer(r["stale"], bool)))
    if parts:
        yield from out(of, parts)


def _parts(n: int, most: int) -> int:
    """Parts of a group of n clusters: no more than ``most``, and so many that none is over MEETING."""
    return max(1, min(most, -(-n // min(max(n // PARTS, LEAST), MEETING))))


def _one_round(large: DataFrame, n: int, ws: Scratch) -> DataFrame:
    """(g, id, cost, lo, hi): the nearest of each cluster (g, id, size, vec, and the same where it is known).

    Parts of a group meet, two in a task: what is shuffled is each cluster once for each part, however many clusters ask how many others.
    """
    task, groups = 0, []
    for r in large.groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect():  # fewer than rows by ``tail``
        groups.append((r["g"], _parts(r["n"], r["n"]), task))
        task += groups[-1][1] * (groups[-1][1] + 1) // 2
    known = F.broadcast(large.sparkSession.createDataFrame(groups, "g long, parts int, task int"))
    rows = large.join(known, "g").withColumn("part", F.pmod(F.xxhash64("g", "id"), F.col("parts")).cast("int"))
    rows = rows.select("g", "id", "size", "vec", "part", F.col("cost").isNull().cast("byte").alias("stale"), "parts", "task")
    shape = "g long, part int, ids binary, sizes binary, data binary, stale binary, meets array<int>"
    cores = large.sparkSession.sparkContext.defaultParallelism
    blocks = rows.repartition(max(cores, sum(p for _, p, _ in groups)), F.xxhash64("g", "part")).sortWithinPartitions("g", "part", "id").mapInArrow(_round_blocks, shape)
    meeting = blocks.select("g", "part", "ids", "sizes", "data", "stale", F.explode("meets").alias("task"))
    others = meeting.repartitionById(task, "task").sortWithinPartitions("task", "part").mapInArrow(_nearest_rows, _NEAR)
    near = large.where("cost IS NOT NULL").select("g", "id", "cost", "lo", "hi").unionByName(others).groupBy("g", "id").agg(F.min(F.struct("cost", "lo", "hi")).alias("m"))
    return ws.save(near.select("g", "id", "m.cost", "m.lo", "m.hi"), "nearest")


def _ended(step: int):
    """All merges of the clusters of a group, group by group."""

    def run(batches):
        for (g,), (ids, size, x) in _stretches(batches, ("g",), ("id", "size")):
            found = _columns(_agglomerated(ids, size, x, None, step)[0])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), g)), *(pa.array(c, t) for c, t in zip(found, kinds))], names=["g", "lo", "hi", "height", "step"])

    return run


_MERGE = "g long, lo long, hi long, height double, step int"


def tree_of(rows: DataFrame, tail: int = TAIL) -> DataFrame:
    """(g, lo, hi, height, step): the merges of each group of (g, id, vec), a written table.

    A merge's cluster goes on under the smaller id. Heights are what a merge adds to the squared error.
    """
    spark = rows.sparkSession
    ws = Scratch(spark, "ward", tidy=True)
    v = rows.where(F.col("g").isNotNull() & F.col("id").isNotNull() & usable(F.col("vec"))).select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    v = ws.save(v.withColumn("key", F.xxhash64("g", F.transform("vec", lambda x: x + F.lit(0.0)))), "vectors")
    # equal vectors: one cluster, the others join its least id at no cost
    heads = ws.save(v.groupBy("g", "vec").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("size"), F.min("key").alias("key")), "heads")
    several = heads.where("size > 1").select("g", "key", F.col("vec").alias("same"), F.col("id").alias("lo"))
    done = ws.save(v.join(several, ["g", "key"]).where("vec = same AND id <> lo").select("g", "lo", F.col("id").alias("hi"), F.lit(0.0).alias("height"), F.lit(0).alias("step")), "equal")
    unknown = [F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")]
    ws.drop(v)
    active, step, seed, wait = heads.select("g", "id", "size", "vec", *unknown), 0, 0, 0
    reads = heads  # the table that ``active`` comes from, which goes when the next one is written
    parts, ending, ends = [done], [], 0
    while True:
        sizes = ws.save(active.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        n, few = sizes.agg(F.sum(F.when(F.col("n") > tail, F.col("n"))), F.count_if(F.col("n") <= tail)).first()
        if few:
            ending.append(ws.save(active.join(sizes.where(F.col("n") <= tail).select("g"), "g", "left_semi").select("g", "id", "size", "vec"), "small"))
            ends += few
            active = ws.save(active.join(sizes.where(F.col("n") > tail).select("g"), "g", "left_semi"), "large")
            ws.drop(reads)
            reads = active
        if not n:
            break
        seed, wait = seed + 1, wait - 1
        if wait < 0:
            large = {r["g"]: r["n"] for r in sizes.where(F.col("n") > tail).collect()}  # fewer than rows by ``tail``
            left, found, merged, step = _inside_cells(active, large, step, seed, ws)
            if merged:
                parts.append(ws.save(found, "merges"))
                active = left.select("*", *unknown)
            ws.drop(reads if merged else left)
            reads = left if merged else reads
            wait = 0 if merged >= WORTH * n else PAUSE
            if merged:
                continue
        near = _one_round(active, n, ws)
        pairs = near.groupBy("g", "lo", "hi").agg(F.count("*").alias("n"), F.min("cost").alias("height")).where("n = 2")
        found = ws.save(pairs.select("g", "lo", "hi", "height", F.lit(step + 1).alias("step")), "merges")
        if not found.limit(1).count():  # equal costs: choose anew by the smaller ids
            active = active.select("g", "id", "size", "vec", *unknown)
            ws.drop(near)
            continue
        step += 1
        parts.append(found)
        to = found.select("g", F.col("lo").alias("id"), F.col("lo").alias("to")).unionByName(found.select("g", F.col("hi").alias("id"), F.col("lo").alias("to")))
        gone = to.select("g", F.col("id").alias("with"), F.lit(True).alias("lost"))
        kept = near.withColumn("with", F.col("lo") + F.col("hi") - F.col("id")).join(gone, ["g", "with"], "left").where("lost IS NULL").select("g", "id", "cost", "lo", "hi")
        rows = active.select("g", "id", "size", "vec").join(kept, ["g", "id"], "left").join(to, ["g", "id"], "left")
        side = F.struct("size", "vec", "cost", "lo", "hi")
        both = rows.groupBy("g", F.coalesce("to", "id").alias("id")).agg(F.min_by(side, "id").alias("a"), F.max_by(side, "id").alias("b"), F.count("*").alias("k"))
        total = F.col("a.size") + F.col("b.size")
        mean = F.zip_with("a.vec", "b.vec", lambda x, y: (x * F.col("a.size") + y * F.col("b.size")) / total)
        one = F.col("k") == 1
        active = both.select("g", "id", F.when(one, F.col("a.size")).otherwise(total).alias("size"), F.when(one, F.col("a.vec")).otherwise(mean).alias("vec"), *(F.when(one, F.col(f"a.{c}")).alias(c) for c in ("cost", "lo", "hi")))
        active = ws.save(active, "active")
        ws.drop(reads, near)
        reads = active
    ws.drop(reads)
    if ending:
        # few groups may be long work each: all at once, over so many tasks that hardly two meet
        tasks = max(4 * spark.sparkContext.defaultParallelism, min(ends * ends, 512))
        small = reduce(DataFrame.unionByName, ending).repartition(tasks, F.xxhash64("g")).sortWithinPartitions("g", "id")
        parts.append(ws.save(small.mapInArrow(_ended(step), _MERGE), "ended"))
        ws.drop(*ending)
    out = reduce(DataFrame.unionByName, parts)
    return ws.save(out, "tree")


def cuts(rows: DataFrame, most: int, tree: DataFrame | None = None, tail: int = TAIL) -> DataFrame:
    """(g, id, labels): for each row its cluster (from 0, in order of their least ids) in the cuts into 2, 3, up to ``most`` clusters of its group; fewer for few rows or few different ones, as equal vectors stay together."""
    ws = Scratch(rows.sparkSession, "cuts")
    tree = tree_of(rows, tail) if tree is None else tree
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("height"), F.desc("step"), F.desc("lo"), F.desc("hi")))
    # what merged at no cost is never parted
    ranked = ws.save(tree.withColumn("rank", F.when(F.col("height") > 0, rank).otherwise(most)), "ranked")
    # a cluster's id goes over to the smaller one once; follow it by doubling steps
    fine = rows.where(F.col("g").isNotNull() & F.col("id").isNotNull() & usable(F.col("vec"))).select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"))
    up = ranked.where(F.col("rank") >= most).select("g", F.col("hi").alias("id"), F.col("lo").alias("root"))
    at = ws.save(fine.join(up, ["g", "id"], "left").withColumn("root", F.coalesce("root", "id")), "roots")
    while True:
        over = at.select("g", F.col("id").alias("root"), F.col("root").alias("next"))
        new = ws.save(at.join(over, ["g", "root"]).select("g", "id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    # the merges that were taken away join the finest clusters again, the cheapest first: at most most - 1 a group
    cut = ranked.where(F.col("rank") < most)
    ends = [at.select("g", F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in ("lo", "hi")]
    cut = cut.join(ends[0], ["g", "lo"]).join(ends[1], ["g", "hi"])
    groups = at.groupBy("g", "root").agg(F.count("*").alias("n")).groupBy("g").agg(F.array_sort(F.collect_list("root")).alias("roots"))
    cut = groups.join(cut.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", "lo_root", "hi_root"))).alias("links")), "g", "left")
    named = cut.mapInArrow(_joined(most), "g long, root long, labels array<int>")
    return at.join(named, ["g", "root"]).select("g", "id", "labels")


def _joined(most: int):
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for g, roots, links in zip(*(batch[c].to_pylist() for c in ("g", "roots", "links"))):
                head = {r: r for r in roots}
                labels: dict = {r: [] for r in roots}
                for k in range(len(roots), 1, -1):
                    names = {h: i for i, h in enumerate(sorted(set(head.values())))}
                    for r in roots:
                        labels[r].append(names[head[r]])
                    link = links[k - 2]  # the costliest merge that still parts k clusters comes last
                    a, b = sorted((head[link["lo_root"]], head[link["hi_root"]]))
                    head = {r: a if h == b else h for r, h in head.items()}
                for r in roots:
                    out[0].append(g)
                    out[1].append(r)
                    out[2].append(labels[r][::-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["g", "root", "labels"])

    return run


def _scored(batches):
    """Sums of silhouettes by squared distances, for each group and cut; a group's model stands ahead of its rows."""
    total: dict = {}
    of, model = None, []
    for batch in batches:
        kind, keys = batch["kind"].to_numpy(), np.stack([batch["g"].to_numpy(), batch["salt"].to_numpy()], 1)
        ends = np.flatnonzero(np.append((keys[1:] != keys[:-1]).any(1) | (kind[1:] != kind[:-1]), True)) + 1 if len(kind) else []
        for at, end in zip([0, *ends[:-1]], ends):
            if of != tuple(keys[at]):  # a group without cuts has no model
                of, model = tuple(keys[at]), []
            if not kind[at]:
                model = [(np.array([c["mean"] for c in m]), np.array([c["spread"] for c in m]), np.array([c["n"] for c in m])) for m in batch["model"][int(at)].as_py()]
                continue
            part, g = batch.slice(at, end - at), int(keys[at, 0])
            x, labels = _rows(part), part["labels"].flatten().to_numpy(zero_copy_only=False).reshape(end - at, -1)
            for k, (mean, spread, n) in enumerate(model):
                own, rows = labels[:, k], np.arange(len(x))
                d = np.maximum((x * x).sum(1)[:, None] + (mean * mean).sum(1)[None] - 2 * (x @ mean.T), 0) + spread
                a = d[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
                d[rows, own] = np.inf
                b = d.min(1)
                high = np.maximum(a, b)
                s = np.where((n[own] > 1) & (high > 0), (b - a) / np.where(high > 0, high, 1), 0.0)
                t = total.setdefault((g, k), [0.0, 0])
                t[0] += float(s.sum())
                t[1] += len(s)
    rows = [(g, k, s, n) for (g, k), (s, n) in total.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64(), pa.int64()))], names=["g", "k", "s", "n"])


def best(rows: DataFrame, most: int = 5, tail: int = TAIL, tree: DataFrame | None = None) -> DataFrame:
    """(g, id, cluster, silhouette): the cut into 2 to ``most`` clusters with the best silhouette, by squared distances; no cut: one cluster, 0."""
    ws = Scratch(rows.sparkSession, "ward-best")
    cut = ws.save(cuts(rows, most, tree, tail), "cuts")
    v = rows.select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    v = ws.save(v.join(cut, ["g", "id"]), "rows")
    cells = v.select("g", "id", "vec", F.posexplode("labels").alias("k", "label")).select("g", "k", "label", F.posexplode("vec").alias("i", "x"))
    cells = cells.groupBy("g", "k", "label", "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    means = cells.groupBy("g", "k", "label").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda c: c["mean"]).alias("mean"), F.sum("var").alias("spread"))
    model = means.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("label", "n", "mean", "spread"))).alias("c")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda m: m["c"]).alias("model"))
    # a group's model goes once to each part of its rows
    salts = v.groupBy("g").agg(F.ceil(F.count("*") / SCORED).alias("salts"))
    heads = ws.save(model, "model").join(salts, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "model")
    body = v.join(salts, "g").select("g", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(1).alias("kind"), "vec", "labels")
    dealt = together(body.unionByName(heads, allowMissingColumns=True), "g", "salt").sortWithinPartitions("g", "salt", "kind")
    scores = dealt.mapInArrow(_scored, "g long, k int, s double, n long")
    scores = scores.groupBy("g", "k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    won = ws.save(scores.groupBy("g").agg(F.max_by(F.struct("k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("w")), "won")
    out = v.join(won, "g", "left")
    return out.select("g", "id", F.coalesce(F.get("labels", F.col("w.k")), F.lit(0)).alias("cluster"), F.coalesce("w.silhouette", F.lit(0.0)).alias("silhouette"))
