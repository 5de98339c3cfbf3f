"""Embedding near-dedup by spherical-cap filters.

Filters are directions of a structured random product code: the coordinates are rotated and
cut into parts, each part has its own random unit vectors, and a filter is one of them for
every part. A vector lies in the caps of a fixed number of filters, those of largest inner product
with it, so each vector's bound is its own quantile of the code; they are list-decoded from the
parts, best first, without looking at the other filters. Vectors meet in the filters that they
share, and are verified by cosine in double precision. The number of caps grows with the number of
vectors: random pairs at the cosine bound go through the code itself, and caps are added until
none of them misses. There are 256 filters at least, so tables of any size go through them; vectors of
few dimensions have a code of one part.

Equal vectors are one entry with a number of rows. Lists of a filter are cut into blocks of
bounded size, and pairs of blocks are compared as matrices, so no list is gathered in one task; a pair
counts under the smallest filter that both vectors hold. Tasks return numbers of links and
a spanning forest, not the pairs.

Cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing,
and are their own component; vectors of different lengths never link; rows with a null vec_id
link with nothing and have a null component; rows that share a vec_id count one by one as links.
Extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace, block_pairs, components, join_by_key

COSINE, PARTS, BLOCK, SEED = 0.9, 2, 512, 20240301
#: Fewest caps of a vector, and random pairs at the cosine bound of which none may miss (so about 1 in 1,300 at most, at 95 percent).
CAPS, TRIALS = 16, 4000
#: Members that a filter has on average: the number of filters follows the number of vectors.
MEMBERS = 128
#: Filters at least, and the dimensions from which a code has several parts and grows; with fewer, a link's share of the directions is large, and more filters only cost caps.
FEWEST, DIVIDED = 256, 8


def parts_of(dim: int, parts: int = PARTS) -> int:
    return parts if dim >= DIVIDED else 1


class CapCode:
    """Random product code for vectors of one length."""

    def __init__(self, dim: int, parts: int = PARTS, codes: int = 64, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = q
        self.cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((codes, b - a))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def caps(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """The ``wanted`` filters (all, if there are fewer) of largest inner product with each row, as a sorted int64 matrix.

        List decoding: the best sums of all parts begin with best sums of the parts so far.
        """
        out = [self._caps(x[at : at + 1000] @ self.rotation, wanted) for at in range(0, len(x), 1000)]
        return np.concatenate(out)

    def _caps(self, x: np.ndarray, wanted: int) -> np.ndarray:
        total, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books):
            s = x[:, a:b] @ book.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :wanted]
            s = np.take_along_axis(s, best, 1)
            # the i-th and the j-th best have i * j sums that are no smaller
            i, j = np.nonzero(np.outer(np.arange(1, total.shape[1] + 1), np.arange(1, s.shape[1] + 1)) <= wanted)
            sums, names = total[:, i] + s[:, j], codes[:, i] * len(book) + best[:, j]
            top = np.argsort(-sums, axis=1, kind="stable")[:, :wanted]
            total, codes = np.take_along_axis(sums, top, 1), np.take_along_axis(names, top, 1)
        return np.sort(codes, axis=1)


def modelled_misses(dim: int, codes: int, caps: int, cosine: float = COSINE, parts: int = PARTS, trials: int = TRIALS) -> int:
    """How many of ``trials`` random pairs at exactly ``cosine`` share no filter."""
    rng = np.random.default_rng([SEED, dim, codes, caps])
    u, w = rng.standard_normal((2, trials, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (u * w).sum(1, keepdims=True) * u
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    code = CapCode(dim, parts, codes)
    a, b = code.caps(u, caps), code.caps(cosine * u + max(0.0, 1 - cosine * cosine) ** 0.5 * w, caps)
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    return int((both[:, 1:] != both[:, :-1]).all(1).sum())


def design(n: int, dim: int, cosine: float = COSINE, parts: int = PARTS, caps: int = CAPS, members: int = MEMBERS, trials: int = TRIALS) -> tuple[int, int]:
    """(codes of a part, caps of a vector) for n vectors: filters by their number, caps until no trial misses."""
    parts = parts_of(dim, parts)
    while True:
        filters = max(FEWEST, n * caps / members) if dim >= DIVIDED else FEWEST
        codes = math.ceil(filters ** (1 / parts))
        caps = min(caps, codes**parts)
        # few trials first, as they already rule most numbers out
        if caps == codes**parts or not any(modelled_misses(dim, codes, caps, cosine, parts, t) for t in (trials // 8, trials)):
            return codes, caps
        caps = math.ceil(caps * 1.25)


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _decode(parts: int, designs: dict[int, tuple[int, int]]):
    def run(batches):
        books: dict[int, CapCode] = {}
        for batch in batches:
            dims = np.array([len(v) for v in batch["vec"]])
            for dim in sorted(set(dims.tolist())):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part["vec"])
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes, most = designs[dim]
                if dim not in books:
                    books[dim] = CapCode(dim, parts_of(dim, parts), codes)
                caps = books[dim].caps(x, most)
                yield pa.RecordBatch.from_arrays([part["rep"], part["rows"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in caps], pa.binary()), pa.array(list(caps), pa.list_(pa.int64())), pa.array(np.full(len(x), dim, np.int32))], names=["rep", "rows", "unit", "caps", "filter", "dim"])

    return run


def _pack(block: int):
    """Packs sorted members of filters into blocks of at most ``block``, one salt each."""

    def run(batches):
        now, held = None, []

        def out():
            cols = list(zip(*held))
            row = (*now, min(cols[0]), np.array(cols[0], np.int64).tobytes(), np.array(cols[1], np.int64).tobytes(), b"".join(cols[2]), list(cols[3]))
            held.clear()
            kinds = (pa.int32(), *(pa.int64(),) * 4, *(pa.binary(),) * 3, pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["dim", "filter", "salt", "salts", "first", "ids", "ns", "units", "caps"])

        for batch in batches:
            for dim, f, s, m, *row in zip(*(batch[c].to_pylist() for c in ("dim", "filter", "salt", "salts", "rep", "rows", "unit", "caps"))):
                if held and ((dim, f, s, m) != now or len(held) >= block):
                    yield out()
                now = dim, f, s, m
                held.append(row)
        if held:
            yield out()

    return run


_BLOCK = "dim int, filter long, salt long, salts long, first long, ids binary, ns binary, units binary, caps array<binary>"
_SIDES = ("first", "ids", "ns", "units", "caps")


def _with_itself(pack, compare):
    """Filters that fill one block: packed and compared in the same task."""

    def both(batch):
        cols = {n: batch[n] for n in batch.schema.names}
        return pa.RecordBatch.from_pydict(cols | {f"{n}_b": cols[n] for n in _SIDES})

    return lambda batches: compare(map(both, pack(batches)))


def _meet_lower(a: list[bytes], b: list[bytes], f: int) -> np.ndarray:
    """Which of the members a share a filter under ``f`` with which of b."""
    sides = []
    for caps in (a, b):
        m = np.frombuffer(b"".join(caps), np.int64).reshape(len(caps), -1)
        row, col = np.nonzero(m < f)
        sides.append((row, m[row, col], len(caps)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        held = []
        for row, name, n in sides:
            i = np.flatnonzero(np.isin(name, part))
            m = np.zeros((n, len(part)), np.float32)
            m[row[i], np.searchsorted(part, name[i])] = 1
            held.append(m)
        out |= held[0] @ held[1].T > 0
    return out


def _compare(cosine: float):
    """Links between two blocks of a filter: numbers for each entry, and a spanning forest."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g = lambda c, i=i: batch[c][i].as_py()
                dim, f = g("dim"), g("filter")
                a, b = np.frombuffer(g("ids"), np.int64), np.frombuffer(g("ids_b"), np.int64)
                na, nb = np.frombuffer(g("ns"), np.int64), np.frombuffer(g("ns_b"), np.int64)
                x, y = np.frombuffer(g("units"), np.float64).reshape(-1, dim), np.frombuffer(g("units_b"), np.float64).reshape(-1, dim)
                u, v = np.nonzero(x @ y.T >= cosine)
                if g("first") == g("first_b"):
                    u, v = u[a[u] < b[v]], v[a[u] < b[v]]
                if len(u):  # the smallest filter that both hold counts the pair
                    own = ~_meet_lower(g("caps"), g("caps_b"), f)[u, v]
                    u, v = u[own], v[own]
                if not len(u):
                    continue
                ids = np.concatenate([a, b])
                n = np.concatenate([np.bincount(u, nb[v], len(a)), np.bincount(v, na[u], len(b))]).astype(np.int64)
                # labels by repeated minimum; the edge to the label keeps what is connected connected
                label = ids.copy()
                while True:
                    before = label.copy()
                    low = np.minimum(label[u], label[len(a) + v])
                    np.minimum.at(label, u, low)
                    np.minimum.at(label, len(a) + v, low)
                    if (before == label).all():
                        break
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(label[at])], names=["rep", "n", "head"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, caps: int = CAPS, members: int = MEMBERS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    ws = Workspace(vectors.sparkSession, "embedding_dedup")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = ws.save(v.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.sha2(F.array_join(F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"), 256))), "vectors")
    entries = ws.save(v.where("ok").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.min("vec").alias("vec")), "entries")
    sizes = entries.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()
    designs = {r.dim: design(r.n, r.dim, cosine, parts, caps, members) for r in sizes}
    coded = entries.select("rep", "rows", "vec").mapInArrow(_decode(parts, designs), "rep long, rows long, unit binary, caps binary, filter array<long>, dim int")
    coded = ws.save(coded, "coded")
    # filters with one member meet nobody
    posts = coded.select("dim", "rep", F.explode("filter").alias("filter"))
    shared = ws.save(posts.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1"), "filters")
    # members of a filter are dealt to salts by their number, so that a full one is spread
    salts = F.ceil(F.col("n") / F.lit(block))
    posts = posts.join(shared, ["dim", "filter"]).select("dim", "filter", "rep", salts.alias("salts"), F.pmod(F.xxhash64("rep"), salts).alias("salt"))
    posts = ws.save(posts, "posts").join(coded.select("rep", "rows", "unit", "caps"), "rep")

    def sorted_(rows):
        rows = rows.select("dim", "filter", "salt", "salts", "rep", "rows", "unit", "caps").repartition("dim", "filter", "salt")
        return rows.sortWithinPartitions("dim", "filter", "salt", "rep")

    # most filters fill one block at most, which meets itself where it is packed; blocks of a full one meet by pairs of salts
    pack, compare, links = _pack(block), _compare(cosine), "rep long, n long, head long"
    alone = sorted_(posts.where("salts = 1")).mapInArrow(_with_itself(pack, compare), links)
    full = ws.save(sorted_(posts.where("salts > 1")).mapInArrow(pack, _BLOCK), "blocks")
    met = block_pairs(full, ["dim", "filter"], _SIDES).mapInArrow(compare, links)
    found = ws.save(alone.unionByName(met), "links")
    groups = ws.save(components(ws, found.where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst"))), "groups")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = entries.select("key", "rep", "rows").join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.select("key", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "rows")
    placed = ws.save(placed, "placed")
    out = join_by_key(v.where("ok").select("id", "key"), placed, "key", "rows").select("id", "n_links", "component_id")
    lone = v.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_duplicates(e).withColumnRenamed("id", "vec_id")


OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.z) = len(b.z)
  WHERE list_cosine_similarity(a.z, b.z) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = e.vec_id
"""
