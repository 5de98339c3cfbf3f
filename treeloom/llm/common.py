"""What several operators share: scratch tables, skew-safe joins, components, repeat filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.scratch import Scratch, bounded_batches  # noqa: F401

#: Whitespace of the contracts, ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Workspace(Scratch):
    """Scratch tables of an operator."""


def join_by_key(big: DataFrame, small: DataFrame, key: str, freq: str, least: int = 2000, share: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row for each key, ``freq`` rows of it in ``big``).

    Keys with over a 1/``share`` of all rows number under ``share`` by arithmetic, whatever the
    data; only they are broadcast, so no shuffled key has more than that part of the rows.
    ``big`` and ``small`` should be written tables, as both are read twice.
    """
    total = small.agg(F.sum(freq)).first()[0] or 0
    bar = max(least, total // share)
    hot, rest = small.where(F.col(freq) > bar), small.where(F.col(freq) <= bar)
    hot_part = big.join(F.broadcast(hot), key)
    if hot.limit(1).count() == 0:
        return big.join(small, key)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hot_part.unionByName(cold.join(rest, key))


def block_pairs(blocks: DataFrame, keys: list[str], sides: tuple[str, ...]) -> DataFrame:
    """Pairs of the blocks of a key, each once: (keys, i, j, sides, sides with ``_b``).

    A block stands in ``salt`` of the key's ``salts``. It is sent to every pair of salts that it is
    in, so the pairs of a frequent key are as many join keys and as many tasks as it has pairs of salts.
    """
    one = blocks.select(*keys, F.col("salt").alias("i"), F.explode(F.sequence("salt", F.col("salts") - 1)).alias("j"), *sides)
    two = blocks.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "salt")).alias("i"), F.col("salt").alias("j"), *(F.col(c).alias(f"{c}_b") for c in sides))
    return one.join(two, [*keys, "i", "j"]).where("i < j OR first <= first_b")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (src, dst): component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges are stars. Neighbour lists
    are never collected: each step is a min() with map-side combining and a join, which
    adaptive execution can split when one hub has very many neighbours.
    """
    a, b = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    e = ws.save(edges.where("src <> dst").select(a, b).distinct(), "edges")
    old = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        n = ws.save(small, "edges")
        new = tuple(n.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e = n
        if new == old:
            break
        old = new
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# --- two Bloom filters: hashes seen once, hashes seen again -------------------------------

SEGMENTS = 256
#: Bits that one hash sets, and the bound on the bits of one segment (256 segments: 32 MB in all).
PROBES, SEGMENT_BITS_MAX = 4, 1 << 20
PACKED = "seg int, n long, once binary, again binary"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for arrays of uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack_hashes(hashes: np.ndarray):
    """Rows of PACKED for the hashes (uint64) of one batch: those it has once, those it has again."""
    values, counts = np.unique(hashes, return_counts=True)
    cuts = np.searchsorted(values, np.arange(SEGMENTS + 1, dtype=np.uint64) << np.uint64(56)) if SEGMENTS == 256 else None
    cuts[-1] = len(values)
    for s in range(SEGMENTS):
        v, c = values[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]
        if len(v):
            yield s, len(v), v[c == 1].tobytes(), v[c > 1].tobytes()


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    a = mix(h)
    b = (a >> np.uint64(32)) | np.uint64(1)
    return (a + b * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(bits - 1)


def _segment_filters(bits: int):
    def run(batches):
        import pyarrow as pa

        state: dict = {}
        for batch in batches:
            for s, once, again in zip(batch["seg"].to_pylist(), batch["once"], batch["again"]):
                if s not in state:
                    state[s] = np.zeros(bits, bool), np.zeros(bits, bool)
                seen, twice = state[s]
                h = np.frombuffer(once.as_py(), np.uint64)
                at = _places(h, bits)
                twice[at[:, seen[at].all(0)]] = True
                seen[at] = True
                at = _places(np.frombuffer(again.as_py(), np.uint64), bits)
                twice[at] = seen[at] = True
        for s, (_, twice) in state.items():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    return run


class RepeatFilter:
    """Says of 64-bit hashes whether they may occur again; never no for one that does."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        self.table = np.zeros((SEGMENTS, bits // 8), np.uint8)
        for s, x in segments.items():
            self.table[s] = np.frombuffer(x, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, bool)
        at, seg = _places(h, self.bits), (h >> np.uint64(56)).astype(np.int64)
        return ((self.table[seg, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(0)


def repeat_filter(ws: Workspace, packed: DataFrame) -> RepeatFilter:
    """The twice-seen filter over all rows of ``packed`` (written table, columns PACKED).

    Each segment of the hash range has a once-seen and a twice-seen Bloom filter, built by
    streaming over packed hashes: memory is the filters', whatever the number of hashes.
    Filters have 16 bits a hash up to a bound of 32 MB for all segments, which bounds what
    is broadcast; beyond it the filter lets more false suspects pass, and as callers
    confirm suspects exactly, results don't change.
    """
    total = packed.agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(10, min(SEGMENT_BITS_MAX.bit_length() - 1, int(16 * total / SEGMENTS).bit_length()))
    rows = packed.repartition(64, "seg").mapInArrow(_segment_filters(bits), "seg int, bits binary").collect()
    return RepeatFilter(bits, {r["seg"]: bytes(r["bits"]) for r in rows})
