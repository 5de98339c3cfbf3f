"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct five-word shingles. Documents with equal sets are one
entry. An entry is posted under each (coordinate, value) pair of its MinHash signature.
Entries that collide in at least ``least`` coordinates are confirmed on their full sets.

Prefix merging: pairs that no other entry has can't collide, and entries with fewer than
``least`` shared pairs drop out before anything is shuffled (two Bloom filters). Of the
shared pairs of an entry, rarest first, one within the first ``m - least + 1`` must collide
with any partner, so only these are joined. Skip merging: within a posting list every entry first
meets the list's smallest alone; lists whose entries are then in one component are
skipped, and only entries of different components are compared further. No posting list is
gathered in one task.

Cases: lower-cases A-Z alone; words are runs of ``[^\\x20\\x09-\\x0D]``; with fewer than
five words the whole sequence is the one shingle; null, empty or blank texts have no shingles and link with nothing;
rows with a null doc_id keep a null component and are kept; rows with one doc_id are one vertex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import PACKED, Workspace, block_pairs, components, join_by_key, mix, pack_hashes, repeat_filter

WORDS, COORDINATES = 5, 48
#: Smallest shingle hashes kept to estimate a similarity, and members of a posting list compared at once.
BOTTOM, BLOCK = 256, 512
_P = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 1 << 31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 1 << 32, 256, dtype=np.uint32)


def least_collisions(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates that a pair at the threshold shares at least, but for one chance in about a million."""
    p, k = percent / 100, coordinates
    term, total, c = (1 - p) ** k, 0.0, 0
    while total + term < 1e-6 and c < k:
        total += term
        c += 1
        term = term * (k - c + 1) / c * p / (1 - p) if p < 1 else 0.0
    return max(1, c)


class Shingler:
    """Shingle sets of texts; hashes of words seen lately are remembered."""

    def __init__(self, words: int = WORDS, remember: int = 60_000):
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes (uint64) of the whole text."""
        parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
        if not parts:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known, h = self.known, xxhash.xxh3_64_intdigest
        try:
            w = np.array([known[x] for x in parts], np.uint64)
        except KeyError:
            for x in parts:
                if x not in known:
                    known[x] = h(x)
            w = np.array([known[x] for x in parts], np.uint64)
        n = min(self.words, len(w))
        out = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ w[i : len(w) - n + 1 + i]) * _P
            out ^= out >> np.uint64(29)
        return np.unique(mix(out))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    a, b = _A[:coordinates, None], _B[:coordinates, None]
    x = (shingles >> np.uint64(17)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (a * x[None, i : i + 4096] + b).min(1))
    return low


def _tokens(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each (coordinate, value) pair."""
    return mix((np.arange(len(sig), dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64))


def _sketch(words: int, coordinates: int, bottom: int):
    def run(batches):
        shingles = Shingler(words)
        for batch in batches:
            n, keys, sigs, sketches = [], [], [], []
            for t in batch["text"]:
                s = shingles(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, coordinates).tobytes())
                sketches.append((s[:bottom] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "key", "sig", "sketch"])

    return run


def _pack(batches):
    for batch in batches:
        if batch.num_rows:
            rows = list(pack_hashes(np.concatenate([_tokens(np.frombuffer(s.as_py(), np.uint32)) for s in batch["sig"]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["seg", "n", "once", "again"])


def _post(shared, least: int):
    def run(batches):
        repeats = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.stack([_tokens(np.frombuffer(s.as_py(), np.uint32)) for s in batch["sig"]])
            hit = repeats(tokens.ravel()).reshape(tokens.shape)
            hit &= (hit.sum(1) >= least)[:, None]
            ids = np.repeat(batch["rep"].to_numpy(), hit.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit].astype(np.int64)), pa.array(ids)], names=["token", "rep"])

    return run


def _pack_ids(batches):
    for batch in batches:
        if batch.num_rows:
            h = np.unique(mix(batch["id"].to_numpy().astype(np.uint64)))
            rows = list(pack_hashes(np.concatenate([h, h])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["seg", "n", "once", "again"])


def _sets(shared, words: int):
    """Full shingle sets of the documents that the filter lets pass."""

    def run(batches):
        wanted, shingles = shared.value, Shingler(words)
        for batch in batches:
            ids = batch["id"]
            if not len(ids):
                continue
            at = np.flatnonzero(wanted(mix(ids.to_numpy().astype(np.uint64))))
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), pa.array([shingles(batch["text"][int(j)].as_py()).tobytes() for j in part], pa.binary())], names=["id", "set"])

    return run


def alike(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int, bottom: int, least: int) -> bool:
    """Whether sets of nx and ny shingles may be similar enough, from the smallest hashes of both."""
    if 100 * min(nx, ny) < percent * max(nx, ny):
        return False
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    if nx <= bottom and ny <= bottom:
        n = int(twice.sum())
        return 100 * n >= percent * (nx + ny - n)
    # of the ``bottom`` smallest of the union, those in both
    at = np.flatnonzero(np.concatenate([[True], ~twice]))[:bottom]
    return int(twice[at[at < len(twice)]].sum()) >= least * min(1.0, len(at) / bottom)


def _collisions(least: int, percent: int, bottom: int):
    """Pairs that collide in ``least`` coordinates and whose smallest hashes agree often enough."""
    enough = least_collisions(percent, bottom)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(s.as_py(), np.uint32) for s in batch[c]]) for c in ("sig_a", "sig_b"))
                ok = (x == y).sum(1) >= least
                for i in np.flatnonzero(ok):
                    p, q = (np.frombuffer(batch[c][int(i)].as_py(), np.uint32) for c in ("sketch_a", "sketch_b"))
                    ok[i] = alike(p, q, batch["n_a"][int(i)].as_py(), batch["n_b"][int(i)].as_py(), percent, bottom, enough)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


_BLOCKS = "token long, salt long, salts long, first long, reps binary, cs binary, ns binary, sigs binary, sketches array<binary>, lists array<binary>"


def _pack_lists(block: int):
    """Packs the sorted members of posting lists into blocks of at most ``block``, one salt each."""

    def run(batches):
        now, held = None, []

        def out():
            reps, cs, ns, sigs, sketches, lists = zip(*held)
            row = (*now, min(reps), *(np.array(x, np.int64).tobytes() for x in (reps, cs, ns)), b"".join(sigs), list(sketches), list(lists))
            held.clear()
            kinds = (*(pa.int64(),) * 4, *(pa.binary(),) * 4, pa.list_(pa.binary()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["token", "salt", "salts", "first", "reps", "cs", "ns", "sigs", "sketches", "lists"])

        for batch in batches:
            for t, s, m, *row in zip(*(batch[c].to_pylist() for c in ("token", "salt", "salts", "rep", "c", "shingles", "sig", "sketch", "list"))):
                if held and ((t, s, m) != now or len(held) >= block):
                    yield out()
                now = t, s, m
                held.append(row)
        if held:
            yield out()

    return run


def _meet(least: int, percent: int, bottom: int):
    """Pairs of entries of different components in two blocks of a list that collide often enough.

    A pair is given under the smallest prefix token of both, so once.
    """
    enough = least_collisions(percent, bottom)

    def run(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                g = lambda c, i=i: batch[c][i].as_py()
                a, b, ca, cb, na, nb = (np.frombuffer(g(x), np.int64) for x in ("reps", "reps_b", "cs", "cs_b", "ns", "ns_b"))
                x, y = (np.frombuffer(g(c), np.uint32).astype(np.uint8).reshape(n, -1) for c, n in (("sigs", len(a)), ("sigs_b", len(b))))
                differ = ca[:, None] != cb[None, :]
                if g("first") == g("first_b"):
                    differ &= a[:, None] < b[None, :]
                if not differ.any():
                    continue
                same = np.zeros(differ.shape, np.uint8)
                for k in range(x.shape[1]):
                    same += x[:, k][:, None] == y[:, k][None, :]
                u, v = np.nonzero(differ & (same >= least))
                if not len(u):
                    continue
                token, la, lb = g("token"), g("lists"), g("lists_b")
                sa, sb = ([set(np.frombuffer(z, np.int64).tolist()) for z in q] for q in (la, lb))
                ka, kb = ([np.frombuffer(z, np.uint32) for z in g(q)] for q in ("sketches", "sketches_b"))
                own = [k for k, (i, j) in enumerate(zip(u.tolist(), v.tolist())) if min(sa[i] & sb[j]) == token and alike(ka[i], kb[j], int(na[i]), int(nb[j]), percent, bottom, enough)]
                found.append((np.minimum(a[u[own]], b[v[own]]), np.maximum(a[u[own]], b[v[own]])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return run


def _with_itself(pack, meet):
    """Lists that fill one block: packed and compared in the same task."""

    def both(batch):
        cols = {n: batch[n] for n in batch.schema.names}
        return pa.RecordBatch.from_pydict(cols | {f"{n}_b": cols[n] for n in _SIDES})

    return lambda batches: meet(map(both, pack(batches)))


_SIDES = ("first", "reps", "cs", "ns", "sigs", "sketches", "lists")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Pairs (a, b) that link, from rows sorted by (a, salt, b): the sets of a itself (b null), then those of its partners.

    So the set of a is sent once for each salt and not once for each partner, and only one is held.
    """

    def run(batches):
        now, own = None, []
        for batch in batches:
            hits = []
            for a, salt, b, s in zip(batch["a"].to_pylist(), batch["salt"].to_pylist(), batch["b"].to_pylist(), batch["set"]):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                if (a, salt) != now:
                    now, own = (a, salt), []
                if b is None:
                    own.append(x.copy())
                elif any(linked(o, x, percent) for o in own):
                    hits.append((a, b))
            a, b = zip(*hits) if hits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _as_bytes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["rep"], batch["shingles"], batch["sig"], batch["sketch"], pa.array([np.array(x, np.int64).tobytes() for x in batch["list"].to_pylist()], pa.binary())], names=["rep", "shingles", "sig", "sketch", "list"])


class _Links:
    """Confirms candidate pairs of entries."""

    def __init__(self, ws, docs, reps, percent: int, least: int, words: int, bottom: int):
        self.ws, self.docs, self.reps, self.percent, self.least, self.words, self.bottom = ws, docs, reps, percent, least, words, bottom

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that collide often enough and link, as a written table."""
        ws = self.ws
        for x in "ab":
            pairs = pairs.join(self.reps.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "sketch"))), x)
        return self.confirmed(ws.save(pairs.mapInArrow(_collisions(self.least, self.percent, self.bottom), "a long, b long"), "colliding"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        ws = self.ws
        ids = ws.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().mapInArrow(_pack_ids, PACKED), "wanted")
        shared = self.docs.sparkSession.sparkContext.broadcast(repeat_filter(ws, ids))
        sets = self.docs.where("id IS NOT NULL").mapInArrow(_sets(shared, self.words), "id long, set binary")
        sets = ws.save(sets, "sets")
        often = pairs.groupBy("a").agg(F.count("*").alias("n"))
        pairs = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(BLOCK))).alias("salt"))
        pairs = ws.save(pairs, "salted")
        heads = pairs.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
        partners = pairs.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "set")
        rows = heads.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        found = ws.save(rows.mapInArrow(_confirm(self.percent), "a long, b long").distinct(), "links")
        ws.drop(sets, ids, pairs)
        shared.destroy()
        return found


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, coordinates: int = COORDINATES, bottom: int = BOTTOM, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row, linked at 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    least = least_collisions(percent, coordinates)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = ws.save(d.mapInArrow(_sketch(words, coordinates, bottom), "id long, n long, key binary, sig binary, sketch binary"), "sketches")
    reps = ws.save(sketches.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch"), F.count("*").alias("rows")), "entries")
    packed = ws.save(reps.select("sig").mapInArrow(_pack, PACKED), "tokens")
    shared = spark.sparkContext.broadcast(repeat_filter(ws, packed))
    postings = ws.save(reps.select("rep", "sig").mapInArrow(_post(shared, least), "token long, rep long"), "postings")
    ws.drop(packed)
    shared.destroy()
    often = ws.save(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = join_by_key(postings, often, "token", "df").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most ``coordinates`` for each
    lists = ranked.where(F.size("t") >= least).select("rep", F.expr(f"slice(transform(t, x -> x.token), 1, size(t) - {least} + 1)").alias("list"))
    lists = ws.save(lists, "prefixes")
    prefix = lists.select("rep", F.explode("list").alias("token"))
    confirm = _Links(ws, d, reps, percent, least, words, bottom)
    # every entry of a posting list meets the smallest entry of the list
    heads = ws.save(prefix.groupBy("token").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    links = confirm(join_by_key(prefix, heads, "token", "n").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = ws.save(components(ws, edges), "groups")
    # lists that still hold several components: their entries of different components meet
    placed = prefix.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("c"))
    placed = ws.save(placed, "placed")
    split = ws.save(placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high"), "split")
    rest = ws.save(join_by_key(placed, split.select("token", "n"), "token", "n").select("token", "rep", "c", "n"), "rest")
    members = lists.join(reps.select("rep", F.col("n").alias("shingles"), "sig", "sketch"), "rep").mapInArrow(_as_bytes, "rep long, shingles long, sig binary, sketch binary, list binary")
    salts = F.ceil(F.col("n") / F.lit(block))
    dealt = rest.join(members, "rep").select("*", salts.alias("salts"), F.pmod(F.xxhash64("rep"), salts).alias("salt"))

    def sorted_(rows):
        rows = rows.select("token", "salt", "salts", "rep", "c", "shingles", "sig", "sketch", "list").repartition("token", "salt")
        return rows.sortWithinPartitions("token", "salt", "rep")

    pack, meet = _pack_lists(block), _meet(least, percent, bottom)
    alone = sorted_(dealt.where("salts = 1")).mapInArrow(_with_itself(pack, meet), "a long, b long")
    full = ws.save(sorted_(dealt.where("salts > 1")).mapInArrow(pack, _BLOCKS), "blocks")
    met = alone.unionByName(block_pairs(full, ["token"], _SIDES).mapInArrow(meet, "a long, b long"))
    more = confirm.confirmed(ws.save(met, "met"))
    if more.limit(1).count():
        edges = edges.union(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        groups = ws.save(components(ws, edges), "groups")
    entries = ws.save(reps.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"), "rows"), "placed_entries")
    fine = sketches.where("n > 0 AND id IS NOT NULL").select("id", "n", "key")
    out = join_by_key(fine, entries, "key", "rows").select("id", F.col("n").alias("n_shingles"), "component_id")
    lone = sketches.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
r(id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM sets s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
