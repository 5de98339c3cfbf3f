"""Byte-level BPE encoding and decoding by two tiers.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary
entry gets its id at once. Tier two merges the other pre-tokens: a heap of (rank, place)
over the linked list of byte parts, so a pre-token of n bytes takes O(n log n).

The vocabulary is read on the driver (its size is the tokenizer's, not the data's) and
broadcast. Encoding is a map over documents without a shuffle.

Cases: a null or empty text has no tokens, and decodes to no bytes; special tokens are
ordinary text; extra columns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import bounded_batches

M64 = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, compare.

    Keys are dealt to buckets; from the largest bucket on, each finds a displacement that
    moves all its keys to free places. A bucket of one key names its place directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.place = [0] * n  # index of the key in the list given
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = [True] * n
        alone = []
        for b, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                alone.append((b, members[0][1]))
                continue
            d = 1
            while True:
                slots = [self._slot(h, d) for h, _ in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, members):
                free[s], self.keys[s], self.place[s] = False, keys[i], i
        rest = (s for s in range(n) if free[s])
        for (b, i), s in zip(alone, rest):
            self.shift[b], self.keys[s], self.place[s] = -s - 1, keys[i], i

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & M64
        return (x ^ (x >> 29)) % self.n

    def find(self, key: bytes) -> int:
        """Index of the key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.place[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


#: Bytes of a pre-token up to which looking through all pairs beats the heap; a rank above all.
SHORT, NONE = 64, 1 << 62


class Codec:
    """Encoder and decoder of one vocabulary; pre-tokens seen lately are remembered: the last ``remember``, and those asked for among as many before."""

    def __init__(self, entries: list[tuple[bytes, int]], pattern: str, remember: int = 100_000):
        self.entries, self.pattern, self.remember = entries, pattern, remember
        self.table = PerfectHash([k for k, _ in entries])
        self.ready = False

    def __getstate__(self):
        return {**self.__dict__, "ready": False, "cache": None, "older": None, "ranks": None, "bytes_of": None, "text_of": None, "split": None}

    def start(self) -> "Codec":
        if not self.ready:
            self.ranks = dict(self.entries)
            self.bytes_of = {r: k for k, r in self.entries}
            self.text_of = {r: str(r) for _, r in self.entries}
            self.cache: dict[str, tuple[int, ...]] = {}
            self.older: dict[str, tuple[int, ...]] = {}
            self.split = regex.compile(self.pattern)
            self.ready = True
        return self

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token outside the vocabulary."""
        rank = self.ranks.get
        n = len(piece)
        if n <= SHORT:
            return self.merge_short(piece, rank)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the part at i ends where the part after[i] begins
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        now = [r for r in map(rank, (piece[i : i + 2] for i in range(n - 1)))] + [None]  # rank of the pair at i, None if none
        while heap:
            r, i = pop(heap)
            if now[i] != r:
                continue
            j = after[i]  # the part at j joins the part at i
            k = after[j]
            after[i] = k
            now[j] = None
            if k < n:
                before[k] = i
                x = now[i] = rank(piece[i : after[k]])
                if x is not None:
                    push(heap, (x, i))
            else:
                now[i] = None
            p = before[i]
            if p >= 0:
                x = now[p] = rank(piece[p:k])
                if x is not None:
                    push(heap, (x, p))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : after[i]]))
            i = after[i]
        return tuple(out)

    def merge_short(self, piece: bytes, rank) -> tuple[int, ...]:
        """The same by looking for the least rank of all pairs each time."""
        at = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], NONE) for i in at[:-2]]
        while pairs and (r := min(pairs)) != NONE:
            i = pairs.index(r)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[at[i] : at[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(piece[at[i - 1] : at[i + 1]], NONE)
        return tuple([rank(piece[a:b]) for a, b in zip(at, at[1:])])

    def piece_ids(self, token: str) -> tuple[int, ...]:
        out = self.cache.get(token) or self.older.get(token)
        if out is None:
            piece = token.encode()
            i = self.table.find(piece)
            out = (self.entries[i][1],) if i >= 0 else self.merge(piece)
        if len(self.cache) >= self.remember:
            self.cache, self.older = {}, self.cache
        if len(token) <= 64:
            self.cache[token] = out
        return out

    def encode(self, text: str) -> list[int]:
        get, ids = self.cache.get, self.piece_ids
        return list(chain.from_iterable([get(t) or ids(t) for t in self.split.findall(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec_of(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _encode(shared):
    def run(batches):
        codec = shared.value.start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array((codec.encode(t.as_py() or "") for t in batch["text"]), pa.list_(pa.int32()))], names=["row", "ids"])

    return run


def _digests(shared):
    def run(batches):
        codec = shared.value.start()
        for batch in batches:
            n, a, b = [], [], []
            for t in batch["text"]:
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(shared):
    def run(batches):
        codec = shared.value.start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array((codec.decode(i.as_py() or ()) for i in batch["ids"]), pa.binary())], names=["row", "bytes"])

    return run


def _mapped(df: DataFrame, col: str, as_name: str, fn, more: str, drop: tuple[str, ...] = ()) -> DataFrame:
    keep = [c for c in df.columns if c not in drop]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{col}`").alias(as_name)) if keep else df.select(F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{col}`").alias(as_name))
    schema = rows.select("row").schema
    for part in more.split(", "):
        schema = schema.add(*part.split(" "))
    out = rows.mapInArrow(fn, schema)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), *(p.split(" ")[0] for p in more.split(", ") if " " in p))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows with ``ids array<int>``; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec_of(path, pattern))
    keep = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    from pyspark.sql.types import ArrayType, IntegerType

    out = rows.mapInArrow(_encode(shared), rows.select("row").schema.add("ids", ArrayType(IntegerType())))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep if c != "ids"), "ids")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``bytes binary`` of their ids; a column of that name is replaced."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(codec_of(path, pattern))
    return _mapped(encoded, ids_col, "ids", _decode(shared), "bytes binary", ("bytes",))


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The rows without their text, with the count of ids and the SHA-256 of ids and of decoded bytes.

    Encoding and decoding happen in one pass, so that neither ids nor bytes leave the task.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec_of(path, pattern))
    return _mapped(docs, text_col, "text", _digests(shared), "n_tokens long, ids_sha256 string, decoded_sha256 string", (text_col, "n_tokens", "ids_sha256", "decoded_sha256"))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, *default_vocabulary())
