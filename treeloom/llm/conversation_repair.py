"""Conversation structure repair by a run-length dynamic programme.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. The cheapest edits (keep,
rerole, delete, insert) are a shortest path through four states: nothing yet, after a system turn,
after a user turn, after an assistant turn. A row's effect depends on its symbol alone (role and
fault), so it is a 4 x 4 matrix in min-plus arithmetic; equal consecutive symbols are a run, whose matrix
is put together from cached binary powers of the symbol's. Costs to the end go backwards through the
runs, and the audit is unrolled forwards by taking the ASCII-least edit that keeps to them.

Rows are put in order by range, so a conversation of any length lies over many tasks. Each task cuts
its rows into pieces of at most ``PIECE`` rows and gives a piece's runs and matrix; one pass over
the pieces, last first, gives the costs behind each piece, one forward pass the state before each,
both with one piece in memory at a time. Texts join the kept rows by key and stream into the digest in order.

Cases: a null conv_id is a conversation of its own; a null role or text is one space; rows of one turn
stand by role and the SHA-256 of their row's key; repeated rows are duplicates; a conversation that loses
all its rows has zeros, an empty audit and the digest of an empty string; roles beyond system, user and
assistant can only be reroled or deleted; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import WS, Workspace, join_by_key

#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows of a piece at most.
PIECE = 8192
FAR = 1 << 60
#: Where the role a state needs leads to, that role, and where each initial leads from a state.
NEED_TO, NEED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP_TO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (True, False, False, True)
#: Symbol 0 must be deleted; others are 1 + 2 * index of the initial (the last one: any other) + truncated.
INITIALS = "sua"


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _inserts() -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        t, cost = s, 0
        for _ in range(3):
            m[s, t] = min(m[s, t], cost)
            t, cost = NEED_TO[t], cost + INSERT
    return m


BEFORE = _inserts()
#: Cost from each state to an end by inserts alone.
LAST = np.minimum((BEFORE + np.where(ENDS, 0, FAR)[None, :]).min(1), FAR)


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row, edits in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        to = KEEP_TO[state].get(INITIALS[kind]) if kind < 3 else None
        if to is not None:
            out.append(("K", CUT * cut, to))
        out.append(("R", REROLE + CUT * cut, NEED_TO[state]))
    return out


@lru_cache(None)
def power(symbol: int, k: int) -> np.ndarray:
    """Matrix of 2**k rows of a symbol, inserts before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    m = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        for _, cost, t in options(symbol, s):
            m[s, t] = min(m[s, t], cost)
    return times(BEFORE, m)


def through_run(symbol: int, n: int, behind: np.ndarray) -> np.ndarray:
    """Costs before n rows of a symbol from those behind them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            behind = times(power(symbol, k), behind)
    return behind


def _unpack(runs: bytes) -> list[tuple[int, int]]:
    return [tuple(x) for x in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist()]


def _remembered(f, size: int = 20_000, nbytes: int = 256):
    """Keeps results for short runs, which most conversations share; long ones are not held."""
    kept = lru_cache(size)(f)
    return lambda runs, *rest: (kept if len(runs) <= nbytes else f)(runs, *rest)


@_remembered
def matrix(runs: bytes) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, n in reversed(_unpack(runs)):
        m = through_run(symbol, n, m)
    return m


@_remembered
def unroll(runs: bytes, behind: tuple[int, ...], is_last: bool) -> tuple[tuple[str, int], ...]:
    """For each state before the rows: the audit of the cheapest edits, ASCII-least, and the state behind them.

    The audit names a system turn that is kept S, so that the states between can be told from it.
    """
    runs_ = _unpack(runs)
    after = [np.array(behind)[:, None]]
    for symbol, n in reversed(runs_):
        after.append(through_run(symbol, n, after[-1]))
    after.reverse()
    states, audits = list(range(4)), [[] for _ in range(4)]
    for (symbol, n), end in zip(runs_, after[1:]):
        costs = [end[:, 0].tolist()]  # behind each row of the run, last first
        for _ in range(n):
            costs.append(times(power(symbol, 0), np.array(costs[-1])[:, None])[:, 0].tolist())
        for i in range(n, 0, -1):
            here, then = costs[i], costs[i - 1]
            for k in range(4):
                while here[states[k]] < FAR:
                    s = states[k]
                    edits = options(symbol, s)
                    found = next(((e, t) for e, c, t in edits[:1] if c + then[t] == here[s]), None)
                    if not found and INSERT + here[NEED_TO[s]] == here[s]:
                        audits[k].append("I")
                        states[k] = NEED_TO[s]
                        continue
                    e, states[k] = found or next((e, t) for e, c, t in edits[1:] if c + then[t] == here[s])
                    audits[k].append("S" if e == "K" and states[k] == 1 else e)
                    break
    for k in range(4):
        while is_last and not ENDS[states[k]]:
            audits[k].append("I")
            states[k] = NEED_TO[states[k]]
    return tuple(("".join(a), s) for a, s in zip(audits, states))


def repair(symbols: list[int]) -> tuple[int, str]:
    """(cost, audit) of the rows of one conversation, for tests and small uses."""
    runs = np.array([(s, len(list(g))) for s, g in groupby(symbols)], "<i4").reshape(-1, 2).tobytes()
    cost = int(times(matrix(runs), LAST[:, None])[0, 0])
    return cost, unroll(runs, tuple(LAST.tolist()), True)[0][0].replace("S", "K")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by the CRC of conv_id and turn: (conv_id, turn, role, text)."""
    space = F.lit(" ")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    c = c.withColumn("how", (F.crc32(name.cast("binary")) % 20).cast("int")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times_ = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times_).alias("copy")).drop("copy")


def _key():
    """Equal for rows of a conversation with the same role and text."""
    parts = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    return F.unhex(F.sha2(parts.cast("binary"), 256))


_STATS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_PIECE = f"conv_id long, pos long, {_STATS}, runs binary, keys binary"


def _types(ddl: str) -> dict:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return {n: kinds[t] for n, t in (x.split(" ") for x in ddl.split(", "))}


def _batches(rows, ddl: str, size: int = 1000, nbytes: int = 4 << 20):
    """Record batches of rows (tuples), bounded in rows and bytes of binary and text values."""
    types, held, weight = _types(ddl), [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.values())], names=list(types))

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= nbytes:
            yield out()
            held, weight = [], 0
    if held:
        yield out()


def _tuples(batches, *cols):
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in cols))


LEGAL = {"su", "ua", "au"}


def _pieces(batches):
    """Runs and figures of the rows that stand together, in order, in one segment of one conversation."""

    def rows():
        source = _tuples(batches, "conv_id", "seg", "pos", "turn", "initial", "blank", "duplicate", "open", "key")
        for (conv, _), group in groupby(source, lambda r: r[:2]):
            group = list(group)  # at most PIECE
            runs, kinds = [], [0, 0, 0]
            turns = {r[3] for r in group if r[3] is not None}
            illegal = sum(a[4] + b[4] not in LEGAL for a, b in zip(group, group[1:]))
            for _, _, _, _, initial, blank, duplicate, is_open, _ in group:
                fault = 0 if blank else 1 if duplicate else 2 if is_open else 3
                if fault < 3:
                    kinds[fault] += 1
                symbol = 0 if fault < 2 else 1 + 2 * (INITIALS.find(initial) if initial in ("s", "u", "a") else 3) + (fault == 2)
                if runs and runs[-1][0] == symbol:
                    runs[-1][1] += 1
                else:
                    runs.append([symbol, 1])
            yield conv, group[0][2], len(group), *kinds, illegal, len(turns), min(turns, default=None), max(turns, default=None), group[0][4], group[-1][4], np.array(runs, "<i4").tobytes(), b"".join(r[8] for r in group)

    return _batches(rows(), _PIECE)


_VALUED = f"{_PIECE}, cost long, behind array<long>, is_last boolean"
_PIECE_COLS = [x.split(" ")[0] for x in _PIECE.split(", ")]


def _behind(batches):
    """Pieces of a conversation, last first: the costs behind each, and from its start if nothing stood before."""

    def rows():
        for _, group in groupby(_tuples(batches, *_PIECE_COLS), lambda r: r[0]):
            value, is_last = LAST, True
            for r in group:
                # only differences decide, so the costs behind are given less their least
                low = int(value.min())
                own = np.minimum(value, FAR)
                value = times(matrix(r[-2]), own[:, None])[:, 0]
                yield *r, int(value[0]), [min(int(v) - low, FAR) for v in own], is_last
                is_last = False

    return _batches(rows(), _VALUED)


_EDITED = f"conv_id long, pos long, {_STATS}, cost long, keys binary, audits array<string>, exits array<int>"


def _unrolled(batches):
    def rows():
        for r in _tuples(batches, *_PIECE_COLS, "cost", "behind", "is_last"):
            out = unroll(r[-5], tuple(r[-2]), r[-1])
            yield *r[:-5], r[-3], r[-4], [a for a, _ in out], [s for _, s in out]

    return _batches(rows(), _EDITED)


#: kind 1: figures of a piece; kind 2: a line of the repaired conversation (without key: inserted).
_EDITS = "conv_id long, kind int, pos long, sub int, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, cost long, audit string, key binary, role string"


def _forward(batches):
    """Pieces of a conversation, first first: the audit of each from the state it is met in, and its lines."""

    def rows():
        cols = [x.split(" ")[0] for x in _EDITED.split(", ")]
        for conv, group in groupby(_tuples(batches, *cols), lambda r: r[0]):
            state, before = 0, None
            for r in map(lambda t: dict(zip(cols, t)), group):
                audit = r["audits"][state]
                illegal, turns = r["illegal"], r["turns"]
                if before:
                    illegal += before["last_initial"] + r["first_initial"] not in LEGAL
                    turns -= before["last_turn"] is not None and before["last_turn"] == r["first_turn"]
                yield conv, 1, r["pos"], 0, r["n"], r["blank"], r["duplicate"], r["truncated"], illegal, turns, r["first_turn"], r["last_turn"], None if before else r["cost"], audit.replace("S", "K"), None, None
                i, s = 0, state
                for sub, edit in enumerate(audit):
                    key, role = r["keys"][32 * i : 32 * i + 32], NEED[s] if edit in "IR" else None
                    if edit != "I":
                        i += 1
                    if edit != "D":
                        s = 1 if edit == "S" else NEED_TO[s]
                    if edit != "D":
                        yield conv, 2, r["pos"], sub, *(None,) * 10, None if edit == "I" else key, role
                state, before = r["exits"][state], r

    return _batches(rows(), _EDITS)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _results(batches):
    """One row for each conversation from its mark, its pieces and its lines, in this order."""

    def rows():
        cols = ("conv_id", "kind", "pos", "sub", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost", "audit", "role", "text")
        for conv, group in groupby(_tuples(batches, *cols), lambda r: r[0]):
            digest, first, audit = hashlib.sha256(), True, []
            sums, low, high, distinct, cost = [0] * 4, None, None, 0, 0
            for _, kind, _, _, blank, duplicate, truncated, illegal, turns, first_turn, last_turn, own, edits, role, text in group:
                if kind == 1:
                    sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal))]
                    distinct, cost = distinct + turns, cost + (own or 0)
                    audit.append(edits)
                    if first_turn is not None:
                        low = first_turn if low is None else min(low, first_turn)
                        high = last_turn if high is None else max(high, last_turn)
                elif kind == 2:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            yield conv, 0 if low is None else high - low + 1 - distinct, *sums, cost, "".join(audit), digest.hexdigest()

    return _batches(rows(), _RESULT)


def repaired(rows: DataFrame, conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Figures, cost, audit and digest of each conversation.

    ``rows`` (conv_id, turn, role, text; no nulls in role and text) are what is there; ``conversations`` has
    every conv_id that is to be returned.
    """
    ws = Workspace(rows.sparkSession, "conversations")
    trimmed = F.rtrim("text", F.lit(WS))
    small = rows.select("conv_id", "turn", "role", _key().alias("key"), F.substring("role", 1, 1).alias("initial"), (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # rows of one conversation, turn and role are equal if their keys are; a number deals even those to several tasks
    small = small.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key", "tie"]
    ordered = small.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "tie").withColumn("pos", F.monotonically_increasing_id())
    ordered = ws.save(ordered, "ordered")
    # most keys stand once; rows of the others are told apart by their first position
    firsts = ws.save(ordered.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    again = join_by_key(ordered.select("key", "pos"), firsts, "key", "n").where("pos > first").select("pos", F.lit(True).alias("duplicate"))
    flagged = ordered.join(again, "pos", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    flagged = flagged.withColumn("seg", F.expr(f"pos div {piece}")).repartition("seg").sortWithinPartitions("pos")
    pieces = ws.save(flagged.mapInArrow(_pieces, _PIECE), "pieces")
    by_end = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
    valued = ws.save(by_end.mapInArrow(_behind, _VALUED), "valued")
    edited = valued.mapInArrow(_unrolled, _EDITED).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    edits = ws.save(edited.mapInArrow(_forward, _EDITS), "edits")
    texts = rows.select(_key().alias("key"), F.struct("role", "text").alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    lines = edits.where("kind = 2")
    kept = lines.where("key IS NOT NULL").join(texts, "key").withColumns({"role": F.coalesce("role", "row.role"), "text": F.col("row.text")}).drop("row")
    marks = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    rest = edits.where("kind = 1 OR key IS NULL").withColumn("text", F.lit(""))
    every = kept.unionByName(rest).unionByName(marks, allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "pos", "sub").mapInArrow(_results, _RESULT)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(c), c)


OP11_SQL = r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten([[((ord(k[i]) >> b) & 1)::BIGINT FOR b IN range(8)] FOR i IN range(1, length(k) + 1)]),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS how FROM named),
hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
    sha256(coalesce(conv_id::VARCHAR, ' ') || ':' || length(role) || ':' || role || ':' || text), copy) AS i FROM hurt),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_r FROM placed),
jump(s, t, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'),
    (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edit(s, t, e, r) AS (VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 2, 'R', ''), (1, 2, 'R', ''), (2, 3, 'R', ''), (3, 2, 'R', ''),
    (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u')),
named_state(s, n) AS (VALUES (2, 'user'), (3, 'assistant')),
step AS (SELECT f.conv_id, f.i, j.s, e.t, j.c + CASE e.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
      + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS c, j.a || e.e AS a,
    CASE j.a WHEN 'I' THEN [(SELECT n FROM named_state WHERE s = j.t) || ':'] WHEN 'II' THEN ['user:', 'assistant:'] ELSE [] END
      || CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] END AS lines
  FROM faults f JOIN edit e ON e.e = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.e = 'R' OR e.r = f.r)) JOIN jump j ON j.t = e.s),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS c, '' AS a, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT conv_id, i, t, min(c), arg_min(a, (c, a)), arg_min(lines, (c, a)) FROM (
    SELECT b.conv_id, p.i, p.t, b.c + p.c AS c, b.a || p.a AS a, b.lines || p.lines AS lines
    FROM best b JOIN step p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i + 1 AND p.s = b.s) GROUP BY conv_id, i, t),
ended AS (SELECT b.conv_id, b.c + j.c AS c, b.a || j.a AS a,
    b.lines || CASE j.a WHEN 'I' THEN [(SELECT n FROM named_state WHERE s = j.t) || ':'] WHEN 'II' THEN ['user:', 'assistant:'] ELSE [] END AS lines
  FROM best b JOIN (SELECT conv_id, max(i) AS i FROM faults GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i
  JOIN jump j ON j.s = b.s WHERE j.t IN (0, 3)),
won AS (SELECT conv_id, min(c) AS cost, arg_min(a, (c, a)) AS audit, arg_min(lines, (c, a)) AS lines FROM ended GROUP BY conv_id),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_r IS NOT NULL AND r || next_r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
