import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from treeloom.llm import conversation_repair as R

SF = "/root/testdata/sf0.001"
FIGURES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _cheapest(symbols):
    """(cost, audit) by a search over whole audits, row by row."""

    def with_inserts(now):
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                t = R.NEED_TO[s]
                now[t] = min(now.get(t, (R.FAR, "")), (c + R.INSERT, a + "I"))
        return now

    now = {0: (0, "")}
    for y in symbols:
        then = {}
        for s, (c, a) in with_inserts(now).items():
            for e, k, t in R.options(y, s):
                then[t] = min(then.get(t, (R.FAR, "")), (c + k, a + e))
        now = then
    return min(v for s, v in with_inserts(now).items() if R.ENDS[s])


def test_runs_against_search():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = [s for s in (rng.randrange(9) for _ in range(rng.randrange(8))) for _ in range(rng.choice((1, 1, 2, 5)))]
        assert R.repair(symbols) == _cheapest(symbols)


def test_long_run():
    cost, audit = R.repair([3] * 1001)  # user turns alone
    assert audit.count("D") + audit.count("K") + audit.count("R") == 1001 and cost == 2 + 500


def _sql(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(c.execute(f"SELECT {', '.join(FIGURES)} FROM ({R.OP11_SQL})").fetchall(), key=repr)


@pytest.mark.parametrize("piece", [3, R.PIECE])
def test_edges_against_sql(spark, piece):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Fine.", "Cut", "", " \t\n", None, "What? ", "Fine.", "Yes!\n", "a long text. " * 3000]
    rows = [(i, t, rng.choice(roles), rng.choice(texts)) for i in [*range(60), None] for t in [None, *range(rng.randrange(12))] if rng.random() < 0.8]
    rows += [(100, t // 2, "user", "Again.") for t in range(40)] + [(101, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(40)] + [(0, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "pos": F.lit("x"), "kind": F.lit(None)})
    got = R.repaired(R.damaged(df), df, piece=piece).select(*FIGURES).collect()
    assert sorted(map(tuple, got), key=repr) == _sql(rows)


def test_empty(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").where("false")
    assert R.repaired(R.damaged(df), df).count() == 0


def test_query_against_sql(spark):
    assert_same(spark, R.op11_conversation_repair, R.OP11_SQL, SF)
