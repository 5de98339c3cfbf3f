import pytest

from tests.oracle import assert_same
from treeloom.jobs import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)


def test_pack_edges(spark):
    from pyspark.sql import functions as F

    from treeloom.functions import text as T
    from treeloom.operators import chunking as C

    df = spark.createDataFrame([(1, None), (2, ""), (3, "One two. Three four! Five."), (4, "a b c d e f g.")], "i int, t string")
    df = df.select("i", T.sentences(F.col("t")).alias("s"))
    rows = {r.i: [(c.text, c.n_tokens) for c in r.c] for r in df.select("i", C.packed(F.col("s"), F.transform("s", T.token_count), 6).alias("c")).collect()}
    assert rows[1] == rows[2] == []
    assert rows[3] == [("One two. Three four!", 6), ("Five.", 2)]
    assert rows[4] == [("a b c d e f g.", 8)]


def test_unknown_metric():
    from treeloom.functions.vector import distance

    with pytest.raises(Exception):
        distance(None, None, "no")
