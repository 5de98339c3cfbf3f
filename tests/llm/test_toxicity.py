import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"
PLAIN = T._ready(T.Model({}, T.PRIOR, T.BIAS))


def test_composition_equals_cascade():
    parts = [T._negation(), T._target(), T._threat(), T._insult(), T._report()]
    whole = T.grammar()
    rng = np.random.default_rng(3)
    for _ in range(300):
        tape = ["OIVMTNR"[i] for i in rng.integers(0, 7, rng.integers(0, 25))]
        out = tape
        for p in parts:
            out = p.run(out)
        assert whole.run(tape) == out
    assert set(whole.outputs()) == {"O", *T.KINDS}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("What an idiot.", "I"), ("You are an idiot.", "Ia"), ("Idiot, you.", "Ia"), ("This is not an idiot.", "I!"), ("you are not a moron", "Ia!"),
        ("I will kill you.", "Hm"), ("they kill them", "H"), ("I would never hurt you", "Hm!"), ("The report says he is a loser", "rIa"), ("He said I will kill you", "rHm"),
    ],
)
def test_kinds(text, kind):
    assert [k for k, x in zip(T.KINDS, PLAIN.features(text)) if x] == [kind]


def test_clauses_bound_the_scope():
    assert [k for k, x in zip(T.KINDS, PLAIN.features("He said so. An idiot! Never again; a moron"))if x] == ["I"]
    assert not PLAIN.features("Kill the process. You wait.").any() and not PLAIN.features("Nobody spoke to you").any()
    scores = [PLAIN.score(t) for t in ("", "you are not an idiot", "he said she was a loser", "an idiot", "you idiot", "you idiot. you moron.")]
    assert scores == sorted(scores) and scores[2] < T.THRESHOLD <= scores[3]
    assert PLAIN.score(None) == PLAIN.score("") and 0 < scores[0] < scores[-1] <= 1


def test_stems_add_up():
    m = T._ready(T.Model({"gro+": 1.0, "gron+": 0.5, "grob$": -2.0}, T.PRIOR, T.BIAS))
    assert m.symbol("gronk") == ("I", 1.5) and m.symbol("groll") == ("I", 1.0) and m.symbol("grob") == ("O", -1.0) and m.symbol("gro") == ("O", 0.0)


def test_boosting_leaves_what_is_explained():
    toxic = np.arange(100) < 50
    same = toxic.copy()
    rare = np.arange(100) < 20  # stands only where the first does
    other = np.zeros(100, bool)
    assert list(T.boosted(np.column_stack([same, rare, other]), toxic)) == [0]
    assert T.boosted(np.column_stack([same]), np.zeros(100, bool)) == {}


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = T.op13_toxicity(spark, SF).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.predicted == int(r.score >= T.THRESHOLD) for r in out} == {True} and all(0 <= r.score <= 1 for r in out)
    clean, toxic = ([r for r in out if r.toxic == y] for y in (0, 1))
    assert sum(r.predicted for r in clean) == 0
    english = [r.predicted for r in toxic if r.lang == "en"]
    assert sum(english) >= 0.9 * len(english)


def test_learns_a_language(spark):
    rng = np.random.default_rng(1)
    syllables = ["".join(p) for p in itertools.product("bdkl", "aeiou")]
    word = lambda: "".join(rng.choice(syllables, 3))
    rows = []
    for i in range(1200):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[5] = "zur" + word()
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    seen = docs.where("doc_id < 900")
    m = T.fit(seen, labels.where("doc_id < 900").union(labels.where("doc_id < 900")))
    out = T.score(docs.where("doc_id >= 900"), m).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in out)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "You idiot."), (4, "You idiot. " * 60_000), (4, "fine"), (4, "fine"), (5, "İdiot’s won’t ''' \u0000 日本語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "row": F.lit(1), "toxic": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.where("false")):
        out = T.score(docs, T.fit(docs, marks)).collect()
        assert len(out) == len(rows) and {r.row for r in out} == {1}
        by = {r.doc_id: r.score for r in out}
        assert by[1] == by[2] == by[3] <= by[None]
    assert T.score(docs.where("false"), PLAIN).count() == 0
