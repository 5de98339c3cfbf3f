import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import assert_same
from treeloom.llm import bpe, embedding_dedup, language_id, licenses, line_dedup, lm_scoring, minhash_dedup, mixing, queries, suffix_dedup, topk

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog and runs far away from here today " * 400
P = "a shared passage that stands in several documents and is surely longer than two hundred bytes, " * 3
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, LONG, "en", None), (5, LONG, "en", "a"),
    (6, "Released under the MIT License.\nx " + P, "en", "b"), (7, "y " + P + " z", "de", "b"), (None, "no id. " + P, "en", "b"),
    (8, "ÀÉ unicode   text 12345 ***", "fr", "c"), (8, "ÀÉ unicode   text 12345 ***", "fr", "c"), (9, "aaaa" * 200, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns with names that operators use themselves
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"n_dropped": F.lit("x"), "row": F.lit("y"), "id": F.lit("z"), "score": F.lit("s"), "key": F.lit(1)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect() if r.doc_id}
    assert [(m.license, m.n) for m in got[6].matches] == [("MIT", 1)]
    assert got[1].n_sentences == got[2].n_sentences == 0 and got[1].matches == []
    assert licenses.scan(none).count() == 0


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect() if r.doc_id}
    assert got[4].n_dropped == 0 and got[5].n_dropped == 1 and got[5].text == ""
    assert got[1].n_lines == got[2].n_lines == 1 and got[8].n_dropped == 0 and got[8].key == 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_language(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.queries()["op3_language_id"](spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    model = language_id.fit(d)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(none.select("doc_id", "text", "lang"))).collect()} == {"und"}


def test_lm(docs, none):
    got = {r.id: r for r in lm_scoring.score(docs).collect()}
    assert got[1].n_tokens == 0 and got[1].mean_log_score is None
    assert got[4].n_backoff == 0 and got[7].n_tokens > 0 and got[9].mean_log_score < got[4].mean_log_score
    assert lm_scoring.score(docs, order=3, block_words=20).count() == len(ROWS)
    assert lm_scoring.score(none).count() == 0


def test_bpe(docs, none):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect():
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    assert bpe.digests(none, path, pattern).count() == 0
    codec = bpe.codec_of(path, pattern).start()
    for t in ("x" * 5000, "<|endoftext|>", "  \n\n  a", "日本語 привет", "!" * 300):
        assert codec.encode(t) == enc.encode_ordinary(t)


@pytest.mark.parametrize("anchor_bytes", [1 << 22, 600, 1])
def test_suffix(spark, docs, none, anchor_bytes):
    got = suffix_dedup.remove_repeats(docs.withColumn("n", F.monotonically_increasing_id()), anchor_bytes=anchor_bytes).orderBy("n").collect()
    want = suffix_dedup.brute_force([r[1] for r in ROWS])
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got] == want
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("anchor_bytes", [None, 500])
def test_suffix_table(spark, anchor_bytes):
    if anchor_bytes is None:
        got = queries.queries()["op6_suffix_dedup"](spark, SF)
    else:
        d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        got = suffix_dedup.remove_repeats(d, anchor_bytes=anchor_bytes).withColumn("kept_sha256", F.sha2("kept", 256))
    got = got.orderBy("doc_id").collect()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == suffix_dedup.brute_force(texts)


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0
    assert set(mixing.mixed_documents(docs).columns) == set(docs.columns)
    many = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), bucket_rows=3)
    per = many.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in per)


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [0.0, -1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [])]


def test_embeddings(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("rows", F.lit(3))
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(v).collect()}
    assert got[1] == (3, 1, True) and got[2] == got[3] == got[9] == (3, 1, False)
    assert got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[8] == (0, 8, True)
    assert embedding_dedup.near_duplicates(v.where("false")).count() == 0


def test_topk(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("id", F.lit(3))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") == 1, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 2048 * 1024), (1, 2, 3, 1024 * 1024), (1, 3, 9, 1024 * 1024)]
    assert topk.top_k(v.where("false"), F.lit(True)).count() == 0


def test_topk_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(300)] + [(7, rng.normal(size=3).tolist()), (300, [1e300, 1e300]), (303, [2e300, -1e300])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(v, F.col("vec_id") % 10 == 0, k=4, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    z = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows]
    high = (1 << 63) - 1
    for q, e in z:
        if q % 10 == 0:
            s = sorted((-max(-high - 1, min(high, sum(a * b for a, b in zip(e, c)))), i) for i, c in z if len(c) == len(e) and i != q)
            assert got[q] == [(i, -x) for x, i in s[:4]], q


def test_topk_keeps_scores_at_the_ends_of_a_long(spark):
    rows = [(100, [1.8e6]), (1, [-1.8e6]), (2, [-0.9e6]), (3, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") == 100).orderBy("rank").collect()]
    q = 1024 * 1800000
    assert got == [(1, 3, q * 1024), (2, 2, -q * 1024 * 900000), (3, 1, -q * q)]
    # scores over the whole range of a long, and beyond it on both sides, in few bins
    rng = np.random.default_rng(6)
    xs = [*(rng.uniform(-1, 1, 150) * 3e6).tolist(), 9e9, -9e9, -8e9, 2.96e6, -2.96e6]
    v = spark.createDataFrame([(i, [x]) for i, x in enumerate(xs)], "vec_id long, embedding array<double>")
    z, high = [math.floor(1024 * x) for x in xs], (1 << 63) - 1
    for k in (3, 158):
        got = [(r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id").isin(153, 154), k=k, block=32, bins=8).orderBy("query_id", "rank").collect()]
        want = []
        for q in (153, 154):
            s = sorted((-max(-high - 1, min(high, z[q] * c)), i) for i, c in enumerate(z) if i != q)
            want += [(i, -x) for x, i in s[:k]]
        assert got == want


@pytest.mark.parametrize("block", [4, 512])
def test_blocks_of_full_lists(spark, block):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.integers(0, 120, i % 4):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    link = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    want = list(range(60))
    for _ in range(60):
        for i, j in link:
            want[i] = want[j] = min(want[i], want[j])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in minhash_dedup.near_duplicates(d, block=block).collect()}
    assert [got[i] for i in range(60)] == want
    x = rng.normal(size=(1, 8)) + rng.normal(size=(90, 8)) * 0.35
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    links = {r.id: r.n_links for r in embedding_dedup.near_duplicates(v, block=block).collect()}
    near = (unit @ unit.T >= 0.9).sum(1) - 1
    assert near.sum() > 500 and sum(links.values()) >= 0.99 * near.sum() and all(links[i] <= near[i] for i in range(90))


def test_names_that_clash(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License.", "en", "a", 1, 2, 3, 4)], "doc_id long, text string, lang string, source string, ids int, row int, rows int, copies int")
    d = d.withColumns({c: F.lit(1) for c in ("_ids", "_i", "_t", "_n", "tie", "rest", "key", "lang_pred", "_gone", "id")})
    assert licenses.scan(d).drop("n_sentences", "n_known", "matches").columns == d.columns
    for out in (mixing.mixed_documents(d), corpus_pipeline.dedup_near(spark, d, SF), corpus_pipeline.dedup_lines(spark, d, SF)):
        assert out.columns == d.columns and out.first().rows == 3


def test_digests(docs):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    out = bpe.digests(docs.withColumn("copy", F.col("text")), path, pattern).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = enc.encode_ordinary(r.copy or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.copy or "").encode()).hexdigest())


def test_minhash(docs, none):
    got = {r.id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[5].component_id == 4 and not got[5].kept and got[4].kept
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].component_id == 3
    assert got[7].component_id == 7  # 16 shingles shared with document 6, of 24
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_windows_agree():
    rng = np.random.default_rng(1)
    for _ in range(5):
        s = [bytes(rng.integers(97, 99, int(rng.integers(20, 60)), dtype=np.uint8)) for _ in range(6)]
        flags, at = suffix_dedup.repeated_starts(s, 8), 0
        all_ = [x[i : i + 8] for x in s for i in range(len(x) - 7)]
        for x in s:
            assert [bool(f) for f in flags[at : at + len(x) - 7]] == [all_.count(x[i : i + 8]) > 1 for i in range(len(x) - 7)]
            at += len(x) + 1


def test_embedding_caps_grow_with_the_table():
    caps = []
    for n in (5_000, 50_000, 1_000_000):
        codes, k = embedding_dedup.design(n, 64)
        caps.append(k)
        # pairs that the choice of caps has not seen
        assert embedding_dedup.modelled_misses(64, codes, k, trials=6001) <= 6
    assert caps == sorted(caps) and caps[0] < caps[2]
    # filters at every size, and few dimensions need no more of them
    for n, dim in ((1, 64), (500, 64), (2000, 64), (50_000, 2), (50_000, 7), (10, 1)):
        codes, k = embedding_dedup.design(n, dim)
        assert codes ** embedding_dedup.parts_of(dim) == 256 and k < 40


@pytest.mark.parametrize("n", [60, 500, 3000])
def test_embedding_links_planted_in_64_dimensions(spark, n):
    """Pairs at cosines of 0.85 to 0.95 among vectors that are far from each other; those from 0.9 on are found."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2 * n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = x[n:] - (x[n:] * x[:n]).sum(1, keepdims=True) * x[:n]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = np.linspace(0.85, 0.95, n)[:, None]
    x[n:] = (c * x[:n] + np.sqrt(1 - c * c) * side) * rng.uniform(0.1, 9, (n, 1))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(v).collect()}
    near = c[:, 0] >= 0.9
    found = np.array([got[n + i] == (1, i, False) and got[i] == (1, i, True) for i in range(n)])
    assert found[near].sum() >= 0.999 * near.sum() and all(got[i][0] == got[n + i][0] == 0 for i in np.flatnonzero(~near))


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 16))
    x[2000:] = x[:2000] + rng.normal(size=(2000, 16)) * 0.45
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(v).collect()}
    assert want.sum() > 1500 and sum(got[i] for i in range(4000)) >= 0.999 * want.sum() and all(got[i] <= want[i] for i in range(4000))


def _wrapped(text, start=""):
    import textwrap

    # what follows a colon stands in a paragraph of its own
    return "\n\n".join("\n".join(start + line for line in textwrap.wrap(p, 72 - len(start))) for p in text.split("\n\n"))


def test_every_licence_rule_on_its_wrapped_text(spark):
    s = licenses.SENTENCES
    rows, want = [], {}
    for n, (name, run) in enumerate(licenses.RULES, 1):
        body = " ".join(s[i] for i in run).replace("conditions: ", "conditions:\n\n").replace("are met: ", "are met:\n\n")
        apart = "\n\n".join(_wrapped(s[i]) for i in run)
        items = "\n\n".join(f"{k}. " * (k > 0) + _wrapped(s[i]) for k, i in enumerate(run))
        for k, text in enumerate((_wrapped(body), _wrapped(body, "# "), _wrapped(body, " * "), apart, items, "Some Title\n\n" + apart + "\n\nOther words.")):
            rows.append((10 * n + k, text))
            want[10 * n + k] = [(n, name, 1)]
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
    apache = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
"""
    part = "Licensed under the Apache License, Version 2.0 or later\nReleased under the MIT License. x"
    got = [[m.license for m in r.matches] for r in licenses.scan(spark.createDataFrame([(bsd,), (apache,), (part,)], "text string")).collect()]
    assert got == [["BSD-2-Clause"], ["Apache-2.0"], ["MIT"]]
