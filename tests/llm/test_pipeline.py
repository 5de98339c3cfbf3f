import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from treeloom.llm import bpe
from treeloom.llm.common import Workspace

SF = "/root/testdata/sf0.001"


def _lines_kept(docs):
    """doc_id -> text without the lines that an earlier document holds."""
    white = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(white))
    held = {}
    for i, t in docs.items():
        for k in {key(line) for line in t.split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = lambda i, k: len(k) >= 10 and len(held[k]) > 1 and i != min(held[k])
    return {i: "\n".join(line for line in t.split("\n") if not gone(i, key(line))) for i, t in docs.items()}


def _alone(docs, percent=80):
    """Ids of one document for each group of near duplicates."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in pairs:
        before = dict(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    return {i for i in sets if group[i] == i}


def test_stages_against_brute_force(spark):
    import tiktoken

    ws, docs = Workspace(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = ws.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        texts.append({r.doc_id: r.text for r in docs.collect()})
    assert texts[1] == texts[0]  # all documents are in a language that was learned
    assert texts[2] == _lines_kept(texts[1]) and docs.where("n_chars <> length(text)").count() == 0
    assert set(texts[3]) == _alone(texts[2]) and all(texts[3][i] == texts[2][i] for i in texts[3])
    mixed = ws.save(corpus_pipeline.STAGES[3][1](spark, docs, SF), "mixed")
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    before, after, most = words(docs), words(mixed), max(len(t.split()) for t in texts[3].values())
    total, shares = sum(before.values()), {s: k % 3 + 1 for k, s in enumerate(sorted(before))}
    level = total / sum(shares.values())
    if all(level * w <= 3 * before[s] for s, w in shares.items()):  # no source is full
        assert all(abs(after[s] - level * w) <= most for s, w in shares.items())
    encoded = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    digest = lambda ids: hashlib.md5(repr(ids).encode()).hexdigest()
    assert sorted((r.doc_id, digest(list(r.ids))) for r in encoded.collect()) == sorted((r.doc_id, digest(enc.encode_ordinary(r.text))) for r in mixed.collect())


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
