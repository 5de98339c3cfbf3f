"""Queries over texts: tokens, types, profiles, sections, chunks, contexts, contents that repeat."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import embedding as E
from treeloom.functions import text as T
from treeloom.operators import chunking as C
from treeloom.operators import retriever as V
from treeloom.sources.embedding_store import EmbeddingStore
from treeloom.sources.scratch import shared_folder


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _marked_up(spark, sf):
    """The documents as markdown: lines that begin with A to M are headers, those with N to P list items."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?md)^(?=[A-M])", "## "), r"(?md)^(?=[N-P])", "- ")
    return _docs(spark, sf).select("doc_id", text.alias("text"))


def token_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


def _types(docs):
    score = T.markdown_score(F.col("text"))
    return docs.select("doc_id", F.round(score, 6).alias("score"), T.document_type(score).alias("doc_type"))


def doc_type(spark, sf):
    return _types(_docs(spark, sf))


def markdown_type(spark, sf):
    return _types(_marked_up(spark, sf))


def content_profile(spark, sf):
    c = F.col("text")
    return _marked_up(spark, sf).select(
        "doc_id", F.round(T.mean_line(c), 6).alias("mean_line"), F.round(T.mean_sentence(c), 6).alias("mean_sentence"), F.round(T.code_ratio(c), 6).alias("code_ratio"),
        F.round(T.list_density(c), 6).alias("list_density"), T.header_count(c).cast("long").alias("headers"), T.paragraph_count(c).cast("long").alias("paragraphs"),
    )


def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def markdown_sections(spark, sf):
    s = _marked_up(spark, sf).select("doc_id", F.posexplode(C.sections(F.col("text"))).alias("pos", "s"))
    return s.select("doc_id", "pos", F.col("s.level").alias("level"), F.col("s.title").alias("title"), F.col("s.content").alias("content"))


def _packed(docs, limit=100):
    d = docs.select("doc_id", T.sentences(F.col("text")).alias("items"))
    return d.select("doc_id", C.packed(F.col("items"), F.transform("items", T.token_count), limit).alias("chunks"))


def greedy_chunks(spark, sf):
    return C.exploded(_packed(_docs(spark, sf)), "doc_id")


def semantic_boundaries(spark, sf):
    """Places of sentences that are unlike the one before by letter shares."""
    s = _docs(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("s"))
    b = s.select("doc_id", F.posexplode(C.boundaries(F.transform("s", T.letter_vector), F.lit(0.75))).alias("pos", "b"))
    return b.where("b").select("doc_id", "pos")


def chunk_documents(spark, sf):
    """Chunks of all documents: adapted threshold, semantic boundaries, packing, quality, fallback.

    The documents have no headers, so the SQL takes one that counts as markdown for one section.
    """
    return C.exploded(C.chunks(_docs(spark, sf)), "doc_id", "fallback")


def chunk_markdown(spark, sf):
    """Chunks of the documents as markdown: by sections, with the last sentence of the chunk before."""
    return C.exploded(C.chunks(_marked_up(spark, sf), C.Chunking(overlap=1)), "doc_id", "doc_type", "fallback")


def chunk_quality(spark, sf):
    """Each greedy chunk's quality, and whether it is kept."""
    c = C.exploded(_packed(_docs(spark, sf)), "doc_id").withColumn("q", C.quality(F.col("text"), F.col("n_tokens"), C.Chunking()))
    return c.select("doc_id", "pos", F.round("q", 6).alias("quality"), (F.col("q") >= 0.8).alias("kept"))


def document_quality(spark, sf):
    """Each document's mean quality of chunks, and how many of them are kept."""
    c = C.exploded(_packed(_docs(spark, sf)), "doc_id").withColumn("q", C.quality(F.col("text"), F.col("n_tokens"), C.Chunking()))
    return c.groupBy("doc_id").agg(F.round(F.avg("q"), 6).alias("quality"), F.count("*").alias("n_chunks"), F.count_if(F.col("q") >= 0.8).alias("n_kept"))


def overlap_chunks(spark, sf):
    """The last two sentences of the chunk before go ahead, if both stay within 1.2 times 100 tokens."""
    c = _packed(_docs(spark, sf))
    return C.exploded(c.withColumn("chunks", C.overlapped(F.col("chunks"), C.Chunking(overlap=2))), "doc_id")


def legacy_chunks(spark, sf):
    c = C.legacy_chunks(_docs(spark, sf), 60, 1)
    return c.select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


def input_sizing(spark, sf):
    """Size, estimate of chunks and suggested parameters of each document, a thousandth of the limits of a whole input."""
    mb = F.octet_length("text") / F.lit(1 << 20)
    d = _docs(spark, sf).select("doc_id", mb.alias("mb"), F.greatest(F.lit(1), F.floor(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) / 75)).alias("chunks"))
    tier = lambda a, b, c: F.when(F.col("mb") < 0.001, a).when(F.col("mb") < 0.01, b).otherwise(c)
    return d.select("doc_id", F.round("mb", 9).alias("mb"), "chunks", tier(150, 120, 100).alias("chunk_size"), tier(3, 4, 5).alias("num_layers"), tier(50, 100, 150).alias("batch_size"))


def context_assembly(spark, sf):
    """Each conversation's turns in order, lines joined by a space, blocks parted by a blank line."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(T.one_line(F.col("text")), F.lit("\n\n")).alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "").alias("context"))


def _results(spark, sf):
    """What queries found: documents as contexts, their own start as the query, by source."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("source").alias("batch"), F.col("doc_id").alias("pos"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.col("text").alias("context"))


def content_dedupe(spark, sf):
    c = V.several_queries(_results(spark, sf))
    return c.select("batch", "content_no", "primary_query", F.array_join("additional_queries", ",").alias("additional_queries"), "preview", F.md5("context").alias("context"))


def dedupe_stats(spark, sf):
    return V.dedupe_stats(V.several_queries(_results(spark, sf)))


def combined_context(spark, sf):
    """The deduplicated turns of each conversation as one numbered document."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("query"), F.col("text").alias("context"))
    return V.combined(V.several_queries(c)).withColumn("document", F.md5("document"))


def _asked(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


def query_analysis(spark, sf):
    return V.analysed(_asked(spark, sf)).drop("query").withColumn("mean_word", F.round("mean_word", 6))


def adapt_params(spark, sf):
    return V.adapted(V.analysed(_asked(spark, sf))).select("conv_id", "turn", "top_k", F.round("threshold", 6).alias("threshold"), "max_tokens")


def extractive_answer(spark, sf):
    """The sentence of a conversation's next answer that has most of the question's words."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return V.answered(q.join(a, ["conv_id", "turn"])).select("conv_id", "turn", "answer")


def cache_key(spark, sf):
    return _docs(spark, sf).select("doc_id", E.cache_key(F.col("text")).alias("cache_key"))


def prefixed_texts(spark, sf):
    """Digests of what an embedder with prefixes gets: user turns as queries, other turns as passages."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("query: "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return c.select("conv_id", "turn", F.md5(E.prefixed(F.col("text"))).alias("prepared"))


def model_vectors(spark, sf):
    """Two models' vectors of a text as a map, here by their first numbers."""
    models = {"letters": T.letter_vector, "length": lambda t: F.array(F.length(t).cast("double"))}
    m = _docs(spark, sf).select("doc_id", E.vectors_of(F.col("text"), models).alias("m"))
    return m.select("doc_id", F.round(F.get(F.col("m")["letters"], F.lit(0)), 6).alias("letters"), F.get(F.col("m")["length"], F.lit(0)).alias("length"))


def cached_batch(spark, sf):
    """Vectors of all texts: labelled documents' come from a cache, the others are made, each distinct text once."""
    d = _docs(spark, sf)
    known = d.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(E.cache_key(F.col("text")).alias("cache_key"), T.letter_vector(F.col("text")).alias("vector")).dropDuplicates(["cache_key"])
    v = E.cached_vectors(d, cache, T.letter_vector)
    return v.select("doc_id", "cached", *(F.round(F.get("vector", F.lit(i)), 6).alias(f"v_{c}") for i, c in enumerate(T.LETTERS)))


def stored_batch(spark, sf):
    """Vectors of all texts by a store in buckets: those of labelled documents are 30 days old and unread, toxic ones' of today; the others are made."""
    d, labels = _docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    today = dt.date(2024, 3, 31)
    name = f"stored_batch_{uuid.uuid4().hex}"
    store = EmbeddingStore(spark, name, f"{shared_folder(spark)}/{name}")
    for rows, day in ((labels, today - dt.timedelta(days=store.ttl)), (labels.where("toxic = 1"), today)):
        texts = d.join(rows.select("doc_id"), "doc_id", "left_semi").select(E.cache_key(F.col("text")).alias("cache_key"), "text").dropDuplicates(["cache_key"])
        store.add(texts.select("cache_key", T.letter_vector(F.col("text")).alias("vector")), day)
    v = store.vectors(d, T.letter_vector, today)
    return v.select("doc_id", "cached", *(F.round(F.get("vector", F.lit(i)), 6).alias(f"v_{c}") for i, c in enumerate(T.LETTERS)))


def request_stats(spark, sf):
    """Statistics of embedding requests, here the events: views come from the cache, values are their sizes."""
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_type") == "view").alias("cache_hit"), F.col("value").alias("batch_size"), (F.col("value") / 1000).alias("seconds"))
    return E.request_stats(e).select("total", *(F.round(c, 6).alias(c) for c in ("hit_rate", "avg_time", "batch_share")))


def budget_prefix(spark, sf):
    """A source's first documents within 3500 tokens. A text has a token at least, so the rank limit comes before the shuffle."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens")).where("n_tokens > 0")
    w = Window.partitionBy("source").orderBy("doc_id")
    d = d.withColumn("rank", F.row_number().over(w)).where("rank <= 3500")
    return d.withColumn("upto", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= 3500").select("source", "doc_id", "upto")


QUERIES = {
    f.__name__: f
    for f in (
        token_count, doc_type, markdown_type, content_profile, sentence_split, markdown_sections, greedy_chunks, semantic_boundaries, chunk_documents, chunk_markdown, chunk_quality, document_quality, overlap_chunks, legacy_chunks,
        input_sizing, context_assembly, content_dedupe, dedupe_stats, combined_context, query_analysis, adapt_params, extractive_answer, cache_key, prefixed_texts, model_vectors, cached_batch, stored_batch, request_stats, budget_prefix,
    )
}

_TOK = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"


class _Sql(str):
    """SQL with places {0}, {1} ..., and other braces as they are."""

    def format(self, *parts):
        out = str(self)
        for i, part in enumerate(parts):
            out = out.replace(f"{{{i}}}", part)
        return out


_N = _Sql("len(regexp_extract_all({0}, '" + _TOK + "'))")
_CUT = _Sql(r"string_split(regexp_replace(coalesce({0}, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")
_RAW = _Sql(f"list_filter({_CUT}, lambda s: regexp_matches(s, '\\S'))")
_SENT = _Sql(f"list_transform({_RAW}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))")
_MARKED = r"m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^([A-M])', '## \1', 'g'), '(?m)^([N-P])', '- \1', 'g') AS text FROM documents)"
# The nine marks once more, as this engine writes them.
_MARKS = [r"^#{1,6}\s+", r"```[\s\S]*?```", r"^\s*[-*+]\s+", r"^\s*\d+\.\s+", r"\|.*\|", r"^\s*>\s+", r"\[.*\]\(.*\)", r"\*\*.*\*\*", r"\*.*\*"]
_SCORE = "(" + " + ".join(f"len(regexp_extract_all(text, '(?m){p}'))" for p in _MARKS) + ")::DOUBLE / greatest(len(string_split(text, chr(10))), 1)"
_TYPE = "CASE WHEN s > 0.1 THEN 'markdown' WHEN s > 0.02 THEN 'mixed' ELSE 'plain_text' END"
_MEAN = _Sql("coalesce(list_avg([length(s)::DOUBLE FOR s IN {0}]), 0)")
_FILLED_LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))"
_SENTENCE_MEAN = _MEAN.format(r"list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))")
_CODE = r"len(regexp_extract_all(text, '```[\s\S]*?```'))::DOUBLE / len(string_split(text, chr(10)))"


def _fold(source, items):
    """Greedy packing of (s, n, open) lists to 100 tokens."""
    return f"""list_reduce(list_transform({items}, lambda x: {{'done': []::STRUCT(text VARCHAR, n_tokens INTEGER)[], 'cur': x.s, 'n': x.n::INTEGER, 'open': x.open}}), lambda a, b: CASE
    WHEN a.cur IS NULL THEN {{'done': a.done, 'cur': b.cur, 'n': b.n, 'open': false}}
    WHEN b.open OR a.n + b.n > 100 THEN {{'done': list_append(a.done, {{'text': a.cur, 'n_tokens': a.n}}), 'cur': b.cur, 'n': b.n, 'open': false}}
    ELSE {{'done': a.done, 'cur': a.cur || ' ' || b.cur, 'n': a.n + b.n, 'open': false}} END,
    {{'done': []::STRUCT(text VARCHAR, n_tokens INTEGER)[], 'cur': NULL::VARCHAR, 'n': 0::INTEGER, 'open': false}}) AS a FROM {source}"""


_DONE = "CASE WHEN a.cur IS NULL THEN a.done ELSE list_append(a.done, {'text': a.cur, 'n_tokens': a.n}) END"
_CHUNKS = f"""
f AS (SELECT doc_id, {_fold("documents", f"list_transform({_SENT.format('text')}, lambda s: {{'s': s, 'n': {_N.format('s')}, 'open': false}})")}),
l AS (SELECT doc_id, {_DONE} AS c FROM f),
k AS (SELECT doc_id, pos, c.text AS text, c.n_tokens AS n_tokens FROM (SELECT doc_id, (unnest(range(len(c))))::INTEGER AS pos, unnest(c) AS c FROM l))"""
_Q = _Sql(r"((CASE WHEN {0}.n_tokens BETWEEN 20 AND 100 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) + (CASE WHEN length(regexp_replace({0}.text, '^\s+|\s+$', '', 'g')) < 10 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN (length({0}.text) - length(replace({0}.text, chr(10), ''))) / length({0}.text)::DOUBLE > 0.1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)) / 2")
_VEC = _Sql("[(length(lower({0})) - length(replace(lower({0}), c, '')))::DOUBLE / greatest(length(lower({0})), 1) FOR c IN [" + ", ".join(f"'{c}'" for c in T.LETTERS) + "]]")
_DOT = _Sql("list_sum([{0}[j] * {1}[j] FOR j IN range(1, " + str(len(T.LETTERS) + 1) + ")])")
_OPEN = f"""
t AS (SELECT doc_id, 0.75 * CASE WHEN {_SENTENCE_MEAN} > 100 THEN 0.9 ELSE 1.0 END::DOUBLE * CASE WHEN {_CODE} > 0.1 THEN 0.8 ELSE 1.0 END::DOUBLE AS adapted, {_SENT.format('text')} AS s FROM documents),
x AS (SELECT doc_id, adapted, unnest(s) AS s, unnest(range(len(s)))::INTEGER AS pos FROM t),
y AS (SELECT *, {_N.format('s')} AS n, {_VEC.format('s')} AS v FROM x),
z AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM y),
o AS (SELECT doc_id, pos, s, n, adapted, {_DOT.format('v', 'w')} / nullif(sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('w', 'w')}), 0) AS sim FROM z)"""
_ONE = _Sql(r"regexp_replace(regexp_replace({0}, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g')")
_PLAIN = r"regexp_replace(regexp_replace(context, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_DED = f"SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY min(pos)) - 1)::INTEGER AS content_no, list(query ORDER BY pos) AS q, min_by(context, pos) AS context, plain FROM (SELECT *, {_PLAIN} AS plain FROM r) GROUP BY batch, plain"
_R = "r AS (SELECT source AS batch, doc_id AS pos, 'q' || doc_id AS query, text AS context FROM documents)"
_QA = r"SELECT *, (n_words * (1 + len(regexp_extract_all(query, '[,;]'))))::BIGINT AS complexity FROM (SELECT conv_id, turn, text AS query, length(text)::BIGINT AS length, len(w)::BIGINT AS n_words, round(coalesce(list_sum([length(x) FOR x IN w])::DOUBLE / greatest(len(w), 1), 0), 6) AS mean_word, regexp_matches(lower(text), 'what|how|why|when|where|who') AS has_questions, regexp_matches(lower(text), 'specific|detail|exactly|precise') AS has_specifics FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM conversations WHERE role = 'user'))"
_WORDS = _Sql(r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{L}\p{N}]+'), lambda w: w <> ''))")
_KNOWN = "(SELECT coalesce(text, '') FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
_KNOWN_TODAY = "(SELECT coalesce(text, '') FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"

ORACLES = {
    "token_count": f"SELECT doc_id, {_N.format('text')}::BIGINT AS n_tokens FROM documents",
    "doc_type": f"SELECT doc_id, round(s, 6) AS score, {_TYPE} AS doc_type FROM (SELECT doc_id, {_SCORE} AS s FROM documents)",
    "markdown_type": f"WITH {_MARKED} SELECT doc_id, round(s, 6) AS score, {_TYPE} AS doc_type FROM (SELECT doc_id, {_SCORE} AS s FROM m)",
    "content_profile": rf"WITH {_MARKED} SELECT doc_id, round({_MEAN.format(_FILLED_LINES)}, 6) AS mean_line, round({_SENTENCE_MEAN}, 6) AS mean_sentence, round({_CODE}, 6) AS code_ratio, round(len(regexp_extract_all(text, '(?m)^\s*[-*+\d]+\.?\s+'))::DOUBLE / len(string_split(text, chr(10))), 6) AS list_density, len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+'))::BIGINT AS headers, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S')))::BIGINT AS paragraphs FROM m",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents) SELECT doc_id, (unnest(range(len(s))))::INTEGER AS pos, unnest(s) AS sentence FROM s",
    "markdown_sections": rf"WITH {_MARKED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h), s AS (SELECT doc_id, sec, min_by(line, i) AS first, bool_or(head) AS head, string_agg(line || chr(10), '' ORDER BY i) AS content FROM g GROUP BY doc_id, sec) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS pos, CASE WHEN head THEN length(regexp_extract(first, '^(#+)', 1)) ELSE 0 END::INTEGER AS level, CASE WHEN head THEN regexp_extract(first, '^#{{1,6}}\s+(.*)', 1) ELSE '' END AS title, content FROM s WHERE regexp_matches(content, '\S')",
    "greedy_chunks": f"WITH {_CHUNKS} SELECT * FROM k",
    "semantic_boundaries": f"WITH {_OPEN} SELECT doc_id, pos FROM o WHERE sim < 0.75",
    "chunk_documents": f"""WITH {_OPEN},
i AS (SELECT doc_id, list({{'s': s, 'n': n, 'open': coalesce(sim < adapted, false)}} ORDER BY pos) AS items FROM o GROUP BY doc_id),
w AS (SELECT doc_id, {_SCORE} > 0.1 AND {_N.format('text')} <= 100 AS whole, {_N.format('text')} AS n, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
p AS (SELECT i.doc_id, CASE WHEN whole THEN [{{'s': w.t, 'n': w.n, 'open': false}}] ELSE items END AS items FROM i JOIN w ON w.doc_id = i.doc_id),
f AS (SELECT doc_id, {_fold("p", "items")}), c AS (SELECT doc_id, {_DONE} AS c FROM f),
q AS (SELECT doc_id, list_transform(c, lambda x: {{'text': x.text, 'n_tokens': x.n_tokens, 'q': {_Q.format('x')}}}) AS c FROM c),
b AS (SELECT doc_id, c, list_avg([x.q FOR x IN c]) < 0.8 AS fallback FROM q),
rf AS (SELECT doc_id, {_fold("(SELECT doc_id, list_transform(" + _RAW.format('text') + ", lambda s: {'s': s, 'n': " + _N.format('s') + ", 'open': false}) AS items FROM documents)", "items")}), r AS (SELECT doc_id, {_DONE} AS c FROM rf),
u AS (SELECT b.doc_id, fallback, CASE WHEN fallback THEN r.c ELSE [{{'text': x.text, 'n_tokens': x.n_tokens}} FOR x IN b.c IF x.q >= 0.8] END AS c FROM b JOIN r ON r.doc_id = b.doc_id)
SELECT doc_id, fallback, pos, c.text AS text, c.n_tokens AS n_tokens FROM (SELECT doc_id, fallback, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS c FROM u)""",
    "chunk_quality": f"WITH {_CHUNKS} SELECT doc_id, pos, round({_Q.format('k')}, 6) AS quality, {_Q.format('k')} >= 0.8 AS kept FROM k",
    "document_quality": f"WITH {_CHUNKS} SELECT doc_id, round(avg({_Q.format('k')}), 6) AS quality, count(*)::BIGINT AS n_chunks, (count(*) FILTER ({_Q.format('k')} >= 0.8))::BIGINT AS n_kept FROM k GROUP BY doc_id",
    "overlap_chunks": rf"WITH {_CHUNKS}, b AS (SELECT *, {_CUT.format('lag(text) OVER (PARTITION BY doc_id ORDER BY pos)')} AS before FROM k), s AS (SELECT doc_id, pos, text, n_tokens, array_to_string(before[-2:], ' ') AS ahead FROM b) SELECT doc_id, pos, CASE WHEN pos > 0 AND {_N.format('ahead')} + n_tokens <= 120 THEN ahead || ' ' || text ELSE text END AS text, CASE WHEN pos > 0 AND {_N.format('ahead')} + n_tokens <= 120 THEN {_N.format('ahead')} + n_tokens ELSE n_tokens END::INTEGER AS n_tokens FROM s",
    "input_sizing": r"SELECT doc_id, round(mb, 9) AS mb, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) // 75)::BIGINT AS chunks, CASE WHEN mb < 0.001 THEN 150 WHEN mb < 0.01 THEN 120 ELSE 100 END AS chunk_size, CASE WHEN mb < 0.001 THEN 3 WHEN mb < 0.01 THEN 4 ELSE 5 END AS num_layers, CASE WHEN mb < 0.001 THEN 50 WHEN mb < 0.01 THEN 100 ELSE 150 END AS batch_size FROM (SELECT *, strlen(text) / 1048576::DOUBLE AS mb FROM documents)",
    "context_assembly": f"SELECT conv_id, string_agg({_ONE.format('text')} || chr(10) || chr(10), '' ORDER BY turn) AS context FROM conversations GROUP BY conv_id",
    "content_dedupe": f"WITH {_R} SELECT batch, content_no, q[1] AS primary_query, array_to_string(q[2:], ',') AS additional_queries, CASE WHEN length(plain) > 100 THEN substr(plain, 1, 100) || '...' ELSE plain END AS preview, md5(context) AS context FROM ({_DED})",
    "dedupe_stats": f"WITH {_R} SELECT batch, sum(len(q))::BIGINT AS total, count(*)::BIGINT AS unique_contents, sum(len(q) - 1)::BIGINT AS removed, sum(len(q) - 1)::BIGINT || '/' || sum(len(q))::BIGINT AS ratio FROM ({_DED}) GROUP BY batch",
    "combined_context": f"WITH r AS (SELECT conv_id AS batch, turn AS pos, role || ' ' || turn AS query, text AS context FROM conversations) SELECT batch, md5(chr(10) || chr(10) || '--- DOCUMENT INFORMATION ---' || chr(10) || chr(10) || string_agg('=== Section ' || (content_no + 1) || ' ===' || chr(10) || 'Source: Primary query: ' || q[1] || CASE WHEN len(q) > 1 THEN ' (Also: ' || array_to_string(q[2:], ', ') || ')' ELSE '' END || chr(10) || context || chr(10) || chr(10), '' ORDER BY content_no)) AS document FROM ({_DED}) GROUP BY batch",
    "query_analysis": f"SELECT * EXCLUDE (query) FROM ({_QA})",
    "adapt_params": f"SELECT conv_id, turn, (CASE WHEN complexity > 20 THEN 7 WHEN n_words <= 3 THEN 4 ELSE 5 END)::BIGINT AS top_k, CASE WHEN has_specifics THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS threshold, (CASE WHEN has_questions AND n_words > 5 THEN 4000 ELSE 3500 END)::BIGINT AS max_tokens FROM ({_QA})",
    "extractive_answer": f"WITH p AS (SELECT q.conv_id, q.turn, q.text AS question, {_SENT.format('a.text')} AS s FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'), x AS (SELECT conv_id, turn, question, unnest(s) AS s, unnest(range(len(s))) AS i FROM p), b AS (SELECT conv_id, turn, arg_max(s, len(list_intersect({_WORDS.format('s')}, {_WORDS.format('question')})) * 100000 - i) AS answer FROM x GROUP BY conv_id, turn) SELECT p.conv_id, p.turn, b.answer FROM p LEFT JOIN b ON b.conv_id = p.conv_id AND b.turn = p.turn",
    "cache_key": "SELECT doc_id, substr(sha256('model:' || coalesce(text, '')), 1, 16) AS cache_key FROM documents",
    "prefixed_texts": "SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN 'query: ' || text WHEN starts_with(text, 'query') THEN text ELSE 'passage: ' || text END) AS prepared FROM conversations",
    "model_vectors": f"SELECT doc_id, round({_VEC.format('text')}[1], 6) AS letters, length(text)::DOUBLE AS length FROM documents",
    "cached_batch": f"SELECT doc_id, coalesce(text, '') IN {_KNOWN} AS cached, " + ", ".join(f"round((length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE / greatest(length(lower(text)), 1), 6) AS v_{c}" for c in T.LETTERS) + " FROM documents",
    "stored_batch": f"SELECT doc_id, coalesce(text, '') IN {_KNOWN_TODAY} AS cached, " + ", ".join(f"round((length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE / greatest(length(lower(text)), 1), 6) AS v_{c}" for c in T.LETTERS) + " FROM documents",
    "request_stats": "SELECT count(*)::BIGINT AS total, round((count(*) FILTER (event_type = 'view'))::DOUBLE / count(*), 6) AS hit_rate, round(sum(value / 1000) / count(*), 6) AS avg_time, round((count(*) FILTER (value > 1))::DOUBLE / count(*), 6) AS batch_share FROM events",
    "budget_prefix": f"SELECT * FROM (SELECT source, doc_id, (sum({_N.format('text')}) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS upto FROM documents WHERE {_N.format('text')} > 0) WHERE upto <= 3500",
}
