"""Mixing sources to target weights, in DataFrame operations alone.

Each source gets a target: its share of all words by weight, at most ``max_epochs`` times
its own size, what exceeds that shared again by weight among the others. Complete epochs
come first; the rest of a target is drawn without replacement by Efraimidis-Spirakis keys
``-ln(u) / quality``, ascending, until the words add up.

The prefix sums never sort a whole source in one task: keys fall in buckets of bounded
size (histogram), bucket totals are summed by source, and rows are ordered inside a
bucket only.

Cases: a null or blank text has size 0 and takes nothing; a null source is a source of its
own, last in order; a null weight or one not above 0 counts as 1; u depends on doc_id
alone (a null id: on the text), so reruns agree; equal keys go by doc_id, then size, then text hash; rows that
repeat are drawn one by one; an empty table stays empty. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace

MAX_EPOCHS = 3
BUCKET_ROWS = 2_000


def n_words(text):
    """Number of runs of ``[^\\x20\\x09-\\x0D]`` in a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Water-filling in closed form: ordered by the level cap / weight at which a source is
    full, source k is full if the level that remains for it and those after it reaches it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = w.withColumn("caps", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("ws", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.col("caps")) / F.col("ws"))
    w = w.withColumn("open", F.when(F.col("level") < F.col("full_at"), F.col("level")))
    # the first source in order that isn't full sets the level of all after it
    w = w.withColumn("level", F.first("open", ignorenulls=True).over(whole.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, tie, size, source_size, target, taken, copies): one row for each row of ``docs``, without the text.

    ``weights`` has one row (doc_id, weight) for each document whose quality weight isn't 1.
    ``tie`` tells rows with one doc_id apart; ``copies`` is how often the mix takes the document.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    text = F.col(text_col)
    tie = F.xxhash64(text)
    # u in (0, 1) from 13 hexadecimal digits, the same on any engine
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))).cast("binary")), 1, 13), 16, 10).cast("double")
    u = (digits + 0.5) / F.lit(float(1 << 52))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tie.alias("tie"), n_words(text).alias("size"), (-F.log(u)).alias("key"))
    if weights is not None:  # joined to sizes, so that texts aren't shuffled
        rows = ws.save(rows, "words")
        w = weights.select(F.col("doc_id").alias("_w"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"))
        rows = rows.join(w, F.col("doc_id") == F.col("_w"), "left").withColumn("key", F.col("key") / F.coalesce("weight", F.lit(1.0))).drop("_w", "weight")
    rows = ws.save(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = ws.save(source_targets(per, max_epochs).join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    # each source's budget beyond its complete epochs; exp(-key) is spread evenly enough for equal buckets
    t = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_rows)))
    t = t.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget", "buckets")
    r = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    r = r.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1))
    sums = r.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    r = r.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("upto", F.col("base") + F.sum("size").over(inside))
    # the document at the edge is taken if that brings the source nearer to its target
    drawn = (F.col("upto") - F.col("size") / 2 <= F.col("budget")) & (F.col("budget") > 0)
    copies = F.col("epochs") + F.when(drawn & (F.col("epochs") < max_epochs), 1).otherwise(0)
    return r.withColumn("copies", copies.cast("long")).select("doc_id", "tie", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents that labels give quality 1."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(2.0).alias("weight")).distinct()


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it does; columns stay as they are, whatever their names."""
    ws = Workspace(docs.sparkSession, "mixed")
    picks = mix(docs, id_col, text_col, weights=weights, **options).where("copies > 0")
    # rows with one doc_id and one text are drawn one by one: number them on both sides
    picks = picks.groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies")).select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "copies")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tie"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))
    shares = d.groupBy("doc_id", "tie").agg(F.count("*").alias("rows")).join(picks, same).select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "rows", "copies")
    out = d.join(ws.save(shares, "picks"), same)
    once = out.where("rows = 1").select("row", F.col("copies").alias("n"))
    # identical rows: their copies are dealt evenly, the first rows take what is left
    nth = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy(F.lit(0)))
    left = (nth <= F.col("copies") % F.col("rows")).cast("long")
    many = out.where("rows > 1").select("row", (F.floor(F.col("copies") / F.col("rows")) + left).alias("n"))
    taken = once.unionByName(many).where("n > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mix(docs, weights=quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE AS digits FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
k AS (SELECT d.doc_id, d.source, d.size,
        -ln((digits + 0.5) / 4503599627370496.0) / CASE WHEN good.doc_id IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS key
      FROM d LEFT JOIN good ON d.doc_id = good.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM k GROUP BY source),
fill AS (
  SELECT 0 AS round, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS level
  UNION ALL
  SELECT round + 1, ((SELECT sum(source_size) FROM s)
           - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE 3 * source_size / w <= level))::DOUBLE
           / (SELECT sum(w) FROM s WHERE 3 * source_size / w > level)
  FROM fill WHERE round < 40 AND EXISTS (SELECT 1 FROM s WHERE 3 * source_size / w > level)),
lvl AS (SELECT level FROM fill WHERE level IS NOT NULL ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size / w <= level THEN (3 * source_size)::DOUBLE ELSE level * w END AS target
      FROM s, lvl),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN budget > 0 AND upto - size / 2 <= budget AND epochs < 3 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
