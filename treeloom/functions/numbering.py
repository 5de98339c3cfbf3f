"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.sources.scratch import Scratch

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """The rows with ``name``: their number in order, from ``start``.

    Rows are dealt to ranges of the order and numbered inside; only one count for each range
    is summed up. The order should be unique, else equal rows get their numbers as they come.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(row.alias("row"), F.monotonically_increasing_id().alias("at"))
    dealt = Scratch(df.sparkSession, "numbered").save(dealt.select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(_PLACE)).alias("place")), "rows")
    per = dealt.groupBy("part").agg(F.count("*").alias("n"))
    base = per.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("base"))
    out = dealt.join(F.broadcast(base), "part")  # one row for each partition
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns), (F.col("base") + F.col("place")).alias(name))
