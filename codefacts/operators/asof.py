"""As-of joins of source lines with the symbols defined around them.

Both sides meet in one window per file, ordered by line; a file is the unit that bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _met(hits: DataFrame, sym: DataFrame, first: str) -> DataFrame:
    s = F.struct(F.col("line"), F.col("sym_id"))
    defs = sym.join(hits.select("file_id").distinct(), "file_id", "left_semi")
    rows = hits.select("file_id", F.col("ln").alias("line"), "text", F.lit(None).cast("long").alias("sym_id"))
    rows = rows.unionByName(defs.select("file_id", "line", F.lit(None).cast("string").alias("text"), "sym_id"))
    return rows.withColumn("s", F.when(F.col("sym_id").isNotNull(), s)).withColumn("first", F.when(F.col("sym_id").isNotNull(), F.lit(first == "sym")).otherwise(F.lit(first != "sym")))


def enclosing(hits: DataFrame, sym: DataFrame) -> DataFrame:
    """(file_id, ln, text, sym_id) of hits (file_id, ln, text): the last symbol whose line is at or
    before the hit, whatever its end; null before the first. Of several on a line the largest id."""
    order = Window.partitionBy("file_id").orderBy("line", F.desc("first"), "sym_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _met(hits, sym, "sym").withColumn("at", F.last("s", ignorenulls=True).over(order))
    return rows.where("sym_id is null").select("file_id", F.col("line").alias("ln"), "text", F.col("at.sym_id").alias("sym_id"))


def following(hits: DataFrame, sym: DataFrame) -> DataFrame:
    """The same with the first symbol whose line is after the hit. Of several the least id."""
    order = Window.partitionBy("file_id").orderBy("line", F.desc("first"), "sym_id").rowsBetween(1, Window.unboundedFollowing)
    rows = _met(hits, sym, "sym").withColumn("at", F.first("s", ignorenulls=True).over(order))
    return rows.where("sym_id is null").select("file_id", F.col("line").alias("ln"), "text", F.col("at.sym_id").alias("sym_id"))
