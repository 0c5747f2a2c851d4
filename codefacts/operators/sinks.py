"""Sinks: text rows, tab-separated files, Markdown tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_rows(rows: DataFrame, *detail: str, limit: int = 50) -> Iterator[str]:
    """``path:line<TAB>detail`` in the order (path, line, details), ``limit`` of them, then how many
    more there are. Rows come one partition at a time."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in detail]
    shown = rows.select("path", "line", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("\t"), F.concat_ws("\t", *cols)).alias("row"))
    for r in shown.orderBy("path", "line", "row").limit(limit).toLocalIterator():
        yield r["row"]
    if (more := rows.count() - limit) > 0:
        yield f"… {more} more"


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def markdown(rows: DataFrame, limit: int = 50) -> str:
    """A table of the first rows of an ordered result."""
    out = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    for r in rows.limit(limit).collect():
        out.append("| " + " | ".join("" if v is None else str(v) for v in r) + " |")
    return "\n".join(out)
