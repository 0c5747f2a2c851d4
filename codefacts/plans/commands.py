"""Whole answers to the commands: which branch applies, its rows in report order, and what is cut.

An answer is one DataFrame (section, rank, path, line, label, detail, total): ``rank`` is the place
in the section, ``total`` the rows that the section has in all, so ``total - limit`` are not shown.
A name without a definition gives suggestions; one with several, if no container is named, a summary;
else the rows themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..store import Facts
from . import queries as Q

COLUMNS = ("section", "rank", "path", "line", "label", "detail", "total")


def section(rows: DataFrame, name: str, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows of a section in its order; all of them without a limit. The rows are
    counted apart, so that the order is a top-k of each task before one task ranks what is left."""
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("long") if c in rows.columns else F.lit(None).cast("long")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.orderBy(*order)).alias("rank")
    top = rows.select("*", rank)
    if limit is not None:
        top = top.where(F.col("rank") <= limit)
    # total is one row.
    return top.join(F.broadcast(total)).select(F.lit(name).alias("section"), "rank", text("path").alias("path"), number("line").alias("line"), text("label").alias("label"), text("detail").alias("detail"), "total")


def _suggested(facts: Facts, name: str) -> DataFrame:
    rows = Q.suggestions(facts, name).select(F.col("name").alias("label"), F.col("score").cast("string").alias("detail"), "score")
    return section(rows, "suggestion", None, F.desc("score"), "label")


def _summary(rows: DataFrame, limit: int | None) -> DataFrame:
    """Definitions by their count, the largest first, ties by id."""
    return section(rows.withColumn("detail", F.col("n").cast("string")), "summary", limit, F.desc("n"), "sym_id")


def _branch(facts: Facts, name: str, container: str | None) -> str:
    """missing, several or one, by the definitions of a name: two rows at most are looked at."""
    n = Q.defs_of(facts, name, container).limit(2).count()
    return "missing" if n == 0 else "several" if n > 1 and container is None else "one"


def callers(facts: Facts, name: str, container: str | None = None, limit: int | None = Q.LIMIT) -> DataFrame:
    """Confirmed callers with their source line, then candidates with the reason, then the counts:
    name matches = confirmed + candidates + other."""
    found = _branch(facts, name, container)
    totals = Q.callers_totals(facts, name, container)
    counts = totals.select(F.explode(F.create_map(*[x for c in ("name_total", "confirmed", "candidates", "other") for x in (F.lit(c), F.col(c))])).alias("label", "n"))
    counts = section(counts.withColumn("detail", F.col("n").cast("string")), "count", None, "label")
    if found == "missing":
        return _suggested(facts, name).unionByName(counts)
    if found == "several":
        return _summary(Q.callers_summary(facts, name), limit).unionByName(counts)
    sure = Q.callers_confirmed(facts, name, container, with_source=facts.lines is not None)
    sure = section(sure.withColumnRenamed("source", "detail"), "confirmed", limit, "path", "line", "label", "call_id")
    maybe = section(Q.callers_candidates(facts, name).withColumn("detail", F.col("res")), "candidate", limit, "path", "line", "label", "res", "call_id")
    return reduce(DataFrame.unionByName, (sure, maybe, counts))


def refs(facts: Facts, name: str, container: str | None = None, limit: int | None = Q.LIMIT) -> DataFrame:
    """References with their role."""
    found = _branch(facts, name, container)
    if found == "missing":
        return _suggested(facts, name)
    if found == "several":
        return _summary(Q.refs_summary(facts, name), limit)
    return section(Q.refs(facts, name, container).withColumn("detail", F.col("role")), "reference", limit, "path", "line", "role", "col")


def read(facts: Facts, name: str, container: str | None = None, limit: int | None = Q.LIMIT) -> DataFrame:
    """The body of the one definition, a row a line, BODY_MOST at most; a last row of section ``more``
    names the line to go on from. Several definitions are listed with their signatures."""
    found = _branch(facts, name, container)
    if found == "missing":
        return _suggested(facts, name)
    one = Q.defs_of(facts, name, container)
    if found == "several" or container is not None and one.limit(2).count() > 1:
        return section(Q.located(facts, one).withColumns({"label": S.symbol_label(), "detail": F.col("sig")}), "definition", limit, "path", "line", "sym_id")
    lines = Q.body(facts, name, container).join(Q.located(facts, one).select("sym_id", "path", "end_line"), "sym_id")
    shown = section(lines.select("path", F.col("ln").alias("line"), F.col("text").alias("detail")), "body", None, "line")
    rest = lines.groupBy("path").agg(F.max("ln").alias("last"), F.max("end_line").alias("end_line")).where("last < end_line")
    hint = F.concat(F.col("path"), F.lit(":"), F.col("last") + 1, F.lit("-"), F.col("end_line"))
    return shown.unionByName(section(rest.select("path", (F.col("last") + 1).alias("line"), hint.alias("detail")), "more", None, "line"))


def impact(facts: Facts, name: str, container: str | None = None, limit: int | None = Q.LIMIT) -> DataFrame:
    """(depth, rank, path, line, label, total): the first rows of each layer in canonical order, with
    the size of the layer."""
    rows = Q.impact(facts, name, container)
    layer = Window.partitionBy("depth")
    rows = rows.withColumns({"rank": F.row_number().over(layer.orderBy("path", "line", "sym_id")), "total": F.count(F.lit(1)).over(layer)})
    return (rows if limit is None else rows.where(F.col("rank") <= limit)).select("depth", "rank", "path", "line", "label", "total")


def tests(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    """(rank, depth, path, line, label): tests that reach a name, the nearest first."""
    order = Window.orderBy("depth", "path", "line", "sym_id")
    return Q.tests_reaching(facts, name, container).select(F.row_number().over(order).alias("rank"), "depth", "path", "line", "label")


def across(stores: dict[str, Facts], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A name over several repositories: (repo, n_defs, n_confirmed, n_name) of those that have it,
    the first definitions of each (repo, rank, path, line, label), and (def_repo, repo, symbol, n)
    references in one repository to symbols that the name has in another."""
    counts, defs, symbols, outside = [], [], [], []
    for repo, facts in stores.items():
        tag = F.lit(repo).alias("repo")
        own = Q.callers_totals(facts, name).select(tag, F.col("confirmed").alias("n_confirmed"), F.col("name_total").alias("n_name"))
        n = Q.defs_of(facts, name).agg(F.count(F.lit(1)).alias("n_defs")).withColumn("repo", F.lit(repo))
        counts.append(n.join(own, "repo").select("repo", "n_defs", "n_confirmed", "n_name").where("n_defs > 0 or n_name > 0"))
        rank = F.row_number().over(Window.orderBy("sym_id"))
        found = Q.located(facts, Q.defs_of(facts, name)).select(tag, rank.alias("rank"), "path", "line", S.qualified(F.col("container"), F.col("name")).alias("label"))
        defs.append(found.where(F.col("rank") <= Q.SHOWN_DEFS))
        symbols.append(Q.defs_of(facts, name).where("symbol <> ''").select(F.lit(repo).alias("def_repo"), "symbol").distinct())
        outside.append(facts.extref.select(tag, "symbol"))
    join = lambda parts: reduce(DataFrame.unionByName, parts)
    refs_ = join(outside).join(join(symbols), "symbol").where("repo <> def_repo").groupBy("def_repo", "repo", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return join(counts), join(defs), refs_
