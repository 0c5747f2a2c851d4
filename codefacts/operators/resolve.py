"""Name resolution: which symbol a call-site means, with a code that says how sure that is.

The cascade needs, for each site, how many symbols of its name there are (of all kinds, and methods
alone) and how many of them sit in the container or the module that qualifies it. These are three
aggregates over ``sym``, joined to the sites one row to one row, so a name with thousands of
definitions and thousands of calls never multiplies. Skewed names are split by adaptive execution,
as each join has one row per key on its right side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AMBIGUOUS, CALL, METHOD, QUALIFIED, SITE, UNIQUE, UNRESOLVED


def _counts(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    method = F.col("kind") == METHOD
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{tag}_n"), F.min("sym_id").alias(f"{tag}_id"),
        F.count_if(method).alias(f"{tag}_mn"), F.min(F.when(method, F.col("sym_id"))).alias(f"{tag}_mid"),
    )


def resolve(sites: DataFrame, sym: DataFrame, *more: str) -> DataFrame:
    """``sites`` as calls: with ``callee_sym`` and ``res``, and the columns ``more`` as they are.

    1. A method call means methods only, any other call all kinds; without any it is unresolved.
    2. Qualified: the qualifier (``Self`` is the caller's container) is a container first: one
       symbol in it is the one, several are ambiguous; without any, one symbol whose module ends
       in it is the one, anything else is unresolved.
    3. Unqualified: a name with one symbol is unique, else it is ambiguous.
    """
    s = sym.select("sym_id", "name", "kind", "container", F.element_at(F.split("module", "::"), -1).alias("tail"))
    by_name = _counts(s, ["name"], "a").withColumnRenamed("name", "callee")
    by_container = _counts(s, ["name", "container"], "c").toDF("callee", "target", "c_n", "c_id", "c_mn", "c_mid")
    by_tail = _counts(s, ["name", "tail"], "t").toDF("callee", "target", "t_n", "t_id", "t_mn", "t_mid")

    # Only sites with Self need their caller; the others don't take part in that join.
    own = sym.select(F.col("sym_id").alias("owner"), F.col("container").alias("own"))
    asked = sites.withColumn("owner", F.when(F.col("qual") == "Self", F.col("caller")))
    asked = asked.join(own, "owner", "left").withColumn("target", F.when(F.col("qual") == "Self", F.col("own")).when(F.col("qual") != "", F.col("qual")))
    rows = asked.join(by_name, "callee", "left").join(by_container, ["callee", "target"], "left").join(by_tail, ["callee", "target"], "left")

    def of(tag: str) -> tuple[Column, Column]:
        m = F.col("is_method") == 1
        n = F.coalesce(F.when(m, F.col(f"{tag}_mn")).otherwise(F.col(f"{tag}_n")), F.lit(0))
        return n, F.when(m, F.col(f"{tag}_mid")).otherwise(F.col(f"{tag}_id"))

    (an, aid), (cn, cid), (tn, tid) = of("a"), of("c"), of("t")
    plain = F.col("qual") == ""
    res = (
        F.when(an == 0, UNRESOLVED)
        .when(plain, F.when(an == 1, UNIQUE).otherwise(AMBIGUOUS))
        .when(cn == 1, QUALIFIED).when(cn > 1, AMBIGUOUS).when(tn == 1, QUALIFIED).otherwise(UNRESOLVED)
    )
    found = F.when(an == 0, None).when(plain, F.when(an == 1, aid)).when(cn == 1, cid).when((cn == 0) & (tn == 1), tid)
    return rows.withColumns({"res": res.cast("int"), "callee_sym": found}).select(*CALL.fieldNames(), *more)


def confirmed(sites: DataFrame, sym: DataFrame, names: DataFrame) -> DataFrame:
    """(sym_id, n): how many sites that call one of ``names`` (callee) resolve to a symbol.

    Sites that ``resolve`` can't tell apart are counted before they are moved, and resolved once;
    it looks at the caller for ``Self`` only."""
    alike = sites.withColumn("caller", F.when(F.col("qual") == "Self", F.col("caller"))).groupBy("callee", "caller", "qual", "is_method").agg(F.count(F.lit(1)).alias("n"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in SITE if f.name not in alike.columns}
    calls = resolve(alike.join(names, "callee", "left_semi").withColumns(blank), sym, "n").where("callee_sym is not null")
    return calls.groupBy(F.col("callee_sym").alias("sym_id")).agg(F.sum("n").alias("n"))


def last_symbols(sym: DataFrame) -> DataFrame:
    """(symbol, known): the symbol strings that syms carry; of several syms the one of largest id,
    which is fixed by path and place, where an order of insertion isn't."""
    return sym.where("symbol <> ''").groupBy("symbol").agg(F.max("sym_id").alias("known"))


def positions(occurrences: DataFrame) -> DataFrame:
    """One occurrence per place: the last one read."""
    return occurrences.groupBy("rel_path", "line0", "col0").agg(F.max_by(F.struct("symbol", "role"), "seq").alias("o")).select("rel_path", "line0", "col0", "o.symbol", "o.role")


def resolve_precise(sites: DataFrame, sym: DataFrame, file: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Calls by position: a site where an occurrence of a known symbol stands is unique, one with an
    unknown symbol is unresolved, and one without an occurrence falls back to the cascade."""
    placed = sites.join(file.select("file_id", F.col("path").alias("rel_path")), "file_id").withColumns({"line0": F.col("line") - 1, "col0": F.col("col")})
    at = positions(occurrences).select("rel_path", "line0", "col0", F.col("symbol").alias("at_symbol"))
    met = placed.join(at, ["rel_path", "line0", "col0"], "left").join(last_symbols(sym).withColumnRenamed("symbol", "at_symbol"), "at_symbol", "left")
    there = F.col("at_symbol").isNotNull()
    return resolve(met, sym, "at_symbol", "known").withColumns(
        {
            "callee_sym": F.when(there, F.col("known")).otherwise(F.col("callee_sym")),
            "res": F.when(there, F.when(F.col("known").isNotNull(), UNIQUE).otherwise(UNRESOLVED)).otherwise(F.col("res")).cast("int"),
        }
    ).select(*CALL.fieldNames())


def references(occurrences: DataFrame, sym: DataFrame, file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, extref) of the occurrences in indexed files: those of known symbols, and those of
    others but locals and the standard library."""
    placed = occurrences.join(file.select("file_id", F.col("path").alias("rel_path")), "rel_path").withColumns({"line": F.col("line0") + 1, "col": F.col("col0")})
    met = placed.join(last_symbols(sym), "symbol", "left")
    ref = met.where("known is not null").select(F.col("known").alias("sym_id"), "file_id", "line", "col", "role")
    outside = ~F.col("symbol").contains("https://github.com/rust-lang/rust/library") & ~F.col("symbol").startswith("local ")
    return ref, met.where(F.col("known").isNull() & outside).select("symbol", "file_id", "line", "col", "role")


def coverage(sites: DataFrame, file: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(n_sites, n_covered, n_missing, n_silent_files): call-sites with an occurrence at their
    place, without one, and files that the occurrences don't mention."""
    paths = file.select("file_id", F.col("path").alias("rel_path"))
    at = positions(occurrences).select("rel_path", "line0", "col0", F.lit(1).alias("hit"))
    met = sites.join(paths, "file_id").withColumns({"line0": F.col("line") - 1, "col0": F.col("col")}).join(at, ["rel_path", "line0", "col0"], "left")
    silent = paths.join(occurrences.select("rel_path").distinct(), "rel_path", "left_anti")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    hit = F.when(F.col("hit").isNotNull(), one).otherwise(zero)
    parts = met.select(one.alias("n_sites"), hit.alias("n_covered"), (one - hit).alias("n_missing"), zero.alias("n_silent_files"))
    parts = parts.unionByName(silent.select(zero.alias("n_sites"), zero.alias("n_covered"), zero.alias("n_missing"), one.alias("n_silent_files")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])
