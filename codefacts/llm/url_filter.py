"""URL filters by a temporal list join.

Dated list entries (kind, value, action, since) become validity intervals: an entry holds from its
date until the next entry of its kind and value. An as-of join evaluates every capture against the
entries active at its fetch date. Only DataFrame functions are used.

Kinds, the more specific first: ``url`` (scheme, fragment and user stripped), ``prefix`` (host and
first path segment), ``host`` (exact) and ``domain`` (the host or any parent, the longest first).
The most specific active entry decides; its action is the verdict, ``none`` without one.

The join is on the key and the month, so neither a host with very many captures nor a key with very
many entries meets in one place, and a capture meets at most the entries of its own month.

Defined cases: a null URL, one without a host, or a null date gives the verdict ``none``; several
entries of a key on one date count as one, the action last in code point order; entries with a null
kind, value, action or date are ignored; repeated captures each get their verdict; other columns
pass through, those called like the added ones are replaced; empty lists give ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parts of a URL.
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)"
_SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)"
_REST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 2), r"\.$", ""))


def keys_of(url: Column) -> Column:
    """The keys of a URL, array<struct<kind, value, rank>>; the lower the rank the more specific."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")

    def key(kind: str, value: Column, rank: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), rank.cast("int").alias("rank"))

    parents = F.transform(
        F.sequence(F.lit(1), F.array_size(labels)),
        lambda i: key("domain", F.array_join(F.slice(labels, i, F.array_size(labels)), "."), i + 2),
    )
    own = F.array(
        key("url", F.concat(host, F.regexp_extract(url, _REST, 1)), F.lit(0)),
        key("prefix", F.concat(host, F.regexp_extract(url, _SEGMENT, 1)), F.lit(1)),
        key("host", host, F.lit(2)),
    )
    return F.when(host != "", F.concat(own, parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, action, since, until): ``until`` is exclusive, null for what still holds."""
    one = entries.dropna(subset=["kind", "value", "action", "since"]).groupBy("kind", "value", "since").agg(F.max("action").alias("action"))
    later = Window.partitionBy("kind", "value").orderBy("since")
    return one.withColumn("until", F.lead("since").over(later))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with ``verdict``, ``kind``, ``value`` and ``since`` of the entry that decided."""
    asked = captures.select(F.col(f"`{url}`").alias("u"), F.col(f"`{fetched}`").cast("date").alias("f")).where("u is not null and f is not null").distinct()
    keyed = asked.select("u", "f", F.trunc("f", "month").alias("month"), F.explode(keys_of(F.col("u"))).alias("k")).select("u", "f", "month", "k.*")
    # The range of fetch dates, one row, bounds the months of intervals that still hold.
    first, last = (F.lit(x).cast("date") for x in asked.agg(F.min("f"), F.max("f")).first())
    spread = (
        intervals(entries)
        .withColumns({"lo": F.greatest("since", first), "hi": F.least(F.coalesce(F.date_sub("until", 1), last), last)})
        .where("lo <= hi")
        .withColumn("month", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))))
        .drop("lo", "hi")
    )
    active = keyed.join(spread, ["kind", "value", "month"]).where("f >= since and (until is null or f < until)")
    best = active.groupBy(F.col("u").alias("__url"), F.col("f").alias("__day")).agg(F.min_by(F.struct("action", "kind", "value", "since"), "rank").alias("__entry"))
    found = captures.join(best, captures[f"`{url}`"].eqNullSafe(best["__url"]) & captures[f"`{fetched}`"].cast("date").eqNullSafe(best["__day"]), "left")
    added, entry = ("verdict", "kind", "value", "since"), best["__entry"]
    return found.select(
        *[captures[f"`{c}`"] for c in captures.columns if c not in added],
        F.coalesce(entry["action"], F.lit("none")).alias("verdict"), entry["kind"].alias("kind"), entry["value"].alias("value"), entry["since"].alias("since"),
    )
