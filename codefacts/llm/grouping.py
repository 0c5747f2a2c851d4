"""Links and classes from buckets of candidates, without pairing all members of a bucket.

Shared by the operators that find copies: rows (id, key) say which bucket an id is in, and a check
decides about pairs. Defined cases: ids are not null; a bucket of one, or the same row twice, links
nothing; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, written

#: Links that a task contracts at a time.
CHUNK = 1 << 20
#: Members of a bucket that a tile holds: a task compares one tile with another.
TILE = 128
#: Parts that the pairs of one id are dealt over.
SPREAD = 64


def buckets(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(key, id, low) of the rows in buckets with several ids; low is the bucket's least id. A hot
    bucket is pre-aggregated to its least id, then met by a join that may split it."""
    lows = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key", "low")
    return written(rows.join(lows, "key"), "members", keep)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) with the same components as the given ones, each node's going to the least of
    its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = np.minimum(up[u], up[v]), np.maximum(up[u], up[v])
        if (x == y).all():
            break
        np.minimum.at(up, y, x)
        while (up[up] != up).any():
            up = up[up]
    some = up != np.arange(len(nodes))
    return nodes[some], nodes[up[some]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the given ones connect, with a > b: a task replaces each
    CHUNK of its links by stars, so it holds no more and shuffles nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield starred(held)
                held, n = [], 0
        if n:
            yield starred(held)

    def starred(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        a, b = stars(*ends)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links.select("a", "b").mapInArrow(tidied(run), "a long, b long")


def starry(edges: DataFrame) -> bool:
    """Whether each a of the distinct links (a, b) has one b, which is no a of another."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    ends = ends.unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or ups = 1 and downs = 1").isEmpty()


def components(links: DataFrame, keep: list[str]) -> DataFrame:
    """(id, component) of every end of a link (a, b); the component is its least id.

    Each task contracts its own links; then large-star and small-star steps in turn until all
    links are stars: a number of rounds in the logarithm of the largest component. A step's hot
    node is pre-aggregated to its least neighbour; nothing is gathered in one place.
    """
    edges = written(contracted(links.where("a <> b")).distinct(), "links", keep)
    while not starry(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "links", keep)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def joined(parts: DataFrame, links: DataFrame, keep: list[str]) -> DataFrame:
    """The components (id, component) after more links (a, b): only the components that these
    connect are worked on, and their ids renamed."""
    of = links.select("a", "b")
    for end in ("a", "b"):
        named = parts.select(F.col("id").alias(end), F.col("component").alias("c"))
        of = of.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    more = written(components(of, keep), "joined", keep)
    renamed = parts.join(more.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left")
    return written(renamed.select("id", F.coalesce("c", "component").alias("component")).unionByName(more.join(parts, "id", "left_anti")), "components", keep)


def mixed(members: DataFrame, parts: DataFrame, keep: list[str]) -> DataFrame:
    """(key, id, component, main, mains, others) of the members of buckets that hold several
    components; main is the bucket's largest one, with the numbers of members in it and not."""
    of = members.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("n")).where("n > mains")
    return written(of.join(several.select("key", "main", "mains", (F.col("n") - F.col("mains")).alias("others")), "key"), "mixed", keep)


def crossing(rows: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b), a > b, of the members (``mixed``) of a bucket that are in different
    components, less those that ``cells`` (id, cells), if there, exclude.

    The cells of an id are its weights summed by hash. The sum of the lesser of two ids' cells is no
    less than their overlap, so a pair whose cells stay under ``least`` can't reach it. A bucket is
    cut into tiles; members of its main component, which may be most of it, only meet the others.
    """
    others, mains = (F.ceil(F.col(c) / TILE).cast("int") for c in ("others", "mains"))
    own, h = F.col("component") == F.col("main"), F.xxhash64("id", "key")
    tile = F.when(own, others + F.pmod(h, mains)).otherwise(F.pmod(h, others)).cast("int")
    meets = F.sequence(F.lit(0), F.when(own, others).otherwise(others + mains) - 1)
    cells = [c for c in rows.columns if c == "cells"]
    rows = rows.select("key", "id", "component", *cells, tile.alias("tile"), F.explode(meets).alias("other"))
    rows = rows.select("key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "id", "component", *cells)
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def pairs(held: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y, tile, ids, parts = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("x", "y", "tile", "id", "component"))
        w = np.stack([np.frombuffer(c.as_py(), np.float32) for b in held for c in b.column("cells")]) if cells else None
        total = w.sum(axis=1, dtype=np.float64) if cells else None
        for i in np.flatnonzero(tile == x).tolist():
            j = np.flatnonzero((parts != parts[i]) & ((ids < ids[i]) if x[0] == y[0] else (tile == y)))
            if w is not None and len(j):
                both = total[i] + total[j]
                j = j[np.minimum(w[i], w[j]).sum(axis=1, dtype=np.float64) * (1 + least) >= least * both * (1 - 1e-4)]  # less what rounding may take
            yield np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out() -> pa.RecordBatch:
            ends = [np.concatenate(z) for z in zip(*pairs(held))] or [np.zeros(0, np.int64)] * 2
            return pa.RecordBatch.from_pydict({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and tuple(k[:, i].tolist()) != at:
                        yield out()
                        held = []
                    held.append(batch.slice(i, j - i))
                    at = tuple(k[:, i].tolist())
        if held:
            yield out()

    return rows.mapInArrow(tidied(run), "a long, b long").distinct()


def link(
    members: DataFrame, check: Callable[[DataFrame], DataFrame], keep: list[str], rounds: int = 4,
    cells: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0, extra: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The links (a, b, ...) that ``check`` leaves of pairs (a, b), and the components they make.

    First each member of a bucket is paired with its least, and of further pairs ``extra`` (a, b, n)
    each a's one of most n; then the pairs of ``extra`` whose ends are still in different components.
    Then, as long as that links something and for ``rounds`` rounds at most, a random member of each
    component in a bucket is paired with a random one of another: that joins at little cost what
    would else make many pairs. Last, all pairs that a bucket still holds in different components are
    checked, so that any two members of a bucket are in one component, or were checked, or can't be
    similar by the ``cells`` (id, cells) of the ids given (see ``crossing``). So ``rounds`` decides
    about the work, not about the result.
    """
    first = members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    if extra is not None:
        first = first.unionByName(extra.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b")))
    pairs = written(first.distinct(), "pairs", keep)
    links = written(check(pairs), "verified", keep)
    parts = written(components(links, keep), "components", keep)
    if extra is not None:
        rest = extra.select("a", "b").join(pairs, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(parts.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
        more = written(rest.where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b"), "pairs", keep)
        found = written(check(more), "verified", keep)
        pairs, links, parts = pairs.unionByName(more), links.unionByName(found), joined(parts, found, keep)
    for k in range(rounds):
        of = members.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        pick = of.groupBy("key", "component").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(k))).alias("id"))
        one = pick.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(k))).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        more = pick.join(one, "key").where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "pairs", keep)
        if more.isEmpty():
            break
        found = written(check(more), "verified", keep)
        pairs = pairs.unionByName(more)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        parts = joined(parts, found, keep)
    rows = mixed(members, parts, keep)
    if rows.isEmpty():
        return links, parts
    if cells is not None:
        rows = rows.join(cells(rows.select("id").distinct()), "id")
    more = written(crossing(rows, least).join(pairs, ["a", "b"], "left_anti"), "pairs", keep)
    found = written(check(more), "verified", keep)
    if found.isEmpty():
        return links, parts
    return links.unionByName(found), joined(parts, found, keep)


def degrees(links: DataFrame) -> DataFrame:
    """(id, n) links of each id."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def salted(pairs: DataFrame, size: int) -> DataFrame:
    """Rows (id, b, salt, kind) that bring both ends of the pairs to where they are compared: kind 0
    is b itself, once for each salt; kind 1 are its partners, about ``size`` a salt.

    Only a b of more than ``size`` pairs needs salts. Pairs meet the counts of such a b by b and one
    of SPREAD parts, so that those of a b that very many have are not dealt to one task."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / size).alias("copies")).where("copies > 1")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64("a"), F.lit(SPREAD)).cast("int")
    salt = F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1)))
    rows = pairs.withColumn("part", part).join(copies, ["b", "part"], "left").withColumn("salt", salt.cast("int"))
    members = rows.select(F.col("a").alias("id"), "b", "salt", F.lit(1).alias("kind"))
    return members.unionByName(rows.select(F.col("b").alias("id"), "b", "salt", F.lit(0).alias("kind")).distinct())
