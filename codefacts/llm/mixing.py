"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a hash of the id over ``BLOCKS`` blocks. A source's target is
turned into an exact number of block copies (whole passes over the source, then blocks in a
permuted order), and the tree deals these quotas out: the root holds all block copies of the mix,
and each node draws how many of each source go to its left half of the output shards from the
multivariate hypergeometric distribution. Leaves then take disjoint runs of the permuted blocks,
and a shard is shuffled locally by a hash. What a source still lacks after whole blocks is filled
from one more block: by whole parts of it, then by documents of one more part.

Sizes are kept as a table without texts. The driver holds one row per block: ``BLOCKS`` a source, and
fewer each if that would be more than ``MOST_BLOCKS`` for all sources. Such lists are broadcast while
they have no more rows than that, else they are joined. Everything is fixed by the ids and the seed,
so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order; a
source without words has target 0 and nothing of it is taken; a null id is an id like any other;
rows of one id lie in one block, and are filled in one by one; an empty table gives an empty result;
columns called like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied, written

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCKS, SHARDS, PIECES, MOST_BLOCKS = 256, 16, 64, 1 << 18
_COPIES = "array<struct<copy:int,shard:int>>"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of the sources, in their order: the budget by weight; a target stops at ``most``
    times its source, and what is over is shared again by weight until none is above."""
    n = len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    left, out, open_ = share * sum(sizes), [0.0] * n, [i for i in range(n)]
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass
class Plan:
    """Sources in order with size and target; block copies as (source number, block, copy, shard);
    the words each source's last block has to give."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    copies: list[tuple[int, int, int, int]]
    rest: list[tuple[int, int, int, int, float]]


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Quotas of each shard. A node's draw fixes how many of each source go left; both halves get
    the same number of blocks, to one."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    total = int(quotas.sum())
    take = round(total * left / shards)
    if total < 1_000_000_000:
        drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    else:
        raise ValueError("too many block copies")
    return split(drawn, left, rng) + split(quotas - drawn, shards - left, rng)


def fitting(order: Sequence[int], words: dict[int, int], lack: float) -> tuple[list[int], list[int], float]:
    """The blocks that fit in what lacks, in their order, the others, and what is left."""
    whole, skipped = [], []
    for b in order:
        if words[b] <= lack:
            whole.append(b)
            lack -= words[b]
        else:
            skipped.append(b)
    return whole, skipped, lack


def plan(blocks: list[tuple[str | None, int, int]], shards: int = SHARDS, seed: int = 11, **terms) -> Plan:
    """The plan for rows (source, block, words)."""
    names = sorted({s for s, _, _ in blocks if s is not None}) + [None] * any(s is None for s, _, _ in blocks)
    number = {s: i for i, s in enumerate(names)}
    own: list[dict[int, int]] = [{} for _ in names]
    for s, b, words in blocks:
        own[number[s]][b] = own[number[s]].get(b, 0) + words
    sizes = [sum(x.values()) for x in own]
    goal = targets(sizes, **terms)
    rng = np.random.default_rng(seed)
    runs: list[list[tuple[int, int]]] = []
    rest: list[tuple[int, int, int, int, float]] = []
    for i, x in enumerate(own):
        order = [b for b in rng.permutation(BLOCKS).tolist() if x.get(b)]
        passes = int(goal[i] // sizes[i]) if sizes[i] else 0
        run = [(b, k) for k in range(passes) for b in order]
        whole, skipped, lack = fitting(order, x, goal[i] - passes * sizes[i])
        run += [(b, passes) for b in whole]
        if skipped and lack >= 1:
            rest.append((i, skipped[0], passes, -1, lack))
        runs.append(run)
    quotas = np.array([len(r) for r in runs], dtype=np.int64)
    copies: list[tuple[int, int, int, int]] = []
    at = [0] * len(names)
    for shard, part in enumerate(split(quotas, shards, rng) if len(names) else []):
        for i, n in enumerate(part.tolist()):
            copies += [(i, b, k, shard) for b, k in runs[i][at[i] : at[i] + n]]
            at[i] += n
    rest = [(i, b, k, int(rng.integers(shards)), lack) for i, b, k, _, lack in rest]
    return Plan(names, sizes, goal, copies, rest)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))


def _block(seed: int, blocks: int) -> Column:
    return F.pmod(_hash(seed), F.lit(blocks)).cast("int")


def _listed(rows: DataFrame, n: int) -> DataFrame:
    """A list of ``n`` rows to be broadcast, if it is short enough for that."""
    return F.broadcast(rows) if n <= MOST_BLOCKS else rows


@dataclass
class Mix:
    """The lists that say what is taken: (name, number, source_size, target) of the sources, (number,
    block, copies) of whole blocks; what fills the last blocks, by row of ``sizes``."""

    sizes: DataFrame
    sources: DataFrame
    whole: DataFrame
    extra: DataFrame
    last: DataFrame
    blocks: int
    plan: Plan


def decided(docs: DataFrame, shards: int = SHARDS, seed: int = 11, **terms) -> Mix:
    """What is taken of ``docs``. Their texts are read once, for the sizes."""
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    sizes = written(sizes, "sizes")
    n = max(1, sizes.select("source").distinct().count())
    blocks = max(1, min(BLOCKS, 1 << max(0, (MOST_BLOCKS // n).bit_length() - 1)))
    sums = sizes.groupBy("source", _block(seed, blocks).alias("block")).agg(F.sum("size").alias("n")).collect()
    made = plan([(r["source"], r["block"], r["n"]) for r in sums], shards, seed, **terms)
    frame = pd.DataFrame({"name": pd.Series(made.sources, dtype=object), "number": range(len(made.sources)), "source_size": made.sizes, "target": made.targets})
    kind = "name string, number long, source_size long, target double"
    sources = _listed(spark.createDataFrame(frame, kind) if made.sources else spark.createDataFrame([], kind), n)
    by_block: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, b, k, shard in made.copies:
        by_block.setdefault((i, b), []).append((k, shard))
    whole = _listed(spark.createDataFrame([(i, b, x) for (i, b), x in by_block.items()], f"number long, block int, copies {_COPIES}"), len(by_block))
    last = _listed(spark.createDataFrame(made.rest, "number long, block int, copy int, shard int, lack double"), len(made.rest))

    # The last blocks, part by part, then the rows of one more part.
    named = sizes.join(sources, sizes["source"].eqNullSafe(sources["name"])).withColumn("block", _block(seed, blocks))
    part = F.pmod(_hash(seed + 3), F.lit(blocks)).cast("int")
    left = named.join(last, ["number", "block"]).withColumn("part", part)
    words: dict[int, dict[int, int]] = {}
    for r in left.groupBy("number", "part").agg(F.sum("size").alias("n")).where("n > 0").collect():
        words.setdefault(r["number"], {})[r["part"]] = r["n"]
    taken_parts, last_parts = [], []
    for i, _, _, _, lack in made.rest:
        own = words.get(i, {})
        some, skipped, lack = fitting(sorted(own), own, lack)
        taken_parts += [(i, p) for p in some]
        if skipped and lack >= 1:
            last_parts.append((i, skipped[0], lack))
    some = _listed(spark.createDataFrame(taken_parts, "number long, part int"), len(taken_parts))
    more = _listed(spark.createDataFrame(last_parts, "number long, part int, most double"), len(last_parts))
    extra = left.join(some, ["number", "part"]).select("row", "copy", "shard").unionByName(_fill(left.join(more, ["number", "part"]), seed))
    return Mix(named, sources, whole, written(extra, "extra"), last, blocks, made)


def _fill(rows: DataFrame, seed: int) -> DataFrame:
    """The rows that fill what a source still lacks: in the permuted order, each one that still fits.
    A task streams a source's rows, sorted; they are one part of one of its blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lack = None, 0.0
        for part in parts:
            keep = []
            for number, size, most in zip(part["number"], part["size"], part["most"]):
                if number != now:
                    now, lack = number, most
                fits = 0 < size <= lack
                lack -= size if fits else 0
                keep.append(fits)
            yield part.loc[keep, ["row", "copy", "shard"]]

    cols = rows.select("number", "size", "most", "row", "copy", "shard", _hash(seed + 1).alias("key"))
    return cols.repartition("number").sortWithinPartitions("number", "key", "row").drop("key").mapInPandas(tidied(run), "row long, copy int, shard int")


def _none() -> Column:
    return F.array().cast(_COPIES)


def shares(docs: DataFrame, shards: int = SHARDS, seed: int = 11, **terms) -> tuple[DataFrame, Plan]:
    """(doc_id, source, size, source_size, target, copies array<struct<copy, shard>>) of every row,
    and the plan."""
    d = decided(docs, shards, seed, **terms)
    extra = d.extra.select("row", F.array(F.struct("copy", "shard")).alias("more"))
    found = d.sizes.join(d.whole, ["number", "block"], "left").join(extra, "row", "left")
    copies = F.concat(F.coalesce("copies", _none()), F.coalesce("more", _none()))
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(_none()).alias("copies")), d.plan


def taken(docs: DataFrame, **terms) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    found, _ = shares(docs, **terms)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 11, **terms) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, by shard, shuffled within it. The
    columns are those of ``docs`` and ``shard``.

    Copies of whole blocks follow from the id and the source where a row is read; only rows of the
    last blocks meet the list of those that fill them. The texts are shuffled once, by shard."""
    d = decided(docs, shards, seed, **terms)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    tag = lambda t: t.toDF(*[f"__{c}" for c in t.columns])
    sources, whole, last = (tag(t) for t in (d.sources.select("name", "number"), d.whole, d.last.select("number", "block")))
    rows = docs.where(F.coalesce(F.regexp_like(F.col("text"), F.lit(WORD)), F.lit(False))).withColumn("__block", _block(seed, d.blocks))
    rows = rows.join(_listed(sources, len(d.plan.sources)), F.col("source").eqNullSafe(F.col("__name")))
    rows = rows.join(_listed(whole, len(d.plan.copies)), ["__number", "__block"], "left")
    last = _listed(last, len(d.plan.rest))
    # Equal rows of one id are told apart by a count, the same here and among the sizes.
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1]))
    filled = d.sizes.where("size > 0").join(_listed(d.last.select("number", "block"), len(d.plan.rest)), ["number", "block"], "left_semi")
    filled = filled.withColumn("nth", nth("doc_id", "number", "hash", "row")).join(d.extra, "row")
    filled = filled.select(F.col("doc_id").alias("__id"), F.col("number").alias("__of"), F.col("hash").alias("__text"), F.col("nth").alias("__n"), F.array(F.struct("copy", "shard")).alias("__more"))
    at = rows.join(last, ["__number", "__block"], "left_semi").withColumn("__hash", F.xxhash64("text"))
    at = at.withColumn("__nth", nth("doc_id", "__number", "__hash", F.lit(1)))
    at = at.join(filled, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__number") == F.col("__of")) & (F.col("__hash") == F.col("__text")) & (F.col("__nth") == F.col("__n")), "left")
    at = at.select(*cols, F.concat(F.coalesce("__copies", _none()), F.coalesce("__more", _none())).alias("__copies"))
    plain = rows.join(last, ["__number", "__block"], "left_anti").where("__copies is not null").select(*cols, "__copies")
    place = F.xxhash64(F.lit(seed + 2), F.col("doc_id").cast("string"), "__one.copy")
    out = plain.unionByName(at).select(*cols, F.explode("__copies").alias("__one")).select(*cols, F.col("__one.shard").alias("shard"), place.alias("__place"))
    # A shard is cut into PIECES runs of its own shuffled order, so that a large one is many tasks.
    out = out.withColumn("__piece", F.shiftrightunsigned("__place", 64 - PIECES.bit_length() + 1))
    return out.repartition("shard", "__piece").sortWithinPartitions("shard", "__piece", "__place").drop("__piece", "__place")
