"""Approximate nearest neighbours with vantage-point trees per shard.

Vectors are dealt by hash over shards of about ``SHARD`` rows; each shard's rows, all of them, make
one tree over unit vectors and their chord distance, a metric in which less is nearer exactly if
the cosine is larger. A subtree is skipped if its ball can't reach a query's k-th best so far: the
triangle inequality, with the gap multiplied by ``factor``. At 1 the search is exact; above, it
skips more and may miss some.

Queries go to every shard and are streamed through its tree in batches, near side first; each
shard gives its k best, and the best of these are the result. A task holds one tree and one batch.

Nearness is the cosine in double precision, summed in component order over the original vectors.
Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows
with a null id, take no part; only vectors of the query's length are compared; a query's candidates
are all rows but those of its own id; a repeated id is one query (the least of its vectors) and a
candidate per row; ties go to the smaller id; other columns don't matter; empty tables give an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied

SHARD, LEAF = 4096, 96
#: Room for rounding in distances and cosines.
SLACK, NEAR = 1e-6, 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; sums run in component order."""
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Tree:
    """A vantage-point tree over rows (ids, vectors)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        order, self.radius = np.arange(len(ids)), {}
        rng, todo = np.random.default_rng(seed), [(0, len(ids))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                continue
            at = int(rng.integers(lo, hi))
            order[lo], order[at] = order[at], order[lo]
            rest = order[lo + 1 : hi]
            d = np.sqrt(np.maximum(0, 2 - 2 * (unit[rest] @ unit[order[lo]])))
            mid = len(rest) // 2
            part = np.argpartition(d, mid)
            order[lo + 1 : hi] = rest[part]
            self.radius[lo, hi] = float(d[part[mid]])
            todo += [(lo + 1, lo + 1 + mid), (lo + 1 + mid, hi)]
        self.ids, self.vectors, self.unit = ids[order], vectors[order], unit[order]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> list[list[tuple[float, int]]]:
        """The k best (cosine, id) of each query, best first."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        worst = np.full(len(ids), -np.inf)  # the k-th best cosine so far

        def scan(lo: int, hi: int, own: np.ndarray) -> None:
            near = unit[own] @ self.unit[lo:hi].T
            i, j = np.nonzero((near >= worst[own, None] - NEAR) & (self.ids[None, lo:hi] != ids[own, None]))
            if not len(i):
                return
            score = cosines(queries[own[i]], self.vectors[lo + j])
            cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])).tolist() + [len(i)]
            for a, b in zip(cuts, cuts[1:]):
                q = own[i[a]]
                got = sorted(best[q] + list(zip((-score[a:b]).tolist(), self.ids[lo + j[a:b]].tolist())))[:k]
                best[q] = got
                if len(got) == k:
                    worst[q] = -got[-1][0]

        def visit(lo: int, hi: int, own: np.ndarray) -> None:
            if not len(own) or lo >= hi:
                return
            if (lo, hi) not in self.radius:
                scan(lo, hi, own)
                return
            scan(lo, lo + 1, own)
            mid, radius = lo + 1 + (hi - lo - 1) // 2, self.radius[lo, hi]
            gap = np.sqrt(np.maximum(0, 2 - 2 * (unit[own] @ self.unit[lo]))) - radius
            inner = gap <= 0
            visit(lo + 1, mid, own[inner])
            visit(mid, hi, own[~inner])
            reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(worst[own], -1)))
            open_ = np.abs(gap) * factor <= reach + SLACK
            visit(mid, hi, own[inner & open_])
            visit(lo + 1, mid, own[~inner & open_])

        visit(0, len(self.ids), np.arange(len(ids)))
        return [[(-s, i) for s, i in x] for x in best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def index(vectors: DataFrame, shard_rows: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The trees (shard, tree binary) of ``vectors`` (vec_id, embedding), and (shard, dim) of each."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim")
    )
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs = None, [], []

        def flush() -> pa.RecordBatch:
            tree = pickle.dumps(Tree(np.concatenate(ids), np.concatenate(vecs)), protocol=5)
            return pa.RecordBatch.from_pydict({"dim": pa.array([now[0]], pa.int32()), "part": pa.array([now[1]], pa.int32()), "tree": pa.array([tree], pa.binary())})

        for batch in batches:
            dim, part = batch.column("dim").to_numpy(), batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now != (key := (int(dim[a]), int(part[a]))):
                    if ids:
                        yield flush()
                    now, ids, vecs = key, [], []
                piece = batch.slice(a, b - a)
                ids.append(piece.column("vec_id").to_numpy())
                vecs.append(_matrix(piece.column("v")))
        if ids:
            yield flush()

    trees = (
        dealt.select("dim", "part", "vec_id", "v").repartition("dim", "part").sortWithinPartitions("dim", "part", "vec_id")
        .mapInArrow(tidied(build), "dim int, part int, tree binary")
    )
    return trees, sizes


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` for each of ``queries``."""
    trees, sizes = index(vectors, shard_rows)
    wanted = (
        queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("query_id"))
        .agg(F.min("embedding").alias("e"))
        .select("query_id", F.transform("e", lambda x: x.cast("double")).alias("v"), F.size("e").alias("dim"))
    )
    # sizes has a row per vector length.
    asked = wanted.join(F.broadcast(sizes), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("part"), F.lit(1).alias("kind"), "query_id", "v")
    rows = (
        trees.select("dim", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "tree")
        .unionByName(asked.withColumn("tree", F.lit(None).cast("binary")))
        .repartition("dim", "part").sortWithinPartitions("dim", "part", "kind", "query_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            dim, part, kind = (batch.column(c).to_numpy() for c in ("dim", "part", "kind"))
            cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece, key = batch.slice(a, b - a), (dim[a], part[a])
                if kind[a] == 0:
                    now, tree = key, pickle.loads(piece.column("tree")[0].as_py())
                    continue
                if key != now:
                    continue
                ids = piece.column("query_id").to_numpy()
                found = tree.search(ids, _matrix(piece.column("v")), k, factor)
                out = [(q, i, s) for q, x in zip(ids.tolist(), found) for s, i in x]
                if out:
                    q, i, s = zip(*out)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    near = rows.mapInArrow(tidied(run), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
