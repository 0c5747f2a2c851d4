"""Traversal of the call graph: layered breadth-first search.

A graph whose measured number of edges is at most ``ONE_TASK`` is walked in one task, over arrays.
Beyond that the search is a loop over DataFrames: a layer is one join of the frontier with the edges,
an anti-join with what was visited, and a small table in the shared folder, so the lineage stays
short and lost executors cost a layer at most. The frontier is broadcast by adaptive execution when
its size allows it; else the join shuffles. The driver sees one count per layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import drop, ship, written

#: Levels after which a search ends.
DEEPEST = 64
#: Edges, seeds and goals that one task may hold: some 100 MB.
ONE_TASK = 1 << 21
_EDGE, _SEED, _GOAL = range(3)


def walk(start: np.ndarray, end: np.ndarray, seeds: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, depth, parent) of what the seeds reach over edges start -> end; of several parents in
    the layer before the least, and -1 of a seed."""
    nodes = np.unique(np.concatenate([start, end, seeds]))
    s, e = np.searchsorted(nodes, start), np.searchsorted(nodes, end)
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    first = np.searchsorted(s, np.arange(len(nodes) + 1))
    depth, parent = np.full(len(nodes), -1), np.full(len(nodes), -1)
    frontier = np.unique(np.searchsorted(nodes, seeds))
    depth[frontier] = 0
    for d in range(1, deepest + 1):
        n = first[frontier + 1] - first[frontier]
        at = np.repeat(first[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found, by = e[at], np.repeat(frontier, n)
        new = depth[found] < 0
        found, by = found[new], by[new]
        if not len(found):
            break
        order = np.lexsort((by, found))
        found, by = found[order], by[order]
        one = np.append(True, found[1:] != found[:-1])
        frontier = found[one]
        depth[frontier], parent[frontier] = d, by[one]
    there = depth >= 0
    return nodes[there], depth[there], np.where(parent[there] < 0, -1, nodes[parent[there]])


def _gathered(edges: DataFrame, start: str, end: str, seeds: DataFrame, goals: DataFrame | None) -> DataFrame | None:
    """(kind, x, y) of edges, seeds and goals in one partition, None if they are too many."""
    parts = [edges.select(F.lit(_EDGE).alias("kind"), F.col(start).alias("x"), F.col(end).alias("y"))]
    parts += [t.select(F.lit(k).alias("kind"), F.col("sym_id").alias("x"), F.col("sym_id").alias("y")) for k, t in ((_SEED, seeds), (_GOAL, goals)) if t is not None]
    rows = reduce(DataFrame.unionByName, parts)
    ship(edges.sparkSession)
    return rows.coalesce(1) if rows.limit(ONE_TASK + 1).count() <= ONE_TASK else None


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = list(batches)
    kind, x, y = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in held)]).astype(np.int64) for c in ("kind", "x", "y"))
    return kind, x, y


def bfs_layers(edges: DataFrame, seeds: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(sym_id, depth) of every symbol that reaches a seed: distinct edges (caller, callee_sym)
    backwards.

    All seeds are depth 0 and not in the result, also on cycles; a symbol has its least depth.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, x, y = _arrays(batches)
        node, depth, _ = walk(x[kind == _EDGE], y[kind == _EDGE], x[kind == _SEED], deepest)
        yield pa.RecordBatch.from_pydict({"sym_id": pa.array(node[depth > 0], pa.int64()), "depth": pa.array(depth[depth > 0], pa.int32())})

    if (rows := _gathered(edges, "callee_sym", "caller", seeds, None)) is not None:
        return rows.mapInArrow(run, "sym_id long, depth int")
    spark, keep = edges.sparkSession, []
    seen = written(seeds.select("sym_id").distinct().withColumn("depth", F.lit(0)), "bfs-0", keep)
    layers, frontier = [seen], seen
    for depth in range(1, deepest + 1):
        visited = reduce(DataFrame.unionByName, layers).select("sym_id")
        step = edges.join(frontier.select(F.col("sym_id").alias("callee_sym")), "callee_sym").select(F.col("caller").alias("sym_id")).distinct()
        frontier = written(step.join(visited, "sym_id", "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}", keep)
        if frontier.isEmpty():
            break
        layers.append(frontier)
    found = layers[1:]
    if not found:
        drop(spark, keep)
        return spark.createDataFrame([], "sym_id long, depth int")
    done = written(reduce(DataFrame.unionByName, found), "layers")
    drop(spark, keep)
    return done


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(hop, sym_id) of one shortest call path from a source to a target, empty if there is none.

    Of several parents the least id wins, and of several targets, so the path is fixed. A source
    that is a target is a path of no hops. The back-trace reads one row per layer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, x, y = _arrays(batches)
        node, depth, parent = walk(x[kind == _EDGE], y[kind == _EDGE], x[kind == _SEED], len(x))
        met = np.isin(node, x[kind == _GOAL])
        steps = []
        if met.any():
            hop = int(depth[met].min())
            at = int(node[met & (depth == hop)].min())
            while hop >= 0:
                steps.append((hop, at))
                at, hop = int(parent[np.searchsorted(node, at)]), hop - 1
        yield pa.RecordBatch.from_pydict({"hop": pa.array([h for h, _ in steps], pa.int32()), "sym_id": pa.array([i for _, i in steps], pa.int64())})

    if (rows := _gathered(edges, "caller", "callee_sym", sources, targets)) is not None:
        return rows.mapInArrow(run, "hop int, sym_id long")
    spark, keep = edges.sparkSession, []
    goal = written(targets.select("sym_id").distinct(), "goal", keep)
    start = sources.select("sym_id").distinct().withColumn("parent", F.lit(None).cast("long"))
    layers = [written(start, "path-0", keep)]
    while True:
        frontier = layers[-1]
        hit = frontier.join(goal, "sym_id", "left_semi").agg(F.min("sym_id")).first()[0]
        if hit is not None:
            break
        visited = reduce(DataFrame.unionByName, layers).select("sym_id")
        step = (
            edges.join(frontier.select(F.col("sym_id").alias("caller")), "caller")
            .groupBy(F.col("callee_sym").alias("sym_id")).agg(F.min("caller").alias("parent"))
        )
        new = written(step.join(visited, "sym_id", "left_anti"), f"path-{len(layers)}", keep)
        if new.isEmpty():
            drop(spark, keep)
            return spark.createDataFrame([], "hop int, sym_id long")
        layers.append(new)
    steps = []
    for hop in range(len(layers) - 1, -1, -1):
        steps.append((hop, hit))
        hit = layers[hop].where(F.col("sym_id") == hit).first()["parent"]
    drop(spark, keep)
    return spark.createDataFrame(sorted(steps), "hop int, sym_id long")


def file_edges(call: DataFrame, sym: DataFrame, file: DataFrame) -> DataFrame:
    """(from_path, to_path, n): resolved calls between different files. The calls are counted by
    (file, callee) before they meet anything, so hot callees are small."""
    n = call.where(F.col("callee_sym").isNotNull()).groupBy("file_id", "callee_sym").agg(F.count(F.lit(1)).alias("n"))
    to = sym.select(F.col("sym_id").alias("callee_sym"), F.col("file_id").alias("to_id"))
    pairs = n.join(to, "callee_sym").where("file_id <> to_id").groupBy("file_id", "to_id").agg(F.sum("n").alias("n"))
    a = file.select("file_id", F.col("path").alias("from_path"))
    b = file.select(F.col("file_id").alias("to_id"), F.col("path").alias("to_path"))
    return pairs.join(a, "file_id").join(b, "to_id").where("from_path <> to_path").groupBy("from_path", "to_path").agg(F.sum("n").alias("n"))
