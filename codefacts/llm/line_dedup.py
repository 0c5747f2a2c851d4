"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key hash, number of documents, largest document id, fresh), bucketed and sorted
by the hash, all runs in the same number of buckets: they meet in merge joins without an exchange.
Each batch of documents is one exchange of its hashes and one run of level 0. It is merge-anti-joined
with the runs before it: keys that none of them has are ``fresh``, the batch's own; the others are
counts that add to a key that is fresh in an older run. When a level holds ``fan_in`` runs they are
compacted into one of the next level by merge joins.

So a key is fresh in one run, and its counts are there and in newer runs, where it isn't fresh: the
frequent keys are found run by run, with nothing grouped again.

The text is read twice: once for the hashes of all lines, which are kept as a table of one row a
document, dealt into batches, and once to drop the lines. Only DataFrame functions are used.

Defined cases: a null or empty text is one empty line; every row counts as one document, whatever
its id; a null ``doc_id`` ranks below all others, and if no row that holds a key has an id, all of
them keep it; an empty table gives an empty result; columns called like the added ones are replaced,
others pass through unchanged, also when they are called ``lines``, ``key`` or the like.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fresh_path, give_back, written

#: The white space that is stripped from both ends of a line.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def hash_of(line: Column, min_chars: int) -> Column:
    """128 bits of the key in hex, null if the key is short."""
    key = key_of(line)
    return F.when(F.char_length(key) >= min_chars, F.md5(key))


def hashed(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """(doc_id, t, hashes, batch) of every row: the hash of each of its lines, in order. ``t`` tells
    rows of one id with different texts apart."""
    hashes = F.transform(lines_of(F.col("text")), lambda x: hash_of(x, min_chars))
    return docs.select("doc_id", F.xxhash64("text").alias("t"), hashes.alias("hashes"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


def run_of(rows: DataFrame) -> DataFrame:
    """(h, n_docs, owner) of a batch of ``hashed`` rows. A document names a key once, so the partial
    counts of a very frequent line are one row a task before the exchange."""
    keys = rows.select(F.col("doc_id").alias("owner"), F.explode(F.array_distinct(F.array_compact("hashes"))).alias("x"))
    return keys.select("owner", F.unhex("x").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("owner").alias("owner"))


class LineRuns:
    """The runs so far, by level; all of them are bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, f"run-{level}")
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        """The runs, the oldest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def unseen(self, run: DataFrame) -> DataFrame:
        """The rows of a batch's run whose key no run holds: a merge-anti-join with each."""
        return reduce(lambda rows, old: rows.join(old.select("h").hint("merge"), "h", "left_anti"), self.runs(), run)

    def add(self, rows: DataFrame) -> None:
        """Add the run of a batch of ``hashed`` rows; compact every level that is full."""
        own = self._write(run_of(rows).withColumn("fresh", F.lit(True)), 0)
        if self.runs():
            # The batch's keys are written once; what the anti-join leaves of them is fresh.
            whole = self.spark.table(own).drop("fresh")
            fresh = self.unseen(whole).select("h", F.lit(True).alias("fresh"))
            marked = whole.join(fresh.hint("merge"), "h", "left").select("h", "n_docs", "owner", F.coalesce("fresh", F.lit(False)).alias("fresh"))
            whole_name, own = own, self._write(marked, 0)
            self._drop([whole_name])
        self.levels[0].append(own)
        for level in range(99):
            if len(self.levels[level]) < self.fan_in:
                break
            self._compact(level)

    def _compact(self, level: int) -> None:
        """One run of a level's runs: a merge join with each. A key that is fresh in one of them is
        fresh in what they become."""
        first, *others = self.levels[level]
        if level + 1 == len(self.levels):
            self.levels.append([])
        for name in others:
            a, b = (self.spark.table(x).select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("n_docs", "owner", "fresh")]) for k, x in (("a", first), ("b", name)))
            n = F.coalesce("n_docs_a", F.lit(0)) + F.coalesce("n_docs_b", F.lit(0))
            fresh = F.coalesce("fresh_a", F.lit(False)) | F.coalesce("fresh_b", F.lit(False))
            both = a.join(b.hint("merge"), "h", "full").select("h", n.alias("n_docs"), F.greatest("owner_a", "owner_b").alias("owner"), fresh.alias("fresh"))
            old, first = (first, name), self._write(both, level + 1)
            self._drop([*old])
        self.levels[level] = []
        self.levels[level + 1].append(first)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, [self.paths.pop(name)])

    def frequent(self, min_docs: int) -> DataFrame:
        """(h, owner) of the keys in ``min_docs`` documents or more over all runs: the fresh keys of
        each run with what newer runs, where they aren't fresh, add to them."""
        parts, runs = [], self.runs()
        for i, run in enumerate(runs):
            rows = run.where("fresh").select("h", "n_docs", "owner")
            for newer in runs[i + 1 :]:
                more = newer.where("not fresh").select("h", F.col("n_docs").alias("n"), F.col("owner").alias("o"))
                rows = rows.join(more.hint("merge"), "h", "left").select("h", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("owner", "o").alias("owner"))
            parts.append(rows.where(F.col("n_docs") >= min_docs).select("h", "owner"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "h binary, owner long")

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fan_in: int = 2) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or
    more is dropped everywhere but in the largest ``doc_id`` that holds it. The documents come in
    ``batches``, dealt by a hash of the id.
    """
    spark, cols = docs.sparkSession, docs.columns
    give_back()
    path, runs = fresh_path(spark, "lines"), LineRuns(spark, fan_in)
    rows = hashed(docs, min_chars, batches)
    rows.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    for i in range(batches):
        runs.add(rows.where(F.col("batch") == i))
    gone: list[str] = []
    frequent = written(runs.frequent(min_docs), "frequent-lines", gone)
    runs.close()

    # What is lost, as positions by document.
    lost = (
        rows.select("doc_id", "t", F.posexplode("hashes").alias("pos", "x")).where("x is not null").withColumn("h", F.unhex("x"))
        .join(frequent, "h").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__lost"))
    )
    lost = written(lost, "lost-lines")
    drop(spark, [path, *gone])
    # Positions belong to a text: rows of one id with different texts are told apart by its hash.
    same = docs["doc_id"].eqNullSafe(lost["__id"]) & (F.xxhash64(docs["text"]) == lost["__t"])
    # Always the same join: a broadcast of so many positions would not hold at any size.
    met = docs.join(lost.hint("merge"), same, "left")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col("__lost"))
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in cols if c not in ("n_lines", "n_dropped")]
    return met.select(*out, F.array_size(lines).cast("long").alias("n_lines"), F.coalesce(F.array_size("__lost"), F.lit(0)).cast("long").alias("n_dropped"))
