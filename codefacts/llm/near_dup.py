"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. A document-frequency sketch counts, over all documents, in how many a shingle of five words
   occurs: 2^21 counters by shingle hash. Its size is fixed, and so is its accuracy: the load of a
   counter grows with the corpus exactly as the floor below which frequencies are told apart no
   more (``1/1000`` of the documents).
2. Weights are term frequency times a damped inverse document frequency. A document's shingles are
   dealt by hash over 32 bins; in each bin four consistent weighted samples are drawn (a sample is
   the shingle of least ``ln a`` in Ioffe's scheme), and empty bins borrow from another one that
   their number fixes. 125 of the 128 samples form 25 bands of 5.
3. Equal word sequences are one class at once and go on as one representative. Documents that
   share a band are compared with the least document of the band's bucket, never all with all; the
   weighted Jaccard similarity of their whole texts decides. Buckets that still hold more than one
   component are tried again with other representatives until that links nothing more; then all
   pairs that a bucket holds in different components are compared, but for those that sums of
   weights by hash show to be under the least similarity.
4. Links make components; the class of a document is the least id of its component.

Words are what white space separates, lower-cased. Defined cases: a text of one to four words is
one shingle; a null text or one without words is a class of its own; a null id takes no part and
has a null class; rows of one id are one document if their words agree and are linked as any
others if not: each text has its own links, and ``class_id`` is that of the row's text; other
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, tidied, written
from .grouping import buckets, degrees, link, salted

SHINGLE, SIMILARITY = 5, 0.8
COUNTERS, BLOCK = 1 << 21, 1 << 15
#: Bits of a task's number that its group of tasks leaves out when counters are added up.
GROUP_BITS = 9
#: Document frequencies under this share of the documents are taken as equal.
FLOOR = 1e-3
#: How much a rare shingle weighs more than one in all documents: 1 + DAMPING at most, to 1.
DAMPING = 0.25
BINS, DRAWS, BANDS, ROWS = 32, 4, 25, 5
#: Cells that a document's weights are summed in, to exclude pairs without their texts.
CELLS = 128
#: Documents that one task compares with one copy of a representative.
SALT = 256
#: Ids of dropped documents that are broadcast, 16 MB of them; beyond, the texts are shuffled once.
MOST_IDS = 1 << 21
#: Characters of text that one array operation takes.
CHUNK = 1_000_000
_MEMO = 100_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """A bounded memo of word hashes."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingle hashes of each text, sorted within a text, their term frequencies, how
    many each text has, and 128 bits of each word sequence (empty without words)."""
    get, parts, digests = _words.__getitem__, [], []
    for t in texts:
        ws = t.lower().split()
        h = np.fromiter(map(get, ws), dtype=np.uint64, count=len(ws))
        parts.append(h)
        digests.append(xxhash.xxh3_128_digest(h.tobytes()) if ws else b"")
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    out = []
    if len(flat) >= SHINGLE:
        n = len(flat) - SHINGLE + 1
        rolled = sum(flat[k : n + k] * _C[k] for k in range(SHINGLE))
        rolled = _mix(rolled)
    ends = np.cumsum(counts)
    for p, end, n in zip(parts, ends.tolist(), counts.tolist()):
        if n >= SHINGLE:
            out.append(np.sort(rolled[end - n : end - SHINGLE + 1]))
        elif n:
            out.append(_mix(np.array([xxhash.xxh3_64_intdigest(p.tobytes())], dtype=np.uint64)))
        else:
            out.append(p)
    sizes = np.array([len(p) for p in out], dtype=np.int64)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    if not len(flat):
        return flat, np.zeros(0, np.int64), sizes, digests
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    firsts = np.cumsum(sizes) - sizes
    new[firsts[sizes > 0]] = True
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(flat)))
    owner = np.repeat(np.arange(len(out)), sizes)[at]
    return flat[at], tf, np.bincount(owner, minlength=len(out)), digests


def idf_of(counts: np.ndarray, docs: int, damping: float = DAMPING) -> np.ndarray:
    """Weights by counter, from 1 (in every document) to 1 + ``damping`` (under the floor)."""
    low = max(1.0, FLOOR * docs)
    x = np.log(max(docs, 2) / np.clip(counts, low, max(low, docs)))
    top = np.log(max(docs, 2) / low)
    return (1 + damping * (x / top if top > 0 else np.ones_like(x))).astype(np.float32)


def weights(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1] of each 64 bits."""
    a = ((x >> np.uint64(40)).astype(np.float32) + 1) * np.float32(2**-24)
    b = (((x >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) + 1) * np.float32(2**-24)
    return a, b


def samples(hashes: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """DRAWS x BINS samples of each document as bits of its least ``ln a``; zeros without any."""
    n = len(counts)
    out = np.full((n, DRAWS, BINS), np.inf, dtype=np.float32)
    if len(hashes):
        owner = np.repeat(np.arange(n), counts)
        cell = owner * BINS + (hashes >> np.uint64(59)).astype(np.int64)  # sorted, as the hashes are
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        log_w = np.log(w)
        for d in range(DRAWS):
            x = [_mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (3 * d + k + 1)) & 0xFFFFFFFFFFFFFFFF)) for k in range(3)]
            (a, b), (c, e), (beta, _) = map(_uniform, x)
            r, log_c = -np.log(a * b), np.log(-np.log(c * e))
            t = np.floor(log_w / r + beta)
            log_a = log_c - r * (t - beta) - r
            least = np.minimum.reduceat(log_a, starts)
            out[cell[starts] // BINS, d, cell[starts] % BINS] = least
    filled = np.isfinite(out[:, 0, :])
    some = filled.any(axis=1)
    bits = out.view(np.uint32).astype(np.uint64)
    fixed = bits.copy()
    for d in range(DRAWS):
        rng = np.random.default_rng(1000 + d)
        open_ = ~filled & some[:, None]
        for _ in range(400):  # tries of a borrowing order that depends on the bin alone
            if not open_.any():
                break
            src = rng.integers(0, BINS, BINS)
            ok = open_ & filled[:, src]
            i, j = np.nonzero(ok)
            fixed[i, d, j] = bits[i, d, src[j]]
            open_ &= ~ok
        i, j = np.nonzero(open_)
        if len(i):
            fixed[i, d, j] = bits[i, d, filled[i].argmax(axis=1)]
    fixed[~some] = 0
    return fixed


def bands(sample: np.ndarray) -> np.ndarray:
    """BANDS keys of each document."""
    x = sample.reshape(len(sample), DRAWS * BINS)[:, : BANDS * ROWS].reshape(len(sample), BANDS, ROWS)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(sample), axis=0)
    for k in range(ROWS):
        key = _mix(key * np.uint64(3) + x[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    total = float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64))
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    hit = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
    return both / (total - both) if total > both else 1.0


def _chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with a bounded number of characters."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def _pack(block: np.ndarray) -> bytes:
    """Counters of a block; few of them with their places."""
    at = np.flatnonzero(block)
    if 6 * len(at) < 4 * BLOCK:
        return b"s" + at.astype(np.uint16).tobytes() + block[at].astype(np.int32).tobytes()
    return b"d" + block.astype(np.int32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] in b"dq":
        return np.frombuffer(data, dtype=np.int32 if data[:1] == b"d" else np.int64, offset=1).astype(np.int64)
    n, out = (len(data) - 1) // 6, np.zeros(BLOCK, dtype=np.int64)
    out[np.frombuffer(data, np.uint16, n, 1)] = np.frombuffer(data, np.int32, n, 1 + 2 * n)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch and the number of documents. Each task adds up its own counters, then each block
    of them is added up over the tasks; the driver gets COUNTERS integers, whatever the input."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(COUNTERS, dtype=np.int32), 0
        for batch in batches:
            for part, texts in _chunks(batch):
                h, _, _, _ = shingles(texts)
                counts += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
                n += part.num_rows
        blocks = [counts[i : i + BLOCK] for i in range(0, COUNTERS, BLOCK)]
        used = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([-1, *used], pa.int32()), "counts": pa.array([b"q" + np.int64(n).tobytes(), *[_pack(blocks[i]) for i in used]], pa.binary())}
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                x = _unpack(data)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(list(sums), pa.int32()), "counts": pa.array([b"q" + x.tobytes() for x in sums.values()], pa.binary())}
        )

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(tidied(local), schema)
    # First in groups of 512 tasks, then over the groups, so no task reads a block of all tasks.
    some = parts.withColumn("g", F.shiftright(F.spark_partition_id(), GROUP_BITS)).repartition("block", "g").select("block", "counts").mapInArrow(tidied(add), schema)
    rows = some.repartition("block").mapInArrow(tidied(add), schema).collect()
    counts, n = np.zeros(COUNTERS, dtype=np.int64), 0  # the driver's
    for r in rows:
        x = _unpack(r["counts"])
        if r["block"] < 0:
            n = int(x[0])
        else:
            counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = x
    return counts, n


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, digest, bands) of every row; ``idf`` is a broadcast of the weights by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                h, tf, counts, digests = shingles(texts)
                keys = bands(samples(h, weights(h, tf, idf.value), counts))
                some = counts > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([d or None for d in digests], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())),
                    ],
                    names=["doc_id", "digest", "bands"],
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of ``least`` or more, with it.

    All pairs of one b meet its text in tasks of SALT pairs each, so a representative of very many
    documents is spread; a task streams its rows and holds one representative at a time. An id with
    several texts is similar if any of them is.
    """
    rows = salted(pairs, SALT).join(texts, "id").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, []
        for batch in batches:
            for part, found in _chunks(batch):
                h, tf, counts, _ = shingles(found)
                w = weights(h, tf, idf.value)
                ends = np.cumsum(counts)
                a, b, sim = [], [], []
                cols = [part.column(c).to_pylist() for c in ("id", "b", "salt", "kind")]
                for i, (one, two, salt, kind) in enumerate(zip(*cols)):
                    x = slice(int(ends[i] - counts[i]), int(ends[i]))
                    if kind == 0:
                        if head != (two, salt):
                            head, own = (two, salt), []
                        own.append((h[x].copy(), w[x].copy()))
                    elif head == (two, salt) and (s := max(similarity((h[x], w[x]), y) for y in own)) >= least:
                        a.append(one)
                        b.append(two)
                        sim.append(s)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    met = rows.mapInArrow(tidied(run), "a long, b long, similarity double")
    return met.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def cells(texts: DataFrame, idf) -> DataFrame:
    """(id, cells): the weights of each text, summed by shingle hash in CELLS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _chunks(batch):
                h, tf, counts, _ = shingles(found)
                at = np.repeat(np.arange(len(counts)), counts) * CELLS + ((h >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64)
                sums = np.bincount(at, weights=weights(h, tf, idf.value), minlength=len(counts) * CELLS).astype(np.float32).reshape(-1, CELLS)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "cells": pa.array([x.tobytes() for x in sums], pa.binary())})

    return texts.mapInArrow(tidied(run), "id long, cells binary")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, rounds: int = 4, damping: float = DAMPING) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least id of the documents that links of
    similarity ``least`` or more connect, and the number of links found to other texts."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_of(counts, n, damping))
    keep: list[str] = []
    signed = written(signatures(docs, idf), "signatures", keep)

    # One representative of each word sequence goes on; a hot one is pre-aggregated.
    usable = signed.where("doc_id is not null and digest is not null")
    heads = written(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "heads", keep)
    members = buckets(heads.select("id", F.explode("bands").alias("key")), keep)
    ids = members.select("id").distinct()
    # An id whose rows have several texts keeps them all: none of its bands is checked by another text.
    texts = written(
        docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
        .join(ids, "id").withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "t"]).select("id", "text"),
        "texts", keep,
    )

    sums = lambda some: written(cells(texts.join(some, "id", "left_semi"), idf), "cells", keep)
    links, parts = link(members, lambda pairs: verified(pairs, texts, idf, least), keep, rounds, sums, least)
    degree = degrees(links)
    classes = (
        heads.select("digest", "id").join(parts, "id", "left").join(degree, "id", "left")
        .select("digest", F.coalesce("component", "id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    )
    done = signed.select("doc_id", "digest").join(classes, "digest", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    done = written(done, "classes")
    drop(spark, keep)
    return done


def _met(ids: DataFrame, n: int, most: int) -> DataFrame:
    """Ids to be joined with the documents: broadcast while there are no more than ``most``."""
    return F.broadcast(ids) if n <= most else ids


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY, most_ids: int = MOST_IDS) -> DataFrame:
    """One row of ``docs`` for each class: that of the document with the class's id, and of several
    such rows the one whose text is least in order. Rows without an id all stay.

    The ids that go are written and counted. Up to ``most_ids`` of them are broadcast and the texts
    stay where they are; more are joined by a shuffle of the texts. Both give the same rows.
    """
    found = near_duplicates(docs, least).where("doc_id is not null")
    by_id = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("class_id").alias("__class"), F.count(F.lit(1)).alias("__rows"))
    told = written(by_id.select("__id", (F.col("__class") != F.col("__id")).alias("__gone"), "__rows").where("__gone or __rows > 1"), "dropped-ids")
    n = told.agg(F.count_if(F.col("__gone")).alias("gone"), F.count_if(~F.col("__gone")).alias("again")).first()
    gone = _met(told.where("__gone").select("__id"), n["gone"], most_ids)
    kept = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    # Only ids that are there several times are looked at again; without any, that is all.
    if not n["again"]:
        return kept
    again = _met(told.where("not __gone").select("__id"), n["again"], most_ids)
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]))
    several = kept.join(again, kept["doc_id"] == again["__id"], "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return kept.join(again, kept["doc_id"] == again["__id"], "left_anti").unionByName(several)
