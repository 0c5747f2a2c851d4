"""Copies among images by local descriptors.

Corners are found on several scales of an image; each gets an orientation from its patch's
intensity centroid and 256 binary intensity tests, rotated by it. Descriptors meet in Hamming
tables: a table's key is a fixed draw of the bits, so descriptors a few bits apart share some keys.
Images that share two keys are compared by geometric consensus: matched corners must agree on one
similarity transform. That finds crops, rotations, scaled, recompressed, brightened and overlaid
copies.

Two keys are asked for, since unrelated images often share one; if they share no more than two, these
must tell of about the same turn and scale. Images of a bucket of at most ``SMALL`` are paired and
the pairs counted over the buckets. A larger bucket is split by the second key: its members meet
again in buckets of two keys, each with its least member first, so a key that very many images have
makes no pairs of all of them, and still no two images that share two keys are missed (see
``grouping.link``).

The number of corners grows with the image: ``CORNERS`` on each scale, or one for each ``SPACING``
pixels if that is more, the best of each tile of the image first. Descriptors of a pair are compared
in pieces, so a large image takes time, not memory.

A media column holds encoded images: PNG (8 bit grey, grey with alpha, RGB or RGBA, not
interlaced) or binary PGM. Defined cases: null, empty or undecodable bytes and images without
corners are a class of their own; equal bytes are one class at once; a null id takes no part and
has a null class; rows of one id are one item, linked if any of them is; other columns don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, tidied, written
from .grouping import buckets, degrees, link, salted

#: Scales, the corners kept on each at least, the radius of a patch and the border that corners keep.
SCALES, CORNERS, RADIUS, BORDER = (1.0, 0.8, 0.64, 0.512), (20, 16, 12, 8), 12, 17
#: Pixels of a scale for a corner more, and the side of a tile that corners are spread over.
SPACING, TILE = 300, 64
TESTS, ANGLES = 256, 36
#: Hamming tables and the bits of a key.
TABLES, KEY_BITS = 4, 32
#: Images of a bucket whose pairs are counted directly.
SMALL = 128
#: Steps of a full turn, and how many the turns that two keys tell of may differ in.
STEPS, TURN = 64, 6
#: Bits that matched descriptors may differ in; corners that must agree, and how closely.
FAR, AGREE, PIXELS = 56, 8, 3.5
SALT = 512
#: Descriptors of one image that are compared with all of another's at a time.
PIECE = 512

_rng = np.random.default_rng(20240101)
_offsets = np.clip(np.round(_rng.normal(0, RADIUS / 2, (TESTS, 4))), -RADIUS + 1, RADIUS - 1)
# Keys are drawn from the half of the tests whose two points are nearest: they depend least on each other.
_near = np.argsort(np.hypot(_offsets[:, 0] - _offsets[:, 2], _offsets[:, 1] - _offsets[:, 3]), kind="stable")[: TESTS // 2]
_keys = [np.sort(_near[_rng.permutation(TESTS // 2)[:KEY_BITS]]) for _ in range(TABLES)]


def _pattern() -> np.ndarray:
    """The tests' pixel offsets (y, x, y, x) for each of ANGLES orientations."""
    out = np.zeros((ANGLES, TESTS, 4), dtype=np.int64)
    for k in range(ANGLES):
        c, s = np.cos(2 * np.pi * k / ANGLES), np.sin(2 * np.pi * k / ANGLES)
        for j in (0, 2):
            y, x = _offsets[:, j], _offsets[:, j + 1]
            out[k, :, j] = np.round(s * x + c * y)
            out[k, :, j + 1] = np.round(c * x - s * y)
    return out


_rotated = _pattern()
_disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values, or None."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data and data[:2] == b"P5":
            parts = data.split(None, 4)
            width, height = int(parts[1]), int(parts[2])
            flat = np.frombuffer(data[-width * height :], np.uint8)
            return flat.reshape(height, width).astype(np.float32)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        pass
    return None


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced:
        raise ValueError("not supported")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width, n), dtype=np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].reshape(width, n)
        up = out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        else:
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                above = up[x].astype(np.int64)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                left = (line[x] + guess) % 256
                out[y + 1, x], corner = left, above
    img = out[1:].astype(np.float32)
    return img[..., 0] if n < 3 else img[..., :3] @ np.array([0.299, 0.587, 0.114], dtype=np.float32)


def png(img: np.ndarray) -> bytes:
    """Grey values as PNG."""
    h, w = img.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.clip(np.round(img), 0, 255).astype(np.uint8)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, on pixel centres."""
    h, w = img.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None]
    rows = img[y0] * (1 - fy) + img[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of radius r."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    k = 2 * r + 1
    s = p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]
    return (s[: a.shape[0], : a.shape[1]] / (k * k)).astype(np.float32)


def _spread(y: np.ndarray, x: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """The order of corners: the best of each tile, then the second of each, so that a part of a
    large image keeps corners whatever the rest of it holds; ties by strength."""
    order = np.argsort(-strength, kind="stable")
    tile = ((y // TILE) * (1 << 20) + x // TILE)[order]
    by_tile = np.argsort(tile, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(tile[by_tile]) != 0)) if len(tile) else np.zeros(0, np.int64)
    rank = np.empty(len(tile), np.int64)
    rank[by_tile] = np.arange(len(tile)) - np.repeat(starts, np.diff(np.append(starts, len(tile))))
    return order[np.argsort(rank, kind="stable")]


def describe(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x, scale, angle) of the corners in full-size pixels, and their tests packed in bytes."""
    places, bits = [], []
    for scale, least in zip(SCALES, CORNERS):
        h, w = round(img.shape[0] * scale), round(img.shape[1] * scale)
        if min(h, w) <= 2 * BORDER + 2:
            continue
        own = img if scale == 1 else resize(img, h, w)
        smooth = _box(own, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        harris = a * b - c * c - 0.05 * (a + b) ** 2
        inner = harris[BORDER:-BORDER, BORDER:-BORDER]
        peak = inner > 1e-2
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    other = harris[BORDER + dy : h - BORDER + dy, BORDER + dx : w - BORDER + dx]
                    peak &= inner >= other if (dy, dx) > (0, 0) else inner > other
        y, x = np.nonzero(peak)
        best = _spread(y, x, inner[y, x])[: max(least, inner.size // SPACING)]
        y, x = y[best] + BORDER, x[best] + BORDER
        if not len(y):
            continue
        patch = smooth[y[:, None] + _disc[:, 0], x[:, None] + _disc[:, 1]]
        angle = np.arctan2(patch @ _disc[:, 0].astype(np.float32), patch @ _disc[:, 1].astype(np.float32))
        turn = _rotated[np.round(angle * ANGLES / (2 * np.pi)).astype(int) % ANGLES]
        soft = smooth
        one = soft[y[:, None] + turn[:, :, 0], x[:, None] + turn[:, :, 1]]
        two = soft[y[:, None] + turn[:, :, 2], x[:, None] + turn[:, :, 3]]
        bits.append(one < two)
        places.append(np.stack([(y + 0.5) / scale, (x + 0.5) / scale, np.full(len(y), scale), angle], axis=1))
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8)
    return np.concatenate(places).astype(np.float32), np.packbits(np.concatenate(bits), axis=1)


def table_keys(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of an image's descriptors in all tables, and the first descriptor of each."""
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits, power = np.unpackbits(packed, axis=1), 1 << np.arange(KEY_BITS, dtype=np.int64)
    keys, at = np.unique(np.concatenate([(bits[:, k].astype(np.int64) @ power) * TABLES + t for t, k in enumerate(_keys)]), return_index=True)
    return keys, at % len(packed)


def nearest(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the descriptors that are each other's nearest, at most FAR bits apart; the first
    of several. Distances are made for PIECE of them at a time."""
    b = np.unpackbits(db, axis=1).astype(np.float32)
    ones = b.sum(axis=1)
    j, off = np.zeros(len(da), np.int64), np.zeros(len(da), np.float32)
    back, least = np.zeros(len(db), np.int64), np.full(len(db), np.inf, np.float32)
    for at in range(0, len(da), PIECE):
        a = np.unpackbits(da[at : at + PIECE], axis=1).astype(np.float32)
        far = a.sum(axis=1)[:, None] + ones[None] - 2 * (a @ b.T)
        j[at : at + PIECE] = far.argmin(axis=1)
        off[at : at + PIECE] = far.min(axis=1)
        k = far.argmin(axis=0)
        better = far[k, np.arange(len(db))] < least
        back[better], least[better] = k[better] + at, far[k, np.arange(len(db))][better]
    i = np.flatnonzero((off <= FAR) & (back[j] == np.arange(len(da))))
    return i, j[i]


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The most matched corners of two images that agree on one similarity transform."""
    (pa_, da), (pb, db) = a, b
    if not len(pa_) or not len(pb):
        return 0
    i, j = nearest(da, db)
    if len(i) < AGREE:
        return 0
    p, q = pa_[i].astype(np.float64), pb[j].astype(np.float64)
    scale, turn = p[:, 2] / q[:, 2], q[:, 3] - p[:, 3]
    # Each pair of neighbouring matches, and each match alone, proposes a transform z -> m z + t.
    zp, zq = p[:, 1] + 1j * p[:, 0], q[:, 1] + 1j * q[:, 0]
    m = list(scale * np.exp(1j * turn))
    t = list(zq - np.array(m) * zp)
    for step in (1, 2, 3, 5):
        dp, dq = np.roll(zp, -step) - zp, np.roll(zq, -step) - zq
        ok = (np.abs(dp) > 6) & (np.abs(dq) > 3)
        own = dq[ok] / dp[ok]
        m += list(own)
        t += list(zq[ok] - own * zp[ok])
    m, t = np.array(m), np.array(t)
    sane = (np.abs(m) > 0.3) & (np.abs(m) < 3.4)
    m, t, best = m[sane], t[sane], np.zeros(len(zp), bool)
    for at in range(0, len(m), PIECE):
        good = np.abs(m[at : at + PIECE, None] * zp[None] + t[at : at + PIECE, None] - zq[None]) <= PIXELS
        k = good.sum(axis=1).argmax()
        if good[k].sum() > best.sum():
            best = good[k]
    # Corners on one spot count once.
    return len({(round(z.real / 3), round(z.imag / 3)) for z in zp[best]})


def pack(places: np.ndarray) -> bytes:
    """Places in 6 bytes each: half pixels, the number of the scale, the angle in 256 steps."""
    out = np.zeros(len(places), dtype=[("y", "<u2"), ("x", "<u2"), ("scale", "u1"), ("angle", "u1")])
    out["y"], out["x"] = (np.minimum(np.round(places[:, k] * 2), 65535) for k in (0, 1))
    out["scale"] = np.abs(places[:, 2:3] - np.array(SCALES)[None]).argmin(axis=1)
    out["angle"] = np.round(places[:, 3] * 256 / (2 * np.pi)).astype(np.int64) % 256
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=[("y", "<u2"), ("x", "<u2"), ("scale", "u1"), ("angle", "u1")])
    return np.stack([raw["y"] / 2, raw["x"] / 2, np.array(SCALES)[raw["scale"]], raw["angle"] * (2 * np.pi / 256)], axis=1).astype(np.float32)


def features(media: DataFrame, item: str, column: str) -> DataFrame:
    """(id, digest, places, bits) of each row of a media column, in one pass over it: the images
    themselves are never shuffled. The digest is null for null and empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, places, bits = [], [], []
            for data in batch.column("data"):
                data = data.as_py()
                img = decode(data)
                p, d = describe(img) if img is not None else (np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8))
                digests.append(hashlib.sha256(data).digest() if data else None)
                places.append(pack(p))
                bits.append(d.tobytes())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "digest": pa.array(digests, pa.binary()), "places": pa.array(places, pa.binary()), "bits": pa.array(bits, pa.binary()),
            })

    rows = media.select(F.col(item).cast("long").alias("id"), F.col(column).alias("data"))
    return rows.mapInArrow(tidied(run), "id long, digest binary, places binary, bits binary")


def _bits(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, TESTS // 8)


def pose(places: np.ndarray) -> np.ndarray:
    """Scale and angle of corners in one number."""
    scale = np.abs(places[:, 2:3] - np.array(SCALES, np.float32)[None]).argmin(axis=1)
    return scale * STEPS + np.round(places[:, 3] * STEPS / (2 * np.pi)).astype(np.int64) % STEPS


def keyed(found: DataFrame) -> DataFrame:
    """(id, key, pose) of the descriptors of (id, places, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, poses = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for places, bits in zip(batch.column("places").to_pylist(), batch.column("bits").to_pylist()):
                k, at = table_keys(_bits(bits))
                keys.append(k)
                poses.append(pose(unpack(places))[at])
            ids = np.repeat(batch.column("id").to_numpy(), [len(k) for k in keys[1:]])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "key": pa.array(np.concatenate(keys), pa.int64()), "pose": pa.array(np.concatenate(poses), pa.int32())})

    return found.select("id", "places", "bits").mapInArrow(tidied(run), "id long, key long, pose int")


def met(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(key, n, ids, poses) of the buckets of (id, key, pose) with several ids; one of more than
    SMALL is there in several rows."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key", "n")
    piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SMALL)).cast("int")
    lists = rows.join(sizes, "key").groupBy("key", "n", piece.alias("piece")).agg(F.collect_list(F.struct("id", "pose")).alias("x"))
    return written(lists.select("key", "n", F.col("x.id").alias("ids"), F.col("x.pose").alias("poses")), "buckets", keep)


def pairs_of(small: DataFrame) -> DataFrame:
    """(a, b, turn), a > b, of the ids of each row: SMALL of them at most. ``turn`` is the difference
    of the poses: 2 * STEPS for each step of scale, and that of the angles from 0 to STEPS - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids, poses, owner = lists.flatten().to_numpy(), batch.column("poses").flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((ids, owner))
            ids, poses, owner = ids[order], poses[order], owner[order]
            for step in range(1, len(ids)):
                same = (owner[step:] == owner[:-step]) & (ids[step:] != ids[:-step])
                if not (owner[step:] == owner[:-step]).any():
                    break
                one, two = poses[step:][same], poses[:-step][same]
                turn = (one // STEPS - two // STEPS) * (2 * STEPS) + (one - two) % STEPS
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[step:][same], pa.int64()), "b": pa.array(ids[:-step][same], pa.int64()), "turn": pa.array(turn, pa.int32())})

    return small.select("ids", "poses").mapInArrow(tidied(run), "a long, b long, turn int")


def candidates(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, n) that share n >= 2 keys of small buckets, and the members (key, id, low)
    of the buckets of two keys, one of them that of a large bucket."""
    found = met(rows, keep)
    shared = pairs_of(found.where(F.col("n") <= SMALL)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("x"), F.max("turn").alias("y"))
    off = F.pmod(F.col("y") - F.col("x"), F.lit(STEPS))
    scales = F.abs(F.floor(F.col("y") / (2 * STEPS)) - F.floor(F.col("x") / (2 * STEPS)))
    alike = (F.least(off, F.lit(STEPS) - off) <= TURN) & (scales <= 1)
    pairs = written(shared.where((F.col("n") > 2) | (F.col("n") == 2) & alike).select("a", "b", "n"), "candidates", keep)
    large = written(found.where(F.col("n") > SMALL).select("key", F.explode("ids").alias("id")).distinct(), "large", keep)
    own = rows.join(large.select("id").distinct(), "id", "left_semi").select("id", F.col("key").alias("other"))
    two = large.join(own, "id").where("key <> other").select("id", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"))
    return pairs, buckets(two.distinct(), keep)


def consensus(pairs: DataFrame, found: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) whose images agree in ``agree`` corners or more; a task streams its rows
    and holds the features of one b at a time."""
    rows = salted(pairs, SALT).join(found.select("id", "places", "bits"), "id").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, []
        for batch in batches:
            a, b, n = [], [], []
            cols = [batch.column(c) for c in ("id", "b", "salt", "kind", "places", "bits")]
            for one, two, salt, kind, places, bits in zip(*(c.to_pylist() for c in cols)):
                this = unpack(places), _bits(bits)
                if kind == 0:
                    if head != (two, salt):
                        head, own = (two, salt), []
                    own.append(this)
                elif head == (two, salt) and (k := max(agreeing(this, x) for x in own)) >= agree:
                    a.append(one)
                    b.append(two)
                    n.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "corners": pa.array(n, pa.int32())})

    return rows.mapInArrow(tidied(run), "a long, b long, corners int").groupBy("a", "b").agg(F.max("corners").alias("corners"))


def copies(media: DataFrame, item: str = "media_id", column: str = "image", agree: int = AGREE) -> DataFrame:
    """(item, class_id, n_links) of every row: the least id of the images that links connect."""
    keep: list[str] = []
    found = written(features(media, item, column), "features", keep)
    ids = found.select("id", "digest")
    usable = found.where("id is not null and digest is not null")
    heads = usable.groupBy("digest").agg(F.min("id").alias("id"))
    # An id whose rows hold several images keeps the features of all of them.
    own = usable.join(heads, ["digest", "id"], "left_semi").select("id", "places", "bits")
    pairs, members = candidates(keyed(own), keep)
    links, parts = link(members, lambda some: consensus(some, own, agree), keep, extra=pairs)
    classes = (
        heads.withColumnRenamed("id", "head")
        .join(parts.withColumnRenamed("id", "head"), "head", "left").join(degrees(links).withColumnRenamed("id", "head"), "head", "left")
        .select("digest", F.coalesce("component", "head").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    )
    done = ids.join(classes, "digest", "left").select(
        F.col("id").alias(item),
        F.when(F.col("id").isNull(), None).otherwise(F.coalesce("class_id", "id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    done = written(done, "classes")
    drop(media.sparkSession, keep)
    return done


def render(vector: np.ndarray, size: int = 112) -> np.ndarray:
    """An image of a vector, for tables that hold vectors and no pictures: its bytes fix noise
    on three scales and some rectangles."""
    rng = np.random.default_rng(np.frombuffer(np.asarray(vector, np.float32).tobytes().ljust(8, b"\0"), np.uint8).tolist())
    img = sum(k * resize(rng.normal(size=(n, n)).astype(np.float32), size, size) for n, k in ((7, 30), (16, 30), (36, 30), (64, 26))) + 128
    for _ in range(8):
        y, x = rng.integers(0, size, 2)
        h, w = rng.integers(6, 26, 2)
        img[y : y + h, x : x + w] += rng.normal() * 50
    return img


def edited(img: np.ndarray, kind: int) -> np.ndarray:
    """A copy of an image: 0 cropped, 1 turned a quarter and darker, 2 scaled, 3 overlaid."""
    n = len(img)
    if kind == 0:
        return img[n // 12 : n - n // 16, n // 16 : n - n // 10]
    if kind == 1:
        return np.rot90(img) * 0.8
    if kind == 2:
        return resize(img, round(n * 1.25), round(n * 1.25))
    out = np.clip(img * 1.15 + 8, 0, 255)
    out[: n // 5, : n // 3] = 255
    return out


def rendered(vectors: DataFrame, step: int = 8) -> DataFrame:
    """(media_id, image) of every row of (vec_id, embedding). Of ``step`` ids in turn the four
    after the first are edited copies of the first's image, the others images of their own; a null
    or empty vector has no image."""
    own = vectors.select(F.col("vec_id").cast("long").alias("media_id"), "embedding")
    turn = F.pmod("media_id", F.lit(step))
    first = own.where(turn == 0).groupBy(F.col("media_id").alias("base")).agg(F.min("embedding").alias("e"))
    rows = own.withColumns({"kind": F.when(turn.between(1, 4), (turn - 1).cast("int")), "base": F.when(turn.between(1, 4), F.col("media_id") - turn).otherwise(F.col("media_id"))})
    rows = rows.join(first, "base", "left").select("media_id", F.when(F.col("e").isNull(), -1).otherwise(F.coalesce("kind", F.lit(-1))).alias("kind"), F.coalesce(F.when(F.col("kind").isNotNull(), F.col("e")), "embedding").alias("e"))

    # Rows are small and their work is not, so they are dealt over all cores by number, not by bytes.
    rows = rows.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism, "media_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for e, kind in zip(batch.column("e").to_pylist(), batch.column("kind").to_pylist()):
                img = render(np.array([x or 0 for x in e], np.float32)) if e else None
                images.append(None if img is None else png(img if kind < 0 else edited(img, kind)))
            yield pa.RecordBatch.from_pydict({"media_id": batch.column("media_id"), "image": pa.array(images, pa.binary())})

    return rows.mapInArrow(tidied(run), T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", T.BinaryType())]))
