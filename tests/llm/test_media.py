"""Image copies against a comparison of all pairs."""

import numpy as np
import pytest

pytest.importorskip("codefacts.llm")
from pyspark.sql import functions as F  # noqa: E402

from codefacts.llm import media  # noqa: E402
from codefacts.llm.grouping import stars  # noqa: E402


def turned(img, degrees):
    h, w = img.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    yy, xx = (h - 1) / 2 + c * y - s * x, (w - 1) / 2 + s * y + c * x
    yy, xx = np.clip(yy, 0, h - 1.001), np.clip(xx, 0, w - 1.001)
    a, b = yy.astype(int), xx.astype(int)
    fy, fx = yy - a, xx - b
    return img[a, b] * (1 - fy) * (1 - fx) + img[a + 1, b] * fy * (1 - fx) + img[a, b + 1] * (1 - fy) * fx + img[a + 1, b + 1] * fy * fx


_noise = np.random.default_rng(8)
EDITS = {
    "crop": lambda i: media.edited(i, 0), "quarter turn": lambda i: media.edited(i, 1), "scaled by 1.25": lambda i: media.edited(i, 2),
    "overlaid": lambda i: media.edited(i, 3), "scaled by 1.1": lambda i: media.resize(i, 123, 123), "turned by 10": lambda i: turned(i, 10),
    "turned by 5": lambda i: turned(i, 5), "coarse greys": lambda i: np.round(i / 24) * 24 + _noise.normal(size=i.shape) * 4, "half the area": lambda i: i[:80, :80],
}


def test_recall_against_all_pairs(spark):
    """Of the pairs that geometric consensus accepts when all pairs are compared, 0.9 or more of each
    kind of edit are candidates, and the classes are those of the links."""
    rng, rows, of = np.random.default_rng(4), [], {}
    for base in range(20):
        img = media.decode(media.png(media.render(rng.normal(size=64))))
        rows.append((base * 100, media.png(img)))
        for k, (name, edit) in enumerate(EDITS.items()):
            of[base * 100 + k + 1] = name
            rows.append((base * 100 + k + 1, media.png(edit(img))))
    own = {i: media.describe(media.decode(data)) for i, data in rows}
    own = {i: (media.unpack(media.pack(p)), d) for i, (p, d) in own.items()}
    frame = spark.createDataFrame(rows, "media_id long, image binary").repartition(4)
    found = media.features(frame, "media_id", "image")
    pairs, _ = media.candidates(media.keyed(found), [])
    met = {(r.a, r.b) for r in pairs.collect()}
    true = {(i, i - i % 100) for i in of if media.agreeing(own[i], own[i - i % 100]) >= media.AGREE}
    for name in EDITS:
        of_kind = [x for x in true if of[x[0]] == name]
        assert np.mean([x in met for x in of_kind]) >= 0.9, name
    ids = sorted(own)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if media.agreeing(own[a], own[b]) >= media.AGREE]
    a, b = stars(*(np.array(x) for x in zip(*links)))
    want = {i: i for i in ids} | dict(zip(a.tolist(), b.tolist()))
    got = {r.media_id: r.class_id for r in media.copies(frame).collect()}
    assert all(got[i] == want[i] or got[i] == i for i in ids)
    assert np.mean([got[i] == want[i] for i in ids if want[i] != i]) >= 0.95


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Any two ids that share two keys are a candidate or in one bucket of two keys."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(media, "SMALL", 16)
    rows = [(i, int(k), 5) for i in range(120) for k in {0, *rng.integers(1, 60, 4).tolist()}] + [(500, 7, 5), (501, 8, 5)]
    pairs, members = media.candidates(spark.createDataFrame(rows, "id long, key long, pose int"), [])
    found = {(r.a, r.b) for r in pairs.collect()}
    for r in members.groupBy("key").agg(F.collect_set("id").alias("ids")).collect():
        found |= {(a, b) for a in r.ids for b in r.ids if a > b}
    keys = {}
    for i, k, _ in rows:
        keys.setdefault(i, set()).add(k)
    want = {(a, b) for a in keys for b in keys if a > b and len(keys[a] & keys[b]) >= 2}
    assert found == want


def test_large_images():
    """Corners grow with the image, and a small part of a large one is still found."""
    rng = np.random.default_rng(6)
    img = np.concatenate([np.concatenate([media.render(rng.normal(size=8), 200) for _ in range(3)], axis=1) for _ in range(3)])
    whole, part = media.describe(img.astype(np.float32)), media.describe(img[210:390, 215:395].astype(np.float32))
    assert len(whole[0]) > 9 * 56 and media.agreeing(part, whole) >= media.AGREE
    assert len(set(media.table_keys(part[1])[0]) & set(media.table_keys(whole[1])[0])) >= 2
    places = media.unpack(media.pack(whole[0]))
    assert np.abs(places[:, :2] - whole[0][:, :2]).max() <= 0.25 and np.allclose(places[:, 2], whole[0][:, 2])


def test_edges(spark):
    img = media.png(media.render(np.arange(5.0)))
    rows = [(7, img), (7, b"x"), (7, img), (9, img), (3, None), (4, b""), (None, img), (11, media.png(np.zeros((40, 40))))]
    frame = spark.createDataFrame(rows, "media_id long, image binary").withColumns({"class_id": F.lit(1), "key": F.lit("k"), "digest": F.lit(2)})
    got = sorted(((r.media_id, r.class_id) for r in media.copies(frame).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (7, 7), (9, 7), (3, 3), (4, 4), (None, None), (11, 11)], key=str)
    assert media.copies(frame.limit(0)).count() == 0
