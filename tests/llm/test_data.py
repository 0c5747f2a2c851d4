"""Archives, vectors, images, URL lists and the pipeline."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("codefacts.llm")
from pyspark.sql import functions as F  # noqa: E402

from codefacts.llm import media, neighbours, queries, url_filter, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a/", body), (3, None, body), (9, "u\nv", body), (1, "http://s/", "short"), (2, "http://t/", "short"), (7, "http://n/", None), (8, "http://l/", "x" * 600_000), (None, "http://z/", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    bundles, index = warc.write(pages)
    got = {r["page_id"]: r for r in warc.read(bundles).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("response", None), 5: ("revisit", 3), 7: ("response", None), 8: ("response", None), 9: ("revisit", 3),
    }
    for page, _, html in rows[:-1]:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    found = {r["page_id"]: r["record"] for r in warc.lookup(spark, bundles, index, pages.where("page_id in (1, 8)")).collect()}
    assert found[1].endswith(b"\r\n\r\nshort") and len(found[8]) > 600_000
    files = warc.export(bundles, str(tmp_path / "out")).collect()
    assert all(len(warc.seek_table(open(f["path"], "rb").read())) for f in files)
    assert warc.read(warc.write(pages.limit(0))[0]).count() == 0
    # Repeated rows of the least id are all responses; of another id all revisits.
    again = spark.createDataFrame([(1, "u", body), (1, "u", body), (2, "v", body), (2, "v", body), (2, "v", "other")], pages.schema.fieldNames()[:3])
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read(warc.write(again)[0]).collect())
    n = len(body.encode())
    assert got == [(1, "response", 0, n)] * 2 + [(2, "response", 0, 5)] + [(2, "revisit", 1, n)] * 2
    # A revisit whose response is gone has no length and no digest: what it says isn't taken on trust.
    alone = bundles.where("false").unionByName(bundles.sparkSession.createDataFrame([("b", bytearray(_only_revisit()))], bundles.schema))
    assert [(r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read(alone).collect()] == [("revisit", None, None)]


def _only_revisit():
    out = warc.BundleWriter()
    out.add(warc.record(5, "u", b"x" * 200, "00" * 32, 3))
    return out.finish()


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(1)
    v[50:60] = v[0]
    v[70] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0, float("nan")] * 4), (502, [None] * 8), (503, [1.0, 2.0]), (None, v[1].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame, frame.where("vec_id % 50 = 0"), shard_rows=90).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    use = [i for i in range(400) if i != 70]
    for q in range(0, 400, 50):
        s = neighbours.cosines(np.repeat(v[[q]], len(use), 0), v[use])
        best = sorted((-x, i) for x, i in zip(s.tolist(), use) if i != q)[:5]
        assert got[q] == [(i, -x) for x, i in best]
    assert set(got) == set(range(0, 400, 50))


def test_tree_factor():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16))
    tree = neighbours.Tree(np.arange(3000), v)
    exact, fast = (tree.search(np.arange(0, 3000, 50), v[::50], 5, f) for f in (1.0, 1.2))
    assert np.mean([len({i for _, i in a} & {i for _, i in b}) / 5 for a, b in zip(exact, fast)]) >= 0.9


def test_media(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(48)] + [(100, None)]
    images = media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    images = images.unionByName(spark.createDataFrame([(200, b"no image"), (201, b""), (None, b"x")], "media_id long, image binary"))
    images = images.unionByName(images.where("media_id = 6").withColumn("media_id", F.lit(300).cast("long")))
    got = {r["media_id"]: r["class_id"] for r in media.copies(images).collect()}
    want = {i: i - i % 8 if i % 8 <= 4 else i for i in range(48)} | {100: 100, 200: 200, 201: 201, None: None, 300: 6}
    assert got == want
    img = media.render(rng.normal(size=64))
    assert np.array_equal(media.decode(media.png(img)), np.clip(np.round(img), 0, 255))
    assert media.decode(b"P5 3 2 255\n" + bytes(range(6))).tolist() == [[0, 1, 2], [3, 4, 5]] and media.decode(None) is None


def test_url_edges(spark):
    entries = spark.createDataFrame(
        [("domain", "x.org", "block", "2024-01-01"), ("host", "a.x.org", "allow", "2024-02-01"), ("domain", "x.org", "allow", "2024-03-01"), ("url", "a.x.org/p?q", "block", "2024-02-10"), (None, "x.org", "block", "2020-01-01")],
        "kind string, value string, action string, since string",
    ).withColumn("since", F.col("since").cast("date"))
    rows = [("http://U@A.x.org.:80/p?q#f", "2024-01-31"), ("http://a.x.org/p?q", "2024-02-09"), ("http://a.x.org/p?q", "2024-02-10"), ("http://b.a.x.org/", "2024-03-01"), ("nothing", "2024-03-01"), (None, "2024-03-01"), ("http://x.org", None), ("http://yx.org", "2024-01-05")]
    got = url_filter.evaluate(spark.createDataFrame(rows, "url string, fetched_on string").withColumns({"fetched_on": F.col("fetched_on").cast("date"), "kind": F.lit("own")}), entries)
    assert sorted((r["url"] or "", r["verdict"], r["kind"] or "") for r in got.collect()) == sorted(
        [("http://U@A.x.org.:80/p?q#f", "block", "domain"), ("http://a.x.org/p?q", "allow", "host"), ("http://a.x.org/p?q", "block", "url"), ("http://b.a.x.org/", "allow", "domain"), ("nothing", "none", ""), ("", "none", ""), ("http://x.org", "none", ""), ("http://yx.org", "none", "")]
    )
    assert url_filter.evaluate(got.limit(0), entries).count() == 0
    clash = spark.createDataFrame([("http://x.org", "2024-01-05", 1, 2, 3, 4, 5)], "url string, fetched_on string, e int, u int, f int, month int, `a.b` int")
    got = url_filter.evaluate(clash, entries).first()
    assert got.verdict == "block" and (got.e, got.u, got.f, got.month, got["a.b"]) == (1, 2, 3, 4, 5)
    assert url_filter.evaluate(clash.unionByName(clash), entries.limit(0)).select("verdict").collect() == [("none",)] * 2


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "123 456", "en", "src0", 7)], docs.schema)
    kept = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF).cache()
        if name != "bpe":
            assert kept.columns == docs.columns
        if name == "language_id":
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()}
        if name == "near_dedup":
            assert kept.count() < before.count() and kept.select("doc_id").distinct().count() == kept.count()
    assert kept.count() == before.count()
    run = corpus_pipeline.run(spark, SF)
    assert set(run.columns) == {"doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"} and run.count() > 100
    assert "pipeline" not in queries.QUERIES
