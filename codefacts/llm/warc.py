"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of records, and a skippable
footer frame with the seek table (public seekable format: compressed and full size of each frame,
the number of frames, a descriptor and a magic number). The index maps a record id to its bundle,
frame and offset within the decompressed frame, so one record needs one ranged read.

Bundles are rows of a table (``bundle``, ``data``), a few MB each, so any store that Spark writes
can hold them; ``export`` writes them as ``.warc.zst`` files where the folder is mounted.

Payloads of ``min_revisit`` bytes or more that occur more than once are kept once: the row of the
least id is a ``response``, the others are ``revisit`` records that name it. The payload is the
body in UTF-8 and its digest is SHA-256.

Defined cases: a null body is an empty payload; an empty or short payload is always a response; a
null URL is written as ``urn:page:<id>``; line breaks in a URL are percent-encoded; rows of the
least id are all responses, however often it is repeated; a null id takes no part; other columns don't matter; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidied, written

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Full bytes of a frame and of a bundle; a larger record has a frame, or a bundle, of its own.
FRAME, BUNDLE = 1 << 18, 1 << 22
#: Fixed date of all records, so that a rerun gives the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _record_id(page: int) -> str:
    h = hashlib.sha256(f"page {page}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit of the one that it refers to."""
    where = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(page)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {where}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {page}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_record_id(refers_to)}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset of a frame."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    size = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + size], stop + 4 + size + 4


class BundleWriter:
    """Groups records into frames and gives the bundle's bytes."""

    def __init__(self, level: int = 3):
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset of the record."""
        if self.open and self.open_size + len(data) > FRAME:
            self._close()
        place = len(self.frames), self.open_size
        self.open.append(data)
        self.open_size += len(data)
        self.size += len(data)
        return place

    def _close(self) -> None:
        packed = self.pack(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.open_size))
        self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, full size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9])
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    at, packed, full = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=full)


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, by what the index says of it."""
    head, block, _ = parse(read_frame(data, frame), offset)
    return head, block


def classified(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): equal long payloads refer to the least id, which
    itself, like any other response, refers to nothing.

    The JVM computes the digests. What refers to what is found among (id, digest) rows; a digest that
    very many pages share is pre-aggregated. The pages then meet only the list of those that refer,
    by id and digest, so no page is dealt by a key that many share; Spark shuffles the bodies for that
    join unless it knows beforehand that the list is short."""
    body = F.encode("html", "UTF-8")
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(body, 256))
    long_ = rows.where(F.octet_length(body) >= min_revisit).select("page_id", "digest")
    shared = long_.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last").drop("last")
    refers = long_.join(shared, "digest").where("page_id <> refers_to").distinct()
    return rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, min_revisit: int = 100, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The bundles (bundle, data) and the index (page_id, bundle, frame, offset), both written to
    the shared folder. A task streams its rows into bundles of bounded size, named by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, places = BundleWriter(), []

        def flush() -> pa.RecordBatch:
            data = out.finish()
            return pa.RecordBatch.from_pydict(
                {
                    "bundle": pa.array([hashlib.sha256(data).hexdigest()[:32]]),
                    "data": pa.array([data], pa.large_binary() if len(data) > 1 << 31 else pa.binary()),
                    "places": pa.array([[{"page_id": p, "frame": f, "offset": o} for p, f, o in places]], pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32())]))),
                }
            )

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                page = page.as_py()
                places.append((page, *out.add(record(page, url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py()))))
                if out.size >= BUNDLE:
                    yield flush()
                    out, places = BundleWriter(), []
        if places:
            yield flush()

    schema = "bundle string, data binary, places array<struct<page_id:long,frame:int,offset:int>>"
    rows = classified(pages, min_revisit)
    made = written(rows.mapInArrow(tidied(run), schema), "warc", keep)
    index = made.select("bundle", F.explode("places").alias("p")).select("p.page_id", "bundle", "p.frame", "p.offset")
    return made.select("bundle", "data"), index


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every
    record of the bundles, frame by frame by the seek table. A response's length and digest are
    those of the bytes read. A revisit has no payload, and length and digest are those read of the
    response that it refers to; null if there is none with the digest that it names."""
    found = records(bundles)
    heads = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = found.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", F.col("payload_digest").alias("named"))
    heads = heads.select(F.col("refers_to").alias("to"), "payload_digest", "payload_bytes")
    met = revisits.join(heads, (F.col("refers_to") == F.col("to")) & (F.col("named") == F.col("payload_digest")), "left")
    return found.where("record_type = 'response'").unionByName(met.drop("to", "named").withColumn("payload", F.lit(None).cast("binary")))


def records(bundles: DataFrame) -> DataFrame:
    """The same of the records as they stand: a revisit's digest is the one that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                data = data.as_py()
                for frame in range(len(seek_table(data))):
                    full, at, rows = read_frame(data, frame), 0, []
                    while at < len(full):
                        head, block, at = parse(full, at)
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((
                            int(head["X-Page-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                            int(head["X-Refers-To-Page"]) if revisit else None,
                            None if revisit else len(payload),
                            head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                            None if revisit else payload,
                        ))
                    yield pa.RecordBatch.from_pandas(
                        pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], dtype=object),
                        schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]),
                    )

    return bundles.mapInArrow(tidied(run), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<folder>/<bundle>.warc.zst``; (bundle, path, bytes) of each. The
    folder must be mounted on every executor. A retried task rewrites the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, paths, sizes = batch.column("bundle").to_pylist(), [], []
            for name, data in zip(names, batch.column("data").to_pylist()):
                path = f"{folder}/{name}.warc.zst"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.{os.getpid()}", path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"bundle": names, "path": paths, "bytes": pa.array(sizes, pa.int64())})

    return bundles.mapInArrow(tidied(run), "bundle string, path string, bytes long")


def lookup(spark: SparkSession, bundles: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, record) of the wanted ids: only their frames are decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"page_id": [r["page_id"] for r in rows], "record": pa.array([read_record(r["data"], r["frame"], r["offset"])[1] for r in rows], pa.binary())})

    wanted = index.join(pages.select("page_id").distinct(), "page_id")
    return wanted.join(bundles, "bundle").select("page_id", "data", "frame", "offset").mapInArrow(tidied(run), "page_id long, record binary")
