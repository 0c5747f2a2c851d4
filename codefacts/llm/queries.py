"""The queries of the training-data operators, each over its whole table, and their SQL.

Each takes (spark, sf_dir). Where SQL can't express the operator there is no text here, and the
operator is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, language_id, line_dedup, media, mixing, near_dup, neighbours, url_filter, warc
from .common import table


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract("html")
    return table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles, _ = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.rendered(table(spark, sf_dir, "embeddings")).withColumnRenamed("media_id", "vec_id")
    return media.copies(images, "vec_id")


#: The list of op7, made from the hosts of the pages by their MD5: (kind, value, action, date).
URL_LIST = (
    ("host", "h", "substr(md5(h), 1, 1) IN ('0', '1', '2')", (("block", "2023-03-01"), ("allow", "2023-09-15"), ("block", "2024-05-01"))),
    ("domain", "d", "substr(md5(d), 1, 1) IN ('2', '3', '4')", (("block", "2023-06-10"), ("allow", "2024-02-29"))),
    ("prefix", "concat(h, '/en')", "substr(md5(h), 2, 1) IN ('0', '1', '5', '6')", (("allow", "2023-04-04"), ("block", "2023-11-30"))),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("h")).where("h <> ''").distinct().withColumn("d", F.substring_index("h", ".", -3))
    entries = None
    for kind, value, when, dates in URL_LIST:
        for action, since in dates:
            part = hosts.where(when).select(F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), F.lit(since).cast("date").alias("since")).distinct()
            entries = part if entries is None else entries.unionByName(part)
    # The table has no fetch dates; the id fixes one in 2023 or 2024.
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")))
    return url_filter.evaluate(captures, entries).select("page_id", "fetched_on", "verdict", "kind", "value", "since")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.digests("text", *vocabulary())
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_html_text, op3_language_id, op4_warc, op5_line_dedup, op6_media_copies,
        op7_url_filter, op8_mixing, op9_bpe, op10_neighbours,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> owner AS gone FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
"""


def _url_oracle() -> str:
    host = r"lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2), '\.$', ''))"
    parts = []
    for kind, value, when, dates in URL_LIST:
        for action, since in dates:
            parts.append(f"SELECT DISTINCT '{kind}' AS kind, {value} AS value, '{action}' AS action, DATE '{since}' AS since FROM named WHERE {when}")
    return f"""
WITH p AS (SELECT page_id, url, {host} AS h, DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS f FROM pages),
named AS (SELECT DISTINCT h, CASE WHEN length(h) - length(replace(h, '.', '')) <= 2 THEN h ELSE regexp_extract(h, '([^.]*\\.[^.]*\\.[^.]*)$', 1) END AS d FROM p WHERE h <> ''),
entries AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM entries),
hits AS (
  SELECT page_id, s.*, CASE s.kind WHEN 'prefix' THEN 1 WHEN 'host' THEN 2 ELSE 1000 - length(s.value) END AS rank
  FROM p JOIN spans s ON f >= since AND (until IS NULL OR f < until) AND (
    (s.kind = 'host' AND h = s.value)
    OR (s.kind = 'domain' AND (h = s.value OR ends_with(h, '.' || s.value)))
    OR (s.kind = 'prefix' AND s.value = h || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1)))
),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS n FROM hits)
SELECT p.page_id, p.f AS fetched_on, coalesce(b.action, 'none') AS verdict, b.kind, b.value, b.since
FROM p LEFT JOIN best b ON b.page_id = p.page_id AND b.n = 1
"""


ORACLES: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
first AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to
FROM p LEFT JOIN first USING (payload_digest)
""",
    "op5_line_dedup": f"""
WITH {_LINES}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op7_url_filter": _url_oracle(),
    "op10_neighbours": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS l FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
