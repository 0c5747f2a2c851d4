"""Facts of a table of documents, read as a toy source tree.

Lines are a document's text split at line feeds; words are runs of letters. The first word of a
line defines a symbol if it has three letters or more; the further words of such a line are
call-sites. Everything is a projection of ``documents``, so extraction is one pass without a
shuffle but for the test flags, which are joined from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve
from ..schema import EXTREF, FILE, FN, IMPL, INDEX_VERSION, METHOD, REF, SITE, SYM, TRAIT, UNRESOLVED
from ..store import Facts

WORD = r"\p{L}+"


def _padded() -> Column:
    """The id with eight digits at least; longer ones stay whole."""
    text = F.col("doc_id").cast("string")
    return F.when(F.char_length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"), "text")


def lines(docs: DataFrame, containing: str | None = None) -> DataFrame:
    """(file_id, ln, text). With a term only documents that hold it are split at all."""
    rows = docs if containing is None else docs.where(F.lower("text").contains(containing.lower()))
    out = _texts(rows).select(F.col("doc_id").alias("file_id"), F.posexplode("ls").alias("i", "text")).select("file_id", (F.col("i") + 1).alias("ln"), "text")
    return out if containing is None else out.where(F.lower("text").contains(containing.lower()))


def files(docs: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", _padded())
    rows = _texts(docs).select(
        F.col("doc_id").alias("file_id"), path.alias("path"), F.col("source").alias("crate_"), F.lit(0).alias("lang"), F.size("ls").alias("loc"),
        # The first 8 hex digits of the MD5 as a number.
        F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("long").alias("hash"),
    )
    return rows.select(*FILE.fieldNames())


def _worded(docs: DataFrame) -> DataFrame:
    """A row per line that defines a symbol, with its words and its document's container."""
    texts = _texts(docs).withColumn("ws", F.transform("ls", lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    first = F.get(F.filter("ws", lambda x: F.size(x) > 0), F.lit(0))
    rows = texts.select("doc_id", "lang", "source", F.lower(F.get(first, F.lit(0))).alias("container"), F.posexplode(F.arrays_zip("ls", "ws")).alias("i", "x"))
    rows = rows.select("doc_id", "lang", "source", "container", (F.col("i") + 1).alias("ln"), F.col("x.ls").alias("line_text"), F.col("x.ws").alias("ws"))
    return rows.where((F.size("ws") > 0) & (F.char_length(F.get("ws", F.lit(0))) >= 3)).withColumn("sym_id", F.col("doc_id") * 100000 + F.col("ln"))


def symbols(docs: DataFrame, labels: DataFrame) -> DataFrame:
    name = F.lower(F.get("ws", F.lit(0)))
    kind = F.when(F.col("ln") == 1, TRAIT).when(F.col("ln") % 2 == 0, METHOD).otherwise(FN)
    tests = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = _worded(docs).join(tests, "doc_id", "left")
    return rows.select(
        "sym_id", name.alias("name"), kind.alias("kind"), (F.col("ln") % 4).cast("int").alias("vis"), F.lit(0).alias("is_async"),
        F.coalesce("toxic", F.lit(0)).alias("is_test"), F.col("doc_id").alias("file_id"), F.col("lang").alias("module"), F.col("source").alias("crate_"),
        "container", F.concat_ws("/", "lang", name).alias("symbol"), F.col("line_text").alias("sig"), F.lit("").alias("doc"),
        F.col("ln").cast("int").alias("line"), F.col("ln").cast("int").alias("end_line"),
    ).select(*SYM.fieldNames())


def _same(word: Column) -> Column:
    """Lower case, in which a sigma is the same at the end of a word as elsewhere: only that letter
    depends on what stands around it."""
    return F.translate(F.lower(word), "ς", "σ")


def call_sites(docs: DataFrame, callee: str | None = None) -> DataFrame:
    """The call-sites, or those of one name. For these only documents that hold it are split."""
    if callee is not None:
        return call_sites(docs.where(_same(F.col("text")).contains(_same(F.lit(callee))))).where(F.col("callee") == callee)
    rows = _worded(docs).select("doc_id", "lang", "ln", "sym_id", F.posexplode("ws").alias("p", "w")).where((F.col("p") > 0) & (F.char_length("w") >= 3))
    pos = F.col("p") + 1
    qual = F.when(pos % 5 == 0, "Self").when(pos % 7 == 0, F.col("lang")).otherwise("")
    rows = rows.withColumn("qual", qual)
    return rows.select(
        (F.col("sym_id") * 100000 + pos).alias("call_id"), F.col("sym_id").alias("caller"), F.lower("w").alias("callee"), "qual",
        ((pos % 3 == 0) & (F.col("qual") == "")).cast("int").alias("is_method"), F.col("doc_id").alias("file_id"), F.col("ln").cast("int").alias("line"), pos.cast("int").alias("col"),
    ).select(*SITE.fieldNames())


def implementations(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").alias("trait_name"), F.col("source").alias("type_name"), F.col("doc_id").alias("file_id"), F.lit(1).alias("line")).select(*IMPL.fieldNames())


def occurrences(docs: DataFrame) -> DataFrame:
    """Words of documents with an even id as occurrences of precise symbols; the others are silent."""
    even = docs.where(F.col("doc_id") % 2 == 0)
    path = F.concat_ws("/", "source", "lang", _padded())
    rows = _texts(even).select(path.alias("rel_path"), "lang", "doc_id", F.posexplode("ls").alias("i", "t"))
    rows = rows.select("rel_path", "lang", "doc_id", "i", F.posexplode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("p", "w"))
    return rows.select(
        "rel_path", F.col("i").cast("int").alias("line0"), (F.col("p") + 1).cast("int").alias("col0"), F.concat_ws("/", "lang", F.lower("w")).alias("symbol"),
        F.when(F.col("p") == 0, 1).otherwise(8).alias("role"), ((F.col("doc_id") * 100000 + F.col("i") + 1) * 100000 + F.col("p") + 1).alias("seq"),
    )


def reference_rows(sym: DataFrame, call: DataFrame, lang: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, extref): a definition per symbol, a use per resolved call, and the unresolved calls as
    symbols of elsewhere. ``lang`` has (file_id, lang)."""
    role = F.when(F.col("col") % 3 == 0, 8).when(F.col("col") % 3 == 1, 4).otherwise(2)
    defs = sym.select("sym_id", "file_id", "line", F.lit(1).alias("col"), F.lit(1).alias("role"))
    uses = call.where(F.col("callee_sym").isNotNull()).select(F.col("callee_sym").alias("sym_id"), "file_id", "line", "col", role.alias("role"))
    outside = call.where(F.col("res") == UNRESOLVED).join(lang, "file_id")
    ext = outside.select(F.concat_ws("/", "lang", "callee").alias("symbol"), "file_id", "line", "col", F.lit(8).alias("role"))
    return defs.unionByName(uses).select(*REF.fieldNames()), ext.select(*EXTREF.fieldNames())


def extract(docs: DataFrame, labels: DataFrame) -> Facts:
    """All facts of the documents."""
    spark: SparkSession = docs.sparkSession
    sym, sites = symbols(docs, labels), call_sites(docs)
    call = resolve(sites, sym)
    ref, ext = reference_rows(sym, call, docs.select(F.col("doc_id").alias("file_id"), "lang"))
    meta = spark.range(1).select(
        F.lit("documents").alias("root"), F.lit(0).cast("long").alias("built_at"), F.lit(None).cast("long").alias("nfiles"),
        F.lit(INDEX_VERSION).alias("ver"), F.lit(None).cast("long").alias("baked_at"), F.lit(0).cast("long").alias("upd_since_bake"),
    )
    return Facts(file=files(docs), sym=sym, call=call, ref=ref, extref=ext, impl=implementations(docs), meta=meta, lines=lines(docs))
