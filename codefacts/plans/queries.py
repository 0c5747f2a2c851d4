"""The query commands, one function per shape of answer, over a set of facts.

Each returns a lazy DataFrame unless it traverses the graph. ``limit`` cuts only where the command
itself is a top-k report. Names are matched exactly but in ``find``, ``text`` and suggestions, which
lower-case both sides.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof, graph
from ..operators.resolve import confirmed
from ..schema import KINDS, METHOD, RESOLUTIONS, VISIBILITIES
from ..store import Facts

#: Rows that reports show, characters of a shown line.
LIMIT, ACROSS_LIMIT, TOP_EXTERNAL, TOP_SIMILAR, TOP_CRATES, SHOWN_DEFS, LINE_MOST, BODY_MOST = 50, 20, 12, 8, 20, 3, 120, 400


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _path(facts: Facts) -> DataFrame:
    return facts.file.select("file_id", "path")


def located(facts: Facts, sym: DataFrame) -> DataFrame:
    """Sym rows with the path of their file; ``?`` for a file that is not there."""
    return sym.join(_path(facts), "file_id", "left").withColumn("path", F.coalesce("path", F.lit("?")))


def defs_of(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    rows = facts.sym.where(F.col("name") == name)
    return rows if container is None else rows.where(F.col("container") == container)


def _listing(facts: Facts, sym: DataFrame, *more: Column | str) -> DataFrame:
    rows = located(facts, sym)
    return rows.select("sym_id", "path", "line", S.kind_name(F.col("kind")).alias("kind"), S.vis_name(F.col("vis")).alias("vis"), S.qualified(F.col("container"), F.col("name")).alias("label"), S.symbol_label().alias("shown"), *more)


def definition(facts: Facts, name: str) -> DataFrame:
    """Where a name is defined, with signature and doc line."""
    return _listing(facts, defs_of(facts, name), "sig", "doc")


def find(facts: Facts, part: str) -> DataFrame:
    """Symbols whose name contains a text, whatever the case."""
    return _listing(facts, facts.sym.where(F.lower("name").contains(part.lower())))


def facets(words: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(key, value) of ``key:value`` words, and the words that are ignored: malformed ones, unknown
    keys, unknown kinds and visibilities."""
    known, ignored = [], []
    for word in words:
        key, colon, value = word.partition(":")
        fits = {"kind": value in KINDS, "vis": value in (*VISIBILITIES, "private")}.get(key, key in ("name", "async", "test", "crate", "container", "module", "calls"))
        if colon and fits:
            known.append((key, value))
        else:
            ignored.append(word)
    return known, ignored


def search(facts: Facts, *words: str) -> DataFrame:
    """Symbols that meet all facets. A repeated key must hold for each of its values; without a
    usable facet every symbol is found."""
    rows = facts.sym
    for key, value in facets(list(words))[0]:
        if key == "kind":
            rows = rows.where(F.col("kind") == KINDS.index(value))
        elif key == "vis":
            rows = rows.where(F.col("vis") == VISIBILITIES.index("priv" if value == "private" else value))
        elif key in ("async", "test"):
            rows = rows.where(F.col(f"is_{key}") == S.as_flag(value))
        elif key == "calls":
            callers = facts.call.where(F.col("callee") == value).select(F.col("caller").alias("sym_id"))
            rows = rows.join(callers, "sym_id", "left_semi")
        else:
            rows = rows.where(F.col("crate_" if key == "crate" else key) == value)
    return _listing(facts, rows)


def _callers(facts: Facts, call: DataFrame) -> DataFrame:
    who = facts.sym.select(F.col("sym_id").alias("caller"), S.qualified(F.col("container"), F.col("name")).alias("label"))
    return call.join(who, "caller", "left").withColumn("label", F.coalesce("label", F.lit("?"))).join(_path(facts), "file_id", "left")


def callers_confirmed(facts: Facts, name: str, container: str | None = None, with_source: bool = False) -> DataFrame:
    """Calls that resolve to a definition of the name: one row per call-site."""
    to = defs_of(facts, name, container).select(F.col("sym_id").alias("callee_sym"))
    rows = _callers(facts, facts.call.join(to, "callee_sym"))
    out = ["call_id", "callee_sym", "path", "line", "label"]
    if not with_source:
        return rows.select(*out)
    rows = rows.join(facts.lines.withColumnRenamed("ln", "line"), ["file_id", "line"], "left")
    return rows.select(*out, S.capped(F.coalesce("text", F.lit("")), 110).alias("source"))


def callers_candidates(facts: Facts, name: str) -> DataFrame:
    """Calls of that simple name that did not resolve, with the reason."""
    rows = _callers(facts, facts.call.where((F.col("callee") == name) & F.col("callee_sym").isNull()))
    return rows.select("call_id", "path", "line", "label", S.res_name(F.col("res")).alias("res"))


def callers_summary(facts: Facts, name: str) -> DataFrame:
    """Confirmed callers of each definition of a name, also of those without any."""
    n = facts.call.join(defs_of(facts, name).select(F.col("sym_id").alias("callee_sym")), "callee_sym", "left_semi").groupBy("callee_sym").agg(_n())
    rows = _listing(facts, defs_of(facts, name)).join(n, F.col("sym_id") == F.col("callee_sym"), "left")
    return rows.select("sym_id", "path", "line", "label", F.coalesce("n", F.lit(0)).alias("n"))


def callers_totals(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    """One row: name matches = confirmed + candidates + other, where other is never negative:
    precise calls may be confirmed under another simple name."""
    named = F.col("callee") == name
    to = defs_of(facts, name, container).select(F.col("sym_id").alias("callee_sym"), F.lit(1).alias("hit"))
    rows = facts.call.join(to, "callee_sym", "left").where(named | F.col("hit").isNotNull())
    got = rows.agg(F.count_if(named).alias("name_total"), F.count("hit").alias("confirmed"), F.count_if(named & F.col("callee_sym").isNull()).alias("candidates"))
    return got.withColumn("other", F.greatest(F.lit(0).cast("long"), F.col("name_total") - F.col("confirmed") - F.col("candidates")))


def callees_resolved(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    """What each definition of a name calls, counted by callee."""
    own = defs_of(facts, name, container).select(F.col("sym_id").alias("caller"))
    n = facts.call.join(own, "caller").where("callee_sym is not null").groupBy("caller", "callee_sym").agg(_n())
    to = located(facts, facts.sym).select(F.col("sym_id").alias("callee_sym"), "path", "line", S.qualified(F.col("container"), F.col("name")).alias("label"))
    return n.join(to, "callee_sym").select("caller", "callee_sym", "path", "line", "label", "n")


def callees_external(facts: Facts, name: str, container: str | None = None, top: int = TOP_EXTERNAL) -> DataFrame:
    """The most frequent names that a name's definitions call and that did not resolve."""
    own = defs_of(facts, name, container).select(F.col("sym_id").alias("caller"))
    n = facts.call.join(own, "caller", "left_semi").where("callee_sym is null").groupBy("callee").agg(_n())
    return n.orderBy(F.desc("n"), "callee").limit(top)


def edges(facts: Facts) -> DataFrame:
    return graph.file_edges(facts.call, facts.sym, facts.file)


def refs(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    rows = facts.ref.join(defs_of(facts, name, container).select("sym_id"), "sym_id").join(_path(facts), "file_id")
    return rows.select("sym_id", "path", "line", "col", S.role_name(F.col("role")).alias("role"))


def refs_summary(facts: Facts, name: str) -> DataFrame:
    n = facts.ref.join(defs_of(facts, name).select("sym_id"), "sym_id", "left_semi").groupBy("sym_id").agg(_n())
    return _listing(facts, defs_of(facts, name)).join(n, "sym_id", "left").select("sym_id", "path", "line", "label", F.coalesce("n", F.lit(0)).alias("n"))


def role_counts(facts: Facts) -> DataFrame:
    return facts.ref.groupBy(S.role_name(F.col("role")).alias("role")).agg(_n())


def implementations(facts: Facts, name: str) -> DataFrame:
    """Implementations of a trait, and the traits that a type implements."""
    of_trait = facts.impl.where(F.col("trait_name") == name).select(F.lit("type").alias("direction"), F.col("type_name").alias("name"), "file_id", "line")
    of_type = facts.impl.where(F.col("type_name") == name).select(F.lit("trait").alias("direction"), F.col("trait_name").alias("name"), "file_id", "line")
    return of_trait.unionByName(of_type).join(_path(facts), "file_id").select("direction", "name", "path", "line")


def outline(facts: Facts, path: str) -> DataFrame:
    """The symbols of the file of that path, else of the least path that ends so."""
    ends = facts.file.where((F.col("path") == path) | F.col("path").endswith(path))
    one = ends.agg(F.min_by("file_id", F.struct(F.col("path") != path, F.col("path"))).alias("file_id"))
    return _listing(facts, facts.sym.join(one, "file_id"), "sig", "doc")


def text(facts: Facts, term: str) -> DataFrame:
    """Lines of the sources that contain a text, whatever the case, with what is around: the last
    symbol defined at or before the line; of a doc line the next one; of a module doc neither."""
    hits = facts.lines.where(F.lower("text").contains(term.lower()))
    before = asof.enclosing(hits, facts.sym)
    after = asof.following(hits, facts.sym).select("file_id", "ln", F.col("sym_id").alias("next_id"))
    t = F.trim("text")
    rows = before.join(after, ["file_id", "ln"]).withColumn("note", F.when(t.startswith("//!"), "module doc").when(t.startswith("///"), "doc of next def").otherwise("in"))
    rows = rows.withColumn("around", F.when(F.col("note") == "in", F.col("sym_id")).when(F.col("note") == "doc of next def", F.col("next_id")))
    names = facts.sym.select(F.col("sym_id").alias("around"), S.qualified(F.col("container"), F.col("name")).alias("label"))
    return rows.join(names, "around", "left").join(_path(facts), "file_id").select("path", F.col("ln").alias("line"), "note", "label", S.capped(F.col("text"), LINE_MOST).alias("text"))


def body(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    """(sym_id, ln, text) of each definition: its lines, extended upwards over doc and attribute
    lines, BODY_MOST at most."""
    d = defs_of(facts, name, container).select("sym_id", "file_id", "line", "end_line")
    rows = d.join(facts.lines, "file_id").where("ln <= end_line")
    t = F.trim("text")
    head = t.startswith("///") | t.startswith("#[")
    # The line after the last one above the symbol that is neither doc nor attribute.
    start = F.coalesce(F.max(F.when((F.col("ln") < F.col("line")) & ~head, F.col("ln"))).over(Window.partitionBy("sym_id")), F.lit(0)) + 1
    return rows.withColumn("start", start).where((F.col("ln") >= F.col("start")) & (F.col("ln") < F.col("start") + BODY_MOST)).select("sym_id", "ln", "text")


def tokens_of(name: str) -> list[str]:
    """The parts of a name that suggestions go by: four bytes or more."""
    return [t for t in re.split(r"[^0-9a-z]+", name.lower()) if len(t.encode()) >= 4] if name.isascii() else [
        t for t in re.split(r"[\W_]+", name.lower()) if len(t.encode()) >= 4
    ]


def suggestions(facts: Facts, name: str, top: int = TOP_SIMILAR) -> DataFrame:
    """Names like a missing one: one point per part contained, one if either contains the other."""
    low, own = F.lower("name"), name.lower()
    score = sum((low.contains(t).cast("int") for t in tokens_of(name)), F.lit(0)) + (low.contains(own) | F.lit(own).contains(low)).cast("int")
    rows = facts.sym.withColumn("score", score).where("score > 0").groupBy("name").agg(F.max("score").cast("long").alias("score"), F.min("sym_id").alias("sym_id"))
    return rows.orderBy(F.desc("score"), "name").limit(top)


def impact(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    """Everything that reaches a definition of the name over resolved calls, by least depth: a
    lower bound, as unresolved calls are left out."""
    layers = graph.bfs_layers(facts.edges(), defs_of(facts, name, container))
    return located(facts, facts.sym.join(layers, "sym_id")).select("depth", "path", "line", "sym_id", S.qualified(F.col("container"), F.col("name")).alias("label"), "is_test")


def impact_counts(facts: Facts, name: str) -> DataFrame:
    return graph.bfs_layers(facts.edges(), defs_of(facts, name)).groupBy("depth").agg(_n())


def impact_top(facts: Facts, name: str, limit: int) -> DataFrame:
    """The first rows of each layer, as the report shows them."""
    order = Window.partitionBy("depth").orderBy("path", "line", "sym_id")
    return impact(facts, name).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("depth", "rank", "path", "line", "sym_id", "label")


def tests_reaching(facts: Facts, name: str, container: str | None = None) -> DataFrame:
    return impact(facts, name, container).where("is_test = 1").drop("is_test")


def test_hint(rows: DataFrame, most: int = 8) -> str | None:
    """The command that runs the found tests, if they have few distinct names."""
    names = sorted({r["label"].split("::")[-1] for r in rows.select("label").distinct().limit(most + 1).collect()})
    return f"cargo test -- {' '.join(names)}" if 0 < len(names) <= most else None


def call_path(facts: Facts, source: str, target: str) -> DataFrame:
    steps = graph.shortest_path(facts.edges(), defs_of(facts, source), defs_of(facts, target))
    return located(facts, facts.sym.join(steps, "sym_id")).select("hop", "sym_id", "path", "line", S.qualified(F.col("container"), F.col("name")).alias("label"))


def stats(facts: Facts) -> DataFrame:
    """One row: sizes, the resolution histogram with zero codes, and the share resolved."""
    by_res = [F.count_if(F.col("res") == i).alias(n) for i, n in enumerate(RESOLUTIONS)]
    rows = facts.call.agg(_n("calls"), *by_res)
    good = F.col("unique") + F.col("qualified")
    rate = F.when(F.col("calls") == 0, 0.0).otherwise(F.round(good * 100.0 / F.col("calls"), 1))
    return rows.withColumn("rate", rate)


def sizes(facts: Facts) -> DataFrame:
    """(what, n): files, symbols, symbols by kind, public ones, tests and implementations."""
    parts = [facts.file.agg(_n()).select(F.lit("files").alias("what"), "n"), facts.impl.agg(_n()).select(F.lit("impls").alias("what"), "n")]
    by = {"symbols": F.lit(True), "pub": F.col("vis") == 0, "async": F.col("is_async") == 1, "tests": F.col("is_test") == 1} | {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    one = facts.sym.agg(*[F.count_if(c).alias(k) for k, c in by.items()])
    parts.append(one.select(F.explode(F.create_map(*[x for k in by for x in (F.lit(k), F.col(k))])).alias("what", "n")))
    return reduce(DataFrame.unionByName, parts)


def crates(facts: Facts, top: int = TOP_CRATES) -> DataFrame:
    """Symbols per crate of the file table, also of crates without any; the largest first."""
    n = facts.sym.groupBy("crate_").agg(_n())
    rows = facts.file.select("crate_").distinct().join(n, "crate_", "left").select("crate_", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.desc("n"), "crate_").limit(top)


def across_counts(facts: Facts, name: str) -> DataFrame:
    """Per repository: definitions of a name, confirmed calls of its own definitions, and calls of
    that simple name; repositories with neither definitions nor such calls are left out."""
    repo = facts.file.select("file_id", F.col("crate_").alias("repo"))
    d = defs_of(facts, name).join(repo, "file_id").groupBy("repo").agg(_n("n_defs"))
    c = facts.call.where(F.col("callee") == name).join(repo, "file_id").groupBy("repo").agg(_n("n_name"))
    own = defs_of(facts, name).join(repo, "file_id").select(F.col("sym_id").alias("callee_sym"), F.col("repo").alias("def_repo"))
    s = facts.call.join(own, "callee_sym").join(repo, "file_id").where("repo = def_repo").groupBy("repo").agg(_n("n_confirmed"))
    rows = d.join(c, "repo", "full_outer").join(s, "repo", "left")
    return rows.select("repo", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_defs", "n_confirmed", "n_name")])


def across_defs(facts: Facts, name: str, most: int = SHOWN_DEFS) -> DataFrame:
    order = Window.partitionBy("repo").orderBy("sym_id")
    rows = located(facts, defs_of(facts, name)).withColumn("repo", F.col("crate_")).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= most).select("repo", "rank", "sym_id", "path", "line")


def across_refs(facts: Facts, name: str) -> DataFrame:
    """References in other repositories to the symbols that a name has in one: joined on the
    symbol string."""
    repo = facts.file.select("file_id", "path", F.col("crate_").alias("repo"))
    symbols = defs_of(facts, name).where("symbol <> ''").select("symbol", F.col("crate_").alias("def_repo")).distinct()
    rows = facts.extref.join(symbols, "symbol").join(repo, "file_id").where("repo <> def_repo")
    return rows.groupBy("symbol", "def_repo", "repo").agg(_n())


def classify_calls(facts: Facts, names: DataFrame) -> DataFrame:
    """(name, sure, other, cand): calls of each simple name that resolve to a definition of that
    name, to another symbol, or to none."""
    defs = facts.sym.select(F.col("sym_id").alias("callee_sym"), F.col("name").alias("def_name"))
    rows = facts.call.join(names.select(F.col("name").alias("callee")), "callee").join(defs, "callee_sym", "left")
    sure = F.col("def_name") == F.col("callee")
    return rows.groupBy(F.col("callee").alias("name")).agg(
        F.count_if(sure).alias("sure"), F.count_if(F.col("callee_sym").isNotNull() & ~F.coalesce(sure, F.lit(False))).alias("other"), F.count_if(F.col("callee_sym").isNull()).alias("cand")
    )


def unique_names(facts: Facts, least: int = 3) -> DataFrame:
    """(name, sym_id, n): names with exactly one definition and ``least`` confirmed callers."""
    one = facts.sym.groupBy("name").agg(_n("defs"), F.min("sym_id").alias("sym_id")).where("defs = 1")
    n = facts.call.where("callee_sym is not null").groupBy(F.col("callee_sym").alias("sym_id")).agg(_n())
    return one.join(n, "sym_id").where(F.col("n") >= least).select("name", "sym_id", "n")


def hot_name(sites: DataFrame, sym: DataFrame) -> str:
    """The first of ``unique_names`` by most confirmed callers, then by name, from call-sites that
    are not resolved yet; empty if there is none."""
    one = sym.groupBy("name").agg(_n("defs"), F.min("sym_id").alias("sym_id")).where("defs = 1")
    top = one.join(confirmed(sites, sym, one.select(F.col("name").alias("callee"))), "sym_id").orderBy(F.desc("n"), "name").first()
    return top["name"] if top else ""


def called_names(facts: Facts, least: int = 3) -> DataFrame:
    """Distinct names of functions and methods, of ``least`` bytes or more, that are called."""
    names = facts.sym.where((F.col("kind") <= METHOD) & (F.octet_length("name") >= least)).select("name").distinct()
    return names.join(facts.call.select(F.col("callee").alias("name")), "name", "left_semi")


def trait_counts(facts: Facts) -> DataFrame:
    return facts.impl.groupBy("trait_name").agg(_n())


def median_callers(facts: Facts) -> DataFrame:
    """The upper median of confirmed callers over the uniquely defined names that have any. The
    counts are counted first: a row per distinct count, not per name, is gathered."""
    n = unique_names(facts, 1).groupBy("n").agg(_n("times"))
    total = n.withColumns({"upto": F.sum("times").over(Window.orderBy("n")), "total": F.sum("times").over(Window.partitionBy())})
    return total.where("upto > floor(total / 2)").agg(F.coalesce(F.min("n"), F.lit(0)).alias("median"))


def grep_noise(facts: Facts, names: DataFrame) -> DataFrame:
    """(name, grep, sure, cand, noise): lines with the shape of a call against classified calls,
    for names chosen by the caller. Lines are cut to the words before a parenthesis once, so the
    join is on the name, not a scan per name."""
    shape = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)[ \t]*\("), F.lit(1))))
    g = facts.lines.select(shape.alias("name")).join(names.select("name"), "name").groupBy("name").agg(_n("grep"))
    rows = names.select("name").join(g, "name", "left").join(classify_calls(facts, names), "name", "left")
    rows = rows.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("grep", "sure", "cand")])
    noise = F.when(F.col("grep") > 0, F.greatest(F.lit(0), F.col("grep") - F.col("sure") - F.col("cand")) / F.col("grep"))
    return rows.withColumn("noise", F.coalesce(noise, F.lit(0.0)))


def sampled_names(facts: Facts, n: int = 100, seed: int = 42) -> DataFrame:
    """A sample of the called names that a seed fixes: the first ``n`` by a digest of seed and name,
    so each task sends its own first ``n`` only."""
    return called_names(facts).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "name")), "name").limit(n)


def quality(facts: Facts, n: int = 100, seed: int = 42) -> DataFrame:
    """One row for a sample of names: upper medians of lines found by text, of confirmed calls, of
    confirmed and candidate ones, and of the share of noise where there are such lines."""
    rows = grep_noise(facts, sampled_names(facts, n, seed))
    noise = S.upper_median(F.when(F.col("grep") > 0, F.col("noise")))  # of n values at most
    return rows.agg(_n("names"), *[S.upper_median(c).alias(a) for a, c in (("grep", F.col("grep")), ("sure", F.col("sure")), ("classified", F.col("sure") + F.col("cand")))], noise.cast("double").alias("noise"))


def word_lines(facts: Facts, word: str) -> DataFrame:
    """(path, line) of the lines that hold a word as a whole identifier."""
    rows = facts.lines.where(F.col("text").contains(word)).where(F.col("text").rlike(S.word_bound(word)))
    return rows.join(_path(facts), "file_id").select("path", F.col("ln").cast("int").alias("line"))


def read_bytes(facts: Facts, word: str, around: int = 20) -> DataFrame:
    """One row of what reading by hand would cost: grep output, then a window around the first hit
    of each file. (hits, files, calls, bytes)"""
    hit = F.lower("text").contains(word.lower())
    firsts = facts.lines.where(hit).groupBy("file_id").agg(F.min("ln").alias("first"), _n("hits")).join(_path(facts), "file_id")
    rows = facts.lines.join(firsts, "file_id")
    size = F.octet_length("text") + 1
    grep = F.when(F.lower("text").contains(word.lower()), F.octet_length("path") + 8 + size).otherwise(0)
    near = F.when(F.abs(F.col("ln") - F.col("first")) <= around, size).otherwise(0)
    by_file = rows.groupBy("file_id").agg(F.sum(grep + near).alias("bytes"), F.first("hits").alias("hits"))
    return by_file.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), _n("files"), (F.count(F.lit(1)) + 1).alias("calls"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def largest_files(facts: Facts, top: int = 5) -> DataFrame:
    n = facts.lines.groupBy("file_id").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    return n.join(_path(facts), "file_id").select("path", "bytes").orderBy(F.desc("bytes"), "path").limit(top)


def hottest_call(facts: Facts) -> DataFrame:
    """The name that is called most, the least of several."""
    n = facts.call.groupBy("callee").agg(_n())
    return n.orderBy(F.desc("n"), "callee").limit(1)
