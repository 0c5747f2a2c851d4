"""Operators on text against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("codefacts.llm")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from codefacts.llm import bpe, html_text, language_id, line_dedup, mixing, near_dup, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairs(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_library(encoder):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "é\n\n  x'll 12345", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), " " * 999 + "b"]
    for t in texts + [words(rng, 200)]:
        ids = encoder.encode(t)
        assert ids == own.encode_ordinary(t) and encoder.decode(ids) == t.encode()
    assert encoder.encode(None) == []


def test_bpe_query(spark, encoder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for r in queries.op9_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[r["doc_id"]] or "")
        assert encoder.encode(docs[r["doc_id"]]) == ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def phrases(text, train):
    """Greedy longest matches, segment by segment."""
    n = 0
    for at in range(0, len(text), language_id.SEGMENT):
        part, i = text[at : at + language_id.SEGMENT], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in train and part[i : i + k] in train:
                k += 1
            i, n = i + k, n + 1
    return n


def test_language_phrases_brute_force():
    rng = random.Random(2)
    train = {"x": [" ".join(rng.choices(["foo", "bar", "bazz"], k=80))], "y": [" ".join(rng.choices(["qux", "foo", "zap"], k=80))]}
    model = language_id.fit(train, 10_000)
    texts = ["foo bar", "qux zap, zap", " ".join(rng.choices(["foo", "qux", "bar", "nope"], k=400)), "ñandú", "漢字"]
    got, _, letters = language_id.phrases(model, texts)
    clean = lambda t: "".join(c if c.isalpha() else " " for c in t)
    for i, t in enumerate(texts):
        squeezed = "".join(c for j, c in enumerate(clean(t)) if c != " " or j == 0 or clean(t)[j - 1] != " ")
        known = "".join(c if c in "".join(train["x"] + train["y"]) or c == " " else "\0" for c in squeezed)
        assert got[i].tolist() == [phrases(known, train[n][0]) for n in model.languages]
    assert letters.all()
    assert language_id.predict(model, ["", None, "12 34", "bar bazz"])[0] == ["und", "und", "und", "x"]
    assert language_id.predict(language_id.fit({}, 100), ["foo"])[0] == ["und"]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_lines(spark):
    long = "This line has more than forty characters, certainly it does"
    rows = [(i, f"own {i}\n \t{long.upper()}\x0b\nshort", "en", "s", 0) for i in range(5)] + [(9, None, None, None, None), (10, "", "en", "s", 0), (11, f"{long}x\n" * 6, "en", "s", 0)]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOC).withColumn("lines", F.lit(1))).collect()}
    assert [got[i]["n_dropped"] for i in range(5)] == [1, 1, 1, 1, 0] and got[0]["text"] == "own 0\nshort" and got[4]["text"] == rows[4][1]
    assert got[9]["text"] is None and got[9]["n_lines"] == 1 and got[10]["text"] == "" and got[11]["n_dropped"] == 0 and got[11]["n_lines"] == 7
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOC)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs(spark):
    a = spark.createDataFrame([(1, "x" * 50), (2, "x" * 50), (3, "y" * 60)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "x" * 50), (8, "z" * 60)], "doc_id long, text string")
    a, b = (line_dedup.hashed(x, 40) for x in (a, b))
    runs = line_dedup.LineRuns(spark, fan_in=2)
    assert runs.unseen(line_dedup.run_of(a)).count() == 2
    for rows in (a, a, b, a, a):
        runs.add(rows)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    keys = [r for x in runs.runs() for r in x.collect()]
    assert len(keys) == 5 and sum(r.fresh for r in keys) == 3  # each of the three keys is fresh once
    assert runs.unseen(line_dedup.run_of(a)).count() == 0
    assert sorted(r.owner for r in runs.frequent(4).collect()) == [3, 7] and sorted(r.owner for r in runs.frequent(1).collect()) == [3, 7, 8]
    # Runs meet without an exchange: the anti-join of one with the others, and what they are compacted to.
    one, *others = runs.runs()
    assert "Exchange" not in plan_of(one.join(others[0].hint("merge"), "h", "left_anti")) and "Exchange" not in plan_of(runs.frequent(4))
    assert "Exchange" not in plan_of(one.join(others[0].hint("merge"), "h", "full"))
    runs.close()
    assert runs.paths == {}


def test_lines_clash(spark):
    """Columns called like the added ones are replaced; repeated rows count one document each."""
    rows = [(i % 2, "a" * 45 + "\nb", 7, 8, "k", "h") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped int, key string, h string")
    got = line_dedup.drop_repeated_lines(frame)
    assert sorted(got.columns) == sorted(frame.columns) and sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == [(0, 2, 1, "b")] * 3 + [(1, 2, 0, "a" * 45 + "\nb")] * 3


def plain_classes(docs):
    """Classes by comparing all documents that share a shingle."""
    ids, texts = zip(*docs)
    h, tf, n, _ = near_dup.shingles(list(texts))
    counts = np.bincount((h & np.uint64(near_dup.COUNTERS - 1)).astype(int), minlength=near_dup.COUNTERS)
    w, ends = near_dup.weights(h, tf, near_dup.idf_of(counts, len(docs))), np.cumsum(n)
    sets = [(h[e - k : e], w[e - k : e]) for e, k in zip(ends, n)]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and near_dup.similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs = []
    for i in range(25):
        base = words(rng, rng.choice([3, 12, 60, 300])).split()
        for k in range(rng.choice([1, 2, 6])):
            own = list(base)
            if k and len(own) > 50:
                own[rng.randrange(len(own))] = f"edit{k}"
            docs.append((len(docs), " ".join(own).upper() if k == 1 else "  ".join(own)))
    docs += [(900, ""), (901, "")]
    want = plain_classes(docs)
    frame = spark.createDataFrame([*docs, (902, None), (None, docs[0][1])], "doc_id long, text string").withColumn("bands", F.lit("x"))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got.pop(None) is None and got.pop(902) == 902 and got == want
    left = near_dup.drop_near_duplicates(frame.where("doc_id is not null"))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({*want.values(), 902})
    again = frame.unionByName(frame.where("doc_id in (0, 900)"))  # repeated ids and the null one
    left = near_dup.drop_near_duplicates(again).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted({*want.values(), 902}) and len(left) == len({*want.values()}) + 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # too many ids for a broadcast
        shuffled = near_dup.drop_near_duplicates(again, most_ids=0)
        assert sorted(map(str, shuffled.collect())) == sorted(map(str, left))
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0


def test_mixing(spark):
    sizes = [100, 10, 1000, 50, 500, 7, 900]
    got = mixing.targets(sizes)
    w, left, out, open_ = [(5, 2, 1)[i % 3] for i in range(7)], 1.5 * sum(sizes), {}, set(range(7))
    while True:  # water filling, one source at a time
        over = [i for i in sorted(open_) if left * w[i] / sum(w[j] for j in open_) > 2 * sizes[i]]
        if not over:
            break
        i = max(over, key=lambda i: w[i] / sizes[i])
        out[i] = 2 * sizes[i]
        left -= out[i]
        open_.remove(i)
    out |= {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
    assert got == pytest.approx([out[i] for i in range(7)])
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 40)) if i % 50 else None, "en", rng.choice(["b", "a", "c", None]), 0) for i in range(800)], DOC)
    one, two = (sorted(map(repr, mixing.taken(docs).collect())) for _ in range(2))
    assert one == two
    rows, by = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect(), {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        s[0] += r["taken"]
        s[2] += r["size"]
    names = [*sorted(s for s in by if s is not None), None]
    assert [by[s][1] for s in names] == pytest.approx(mixing.targets([by[s][2] for s in names])) and all(s[2] == s[3] for s in by.values())
    assert all(abs(s[0] - s[1]) <= 20 for s in by.values())
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(mixed[r["doc_id"]] * r["size"] == r["taken"] for r in rows)
    assert mixing.taken(docs.limit(0)).count() == 0


def test_splitting_tree():
    quotas = np.array([50, 3, 0, 200])
    parts = mixing.split(quotas, 6, np.random.default_rng(1))
    assert sum(parts).tolist() == quotas.tolist() and {int(p.sum()) for p in parts} <= {42, 43}


def test_html():
    page = """<html><head><title>t</title><script>var t="</p>";</script></head><body><header>Site name</header><nav><a href=/>menu</a></nav>
<div class="ad">Buy a very long advert text that is longer than most of the lines around it, really</div>
<article><h1>Head &amp; line</h1><p><b>One<br>two   three<p>Short<aside>side</aside><form>x</form><div class="comments"><p>no</p></div></article>
<footer>&copy; foot</footer>"""
    assert html_text.main_text(page) == "Head & line\n\nOne two three\n\nShort"
    plain = "<body><ul><li><a href=/>a</a><li><a href=/>b</a></ul><p>" + "Long text of an article. " * 9 + "</p><p>End.</p><ul><li><a href=/>next page</a></ul></body>"
    assert html_text.main_text(plain) == ("Long text of an article. " * 9).strip() + "\n\nEnd."
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<!-- x", "<")] == [""] * 5


def test_html_false_marks():
    """Menus named after the main part, comments and mere links don't take the article's place."""
    text = "Long text of an article. " * 9
    want = text.strip()
    menu = "<a href=/>Home page</a><a href=/>All the products that we have</a><a href=/>Contact and company</a>"
    for mark in ("nav class=main-nav", "nav id=main", "div class=main-menu", "ul class=main-navigation", "div class=article-list", "div class=main"):
        name = mark.split()[0]
        assert html_text.main_text(f"<body><{mark}>{menu}</{name}><div id=content><p>{text}</p></div>") == want, mark
    assert html_text.main_text(f"<body><nav class=main-nav>{menu}</nav><article><p>{text}</p></article><article class=comment><p>I, a reader, say: {text}</p></article>") == want
    assert html_text.main_text(f"<main class=no-sidebar><article class='post has-comments'><p>{text}</p></article></main>") == want


def test_language_wide_alphabets():
    """Letters beyond the most frequent ones count as the others do; emoji are no letters."""
    rng = random.Random(6)
    letters = {"ko": range(0xAC00, 0xAC00 + 300), "zh": range(0x4E00, 0x4E00 + 300), "am": range(0x1200, 0x1230), "got": range(0x10330, 0x10340), "la": range(97, 123)}
    words_ = {n: ["".join(chr(rng.choice(r)) for _ in range(3)) for _ in range(60)] for n, r in letters.items()}
    words_["zh2"] = ["".join(rng.sample("".join(words_["zh"]), 3)) for _ in range(60)]
    some = lambda n, k: " ".join(rng.choices(words_[n], k=k))
    train = {n: [some(n, 4000 if n == "la" else 300)] for n in words_}
    small, whole = (language_id.fit(train, 50_000, **x) for x in ({"alphabet": 26}, {"alphabet": 5000}))
    texts = [some(n, 40) for n in sorted(words_)] + [some("ko", 300) + some("zh", 5)]
    assert language_id.predict(small, texts)[0] == [*sorted(words_), "ko"]
    assert small.width < whole.width and language_id.phrases(small, texts)[0].tolist() == language_id.phrases(whole, texts)[0].tolist()
    assert language_id.predict(language_id.fit(train, 50_000), ["\U0001F600\U0001F680", some("got", 3)])[0] == ["und", "got"]


def test_mixing_repeated_rows(spark):
    """Equal rows are filled in one by one, and the mix has as many copies as the shares say."""
    rows = [(1, "a b c", "x")] * 3 + [(2, "w " * 20, "y"), (3, "w " * 7, "y"), (3, "w " * 7, "y"), (None, "p q", None), (None, "p q", None), (4, None, "x"), (5, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "block": F.lit(2), "number": F.lit(3)})
    found, made = mixing.shares(frame)
    got = found.collect()
    assert len(got) == len(rows) and found.columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    for name, target in zip(made.sources, made.targets):
        own = [r for r in got if r.source == name]
        words = sum(r.size * len(r.copies) for r in own)
        assert 0 <= target - words < max(r.size for r in own) and all(len(r.copies) <= 2 for r in own)
    made = mixing.mix(frame)
    assert made.columns == [*frame.columns, "shard"]
    count = lambda rows: sorted(map(str, rows))
    assert count((r.doc_id, r.text) for r in made.collect()) == count((r.doc_id, t) for r in got for t in [next(y for x, y, z in rows if x == r.doc_id and z == r.source and len((y or "").split()) == r.size)] for _ in r.copies)
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.taken(frame.limit(0)).count() == 0
