"""The engine over a small crate of our own with answers checked by hand."""

import hashlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from codefacts.engine import Engine
from codefacts.plans import commands
from codefacts.schema import EXTREF

ROOT_MANIFEST = '[workspace]\nmembers = ["shop", "till"]\n'
SHOP = """//! Orders of a shop.

/// What can be priced.
pub trait Priced {
    fn cents(&self) -> u64;
    fn taxed(&self) -> u64 {
        self.cents() + levy(self.cents())
    }
}

#[derive(Clone)]
pub struct Basket<T> {
    items: Vec<T>,
}

impl<T: Priced> Priced for Basket<T> {
    fn cents(&self) -> u64 {
        let mut sum = 0;
        for item in &self.items {
            sum += item.cents();
        }
        sum
    }
}

impl<T> Basket<T> {
    pub(crate) fn fresh() -> Self {
        Self::with(Vec::new())
    }

    fn with(items: Vec<T>) -> Self {
        Basket { items }
    }
}

pub mod rates {
    pub const LEVY: u64 = 19;

    pub fn rounded(x: u64) -> u64 {
        x / 100
    }
}

fn levy(cents: u64) -> u64 {
    rates::rounded(cents * rates::LEVY)
}
"""
TILL = """use shop::Basket;

pub enum Coin {
    Small,
    Large,
}

pub async fn checkout() -> u64 {
    let basket = Basket::fresh();
    receipt(basket.taxed())
}

fn receipt(total: u64) -> u64 {
    log_total(total);
    total
}

#[cfg(test)]
mod checks {
    fn prepared() -> u64 {
        super::receipt(5)
    }

    #[test]
    fn receipt_keeps_total() {
        assert!(true);
        prepared();
    }
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    (root / "Cargo.toml").write_text(ROOT_MANIFEST)
    for name, text in (("shop", SHOP), ("till", TILL)):
        (root / name / "src").mkdir(parents=True)
        (root / name / "Cargo.toml").write_text(f'[package]\nname = "{name}"\n')
        (root / name / "src/lib.rs").write_text(text)
    (root / "target").mkdir()
    (root / "target/built.rs").write_text("fn built() {}")
    (root / "till/src/broken.rs").write_text("fn broken( {")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine(spark).index(str(tree))


def labels(df):
    return sorted(r["label"] for r in df.collect())


def test_symbols(engine):
    rows = {
        (r["path"][:4], r["label"], r["kind"], r["vis"], r["line"], r["test"])
        for r in engine.search().join(engine.facts.sym.selectExpr("sym_id", "is_test AS test"), "sym_id").collect()
    }
    assert rows == {
        ("shop", "Priced", "trait", "pub", 4, 0), ("shop", "Priced::cents", "method", "pub", 5, 0), ("shop", "Priced::taxed", "method", "pub", 6, 0),
        ("shop", "Basket", "struct", "pub", 12, 0), ("shop", "Basket::cents", "method", "priv", 17, 0), ("shop", "Basket::fresh", "method", "crate", 27, 0),
        ("shop", "Basket::with", "method", "priv", 31, 0), ("shop", "LEVY", "const", "pub", 37, 0), ("shop", "rounded", "fn", "pub", 39, 0),
        ("shop", "levy", "fn", "priv", 44, 0), ("till", "Coin", "enum", "pub", 3, 0), ("till", "checkout", "fn", "pub", 8, 0),
        ("till", "receipt", "fn", "priv", 13, 0), ("till", "prepared", "fn", "priv", 20, 1), ("till", "receipt_keeps_total", "fn", "priv", 25, 1),
    }
    assert {r["path"]: (r["crate_"], r["loc"]) for r in engine.facts.file.collect()} == {"shop/src/lib.rs": ("shop", 46), "till/src/lib.rs": ("till", 29)}
    assert {r["doc"] for r in engine.definition("Priced").collect()} == {"What can be priced."}
    assert [r["sig"] for r in engine.definition("with").collect()] == ["fn with(items: Vec<T>) -> Self"]


def test_resolution(engine):
    """Each call with what it means: see the cascade in ``operators.resolve``."""
    names = {r["sym_id"]: r["label"] for r in engine.search().collect()}
    got = sorted((r["callee"], r["qual"], r["res"], names.get(r["callee_sym"], "")) for r in engine.facts.call.collect())
    assert got == sorted([
        ("cents", "", 3, ""), ("cents", "", 3, ""), ("cents", "", 3, ""), ("levy", "", 1, "levy"), ("with", "Self", 2, "Basket::with"), ("new", "Vec", 0, ""),
        ("rounded", "rates", 2, "rounded"), ("fresh", "Basket", 2, "Basket::fresh"), ("receipt", "", 1, "receipt"), ("taxed", "", 1, "Priced::taxed"),
        ("log_total", "", 0, ""), ("receipt", "super", 0, ""), ("prepared", "", 1, "prepared"),
    ])


def test_callers(engine):
    assert labels(engine.callers_confirmed("receipt")) == ["checkout"]
    assert [(r["label"], r["res"]) for r in engine.callers_candidates("receipt").collect()] == [("prepared", "unresolved")]
    assert engine.callers_totals("receipt").first().asDict() == {"name_total": 2, "confirmed": 1, "candidates": 1, "other": 0}
    assert {r["label"]: r["n"] for r in engine.callers_summary("cents").collect()} == {"Priced::cents": 0, "Basket::cents": 0}
    assert [r["source"] for r in engine.callers_confirmed("levy", with_source=True).collect()] == ["self.cents() + levy(self.cents())"]


def test_graph(engine):
    assert [tuple(r) for r in engine.edges().collect()] == [("till/src/lib.rs", "shop/src/lib.rs", 2)]
    assert {(r["label"], r["depth"]) for r in engine.impact("rounded").collect()} == {("levy", 1), ("Priced::taxed", 2), ("checkout", 3)}
    assert [(r["label"], r["depth"]) for r in engine.tests_reaching("prepared").collect()] == [("receipt_keeps_total", 1)]
    assert [r["label"] for r in engine.call_path("checkout", "rounded").orderBy("hop").collect()] == ["checkout", "Priced::taxed", "levy", "rounded"]
    assert engine.call_path("rounded", "checkout").count() == 0


def test_quality(engine):
    """The sample is the seed's, and the medians are those of the lines and calls read one by one."""
    facts = engine.facts
    pool = {r["name"] for r in engine.called_names().collect()}
    order = sorted(pool, key=lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest())
    assert {r["name"] for r in engine.sampled_names(3).collect()} == set(order[:3]) and len(pool) > 3
    symbols = {r["sym_id"]: r["name"] for r in facts.sym.collect()}
    calls = [(r["callee"], r["callee_sym"]) for r in facts.call.collect()]
    sources = [x for text in (SHOP, TILL) for x in text.split("\n")]
    grep = {n: sum(bool(re.search(rf"\b{n}\s*\(", x)) for x in sources) for n in pool}
    sure = {n: sum(c == n and symbols.get(s) == n for c, s in calls) for n in pool}
    both = {n: sure[n] + sum(c == n and s is None for c, s in calls) for n in pool}
    noise = [max(0, grep[n] - both[n]) / grep[n] for n in pool if grep[n]]
    got = engine.quality().first().asDict()
    middle = lambda v: sorted(v)[len(v) // 2]
    assert got == {"names": len(pool), "grep": middle(grep.values()), "sure": middle(sure.values()), "classified": middle(both.values()), "noise": middle(noise)}
    assert got["grep"] > 0


def test_search(engine):
    assert labels(engine.search("kind:fn", "vis:pub")) == ["checkout", "rounded"]
    assert labels(engine.search("kind:method", "calls:levy")) == ["Priced::taxed"]
    assert labels(engine.search("async:yes")) == ["checkout"]
    assert labels(engine.search("module:rates")) == ["LEVY", "rounded"]
    assert engine.search("kind:nothing", "color:red").count() == 15
    assert engine.search("kind:fn", "kind:method").count() == 0
    assert [(r["direction"], r["name"]) for r in engine.implementations("Priced").collect()] == [("type", "Basket")]
    assert [r["ln"] for r in engine.body("receipt_keeps_total").orderBy("ln").collect()] == [24, 25, 26, 27, 28]
    assert {(r["line"], r["note"], r["label"]) for r in engine.text("priced").collect()} == {(3, "doc of next def", "Priced"), (4, "in", "Priced"), (16, "in", "Basket")}
    assert {(r["note"], r["label"]) for r in engine.text("ORDERS OF").collect()} == {("module doc", None)}


def rows(facts, name):
    return sorted(repr(sorted(r.asDict().items())) for r in getattr(facts, name).collect())


def test_refresh_equals_rebuild(spark, tree):
    engine = Engine(spark).index(str(tree))
    assert {tuple(r) for r in engine.stale().collect()} == {("till/src/broken.rs", "added")}
    (tree / "till/src/lib.rs").write_text(TILL + "pub fn levy() {}\n")
    (tree / "till/src/more.rs").write_text("fn again() { checkout(); }\n")
    (tree / "till/src/broken.rs").unlink()
    try:
        assert {tuple(r) for r in engine.refresh().collect()} == {("till/src/lib.rs", "modified"), ("till/src/more.rs", "added")}
        full = Engine(spark).index(str(tree))
        for name in ("sym", "call", "impl", "file", "edge"):
            assert rows(engine.facts, name) == rows(full.facts, name)
        assert labels(engine.callers_confirmed("checkout")) == ["again"] and engine.callers_confirmed("levy").count() == 0
        assert engine.facts.meta.first()["upd_since_bake"] == 0
        before = engine.facts.sym
        engine.facts.meta = engine.facts.meta.selectExpr("* EXCEPT (built_at)", "0L AS built_at")
        assert engine.refresh().count() == 0 and engine.facts.sym is before and engine.facts.meta.first()["built_at"] > 0
        (tree / "till/src/more.rs").unlink()
        assert [tuple(r) for r in engine.refresh().collect()] == [("till/src/more.rs", "deleted")]
        assert engine.facts.file.count() == 2 and engine.callers_confirmed("checkout").count() == 0
    finally:
        (tree / "till/src/lib.rs").write_text(TILL)
        (tree / "till/src/broken.rs").write_text("fn broken( {")


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def occurrence(place, symbol, roles=0):
    return field(2, field(1, b"".join(map(varint, place))) + field(2, symbol.encode()) + varint(3 << 3) + varint(roles))


def test_precise_index(spark, tree, tmp_path, caplog):
    """Occurrences by position win over the cascade; a site without one falls back to it."""
    shop = [occurrence([4, 7, 12], "shop Priced cents", 1), occurrence([16, 7, 12], "shop Basket cents", 1), occurrence([19, 24, 29], "shop Priced cents", 8), occurrence([6, 13, 18], "std u64 cents", 8)]
    till = [occurrence([12, 3, 10], "till receipt", 1), occurrence([13, 4, 13], "log total", 8), occurrence([20, 15, 22], "till receipt", 8), occurrence([9, 19, 24], "local 4", 8)]
    index = tmp_path / "index.scip"
    index.write_bytes(field(2, field(1, b"shop/src/lib.rs") + b"".join(shop)) + field(2, field(1, b"till/src/lib.rs") + b"".join(till)))
    engine = Engine(spark).index(str(tree), str(index))
    names = {r["sym_id"]: r["label"] for r in engine.search().collect()}
    got = {(r["callee"], r["line"], r["res"], names.get(r["callee_sym"], "")) for r in engine.facts.call.collect()}
    assert {("cents", 20, 1, "Priced::cents"), ("receipt", 21, 1, "receipt"), ("log_total", 14, 0, ""), ("levy", 7, 1, "levy"), ("taxed", 10, 0, "")} <= got
    assert {(names[r["sym_id"]], r["line"], r["role"]) for r in engine.facts.ref.collect()} == {
        ("Priced::cents", 5, 1), ("Priced::cents", 20, 8), ("Basket::cents", 17, 1), ("receipt", 13, 1), ("receipt", 21, 8),
    }
    assert {r["symbol"] for r in engine.facts.extref.collect()} == {"std u64 cents", "log total"}
    assert sorted((r["line"], r["role"]) for r in engine.refs("receipt").collect()) == [(13, "def"), (21, "read")]
    many = [tree / f"till/src/n{i}.rs" for i in range(20)]
    try:
        for p in many:
            p.write_text("fn n() {}")
        engine.refresh()
        assert engine.facts.meta.first()["upd_since_bake"] == 21 and "files changed" in caplog.text
    finally:
        for p in many:
            p.unlink()


def test_answers(engine):
    """The branch, the order, the limit and what is left out."""
    found = lambda *a, **k: [(r["section"], r["rank"], r["label"], r["detail"], r["total"]) for r in engine.answer(*a, **k).orderBy("section", "rank").collect()]
    assert [x for x in found("callers", "receipt") if x[0] != "count"] == [("candidate", 1, "prepared", "unresolved", 1), ("confirmed", 1, "checkout", "receipt(basket.taxed())", 1)]
    assert {(x[2], x[3]) for x in found("callers", "receipt") if x[0] == "count"} == {("name_total", "2"), ("confirmed", "1"), ("candidates", "1"), ("other", "0")}
    assert [x[:4] for x in found("callers", "cents", limit=1) if x[0] == "summary"][0][3] == "0" and found("callers", "cents", limit=1)[-1][-1] == 2
    assert [x[2] for x in found("callers", "receipts") if x[0] == "suggestion"] == ["receipt"]
    assert [x[3] for x in found("read", "rounded")] == ["    pub fn rounded(x: u64) -> u64 {", "        x / 100", "    }"]
    assert [x[3] for x in found("read", "cents")] == ["fn cents(&self) -> u64", "fn cents(&self) -> u64"] and found("refs", "levy") == []
    assert [(r.depth, r["rank"], r.label, r.total) for r in engine.answer("impact", "rounded").orderBy("depth").collect()] == [(1, 1, "levy", 1), (2, 1, "Priced::taxed", 1), (3, 1, "checkout", 1)]
    assert [(r["rank"], r.depth, r.label) for r in engine.answer("tests", "prepared").collect()] == [(1, 1, "receipt_keeps_total")]


def test_across(spark, engine):
    """One name over two stores; references meet definitions by their symbols."""
    f = engine.facts
    named = replace(f, sym=f.sym.withColumn("symbol", F.when(F.col("name") == "levy", "shop levy").otherwise("")))
    other = replace(f, sym=f.sym.where("name <> 'levy'"), call=f.call.withColumn("callee_sym", F.lit(None).cast("long")), extref=spark.createDataFrame([("shop levy", 1, 2, 3, 8)] * 2, EXTREF))
    counts, defs, outside = commands.across({"here": named, "there": other, "nowhere": replace(other, call=f.call.limit(0))}, "levy")
    assert sorted(map(tuple, counts.collect())) == [("here", 1, 1, 1), ("there", 0, 0, 1)]
    assert [(r.repo, r["rank"], r.label) for r in defs.collect()] == [("here", 1, "levy")]
    assert sorted((r.def_repo, r.repo, r.symbol, r.n) for r in outside.collect()) == [("here", "nowhere", "shop levy", 2), ("here", "there", "shop levy", 2)]
