"""Readers and scalar functions."""

import pytest
from pyspark.sql import functions as F

from codefacts.functions import scalar as S
from codefacts.operators import graph
from codefacts.sources import rust, scip, tree


def calls(src):
    return [(name, qual, method) for _, name, qual, method, _, _ in rust.parse(src).sites]


def test_call_sites():
    assert calls("fn f() { Self::a(1); Foo::b(); m::n::c(d()); x.e().g::<u8>(2); h::<T>(); Vec::<u8>::new(); }") == [
        ("a", "Self", 0), ("b", "Foo", 0), ("c", "n", 0), ("d", "", 0), ("e", "", 1), ("g", "", 1), ("h", "", 0), ("new", "Vec", 0),
    ]
    assert calls('fn f() { println!("{}", hidden()); if (a) { return (b); } let c = |x| inner(x); fn g() { nested() } }') == [("inner", "", 0), ("nested", "", 0)]
    assert calls("fn f<'a>(x: &'a str) -> char { g('\\''); r#\"h(\"#; /* i( /* j( */ */ 'b' }") == [("g", "", 0)]


def test_items():
    src = """
/// First line.
#[derive(Debug)]
pub(crate) struct S<T>(T) where T: Clone;
pub(in a::b) enum E { A(u8), B }
const N: usize = { 3 };
static X: u8 = 1;
type Y = u8;
macro_rules! m { () => { fn no() {} } }
pub async unsafe fn g<F: Fn(u8) -> u8>(f: F) -> u8 { f(1) }
#[cfg(test)]
mod t { pub mod u { fn helper() {} } }
impl<T> std::fmt::Display for S<T> { const K: u8 = 1; fn fmt(&self) {} }
"""
    got = rust.parse(src)
    rows = [(s["name"], s["kind"], s["vis"], s["module"], s["container"], s["is_test"], s["is_async"]) for s in got.syms]
    assert rows == [
        ("S", 2, 1, "", "", 0, 0), ("E", 3, 2, "", "", 0, 0), ("N", 5, 3, "", "", 0, 0), ("g", 0, 0, "", "", 0, 1),
        ("helper", 0, 3, "t::u", "", 1, 0), ("fmt", 1, 3, "", "S", 0, 0),
    ]
    assert got.syms[0]["doc"] == "First line." and got.impls == [("Display", "S", 13)]
    for bad in ("fn f( {", 'fn f() { "open }', "fn f() { /* open }"):
        with pytest.raises(rust.ParseError):
            rust.parse(bad)
    assert rust.facts_of("a.rs", "c", "fn f( {") == []


def test_signatures():
    sig = lambda src: rust.parse(src + " {}").syms[0]["sig"]
    assert sig("pub async fn g<'a,T:Clone>( x : &'a [ u8 ;4 ],f:impl Fn(T)->u8 ) -> Vec< Option<T>> where T : Copy") == (
        "async fn g<'a, T: Clone>(x: &'a [u8; 4], f: impl Fn(T) -> u8) -> Vec<Option<T>> where T: Copy"
    )
    assert sig("fn h(self: &mut Self, p: a :: b::C)") == "fn h(self: &mut Self, p: a::b::C)"


def test_ids_of_large_files():
    rows = rust.facts_of("big.rs", "c", "fn f() {" + "g();" * 70_000 + "}")
    assert len({r[4] for r in rows if r[0] == "site"}) == 70_000 and len({r[5] for r in rows if r[0] == "site"}) == 1


@pytest.mark.parametrize("name", ["plain", "a+b (1)", ".hid/p[2]", "target/x y%20z"])
def test_tree(spark, tmp_path, name):
    """The root may be called anything; folders under it that are hidden or build output are left out."""
    root = tmp_path / name
    for p in ("src/a.rs", "sub/b.rs", "target/c.rs", "sub/target/c.rs", ".hid/d.rs", "src/.e.rs", "src/f.txt"):
        (root / p).parent.mkdir(exist_ok=True, parents=True)
        (root / p).write_text("fn f() {}")
    (root / "src/latin.rs").write_bytes(b"fn g() {} // \xe9")
    (root / "sub/Cargo.toml").write_text('[package]\nname = "inner"')
    assert {(r.path, r.crate_) for r in tree.sources(spark, str(root)).collect()} == {("src/a.rs", "root"), ("sub/b.rs", "inner")}


def test_packages(tmp_path):
    assert tree.package_name('[workspace]\nname = "no"\n[package]\nversion = "1"\nname = "yes"\n[deps]\nname = "x"') == "yes"
    assert tree.package_name('[workspace]\nmembers = ["a"]') is None
    (tmp_path / "src").mkdir()
    (tmp_path / "Cargo.toml").write_text("[workspace]")
    assert tree.repository_root(str(tmp_path / "src")) == str(tmp_path)


def _message(number, data):
    return bytes([number << 3 | 2, len(data)]) + data


def test_scip(spark):
    occ = lambda r, s, roles: _message(1, bytes(r)) + _message(2, s.encode()) + bytes([3 << 3, roles])
    doc = _message(1, b"src/a.rs") + _message(2, occ([0, 3, 6], "x#", 1)) + _message(2, occ([5], "bad", 0)) + _message(2, occ([1, 4, 1, 6], "local 3", 8))
    assert list(scip.decode(_message(2, doc))) == [("src/a.rs", 0, 3, "x#", 1, 0), ("src/a.rs", 1, 4, "local 3", 8, 1)]
    rows = spark.createDataFrame([("é = f()", b) for b in (0, 1, 2, 5, 99)] + [("abc", 9), (None, 4), ("x𝄞y", 5)], "t string, b int").coalesce(1)
    assert [r[0] for r in rows.select(scip.char_column(F.col("t"), F.col("b"))).collect()] == [0, 1, 1, 4, 7, 3, 4, 2]


def test_scalars(spark):
    df = spark.createDataFrame([("abc", 12), ("", 0), ("é" * 120, 5)], "t string, r int")
    rows = df.select(S.fnv1a(F.col("t")).alias("h"), S.role_name(F.col("r")).alias("role"), F.char_length(S.capped(F.col("t"), 110)).alias("n")).collect()
    assert [(r["h"], r["role"], r["n"]) for r in rows] == [(440920331, "write", 3), (2166136261, "ref", 0), (rust.fnv1a("é" * 120), "def", 111)]
    lines = spark.createDataFrame([("a\r\nb\n",), ("",), ("x\n\ny",)], "t string").select(S.source_lines(F.col("t"))).collect()
    assert [r[0] for r in lines] == [["a", "b"], [], ["x", "", "y"]]
    for values, want in (([5, 1, 3], 3), ([2, 1, 4, 9], 4)):
        assert spark.createDataFrame([(v,) for v in values], "v int").agg(S.upper_median(F.col("v"))).first()[0] == want
    text = spark.createDataFrame([(x,) for x in "foo();|bar.foo ();|xfoo();|foo_bar();|// foo(|\"foo(\"|foo".split("|")], "t string")
    assert [r[0] for r in text.select(F.col("t").rlike(S.call_shape("foo"))).collect()] == [True, True, False, False, True, True, False]


@pytest.mark.parametrize("most", [1 << 21, 0], ids=["one task", "layers"])
def test_traversal(spark, monkeypatch, most):
    """Cycles, several seeds and parents, and no path, in one task and layer by layer."""
    monkeypatch.setattr(graph, "ONE_TASK", most)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 2), (5, 4), (6, 4), (5, 6), (8, 8), (7, 5)], "caller long, callee_sym long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sym_id long")
    assert sorted(map(tuple, graph.bfs_layers(edges, ids(2, 2, 99)).collect())) == [(1, 1), (3, 2), (4, 1), (5, 2), (6, 2), (7, 3)]
    assert sorted(map(tuple, graph.bfs_layers(edges, ids(2), 1).collect())) == [(1, 1), (4, 1)]
    assert graph.bfs_layers(edges, ids(8)).count() == 0 and graph.bfs_layers(edges, ids()).count() == 0
    path = lambda a, b: [i for _, i in sorted(map(tuple, graph.shortest_path(edges, a, b).collect()))]
    assert path(ids(7, 8), ids(3, 1)) == [7, 5, 4, 2, 3] and path(ids(4, 3), ids(3)) == [3]
    assert path(ids(1), ids(7)) == [] and path(ids(), ids(7)) == []
