"""Answers about a change that need no store of the facts."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codefacts import store
from codefacts.operators.resolve import confirmed
from codefacts.plans import queries as Q
from codefacts.sources import corpus

HERE = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A folder that no query of the session has indexed yet."""
    for name in ("documents", "labels"):
        shutil.copy(f"{HERE}/{name}.parquet", tmp_path)
    return str(tmp_path)


def left(path):
    """Bytes of the tables in a folder."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("name", ["affected_names", "incremental_callers"])
def test_stores_less_than_its_input(spark, folder, tmp_path_factory, monkeypatch, name):
    shared = str(tmp_path_factory.mktemp("shared"))
    monkeypatch.setattr(store, "shared_dir", lambda spark: shared)
    rows = {tuple(r) for r in entry.queries()[name](spark, folder).collect()}
    assert 0 < left(shared) < os.path.getsize(f"{folder}/documents.parquet")
    monkeypatch.undo()
    assert rows and rows == {tuple(r) for r in entry.queries()[name](spark, HERE).collect()}


def test_ids_of_the_snapshot_may_be_taken(spark, tmp_path):
    """Copies that only the snapshot has get ids from 1000000 on, which unchanged documents may have too."""
    texts = {0: "zero none", 1: "target alone", 26: "last none", 1000000: "caller target", 1000026: "other target"}
    rows = [(i, t, "de" if i >= 1000000 else "en", "src0") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("affected_names", "incremental_callers"):
        want = sorted(duck.execute(entry.oracle_sql()[name]).fetchall())
        assert want and sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == want


def test_counts_of_unresolved_sites(spark):
    """The hot name without a store, and its count, are those of the resolved calls."""
    docs, labels = (spark.read.parquet(f"{HERE}/{name}.parquet") for name in ("documents", "labels"))
    facts, sites = corpus.extract(docs, labels), corpus.call_sites(docs)
    names = Q.unique_names(facts, 1)
    assert Q.hot_name(sites, facts.sym) == names.orderBy(F.desc("n"), "name").first()["name"]
    found = confirmed(sites, facts.sym, names.select(F.col("name").alias("callee")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, names.select("sym_id", "n").collect()))
    assert Q.hot_name(sites.limit(0), facts.sym) == ""


def test_sites_of_one_name(spark):
    """Words that are lower-cased otherwise within a text than alone are found as well."""
    texts = ["one ΟΔΟΣ2 οδοσ", "one Οδος ΟΔΟΣ ΟΔΟΣΑ", "one two", None, "two ΟΔΟΣ'Α ΣΑΣ"]
    docs = spark.createDataFrame([(i, t, "el", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    every = corpus.call_sites(docs)
    names = {r["callee"] for r in every.collect()}
    assert len(names) >= 4
    for name in names:
        assert sorted(map(tuple, corpus.call_sites(docs, name).collect())) == sorted(map(tuple, every.where(F.col("callee") == name).collect()))
