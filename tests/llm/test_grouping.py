import random

import numpy as np
import pytest

from codefacts.llm import grouping


def brute(links):
    """The least id of each linked id's component."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def frame(spark, links, n=5):
    return spark.createDataFrame(links or [], "a long, b long").repartition(n)


def found(df):
    rows = [tuple(r) for r in df.select("id", "component").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


CHAIN = [(i, i + 1) for i in range(60)]
STAR = [(7, 100 + i) for i in range(60)] + [(100 + i, 7) for i in range(0, 60, 3)]
RANDOM = [(random.Random(i).randrange(90), random.Random(-i - 1).randrange(90)) for i in range(70)]


@pytest.mark.parametrize("links", [[], [(3, 3)], CHAIN, STAR, RANDOM, CHAIN[::2] + STAR + [(-5, 160), (-5, 160)]], ids=["none", "loop", "chain", "star", "random", "mixed"])
def test_components(spark, links):
    assert found(grouping.components(frame(spark, links), [])) == brute([x for x in links if x[0] != x[1]])


def test_components_joined(spark):
    first, later = RANDOM[:35], RANDOM[35:] + [(2, 500), (500, 600), (700, 800)]
    first, later = ([x for x in links if x[0] != x[1]] for links in (first, later))
    parts = grouping.components(frame(spark, first), [])
    assert found(grouping.joined(parts, frame(spark, later), [])) == brute(first + later)
    assert found(grouping.joined(parts, frame(spark, []), [])) == brute(first)


def test_stars():
    for links in (CHAIN, CHAIN[::-1], STAR, RANDOM):
        a, b = grouping.stars(*(np.array(x, dtype=np.int64) for x in zip(*links)))
        assert dict(zip(a.tolist(), b.tolist())) == {x: y for x, y in brute(links).items() if x != y}


def test_salted(spark):
    """Each pair meets its b once; only a hot b is there under several salts."""
    pairs = [(i, 1) for i in range(2, 52)] + [(60, 50), (61, 50)]
    rows = grouping.salted(frame(spark, pairs), 10).collect()
    heads = [(r.b, r.salt) for r in rows if r.kind == 0]
    assert len(heads) == len(set(heads)) and sum(b == 50 for b, _ in heads) == 1 and 1 < sum(b == 1 for b, _ in heads) <= 5
    assert sorted((r.id, r.b) for r in rows if r.kind) == sorted(pairs) and {(r.b, r.salt) for r in rows if r.kind} == set(heads)


def test_link_whole_buckets(spark):
    """Pairs that neither the bucket's least member nor a pivot meets are found, over many tiles."""
    ids = list(range(2 * grouping.TILE)) + list(range(1000, 1300))
    rows = spark.createDataFrame([(key, i) for key in (5, 6) for i in ids] + [(7, 3), (7, 8)], "key long, id long")
    whole = lambda pairs: pairs.where("b = 0 and a >= 1000 or a < 1000 and a = b + 1 and b % 2 = 0")
    links, parts = grouping.link(grouping.buckets(rows, []), whole, [])
    want = [(i + 1, i) for i in range(0, 2 * grouping.TILE, 2)] + [(i, 0) for i in range(1000, 1300)]
    assert sorted((r.a, r.b) for r in links.collect()) == sorted(want) and found(parts) == brute(want)


def test_cells_exclude_no_similar_pair(spark):
    """A pair that the cells exclude has too little in common."""
    rng = random.Random(5)
    weights = {i: {rng.randrange(60): rng.choice([0.5, 1.0, 3.0]) for _ in range(30)} for i in range(40)}
    for i in range(0, 40, 2):
        weights[i + 1] = {**weights[i], rng.randrange(60): 1.0}
    def summed(w):
        return np.bincount([k % 16 for k in w], weights=list(w.values()), minlength=16).astype(np.float32).tobytes()
    rows = [(1, i, i, 0, 1, 39, bytearray(summed(w))) for i, w in weights.items()]
    frame_ = spark.createDataFrame(rows, "key long, id long, component long, main long, mains long, others long, cells binary")
    got = {(r.a, r.b) for r in grouping.crossing(frame_, 0.8).collect()}
    sim = lambda x, y: sum(min(x[k], y[k]) for k in x.keys() & y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y)
    near = {(a, b) for a in weights for b in weights if b < a and sim(weights[a], weights[b]) >= 0.8}
    assert len(near) >= 15 and near <= got and len(got) < 40 * 39 / 2
