import random

import numpy as np
import pytest

from strandlake.operators import features as V
from tests import models as M


def test_tiny_distance(spark):
    a, b = ("AACATAAGC", "GAAGCCAAC"), ("TAACATAA", "AAGCCAATT")
    rows = [(s, M.encode(k), 1) for s, rs in (("a", a), ("b", b)) for r in rs for k in M.kmers(r, 5)]
    df = spark.createDataFrame(rows, "sample string, comp_no long, value long")
    assert V.bray_curtis(df).first().dist == pytest.approx(7 / 19)


def test_distances_of_dirty_features(spark):
    random.seed(2)
    vec = {f"s{i}": {c: random.randint(1, 50) for c in random.sample(range(30), 8)} for i in range(12)}
    rows = [(s, c, v, 0.5) for s, own in vec.items() for c, v in own.items()]
    rows += rows[:5] + [("zero", 1, 0, None), ("null", 2, None, None), (None, 1, 5, 0.1), ("s0", 29, None, None)]
    df = spark.createDataFrame(rows, "sample string, comp_no int, value long, breadth double")
    got = {(r.sample_i, r.sample_j): r.dist for r in V.bray_curtis(V.vectors(df)).collect()}
    want = {}
    for a in vec:
        for b in vec:
            if a < b:
                num = sum(abs(vec[a].get(c, 0) - vec[b].get(c, 0)) for c in range(30))
                want[a, b] = num / (sum(vec[a].values()) + sum(vec[b].values()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert V.bray_curtis(V.vectors(df.limit(0))).isEmpty()


def test_coverage(spark):
    parts = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, None), (3, 99)], "comp_no int, kmer long")
    counts = spark.createDataFrame([("a", 10, 5), ("a", 11, 1), ("b", 11, 2)], "sample string, kmer long, freq int")
    got = sorted(tuple(r) for r in V.coverage(parts, counts).collect())
    assert got == [("a", 1, 11, 1.0), ("a", 2, 5, 1.0), ("b", 1, 2, pytest.approx(1 / 3))]
    chosen = spark.createDataFrame([(11,)], "kmer long")
    assert sorted(tuple(r)[:3] for r in V.coverage(parts, counts, selected=chosen).collect()) == [("a", 1, 1), ("b", 1, 2)]
    assert V.dense(V.coverage(parts, counts), parts, counts).count() == 6


@pytest.mark.parametrize("n", [1, 2, 5, 14])
def test_average_linkage(n):
    rng = np.random.default_rng(n)
    d = np.round(rng.random((n, n)), 2)
    d = np.triu(d, 1) + np.triu(d, 1).T
    merges, order = V.average_linkage(d)
    heights, leaves = M.linkage(d.tolist())
    assert [round(m.height, 9) for m in merges] == [h for h, _ in heights]
    assert order == leaves and [m.size for m in merges] == [len(g) for _, g in heights]


def test_leaf_order_of_a_small_matrix(spark):
    rows = [("1", "2", 0.5691), ("1", "3", 0.2981), ("2", "3", 0.8448)]
    df = spark.createDataFrame(rows, "sample_i string, sample_j string, dist double")
    assert [r.sample for r in V.leaf_order(df).orderBy("perm").collect()] == ["1", "3", "2"]
    assert V.symmetric(df, spark.createDataFrame([("1",), ("2",), ("3",)], "sample string")).count() == 9
    dirty = spark.createDataFrame([(7, "b", "a", 0.5), (7, "a", "b", 0.5), (7, "a", "a", 0.0), (7, "a", "c", None)], "study int, sample_i string, sample_j string, dist double")
    assert [tuple(r) for r in V.clean_distances(dirty).collect()] == [(7, "a", "b", 0.5)]
    assert V.average_linkage(np.zeros((0, 0))) == ([], [])


def test_ward_linkage_adds_least_variance():
    rng = np.random.default_rng(3)
    x = rng.random((12, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    merges, order = V.average_linkage(d, "ward")
    members = {i: [i] for i in range(12)}
    for step, m in enumerate(merges):
        costs = {}
        for a in members:
            for b in members:
                if a < b:
                    p, q = x[members[a]], x[members[b]]
                    costs[a, b] = (2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()) ** 0.5
        pair = min(costs, key=costs.get)
        assert {m.left, m.right} == set(pair) and m.height == pytest.approx(costs[pair])
        members[12 + step] = members.pop(m.left) + members.pop(m.right)
    assert sorted(order) == list(range(12))


def test_distances_in_blocks(spark, monkeypatch):
    """The same distances whatever the blocks; each pair once, in the order of the names."""
    import random

    random.seed(3)
    vecs = {f"s{i:02d}": {c: random.randint(1, 50) for c in random.sample(range(30), 12)} for i in range(23)}
    rows = [(s, c, v) for s, own in vecs.items() for c, v in own.items()]
    df = spark.createDataFrame(rows, "sample string, comp_no int, value long")
    for block in (4, 256):
        monkeypatch.setattr(V, "BLOCK", block)
        got = {(r.sample_i, r.sample_j): r.dist for r in V.bray_curtis(df).collect()}
        assert len(got) == 23 * 22 // 2
        for (i, j), d in got.items():
            a, b = vecs[i], vecs[j]
            both = sum(a.values()) + sum(b.values())
            assert i < j and abs(d - (both - 2 * sum(min(v, b[c]) for c, v in a.items() if c in b)) / both) < 1e-12
    assert V.bray_curtis(df.limit(0)).isEmpty()
