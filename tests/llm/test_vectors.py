"""Nearest vectors and clusters against brute force."""

import random

import numpy as np
import pytest

from strandlake.llm import clusters, neighbours

SCHEMA = "sample string, comp_no int, value long, breadth double, loaded_at timestamp"


def groups(seed, n_groups=12, size=7, alone=30):
    """Vectors in tight groups, lone ones, equal ones."""
    random.seed(seed)
    out = {}
    for g in range(n_groups):
        base = {c: random.randint(20, 900) for c in random.sample(range(1, 400), 25)}
        for i in range(size):
            own = {c: max(1, int(v * random.uniform(0.85, 1.15))) for c, v in base.items()}
            out[f"g{g:02d}_{i}"] = own
    for i in range(alone):
        out[f"x{i:02d}"] = {c: random.randint(1, 900) for c in random.sample(range(1, 400), 20)}
    for i in range(9):
        out[f"c{i}"] = dict(out["g00_0"])
    return out


def table(spark, vecs):
    rows = [(s, c, v, 0.5, None) for s, own in vecs.items() for c, v in own.items()]
    rows += rows[:50] + [("zero", 1, 0, None, None), ("zero", 2, None, 0.1, None), (None, 3, 4, 0.1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def distance(a, b):
    both = sum(a.values()) + sum(b.values())
    return (both - 2 * sum(min(v, b[c]) for c, v in a.items() if c in b)) / both


def brute(vecs, k=5):
    out = {}
    for s, a in vecs.items():
        out[s] = sorted((distance(a, b), o) for o, b in vecs.items() if o != s)[:k]
    return out


@pytest.mark.parametrize("block", [40, 32_768])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "DATA_BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    vecs = groups(1)
    want = brute(vecs)
    got = {}
    for r in neighbours.nearest(table(spark, vecs)).collect():
        got.setdefault(r.sample, []).append((r.rank, r.d, r.other))
    assert got.keys() == want.keys()
    hits = sum(len({o for _, _, o in got[s]} & {o for _, o in want[s]}) for s in want)
    assert hits >= 0.99 * 5 * len(want)
    same = [[(d, o) for _, d, o in sorted(got[s])] == want[s] for s in want]
    assert sum(same) >= 0.99 * len(same)
    near = {(r.sample, r.other) for r in neighbours.nearest(table(spark, vecs), complete=False).collect()}
    assert near == {(s, o) for s, own in want.items() for d, o in own if d <= 0.35}


def test_few_and_no_vectors(spark):
    df = table(spark, groups(2))
    assert neighbours.nearest(df.limit(0)).isEmpty()
    two = spark.createDataFrame([("a", 1, 5, 0.1, None), ("b", 2, 7, 0.1, None)], SCHEMA)
    assert sorted((r.sample, r.other, r.d) for r in neighbours.nearest(two).collect()) == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_many_equal_vectors(spark):
    rows = [(f"s{i:04d}", c, 10 * c, None, None) for i in range(400) for c in (1, 2, 3)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.sample, []).append((r.rank, r.other))
    first = [f"s{i:04d}" for i in range(6)]
    assert len(got) == 400
    assert all([o for _, o in sorted(own)] == [x for x in first if x != s][:5] for s, own in got.items())


def test_clusters(spark):
    vecs = groups(3)
    dist = []
    for i in range(4):
        for j in range(i + 1, 4):
            dist += [(1, f"d{i}", f"d{j}", 0.2), (1, f"d{j}", f"d{i}", 0.2)]
    dist += [(1, f"d{i}", f"d{i}", 0.0) for i in range(4)] + [(1, "d0", "d9", None), (1, "d0", "x00", 0.9)]
    dist += [(2, "g01_0", "x01", 0.1)]  # both have features: these count
    dist += [(2, f"g02_{i}", "e", 0.3) for i in range(7)] + [(2, "zero", "g03_0", 0.0)]
    distances = spark.createDataFrame(dist, "study int, sample_i string, sample_j string, dist double")
    peaks = clusters.density_peaks(table(spark, vecs), distances)
    got = {}
    for r in clusters.clusters(peaks).collect():
        got.setdefault(r.cluster_key, set()).add(r.sample)
    want = [{s for s in vecs if s.startswith(f"g{g:02d}")} for g in range(12)]
    want[0] |= {f"c{i}" for i in range(9)}
    want[2].add("e")
    want.append({f"d{i}" for i in range(4)})
    assert got == {min(w): w for w in want}
    info = {r.cluster_key: (r.size, r.typical.split(",")) for r in clusters.described(peaks).collect()}
    assert {k: n for k, (n, _) in info.items()} == {min(w): len(w) for w in want}
    assert all(len(t) == 3 and set(t) <= got[k] for k, (_, t) in info.items())


def test_clusters_of_empty_tables(spark):
    features = spark.createDataFrame([], SCHEMA)
    distances = spark.createDataFrame([], "study int, sample_i string, sample_j string, dist double")
    assert clusters.clusters(clusters.density_peaks(features, distances)).isEmpty()
    only = spark.createDataFrame([(1, "a", "b", 0.1), (1, "b", "c", 0.1), (1, "a", "c", 0.2)], "study int, sample_i string, sample_j string, dist double")
    rows = clusters.clusters(clusters.density_peaks(features, only)).collect()
    assert sorted((r.cluster_key, r.sample) for r in rows) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_pointers_double_along_a_chain(spark):
    df = spark.createDataFrame([(f"n{i:03d}", f"n{max(i - 1, 0):03d}") for i in range(200)], "node string, parent string")
    assert {tuple(r) for r in clusters.follow(df).collect()} == {(f"n{i:03d}", "n000") for i in range(200)}


def matrix(n, seed):
    """Vectors with fractions in groups of all spreads, so that distances of every size occur."""
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(n // 10):
        comps = rng.choice(400, 30, replace=False)
        base = rng.lognormal(0, 1.0, 30) * rng.choice([0.01, 1, 100])
        for i in range(10):
            own = base * rng.lognormal(0, rng.choice([0.05, 0.2, 0.5, 0.9]), 30) * rng.choice([1.0, 1.0, 1.4])
            out[f"v{g:03d}_{i}"] = {int(c): float(v) for c, v in zip(comps, own)}
    return out


def test_fractions_and_recall_by_distance(spark):
    vecs = matrix(1500, 4)
    rows = [(s, c, v) for s, own in vecs.items() for c, v in own.items()]
    rows += [("bad", 1, float("nan")), ("bad", 2, -1.0), ("bad", 3, float("inf"))]
    df = spark.createDataFrame(rows, "sample string, comp_no int, value double")
    names = sorted(vecs)
    dense = np.zeros((len(names), 400))
    for i, s in enumerate(names):
        dense[i, list(vecs[s])] = list(vecs[s].values())
    total = dense.sum(1)
    shared = np.stack([np.minimum(dense, row).sum(1) for row in dense])
    d = (total[:, None] + total - 2 * shared) / (total[:, None] + total)
    classes = neighbours.classes_of(neighbours.vectors(df), 1)
    pairs, crowd = neighbours.near_pairs(classes, neighbours.level(len(names), *neighbours.LEVELS[-1]))
    name = {r.id: r.rep for r in classes.select("id", "rep").collect()}
    place = {s: i for i, s in enumerate(names)}
    got = {}
    for r in pairs.collect():
        i, j = sorted((place[name[r.a]], place[name[r.b]]))
        got[i, j] = r.d
        assert abs(r.d - d[i, j]) < 1e-9
    assert crowd.isEmpty()
    for low, high in ((0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.35)):
        want = [(i, j) for i, j in zip(*np.nonzero(np.triu((d >= low) & (d < high), 1)))]
        assert len(want) > 50 and sum(p in got for p in want) >= (0.99 if high < 0.3 else 0.97) * len(want)
    far = {}
    for r in neighbours.nearest(df, 8).collect():
        far.setdefault(r.sample, []).append((r.rank, r.other))
    assert far.keys() == vecs.keys()
    np.fill_diagonal(d, 2)
    hits = sum(len({o for _, o in far[s]} & {names[j] for j in np.argsort(d[i])[:8]}) for i, s in enumerate(names))
    assert hits >= 0.98 * 8 * len(names)
    assert all(len(own) == 8 for own in far.values())


def test_distances_of_fractions(spark):
    rows = [("a", 1, 0.4), ("a", 2, 0.6), ("a", 3, 0.2), ("b", 1, 0.4), ("b", 2, 0.6), ("b", 3, 0.3)]
    df = spark.createDataFrame(rows, "sample string, comp_no int, value double")
    got = {(r.sample, r.other): r.d for r in neighbours.nearest(df).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.04)


@pytest.mark.parametrize("group", [3, 128])
def test_crowded_windows(spark, monkeypatch, group):
    """Groups larger than a window may be are searched in blocks: same neighbours, same clusters."""
    monkeypatch.setattr(neighbours, "GROUP", group)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    monkeypatch.setattr(neighbours, "DATA_BLOCK", 30)
    vecs = groups(5, 4, 25, 20)
    df = table(spark, vecs)
    near = {(r.sample, r.other) for r in neighbours.nearest(df, complete=False).collect()}
    assert near == {(s, o) for s, own in brute(vecs).items() for d, o in own if d <= 0.35}
    none = spark.createDataFrame([], "study int, sample_i string, sample_j string, dist double")
    got = {}
    for r in clusters.clusters(clusters.density_peaks(df, none)).collect():
        got.setdefault(r.cluster_key, set()).add(r.sample)
        size = sum(distance(vecs[r.sample], v) <= 0.35 for v in vecs.values())
        assert r.density == size
    want = [{s for s in vecs if s.startswith(f"g{g:02d}")} for g in range(4)]
    want[0] |= {f"c{i}" for i in range(9)}
    assert got == {min(w): w for w in want}


def test_two_dense_cores_that_touch(spark):
    """A chain of points with a core at either end: two peaks, and the points between go to the nearer denser side."""
    vecs = {}
    for i in range(8):
        vecs[f"a{i}"] = {1: 1000 + i, 2: 1000, 3: 1}
        vecs[f"b{i}"] = {3: 1000 + i, 4: 1000, 1: 1}
    vecs["m1"] = {1: 1000, 2: 500, 3: 500}
    vecs["m2"] = {1: 500, 3: 1000, 4: 500}
    df = table(spark, vecs)
    none = spark.createDataFrame([], "study int, sample_i string, sample_j string, dist double")
    got = {}
    for r in clusters.clusters(clusters.density_peaks(df, none)).collect():
        got.setdefault(r.cluster_key, set()).add(r.sample)
    assert got == {"a0": {f"a{i}" for i in range(8)} | {"m1"}, "b0": {f"b{i}" for i in range(8)} | {"m2"}}


def test_winners_collide_as_often_as_the_distance_says():
    rng = np.random.default_rng(2)
    for d in (0.05, 0.2, 0.35, 0.6):
        base = rng.lognormal(0, 1, 40)
        small = (1 - d) / (1 + d)
        # Contained: totals differ as far as the distance allows.
        comps = np.r_[np.arange(40), np.arange(40)]
        logs = np.log(np.r_[base, base * small])
        start = np.array([0, 40, 80])
        hits = np.mean([len(set(neighbours.winners(start, comps, logs, r).tolist())) == 1 for r in range(3000)])
        assert abs(hits - small) < 0.04


def test_levels_grow_with_the_logarithm():
    few, many = neighbours.level(2_000, *neighbours.LEVELS[-1]), neighbours.level(200_000_000, *neighbours.LEVELS[-1])
    assert few.winners == 2 and many.winners <= 6 and many.arrays < 30 * few.arrays


def test_no_pair_near_the_radius_is_missed(spark):
    """Pairs alone at 0.348: windows hold about 99 % of them."""
    rows = []
    for i in range(2000):
        rows += [(f"a{i:04d}", 6 * i + c, 1000) for c in range(5)] + [(f"b{i:04d}", 6 * i + c, 652) for c in range(5)] + [(f"b{i:04d}", 6 * i + 5, 1740)]
    df = spark.createDataFrame(rows, "sample string, comp_no int, value long")
    got = {(r.sample, r.other, r.d) for r in neighbours.nearest(df, complete=False).collect()}
    pairs = [(f"a{i:04d}", f"b{i:04d}") for i in range(2000)]
    assert got == {(x, y, 0.348) for a, b in pairs for x, y in ((a, b), (b, a))}


@pytest.mark.parametrize("block", [50, 32_768])
def test_nearest_of_crowded_windows_come_before_others(spark, monkeypatch, block):
    """A query with k neighbours found still gets nearer ones of a window that was too full for pairs."""
    monkeypatch.setattr(neighbours, "GROUP", 3)
    monkeypatch.setattr(neighbours, "DATA_BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    random.seed(7)
    vecs = {}
    for g in range(60):
        base = {c: random.randint(20, 900) for c in random.sample(range(1, 400), 25)}
        for i in range(8):
            spread = (0.01, 0.01, 0.05, 0.05, 0.1, 0.1, 0.15, 0.3)[i]
            vecs[f"g{g:02d}_{i}"] = {c: max(1, int(v * random.uniform(1 - spread, 1 + spread))) for c, v in base.items()}
    for k in (1, 2):
        near = {(r.sample, r.other, r.d, r.rank) for r in neighbours.nearest(table(spark, vecs), k, complete=False).collect()}
        assert near == {(s, o, d, i + 1) for s, own in brute(vecs, k).items() for i, (d, o) in enumerate(own) if d <= 0.35}
