import random
from itertools import combinations
from math import ceil, inf
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from strandlake.operators import stats as S


def chi2(present, sizes):
    have = [100 * n / s for n, s in zip(present, sizes)]
    lack = [100 * (s - n) / s for n, s in zip(present, sizes)]
    out = 0.0
    for side in (have, lack):
        e = sum(side) / len(side)
        for x in side:
            out += inf if e == 0 else (abs(x - e) - 0.5) ** 2 / e
    return out


def z_of(a, b):
    both = sorted(a + b)
    rank = {v: (both.index(v) + 1 + len(both) - both[::-1].index(v)) / 2 for v in both}
    u = sum(rank[v] for v in a) - len(a) * (len(a) + 1) / 2
    u = min(u, len(a) * len(b) - u)
    return (u - len(a) * len(b) / 2) / (len(a) * len(b) * (len(a) + len(b) + 1) / 12) ** 0.5


def data(spark, groups, per, seed):
    """K-mers planted in a group, in all, in few, at random."""
    random.seed(seed)
    rows, color = [], {}
    for g in range(groups):
        for i in range(per):
            s = f"g{g}s{i}"
            color[s] = g
            for k in range(40):
                if k < 10:
                    p = 0.95 if k % groups == g else 0.1
                else:
                    p = [1.0, 0.04, 0.5, 0.3][k % 4]
                if random.random() < p:
                    rows.append((s, k, random.randint(1, 9) + 5 * (k < 10)))
    df = spark.createDataFrame(rows, "sample string, kmer long, freq int")
    classes = spark.createDataFrame(list(color.items()) + [("other", None)], "sample string, color int")
    return rows, color, df, classes


def model(rows, color, groups, quantile, p_mw, values, common):
    sizes = [sum(c == g for c in color.values()) for g in range(groups)]
    n_all = sum(sizes)
    total = {}
    for s, _, f in rows:
        total[s] = total.get(s, 0) + f
    mean = sum(total.values()) / n_all
    mean = int(mean) if values == "whole" else mean
    out = set()
    for k in {r[1] for r in rows}:
        own = {s: f for s, k2, f in rows if k2 == k}
        present = [sum(color[s] == g for s in own) for g in range(groups)]
        n = sum(present)
        passed = chi2(present, sizes) > quantile
        if n <= ceil(0.05 * n_all) or (n == n_all and not common) or not (passed or (common and n == n_all)):
            continue
        vals = [[(own.get(s, 0) if values == "raw" else own.get(s, 0) * mean / total[s]) for s, c in color.items() if c == g] for g in range(groups)]
        limit = NormalDist().inv_cdf(p_mw / 2)
        zs = [z_of(vals[a], vals[b]) for a, b in combinations(range(groups), 2)]
        if not any(z <= limit if common else z < limit for z in zs):
            continue
        means = [round(sum(v) / len(v), 6) for v in vals]
        best = next((g for g in range(groups - 1) if all(means[g] > means[o] for o in range(groups) if o != g)), groups - 1)
        out.add((k, best, int(means[best])))
    return out


@pytest.mark.parametrize(
    "groups,df,values,common", [(2, 1, "total", False), (3, 2, "total", False), (2, 1, "raw", True), (3, 1, "whole", False)]
)
def test_group_specific(spark, groups, df, values, common):
    rows, color, counts, classes = data(spark, groups, 12, groups)
    want = model(rows, color, groups, S.chi2_quantile(0.05, df), 0.05, values, common)
    got = S.group_specific(counts, classes, tuple(range(groups)), df=df, values=values, keep_common=common)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3


def test_chi2_and_ranks(spark):
    rows, color, counts, classes = data(spark, 2, 12, 7)
    sizes = [12, 12]
    want = {}
    for k in {r[1] for r in rows}:
        present = [sum(color[s] == g for s, k2, _ in rows if k2 == k) for g in range(2)]
        if ceil(0.05 * 24) < sum(present) < 24:
            want[k] = round(chi2(present, sizes), 9)
    got = S.ranked(counts, classes).orderBy("rank").collect()
    assert [(r.kmer, r.rank) for r in got] == [(k, i) for i, k in enumerate(sorted(want, key=lambda k: (-want[k], k)))]
    assert all(r.chi2 == pytest.approx(want[r.kmer]) for r in got)
    assert S.subset(S.ranked(counts, classes), 3).count() == 3
    with pytest.raises(ValueError):
        S.subset(S.ranked(counts, classes), 1000)


def test_quantiles_and_empty_group(spark):
    assert S.chi2_quantile(0.05, 1) == pytest.approx(3.841458821)
    assert S.chi2_quantile(0.05, 2) == pytest.approx(5.991464547)
    _, _, counts, classes = data(spark, 2, 5, 1)
    assert S.group_specific(counts, classes.where("color = 0")).isEmpty()
    assert S.group_specific(counts.limit(0), classes).isEmpty()
    assert S.ranked(counts.where(F.lit(False)), classes).isEmpty()
