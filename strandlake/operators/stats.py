"""Tests that k-mers differ between classes of samples: chi-squared on presence, Mann-Whitney on frequencies.

All sums are conditional aggregates over the rows that exist; the zeros of samples without a k-mer enter the means and
ranks by their number, so no dense sample-by-k-mer table is ever built. The cheap presence test runs first, and only its
survivors' rows are joined back for ranks.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.counts import with_class
from strandlake.runtime import join_small, materialize, numbered

#: Digits to which statistics are rounded before they are compared or ranked, so that summation order can't matter.
DIGITS = 9


def chi2_quantile(p: float, df: int) -> float:
    """Upper quantile of the chi-squared distribution with 1 or 2 degrees of freedom, in closed form."""
    if df == 1:
        return NormalDist().inv_cdf(1 - p / 2) ** 2
    if df == 2:
        return -2 * log(p)
    raise ValueError("1 or 2 degrees of freedom")


def group_sizes(classed: DataFrame, groups: tuple[int, ...]) -> dict[int, int]:
    """Samples of each group that the count table holds: one row a group."""
    rows = classed.groupBy("color").agg(F.count_distinct("sample").alias("n")).collect()
    found = {r.color: r.n for r in rows}
    return {g: found.get(g, 0) for g in groups}


def chi2(present: list[Column], sizes: list[int], single: bool = False) -> Column:
    """Chi-squared statistic of presence in groups, on percentages and with a continuity correction of 0.5.

    Infinite where a cell's expectation is 0; null if a group has no samples. `single`: the percentages are cut to single
    precision, as some published results have them.
    """
    if not all(sizes):
        return F.lit(None).cast("double")
    cut = (lambda c: c.cast("float").cast("double")) if single else (lambda c: c)
    have = [cut(100 * n / F.lit(float(s))) for n, s in zip(present, sizes)]
    lack = [cut(100 * (F.lit(s) - n) / F.lit(float(s))) for n, s in zip(present, sizes)]
    out = F.lit(0.0)
    for side in (have, lack):
        expected = sum(side[1:], side[0]) / F.lit(float(len(side)))
        for x in side:
            cell = F.pow(F.abs(x - expected) - 0.5, F.lit(2.0))
            out = out + F.when(expected == 0, F.lit(float("inf"))).otherwise(cell / F.when(expected != 0, expected))
    return F.round(out, DIGITS)


def presence(classed: DataFrame, groups: tuple[int, ...], sizes: dict[int, int], min_freq: int = 0, single: bool = False) -> DataFrame:
    """(`kmer`, `n_g` for each group, `n`, `chi2`) of the k-mers above `min_freq` anywhere in the groups."""
    rows = classed.where((F.col("freq") > min_freq) & F.col("color").isin(*groups))
    rows = rows.groupBy("kmer").agg(*[F.count_if(F.col("color") == g).alias(f"n_{g}") for g in groups])
    rows = rows.withColumn("n", sum((F.col(f"n_{g}") for g in groups[1:]), F.col(f"n_{groups[0]}")))
    return rows.withColumn("chi2", chi2([F.col(f"n_{g}") for g in groups], [sizes[g] for g in groups], single))


def informative(found: DataFrame, total: int) -> DataFrame:
    """Without the k-mers of at most 5 % of the samples (rounded up) and those of all samples."""
    return found.where((F.col("n") > ceil(0.05 * total)) & (F.col("n") < total))


def normalised(classed: DataFrame, groups: tuple[int, ...], whole_mean: bool = False) -> DataFrame:
    """`value`: the frequency times the mean total of the samples over the sample's own total.

    A total is the sum of a sample's frequencies; with `whole_mean` the mean is cut to a whole number.
    """
    rows = classed.where(F.col("color").isin(*groups))
    totals = rows.groupBy("sample").agg(F.sum("freq").alias("total"))
    n, every = totals.agg(F.count("*"), F.sum("total")).first()
    mean = (every or 0) / max(n, 1)
    mean = float(int(mean)) if whole_mean else mean
    return join_small(rows, totals, "sample").withColumn("value", F.col("freq") * F.lit(mean) / F.col("total")).drop("total")


def mann_whitney(rows: DataFrame, pairs: list[tuple[int, int]], sizes: dict[int, int]) -> DataFrame:
    """(`kmer`, `z_a_b` for each pair of groups): z of the two-sided test, always at most 0.

    `rows` has (`kmer`, `color`, `value`) of the samples with the k-mer; those without have the value 0. Ranks of ties
    are averaged; no correction for ties or continuity. One sorted pass over the distinct values of each k-mer serves
    all pairs: a value's rank in a pair follows from how many of either group lie below it.
    """
    groups = sorted({g for p in pairs for g in p})
    count = {g: F.count_if(F.col("color") == g).alias(f"__n_{g}") for g in groups}
    own = rows.where(F.col("color").isin(*groups)).groupBy("kmer", F.round("value", DIGITS).alias("value")).agg(*count.values())
    below = W.partitionBy("kmer").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({f"__b_{g}": F.coalesce(F.sum(f"__n_{g}").over(below), F.lit(0)) for g in groups})
    sums = []
    for a, b in pairs:
        rank = F.col(f"__b_{a}") + F.col(f"__b_{b}") + (F.col(f"__n_{a}") + F.col(f"__n_{b}") + 1) / 2
        sums.append(F.sum(F.when(F.col(f"__n_{a}") > 0, F.col(f"__n_{a}") * rank).otherwise(0.0)).alias(f"__r_{a}_{b}"))
    own = own.groupBy("kmer").agg(*[F.sum(f"__n_{g}").alias(f"__n_{g}") for g in groups], *sums)
    out = []
    for a, b in pairs:
        na, nb = sizes[a], sizes[b]
        there = F.col(f"__n_{a}")
        zeros = F.lit(na + nb) - there - F.col(f"__n_{b}")
        # Absent samples share the lowest ranks. A k-mer that neither group has: all values tie.
        ranks = F.col(f"__r_{a}_{b}") + there * zeros + (F.lit(na) - there) * (zeros + 1) / 2
        u = ranks - na * (na + 1) / 2
        low = F.least(u, F.lit(float(na * nb)) - u)
        deviation = (na * nb * (na + nb + 1) / 12) ** 0.5
        z = F.round((low - na * nb / 2) / deviation, DIGITS) if deviation else F.lit(0.0)
        out.append(F.when(there + F.col(f"__n_{b}") > 0, z).otherwise(0.0).alias(f"z_{a}_{b}"))
    return own.select("kmer", *out)


def means(rows: DataFrame, groups: tuple[int, ...], sizes: dict[int, int]) -> DataFrame:
    """Mean value of each group, samples without the k-mer counting 0."""
    each = [F.sum(F.when(F.col("color") == g, F.col("value")).otherwise(0.0)) / max(sizes[g], 1) for g in groups]
    return rows.groupBy("kmer").agg(*[F.round(m, 6).alias(f"mean_{g}") for g, m in zip(groups, each)])


def assigned(groups: tuple[int, ...]) -> tuple[Column, Column]:
    """The group of the strictly largest mean, else the last; and that group's mean, cut to a whole number."""
    group = F.lit(groups[-1])
    for g in reversed(groups[:-1]):
        larger = [F.col(f"mean_{g}") > F.col(f"mean_{o}") for o in groups if o != g]
        test = larger[0]
        for x in larger[1:]:
            test = test & x
        group = F.when(test, F.lit(g)).otherwise(group)
    value = F.lit(None).cast("double")
    for g in groups:
        value = F.when(group == g, F.col(f"mean_{g}")).otherwise(value)
    return group.alias("group"), F.floor(value).cast("int").alias("value")


def group_specific(
    counts: DataFrame,
    classes: DataFrame,
    groups: tuple[int, ...] = (0, 1),
    p_chi2: float = 0.05,
    p_mw: float = 0.05,
    min_freq: int = 0,
    df: int | None = None,
    values: str = "total",
    keep_common: bool = False,
    single: bool = False,
) -> DataFrame:
    """(`kmer`, `group`, `value`): k-mers that differ between groups of samples, with the group they belong to.

    A k-mer stays if it is neither scarce nor in all samples, its chi-squared statistic is above the quantile of `df`
    degrees of freedom (default: groups - 1) and, unless `p_mw` is 0, for some pair of groups the Mann-Whitney p is below
    `p_mw`. `values`: what the ranks and means are of: `raw` frequencies, normalised by the sample's `total` frequency, or
    `whole`, the same with the mean total cut to a whole number. `keep_common`: k-mers of all samples pass the first test, and
    p equal to `p_mw` passes too. `single`: as in `chi2`. Means are rounded to 6 digits, then cut.
    """
    # Read for the sizes, the totals, the presence test and the ranks: written once.
    classed = materialize(with_class(counts, classes).where(F.col("color").isin(*groups)).select("sample", "kmer", "color", "freq"))
    sizes = group_sizes(classed, groups)
    total = sum(sizes.values())
    quantile = chi2_quantile(p_chi2, len(groups) - 1 if df is None else df)
    found = presence(classed, groups, sizes, min_freq, single)
    passed = F.col("chi2") > quantile
    if keep_common:
        found = found.where((F.col("n") > ceil(0.05 * total)) & (passed | (F.col("n") == total)))
    else:
        found = informative(found, total).where(passed)
    if values == "raw":
        rows = classed.where(F.col("color").isin(*groups)).withColumn("value", F.col("freq").cast("double"))
    else:
        rows = normalised(classed, groups, values == "whole")
    rows = materialize(rows.join(found.select("kmer"), "kmer", "left_semi").select("kmer", "color", "value"))
    out = means(rows, groups, sizes)
    if p_mw > 0:
        pairs = list(combinations(groups, 2))
        limit = NormalDist().inv_cdf(p_mw / 2)
        z = F.least(*[F.col(f"z_{a}_{b}") for a, b in pairs]) if len(pairs) > 1 else F.col("z_%d_%d" % pairs[0])
        tested = mann_whitney(rows, pairs, sizes).where(z <= limit if keep_common else z < limit)
        out = out.join(tested.select("kmer"), "kmer", "left_semi")
    return out.select("kmer", *assigned(groups))


def ranked(counts: DataFrame, classes: DataFrame, groups: tuple[int, ...] = (0, 1), min_freq: int = 0) -> DataFrame:
    """(`kmer`, `chi2`, `rank`): all informative k-mers by descending statistic, ties by k-mer; `rank` from 0.

    One range sort with offsets per part; no single task orders all rows.
    """
    classed = with_class(counts, classes)
    sizes = group_sizes(classed, groups)
    found = informative(presence(classed, groups, sizes, min_freq), sum(sizes.values()))
    found = found.select("kmer", "chi2", (-F.col("chi2")).alias("__down"))
    return numbered(found, ["__down", "kmer"], "rank").drop("__down")


def subset(ranks: DataFrame, n: int) -> DataFrame:
    """The n first k-mers by rank; an error if there are fewer."""
    have = ranks.count()
    if n > have:
        raise ValueError(f"{n} k-mers wanted of {have}")
    return ranks.where(F.col("rank") < n)
