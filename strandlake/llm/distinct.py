"""Distinct counts over huge identifier sets, per day, group and combination of groups, by hash ranges."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash ranges into which identifiers fall; the unit in which counts are added up.
BITS = 10
GROUPS = (0, 1, 2)


def hash_range(*identifier: str) -> Column:
    """The identifier's hash range, 0 to 2^BITS - 1: the top bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(*identifier), 64 - BITS).cast("int")


def state(rows: DataFrame, day: str, group: str, identifier: list[str], kept: int = 1 << BITS, groups: tuple = GROUPS) -> DataFrame:
    """The mergeable state: one row per day, hash range and identifier with the groups it was seen in.

    Columns `day`, `bucket`, the identifier's, `mask` (bit i: seen in the i-th of `groups`, at most 63) and `rows_i` for each.
    A row of another group is an error. States of
    different loads or days merge with `merge`. With `kept` below 2^BITS only identifiers of the first `kept` ranges
    stay, which makes the state that much smaller and the counts estimates with the bound that `counts` gives.
    Rows with a null day, group or identifier are left out.
    """
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (day, group, *identifier)])
    rows = rows.where(full).withColumn("bucket", hash_range(*identifier))
    if kept < 1 << BITS:
        rows = rows.where(F.col("bucket") < kept)
    if not 1 <= len(groups) <= 63:
        raise ValueError("1 to 63 groups")
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group)) - 1
    place = F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("a group that is not counted: "), F.col(group).cast("string"))))
    rows = rows.withColumn("__place", place.cast("int"))
    seen = {f"rows_{i}": F.count_if(F.col("__place") == i) for i in range(len(groups))}
    return rows.groupBy(F.col(day).alias("day"), "bucket", *identifier).agg(
        F.bit_or(F.expr("shiftleft(1L, __place)")).alias("mask"), *[c.alias(n) for n, c in seen.items()]
    )


def merge(states: list[DataFrame], identifier: list[str], by_day: bool = True) -> DataFrame:
    """One state of several; `by_day=False` adds the days up: an identifier of two days counts once."""
    both = reduce(DataFrame.unionByName, states)
    keys = (["day"] if by_day else []) + ["bucket", *identifier]
    return both.groupBy(*keys).agg(
        F.bit_or("mask").alias("mask"), *[F.sum(c).alias(c) for c in both.columns if c.startswith("rows_")]
    )


def bucket_counts(s: DataFrame) -> DataFrame:
    """Exact counts inside each hash range: identifiers by the set of groups they were seen in.

    Ranges are disjoint, so these rows add up over ranges without error.
    """
    keys = [c for c in ("day", "bucket", "mask") if c in s.columns]
    return s.groupBy(*keys).agg(
        F.count("*").alias("ids"), *[F.sum(c).alias(c) for c in s.columns if c.startswith("rows_")]
    )


def counts(s: DataFrame, kept: int = 1 << BITS, groups: tuple = GROUPS) -> DataFrame:
    """Per day and combination of groups: `n_ids`, `n_rows` and `error_bound`.

    Only combinations of which every group has rows; there are 2^groups - 1 of them, so name the groups that matter. With all ranges kept the counts are exact and the bound is 0.
    With a part of them an identifier is kept with probability p = kept / 2^BITS, the count is scaled by 1 / p, and
    the bound is 3 standard deviations of that binomial share.
    """
    p = kept / (1 << BITS)
    places = range(len(groups))
    sets = [c for n in range(1, len(groups) + 1) for c in combinations(places, n)]
    named = F.array(
        *[F.struct(F.lit(sum(1 << g for g in c)).cast("long").alias("bits"), F.lit("+".join(str(groups[g]) for g in c)).alias("colors")) for c in sets]
    )
    rows = bucket_counts(s).select("*", F.explode(named).alias("c")).select("*", "c.bits", "c.colors")
    inside = {g: F.when(F.col("bits").bitwiseAND(F.lit(1 << g).cast("long")) > 0, F.col(f"rows_{g}")) for g in places}
    keys = [c for c in ("day", "colors", "bits") if c in rows.columns]
    out = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("mask")) > 0, F.col("ids")).otherwise(0)).alias("__ids"),
        *[F.sum(inside[g]).alias(f"__rows_{g}") for g in places],
    )
    there = reduce(lambda a, b: a & b, [~(F.col(f"__rows_{g}") <= 0) | F.col(f"__rows_{g}").isNull() for g in places])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__rows_{g}"), F.lit(0)) for g in places])
    bound = F.lit(0.0) if p == 1 else 3 * F.sqrt(F.col("__ids") * (1 - p)) / p
    return out.where(there).select(
        *[c for c in ("day", "colors") if c in keys],
        F.round(F.col("__ids") / p).cast("long").alias("n_ids"),
        F.round(total / p).cast("long").alias("n_rows"),
        bound.alias("error_bound"),
    )
