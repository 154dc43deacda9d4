"""Clusters of mutually near records by density peaks over blocked neighbour joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.llm import neighbours
from strandlake.runtime import materialize

RADIUS = neighbours.LEVELS[-1][0]


def table_edges(distances: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, d): near pairs of a distance table, both ways, of which not both names are in `known` (sample).

    A pair may stand in either orientation and several times; null distances and the diagonal are left out, of several
    distances the smallest holds.
    """
    rows = distances.where(f"dist <= {RADIUS} AND sample_i <> sample_j")
    rows = rows.groupBy(F.least("sample_i", "sample_j").alias("a"), F.greatest("sample_i", "sample_j").alias("b"))
    rows = rows.agg(F.min("dist").alias("d"))
    for side in "ab":
        own = known.select(F.col("sample").alias(side), F.lit(True).alias(f"in_{side}"))
        rows = rows.join(own, side, "left")
    rows = rows.where("in_a IS NULL OR in_b IS NULL").select("a", "b", "d")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def follow(pointers: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) with roots pointing at themselves: pointers double until all end at roots."""
    now = materialize(pointers.select("node", F.col("parent").alias("root")))
    while True:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")


def density_peaks(features: DataFrame, distances: DataFrame) -> DataFrame:
    """(`sample`, `root`, `density`): the peak that each sample belongs to and the records within the radius of it.

    The distance of two samples is that of their features where both have rows there, else that of `distances`. Samples
    with equal vectors are one node, weighted with their number. Density: records within RADIUS, the node's own included.
    The order of density (ties: the smaller name is denser) is total, so pointers to the nearest denser node have no
    cycle; a node without a denser one within RADIUS is a peak. Near pairs come from windows of bounded size; members of
    crowded windows are compared in blocks, once to count them and once for the nearest denser, which leaves one row per
    node and block, never the pairs of a group. Samples without any near record are peaks of their own.
    """
    vecs = neighbours.vectors(features)
    classes = neighbours.classes_of(vecs, 1)
    member = materialize(vecs.select("sample", "cls").join(classes.select("cls", "rep"), "cls").select("sample", F.col("rep").alias("node")))
    edges = table_edges(distances, features.where("sample IS NOT NULL").select("sample").distinct())
    for side in "ab":
        own = member.select(F.col("sample").alias(side), F.col("node").alias(f"node_{side}"))
        edges = edges.join(own, side, "left").withColumn(f"node_{side}", F.coalesce(f"node_{side}", side))
    edges = materialize(edges.groupBy("node_a", "node_b").agg(F.min("d").alias("d"), F.count_distinct("b").alias("n")))

    near, crowd = neighbours.near_pairs(classes, neighbours.level(classes.count(), *neighbours.LEVELS[-1]))
    near = neighbours.both_ways(near)
    for side in "ab":
        named = classes.select(F.col("id").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}"))
        near = near.join(named, side)
    near = materialize(near.select(F.col("rep_a").alias("node"), F.col("rep_b").alias("parent"), "n_b", "d"))
    alone = edges.select(F.col("node_a").alias("node")).distinct().join(member.select("node").distinct(), "node", "left_anti")
    parts = [
        classes.select(F.col("rep").alias("node"), "n"),
        near.select("node", F.col("n_b").alias("n")),
        edges.select(F.col("node_a").alias("node"), "n"),
        alone.select("node", F.lit(1).alias("n")),
    ]
    held = None
    if not crowd.isEmpty():
        held = classes.join(crowd, "id").withColumn("rank", F.lit(0.0))
        counted = neighbours.search(held, held, "density", radius=RADIUS)
        parts.append(counted.select(F.col("rep").alias("node"), F.col("d").alias("n")))
    parts = [p.select("node", F.col("n").cast("double").alias("n")) for p in parts]
    density = materialize(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("n").alias("density")))

    dense = {s: density.select(F.col("node").alias(s), F.col("density").alias(f"density_{s}")) for s in ("node", "parent")}
    up = near.join(dense["node"], "node").join(dense["parent"], "parent").where(
        "density_parent > density_node OR (density_parent = density_node AND parent < node)"
    ).select("node", "parent", "d")
    if held is not None:
        held = held.drop("rank").join(density.select(F.col("node").alias("rep"), F.col("density").alias("rank")), "rep")
        denser = neighbours.search(held, held, "denser", radius=RADIUS)
        up = up.unionByName(denser.select(F.col("rep").alias("node"), F.col("other").alias("parent"), "d"))
    side = {s: density.select(F.col("node").alias(f"node_{s}"), F.col("density").alias(f"density_{s}")) for s in "ab"}
    more = edges.join(side["a"], "node_a").join(side["b"], "node_b").where(
        "density_b > density_a OR (density_b = density_a AND node_b < node_a)"
    )
    up = up.unionByName(more.select(F.col("node_a").alias("node"), F.col("node_b").alias("parent"), "d"))
    best = up.groupBy("node").agg(F.min(F.struct("d", "parent")).alias("best"))
    pointers = density.join(best, "node", "left").select("node", F.coalesce("best.parent", "node").alias("parent"))
    roots = follow(pointers).join(density, "node")
    # Nodes are classes of equal vectors or single samples of the distance table.
    samples = member.unionByName(alone.select(F.col("node").alias("sample"), "node"))
    return samples.join(roots, "node").select("sample", "root", "density")


def clusters(peaks: DataFrame, least: int = 3) -> DataFrame:
    """(`cluster_key`, `sample`) of the clusters of at least `least` samples; the key is the smallest name."""
    named = peaks.groupBy("root").agg(F.min("sample").alias("cluster_key"), F.count("*").alias("size"))
    return peaks.join(named.where(F.col("size") >= least), "root").select("cluster_key", "sample", "density", "size")


def described(peaks: DataFrame, typical: int = 3) -> DataFrame:
    """One row per cluster: `cluster_key`, `size`, `typical` (its densest members, ties by name)."""
    rows = clusters(peaks)
    rank = F.row_number().over(W.partitionBy("cluster_key").orderBy(F.desc("density"), "sample"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= typical)
    return top.groupBy("cluster_key", "size").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rank", "sample"))), lambda x: x["sample"])).alias("typical")
    )
