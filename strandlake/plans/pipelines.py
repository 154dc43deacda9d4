"""Pipelines: reads to distance matrix, and reads of two classes to features of their specific k-mers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import counts as C
from strandlake.operators import features as V
from strandlake.operators import graph as G
from strandlake.operators import stats as S
from strandlake.operators import walks
from strandlake.runtime import join_small, materialize, numbered


@dataclass
class Matrix:
    """What the distance pipeline makes: counts, sequences, components, features, distances, leaf order."""

    counts: DataFrame
    sequences: DataFrame
    components: DataFrame
    component_kmers: DataFrame
    features: DataFrame
    distances: DataFrame
    order: DataFrame


def distance_matrix(
    reads: DataFrame, k: int = 31, min_freq: int = 1, min_length: int = 100, least: int = 1000, most: int = 10000, from_reads: bool = False
) -> Matrix:
    """Reads (`sample`, `seq`) to Bray-Curtis distances of the samples.

    Count k-mers, join them to unbranched sequences per sample, cut the joint graph of the sequences of at least
    `min_length` letters into components, take their coverage in every sample (`from_reads`: from the unfiltered counts),
    compare the samples. Each table that is read more than once is written once.
    """
    every = materialize(C.kmer_counts(reads, k, 0))
    counts = every.where(F.col("freq") > min_freq)
    sequences = materialize(G.unitigs(counts, k, min_length, "sample"))
    shared = C.kmer_counts(sequences.select("sample", "seq"), k, 0, ())
    components, kmers = G.cut_components(shared, k, least, most)
    kmers = materialize(kmers)
    features = materialize(V.coverage(kmers, every if from_reads else counts))
    distances = materialize(V.bray_curtis(V.vectors(features)))
    return Matrix(counts, sequences, components, kmers, features, distances, V.leaf_order(distances))


@dataclass
class Specific:
    """What the class pipelines make: the selected k-mers, components around them, their features, their sequences."""

    selected: DataFrame
    component_kmers: DataFrame
    features: DataFrame
    sequences: DataFrame


def _around(selected: DataFrame, counts: DataFrame, k: int, depth: int) -> Specific:
    """Components grown around selected k-mers in the graph of all given counts, and their features in these samples."""
    graph = C.pooled(counts)
    kmers = materialize(walks.pivot_components(graph, selected, k, depth))
    features = V.coverage(kmers, counts, selected=selected)
    sequences = G.unitigs(kmers.select("comp_no", "kmer", F.lit(1).alias("freq")), k, k, "comp_no")
    return Specific(selected, kmers, features, sequences)


def unique_features(positive: DataFrame, negative: DataFrame, k: int = 31, min_freq: int = 1, min_samples: int = 1, depth: int = 1) -> Specific:
    """Features of the k-mers of at least `min_samples` positive samples that no negative sample has.

    `positive`, `negative`: count tables. The graph and the features are those of the positive samples; only unique
    k-mers count for coverage.
    """
    unique = C.unique_kmers(positive, negative, min_freq).where(F.col("n_samples") >= min_samples)
    selected = materialize(unique.select("kmer", "freq"))
    return _around(selected, positive.where(F.col("freq") > min_freq), k, depth)


def stats_features(
    counts: DataFrame, classes: DataFrame, k: int = 31, min_freq: int = 1, p_chi2: float = 0.05, p_mw: float = 0.05, depth: int = 1
) -> Specific:
    """Features of the k-mers that are significantly more frequent in class 0 than in class 1."""
    found = S.group_specific(counts, classes, (0, 1), p_chi2, p_mw, min_freq).where(F.col("group") == 0)
    selected = materialize(found.select("kmer", F.col("value").alias("freq")))
    positive = C.with_class(counts, classes).where("color = 0").drop("color").where(F.col("freq") > min_freq)
    return _around(selected, positive, k, depth)


def specific_features(counts: DataFrame, classes: DataFrame, min_freq: int = 1, min_samples: int = 2) -> DataFrame:
    """Rows of every sample whose k-mer is in `min_samples` samples of some class, with its support in each class."""
    sets = []
    for g in range(3):
        own = C.with_class(counts, classes).where(F.col("color") == g)
        sets.append(C.samples_per_kmer(own, min_freq).where(F.col("n_samples") >= min_samples))
    return C.in_any(C.multiple_filters(counts, sets, min_freq))


def colored_features(counts: DataFrame, classes: DataFrame, k: int = 31, min_freq: int = 1, share: float = 0.9) -> DataFrame:
    """(`sample`, `color`, `comp_no`, `value`, `breadth`): coverage of the components around each class's k-mers.

    Components are numbered per colour by their smallest k-mer.
    """
    colors = materialize(C.colored(counts, classes, min_freq))
    rows = materialize(G.colored_components(colors, k, share))
    # Components of all colours are one table with numbers of their own; a colour's numbers start at 1 again.
    names = materialize(numbered(rows.select("color", "label").distinct(), ["color", "label"], "no", 1))
    first = names.groupBy("color").agg(F.min("no").alias("first"))
    names = join_small(names, first, "color").select("color", "label", "no", (F.col("no") - F.col("first") + 1).cast("int").alias("comp_no"))
    kmers = rows.join(names, ["color", "label"]).select(F.col("no").alias("comp_no"), "kmer")
    found = V.coverage(kmers, counts).withColumnRenamed("comp_no", "no")
    return join_small(found, names, "no").select("sample", "color", "comp_no", "value", "breadth")


def supergraph(counts: DataFrame, k: int, min_freq: int | None = None, percent: int | None = None) -> DataFrame:
    """Sequences of the graph of all samples without branching k-mers, weighted by the number of samples.

    Per sample a k-mer counts if its frequency is above a threshold: `min_freq`, or the sample's bottom cut of `percent`,
    or, with neither, the first minimum of its histogram.
    """
    if min_freq is not None:
        rows = counts.where(F.col("freq") > min_freq)
    else:
        cut = C.first_minimum(counts, "sample") if percent is None else C.bottom_cut(counts, percent, "sample")
        rows = counts.join(cut, "sample").where(F.col("freq") > F.col("threshold"))
    support = materialize(rows.groupBy("kmer").agg(F.count_distinct("sample").alias("freq")))
    plain = support.join(G.branching(support, k), "kmer", "left_anti")
    return G.unitigs(materialize(plain), k, k)
