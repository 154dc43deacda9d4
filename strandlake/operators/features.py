"""Feature vectors of components, Bray-Curtis distances, average-linkage order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import materialize

#: Samples of a distance matrix that are clustered on the driver at most: the matrix is the bound, 8 bytes a cell.
CLUSTERED = 5_000


def coverage(component_kmers: DataFrame, counts: DataFrame, min_freq: int = 0, selected: DataFrame | None = None) -> DataFrame:
    """(`sample`, `comp_no`, `value`, `breadth`): summed frequency of a component's k-mers in a sample, share of them found.

    `component_kmers` (`comp_no`, `kmer`): a k-mer that stands several times in a component counts as often, one of
    several components in each. Only k-mers with a frequency above `min_freq` are found. `selected` (`kmer`) restricts
    which k-mers may be found. Pairs without a found k-mer are absent: value and breadth 0. Null k-mers are left out.
    """
    parts = component_kmers.where("kmer IS NOT NULL AND comp_no IS NOT NULL").groupBy("comp_no", "kmer").agg(F.count("*").alias("times"))
    sizes = parts.groupBy("comp_no").agg(F.sum("times").alias("size"))
    rows = counts.where(F.col("freq") > min_freq).select("sample", "kmer", "freq")
    if selected is not None:
        parts = parts.join(selected.select("kmer").distinct(), "kmer", "left_semi")
    found = rows.join(parts, "kmer").groupBy("sample", "comp_no").agg(
        F.sum(F.col("freq").cast("long") * F.col("times")).alias("value"), F.sum("times").alias("found")
    )
    return found.join(sizes, "comp_no").select("sample", "comp_no", "value", (F.col("found") / F.col("size")).alias("breadth"))


def dense(features: DataFrame, components: DataFrame, samples: DataFrame) -> DataFrame:
    """The same with a row for every sample and component; the dense matrix is the result asked for."""
    every = samples.select("sample").distinct().crossJoin(components.select("comp_no").distinct())
    return every.join(features, ["sample", "comp_no"], "left").fillna(0, ["value"]).fillna(0.0, ["breadth"])


def vectors(features: DataFrame) -> DataFrame:
    """Rows of a feature table as (`sample`, `comp_no`, `value`) without zeros; delivered rows count once."""
    rows = features.where("sample IS NOT NULL AND comp_no IS NOT NULL AND value IS NOT NULL AND value <> 0")
    return rows.groupBy("sample", "comp_no").agg(F.max("value").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, sample, comp_no, value) sorted by block and sample: one row a block with its entries as arrays."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([t["block"][0].as_py()], pa.int64()), *(pa.array([t[c].to_pylist()], pa.list_(t[c].type)) for c in t.column_names[1:])], t.column_names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(block)]):
            if held and held[0].column(0)[0].as_py() != block[a]:
                yield done(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield done(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks (i, samples, comps, values, j, samples, comps, values): distances of all pairs of their samples."""

    def side(batch: pa.RecordBatch, row: int, first: int):
        names, comps, values = (batch.column(first + c)[row].values for c in range(3))
        names = names.dictionary_encode()
        return names.dictionary, names.indices.to_numpy(), comps.to_numpy(), values.to_numpy()

    for batch in batches:
        for r in range(batch.num_rows):
            a, b = side(batch, r, 1), side(batch, r, 5)
            shared = np.zeros((len(a[0]), len(b[0])), a[3].dtype)
            order = [np.argsort(x[2], kind="stable") for x in (a, b)]
            known = np.intersect1d(a[2], b[2])
            ends = [[np.searchsorted(x[2][o], known, s) for s in ("left", "right")] for x, o in zip((a, b), order)]
            for c in range(len(known)):
                x, y = (o[lo[c] : hi[c]] for o, (lo, hi) in zip(order, ends))
                # A sample has a component once, so no cell is met twice here.
                shared[np.ix_(a[1][x], b[1][y])] += np.minimum.outer(a[3][x], b[3][y])
            total = [np.bincount(x[1], x[3], len(x[0])) for x in (a, b)]
            both = total[0][:, None] + total[1]
            i, j = np.nonzero(np.triu(np.ones(both.shape, bool), 1)) if batch.column(0)[r] == batch.column(4)[r] else np.indices(both.shape).reshape(2, -1)
            one, two = a[0].take(pa.array(i)).cast(pa.string()), b[0].take(pa.array(j)).cast(pa.string())
            swap = pc.greater(one, two)
            far = (both[i, j] - 2 * shared[i, j]) / both[i, j]
            yield pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(far)], ["sample_i", "sample_j", "dist"])


#: Samples of a block of the distance matrix.
BLOCK = 256


def bray_curtis(vecs: DataFrame) -> DataFrame:
    """(`sample_i`, `sample_j`, `dist`) for i < j: sum |a-b| / sum (|a|+|b|) over all components.

    The full matrix is the result; it is computed in pairs of blocks of samples, each pair in one task, which gets the
    entries of 2 x BLOCK samples and makes at most BLOCK^2 rows. With sum min(a, b) over the components that both have the
    distance is 1 - 2 * common / (total a + total b). Values are not negative. Samples with only zeros have no row.
    """
    n = vecs.select("sample").distinct().count()
    count = max(1, -(-n // BLOCK))
    # A block by the sample's hash: about BLOCK samples each, without a sort.
    rows = vecs.select(F.pmod(F.xxhash64("sample"), F.lit(count)).alias("block"), "sample", "comp_no", "value")
    kind = dict(rows.dtypes)
    rows = rows.repartition("block").sortWithinPartitions("block", "sample")
    schema = f"block long, sample array<string>, comp_no array<{kind['comp_no']}>, value array<{kind['value']}>"
    packed = materialize(rows.mapInArrow(_blocks, schema))
    left = packed.toDF("i", "sample_a", "comp_a", "value_a").withColumn("j", F.explode(F.expr(f"sequence(i, {count - 1}L)")))
    both = left.join(packed.toDF("j", "sample_b", "comp_b", "value_b"), "j")
    parts = max(1, min(count * (count + 1) // 2, 4096))
    both = both.repartition(parts, "i", "j").select("i", "sample_a", "comp_a", "value_a", "j", "sample_b", "comp_b", "value_b")
    return both.mapInArrow(_compare, "sample_i string, sample_j string, dist double")


def symmetric(distances: DataFrame, samples: DataFrame) -> DataFrame:
    """Both orientations and a diagonal of zeros."""
    other = distances.select(F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "dist")
    own = samples.select(F.col("sample").alias("sample_i"), F.col("sample").alias("sample_j"), F.lit(0.0).alias("dist"))
    return distances.unionByName(other).unionByName(own)


def clean_distances(rows: DataFrame) -> DataFrame:
    """(`study`, `sample_i` < `sample_j`, `dist`) of a table with pairs in either orientation, several times or null."""
    pairs = rows.where("dist IS NOT NULL AND sample_i <> sample_j")
    return pairs.groupBy(
        "study", F.least("sample_i", "sample_j").alias("sample_i"), F.greatest("sample_i", "sample_j").alias("sample_j")
    ).agg(F.min("dist").alias("dist"))


@dataclass
class Merge:
    """A join of two clusters (their numbers; a leaf is its own, later ones count on) at a height."""

    left: int
    right: int
    height: float
    size: int


def average_linkage(d: np.ndarray, method: str = "average") -> tuple[list[Merge], list[int]]:
    """Merges and leaf order of a distance matrix under average linkage, or with `method="ward"` by least variance.

    The nearest pair of clusters joins first, ties at the smallest (i, j) by place; a joined cluster takes the smaller
    place. Leaf order is left before right. Each row keeps its nearest cluster, so a step costs n, not n^2.
    """
    n = len(d)
    if n == 0:
        return [], []
    dist = d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    dist[np.tril_indices(n)] = np.inf
    size, label, alive = np.ones(n, int), list(range(n)), np.ones(n, bool)
    children: dict[int, tuple[int, int]] = {}
    merges: list[Merge] = []
    full = d.astype(float).copy()
    best = dist.min(axis=1) if n > 1 else np.full(n, np.inf)
    for step in range(n - 1):
        i = int(np.argmin(best))
        j = int(np.argmin(dist[i]))
        merges.append(Merge(label[i], label[j], float(dist[i, j]), int(size[i] + size[j])))
        children[n + step] = (label[i], label[j])
        if method == "ward":
            rest = size * full[i, j] ** 2
            row = np.sqrt(np.maximum(0, (size[i] + size) * full[i] ** 2 + (size[j] + size) * full[j] ** 2 - rest) / (size[i] + size[j] + size))
        else:
            row = (size[i] * full[i] + size[j] * full[j]) / (size[i] + size[j])
        full[i], full[:, i] = row, row
        size[i] += size[j]
        label[i] = n + step
        alive[j] = False
        dist[j], dist[:, j] = np.inf, np.inf
        later = alive.copy()
        later[: i + 1] = False
        dist[i] = np.where(later, row, np.inf)
        earlier = np.flatnonzero(alive[:i])
        dist[earlier, i] = row[earlier]
        best = dist.min(axis=1)
    order, stack = [], [label[int(np.flatnonzero(alive)[0])]]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            left, right = children[node]
            stack += [right, left]
    return merges, order


def leaf_order(distances: DataFrame, key: str | None = None, method: str = "average") -> DataFrame:
    """(`key`, `sample`, `perm`): leaf order of each matrix (`sample_i`, `sample_j`, `dist`) under the given linkage.

    One task a matrix; a matrix of more than CLUSTERED samples is refused, as n^2 cells must fit in one task. Pairs
    without a distance count as 1. Samples are placed by name before clustering.
    """
    import pandas as pd

    df = distances if key else distances.withColumn("__key", F.lit(0))
    name = key or "__key"
    kind = dict(df.dtypes)[name]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*part.sample_i, *part.sample_j})
        if len(names) > CLUSTERED:
            raise ValueError(f"{len(names)} samples in one matrix; at most {CLUSTERED}")
        place = {s: i for i, s in enumerate(names)}
        d = np.ones((len(names), len(names)))
        np.fill_diagonal(d, 0)
        i, j = part.sample_i.map(place).to_numpy(), part.sample_j.map(place).to_numpy()
        d[i, j] = d[j, i] = part.dist.to_numpy()
        _, order = average_linkage(d, method)
        return pd.DataFrame({name: part[name].iloc[0], "sample": [names[x] for x in order], "perm": range(len(names))})

    out = df.select(name, "sample_i", "sample_j", "dist").groupBy(name).applyInPandas(work, f"`{name}` {kind}, sample string, perm int")
    return out if key else out.drop(name)
