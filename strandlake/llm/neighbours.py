"""Most similar vectors of every vector in Bray-Curtis distance, by collision counting over sorted arrays of hashes.

Vectors are sparse and non-negative. A projection is a weighted minimum: the component (and the step of its value) that
wins an exponential race in which it starts with its value. Two vectors at a distance d have the same winner with
probability (1 - d) / (1 + d), whatever their totals. An array holds the vectors by several such winners in a row; a
query's window in it are the vectors with the same first winners. Windows are widened from one radius to the next by
comparing fewer winners in more arrays (virtual rehashing), only for queries that lack neighbours; pairs that lie in each
other's windows often enough are verified exactly. The more vectors, the more winners are compared, so that windows hold
about as many unrelated vectors whatever their number. Windows may miss a pair, so what they find of a query only bounds how
far its neighbours can be; an exact search in blocks within that reach gives them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.llm import groups
from strandlake.llm.repetition import BASE, mix
from strandlake.runtime import materialize

#: (radius, winners compared beyond those of the widest windows, probability to miss a pair at the radius).
LEVELS = ((0.1, 1, 1e-5), (0.35, 0, 1e-2))
#: Collisions that make a candidate, and the probability at which unrelated vectors are taken to have the same winner.
COLLISIONS, UNRELATED = 2, 0.04
#: Vectors of a window from which on it is searched in blocks instead of by its pairs.
GROUP = 128
#: Rows and entries of a block that is searched.
DATA_BLOCK, QUERY_BLOCK, BLOCK_ENTRIES = 32_768, 8_192, 2_000_000


@dataclass(frozen=True)
class Level:
    """Winners that are compared and arrays, for one radius among so many vectors."""

    radius: float
    winners: int
    arrays: int


def level(n: int, radius: float, extra: int, miss: float) -> Level:
    """As many winners as keep about one unrelated vector in a window, and as many arrays as the probability to miss a pair
    at the radius (fewer than COLLISIONS common windows) asks for."""
    winners = max(2, round(log(max(2, n)) / log(1 / UNRELATED))) + extra
    p = ((1 - radius) / (1 + radius)) ** winners
    arrays = COLLISIONS
    while sum(comb(arrays, i) * p**i * (1 - p) ** (arrays - i) for i in range(COLLISIONS)) > miss:
        arrays += 1
    return Level(radius, winners, arrays)


def vectors(features: DataFrame) -> DataFrame:
    """One row per sample: `sample`, `total`, `v` (sorted array of (comp_no, value)), `cls` (equal for equal vectors).

    Rows delivered again count once, null values are 0, of two values of one component the larger holds. Values may have
    fractions; negative, infinite and undefined ones are left out. Vectors of zeros only and null names are left out.
    """
    value = F.col("value").cast("double")
    f = features.where(F.col("sample").isNotNull() & F.col("comp_no").isNotNull() & (value > 0) & ~F.isnan(value) & (value < float("inf")))
    f = f.groupBy("sample", F.col("comp_no").cast("long").alias("comp_no")).agg(F.max(value).alias("value"))
    f = f.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("comp_no", "value"))).alias("v"))
    # Summed in the order of the components, so that equal vectors have equal totals.
    total = F.aggregate("v", F.lit(0.0), lambda so_far, x: so_far + x["value"])
    return materialize(f.withColumns({"total": total, "cls": F.md5(F.to_json("v"))}))


def classes_of(vecs: DataFrame, names: int) -> DataFrame:
    """One row per distinct vector: `id`, `rep` (smallest name), `names` (the smallest so many), `n` (vectors alike),
    `total`, `v`."""
    first = F.row_number().over(W.partitionBy("cls").orderBy("sample"))
    some = vecs.select("cls", "sample").withColumn("__r", first).where(F.col("__r") <= names).groupBy("cls")
    some = some.agg(F.sort_array(F.collect_list("sample")).alias("names"))
    one = vecs.groupBy("cls").agg(
        F.min("sample").alias("rep"), F.count("*").alias("n"), F.min_by("v", "sample").alias("v"), F.first("total").alias("total")
    )
    return materialize(one.join(some, "cls").withColumn("id", F.monotonically_increasing_id()))


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the vectors of a column, and components and values of all their entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = column.offsets.to_numpy().astype(np.int64)
    items = column.values.slice(start[0], start[-1] - start[0])
    comps, values = (items.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return start - start[0], comps.astype(np.int64), values.astype(np.float64)


def uniform(comps: np.ndarray, race: int, draw: int) -> np.ndarray:
    """Numbers in (0, 1) of components in a race, the same in every task."""
    salt = np.uint64((race * 8 + draw + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return ((mix(mix(comps.astype(np.uint64) * BASE) ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def winners(start: np.ndarray, comps: np.ndarray, logs: np.ndarray, race: int) -> np.ndarray:
    """The winner of each vector in a race, as a number: a consistent weighted sample of its entries."""
    known, back = np.unique(comps, return_inverse=True)
    u = [uniform(known, race, i) for i in range(5)]
    rate = -np.log(u[0] * u[1])
    late = np.log(-np.log(u[2] * u[3])) - rate
    step = np.floor(logs / rate[back] + u[4][back])
    time = late[back] - rate[back] * (step - u[4][back])
    best = np.minimum.reduceat(time, start[:-1])
    hit = np.flatnonzero(time == np.repeat(best, np.diff(start)))
    first = hit[np.searchsorted(hit, start[:-1])]
    return mix(comps[first].astype(np.uint64) * BASE ^ mix(step[first].astype(np.int64).astype(np.uint64) + np.uint64(race)))


def _windows(own: Level, hot: np.ndarray):
    """Keys of the windows of vectors (id, v): one for each array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start, comps, values = entries(batch.column(1))
            logs, unit, keys = np.log(values), batch.column(0).to_numpy(), []
            for array in range(own.arrays):
                key = np.full(batch.num_rows, array + 1, np.uint64)
                for i in range(own.winners):
                    # Arrays have the same races at every radius: a wider window holds the narrower one.
                    key = mix(key * BASE ^ winners(start, comps, logs, 64 * array + i))
                keys.append(key)
            yield groups.key_rows(np.concatenate(keys), np.tile(unit, own.arrays), hot)

    return work


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bray-Curtis distances of pairs (a, b, total_a, total_b, v_a, v_b)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts = [entries(batch.column(i)) for i in (4, 5)]
        row = np.concatenate([np.repeat(np.arange(n), np.diff(start)) for start, _, _ in parts])
        comp, value = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((comp, row))
        row, comp, value = row[order], comp[order], value[order]
        both = np.flatnonzero((row[1:] == row[:-1]) & (comp[1:] == comp[:-1]))
        shared = np.bincount(row[both], np.minimum(value[both], value[both + 1]), n)
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((total - 2 * shared) / total)], ["a", "b", "d"])


def near_pairs(classes: DataFrame, own: Level, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of vectors (`a` < `b`, `d`) within the level's radius, and the vectors (`id`) of crowded windows.

    With `asked` (id) only pairs of which one side is among these. Pairs of which both sides stand in crowded windows are
    left to `search` in blocks: a group of any size costs each of its members one row an array here.
    """
    found = groups.together(classes.select("id", "v"), partial(_windows, own), GROUP)
    crowd = materialize(found.where("b IS NULL").select(F.col("a").alias("id")).distinct())
    pairs = found.where("b IS NOT NULL")
    if asked is not None:
        for side in "ab":
            pairs = pairs.join(asked.select(F.col("id").alias(side), F.lit(True).alias(f"asked_{side}")), side, "left")
        pairs = pairs.where("asked_a OR asked_b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COLLISIONS).select("a", "b")
    if not crowd.isEmpty():
        for side in "ab":
            pairs = pairs.join(crowd.select(F.col("id").alias(side), F.lit(True).alias(f"crowd_{side}")), side, "left")
        pairs = pairs.where("crowd_a IS NULL OR crowd_b IS NULL").select("a", "b")
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("total").alias(f"total_{side}"), F.col("v").alias(f"v_{side}")), side)
    pairs = pairs.select("a", "b", "total_a", "total_b", "v_a", "v_b").mapInArrow(_distances, "a long, b long, d double")
    return materialize(pairs.where(F.col("d") <= own.radius)), crowd


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


@dataclass
class Block:
    """Vectors of one block in the order of their names, in compressed sparse rows."""

    names: np.ndarray
    n: np.ndarray
    total: np.ndarray
    rank: np.ndarray
    start: np.ndarray
    comps: np.ndarray
    values: np.ndarray

    def listed(self) -> None:
        """Lists of the rows of each component, for a block that is searched."""
        self.known, self.local = np.unique(self.comps, return_inverse=True)
        local, order = self.local, np.argsort(self.local, kind="stable")
        self.row = np.repeat(np.arange(len(self.total)), np.diff(self.start))[order]
        self.edge, self.value = np.searchsorted(local[order], np.arange(len(self.known) + 1)), self.values[order]
        self.wanted = np.zeros(len(self.known))

    def distances(self, queries: Block, q: int) -> np.ndarray:
        """Bray-Curtis distances of all rows to a row of `queries`, over the lists of its components."""
        part = slice(queries.start[q], queries.start[q + 1])
        shared = np.zeros(len(self.total))
        for c, at, w in zip(queries.comps[part], np.searchsorted(self.known, queries.comps[part]), queries.values[part]):
            if at < len(self.known) and self.known[at] == c:
                own = slice(self.edge[at], self.edge[at + 1])
                shared[self.row[own]] += np.minimum(self.value[own], w)
        both = queries.total[q] + self.total
        return (both - 2 * shared) / both

    def within(self, queries: Block, q: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """All rows within `reach` of a row of `queries`, perhaps with some beyond it, and their distances.

        Within it two vectors share at least (1 - reach) / (1 + reach) of the larger total. Lists of the query's components
        are added up, the shortest first, until what is left is half of that: the other half must be in these.
        """
        part = slice(queries.start[q], queries.start[q + 1])
        comps, weights, total = queries.comps[part], queries.values[part], queries.total[q]
        at = np.minimum(np.searchsorted(self.known, comps), len(self.known) - 1)
        there = self.known[at] == comps
        at, weights = at[there], weights[there]
        least = (1 - reach) / (1 + reach) * (1 - 1e-9)
        size = self.edge[at + 1] - self.edge[at]
        order = np.argsort(size, kind="stable")
        left = np.cumsum(weights[order][::-1])[::-1]
        ahead = order[left >= least * total / 2]
        rest = left[len(ahead)] if len(ahead) < len(left) else 0.0
        if not len(ahead):
            return np.empty(0, np.int64), np.empty(0)
        lists = [slice(self.edge[a], self.edge[a + 1]) for a in at[ahead]]
        row = np.concatenate([self.row[x] for x in lists])
        both = np.minimum(np.concatenate([self.value[x] for x in lists]), np.repeat(weights[ahead], size[ahead]))
        if 8 * len(row) < len(self.total):
            near, place = np.unique(row, return_inverse=True)
            shared = np.bincount(place, both, len(near))
        else:
            shared = np.bincount(row, both, len(self.total))
            near = np.flatnonzero(shared)
            shared = shared[near]
        near = near[shared + rest >= least * np.maximum(self.total[near], total)]
        # Exactly, in the order of the components, over the rows that are left.
        n = self.start[near + 1] - self.start[near]
        own = np.repeat(np.arange(len(near)), n)
        entry = np.arange(len(own)) + np.repeat(self.start[near] - (np.cumsum(n) - n), n)
        self.wanted[at] = weights
        shared = np.bincount(own, np.minimum(self.values[entry], self.wanted[self.local[entry]]), len(near))
        self.wanted[at] = 0
        both = total + self.total[near]
        return near, (both - 2 * shared) / both


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rep, n, total, rank, v) sorted by block and name: one row per block with its Block."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        total = part["total"].to_numpy()
        names = np.array(part["rep"].to_pylist(), object)
        packed = Block(names, part["n"].to_numpy(), total, part["rank"].to_numpy(), *entries(part["v"]))
        columns = [pa.array([part["block"][0].as_py()], pa.int64()), pa.array([float(total.min())]), pa.array([float(total.max())])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(packed, 5)], pa.binary())], ["block", "low", "high", "packed"])

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


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of vectors (id, rep, n, total, rank, v) with similar totals: at most about `most` rows and BLOCK_ENTRIES
    entries, so a block's memory is bounded whatever the vectors."""
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("entries")).first()
    count = max(1, -(-sums.n // most), -(-(sums.entries or 0) // BLOCK_ENTRIES))
    # As many sorted parts as there may be cuts, each cut into blocks by itself.
    parts = max(1, min(count, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-count // parts)
    spot = F.pmod(F.xxhash64("rep"), F.lit(each)) if each > 1 else F.lit(0)
    rows = rows.repartitionByRange(parts, "total", "id") if parts > 1 else rows.coalesce(1)
    rows = rows.withColumn("block", F.spark_partition_id().cast("long") * each + spot)
    rows = rows.select("block", "rep", "n", "total", "rank", "v").sortWithinPartitions("block", "rep")
    return materialize(rows.mapInArrow(_pack, "block long, low double, high double, packed binary"))


def _search(kind: str, k: int, radius: float | None):
    """What a task makes of a pair of blocks: `nearest` (k per query), `density` or `denser` (the nearest denser row), or
    `reached` (k per query, whose rank says how far they can be)."""
    schema = pa.schema([("rep", pa.string()), ("other", pa.string()), ("d", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column(0), batch.column(1)):
                queries, data = pickle.loads(q.as_py()), pickle.loads(d.as_py())
                data.listed()
                yield pa.RecordBatch.from_pylist(list(found(queries, data)), schema)

    def found(queries: Block, data: Block) -> Iterator[dict]:
        for q, name in enumerate(queries.names):
            if kind == "reached":
                near, far = data.within(queries, q, queries.rank[q])
                fit = (far <= radius) & (data.names[near] != name)
                near, far = near[fit], far[fit]
                for i in np.lexsort((near, far))[:k]:
                    yield {"rep": name, "other": data.names[near[i]], "d": float(far[i])}
                continue
            far = data.distances(queries, q)
            if kind == "density":
                yield {"rep": name, "other": None, "d": float(data.n[(far <= radius) & (data.names != name)].sum())}
                continue
            fit = data.names != name
            if radius is not None:
                fit &= far <= radius
            if kind == "denser":
                own = queries.rank[q]
                fit &= (data.rank > own) | ((data.rank == own) & (data.names < name))
            near = np.flatnonzero(fit)
            if len(near) > k:
                near = near[far[near] <= np.partition(far[near], k - 1)[k - 1]]
            for i in near[np.lexsort((near, far[near]))[:k]]:
                yield {"rep": name, "other": data.names[i], "d": float(far[i])}

    return work


def search(queries: DataFrame, data: DataFrame, kind: str, k: int = 1, radius: float | None = None) -> DataFrame:
    """(`rep`, `other`, `d`): exact search of vectors among vectors, in pairs of blocks whose totals allow the radius.

    For what windows can't give: the members of crowded windows among each other, queries without enough neighbours within
    the last radius against everything, and pairs that no windows hold. The work grows with queries times data, rows out only with the queries.
    """
    q, d = blocks(queries, QUERY_BLOCK), blocks(data, DATA_BLOCK)
    spark = data.sparkSession
    last = q.agg(F.max("block")).first()[0]
    if last is None or d.isEmpty():
        return spark.createDataFrame([], "rep string, other string, d double")
    plan = d.select(F.col("block").alias("j"), "low", "high", F.explode(F.expr(f"sequence(0L, {last}L)")).alias("i"))
    plan = plan.join(q.select(F.col("block").alias("i"), F.col("low").alias("q_low"), F.col("high").alias("q_high")), "i")
    if radius is not None:
        slack = (1 - radius) / (1 + radius) * (1 - 1e-9)
        plan = plan.where((F.col("q_high") >= slack * F.col("low")) & (F.col("high") >= slack * F.col("q_low")))
    plan = materialize(plan.select("i", "j"))
    parts = max(1, min(plan.count(), 4 * spark.sparkContext.defaultParallelism))
    rows = plan.join(q.select(F.col("block").alias("i"), F.col("packed").alias("q")), "i")
    rows = rows.join(d.select(F.col("block").alias("j"), F.col("packed").alias("x")), "j").repartition(parts, "i", "j").select("q", "x")
    return materialize(rows.mapInArrow(_search(kind, k, radius), "rep string, other string, d double"))


def top(pairs: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy("d", "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def class_neighbours(classes: DataFrame, k: int) -> DataFrame:
    """(`rep`, `other`, `d`): the k nearest other vectors of each vector within the outer radius, exactly.

    Windows are widened for the queries that have fewer than k neighbours within the inner radius. The k-th neighbour found
    bounds the reach of a query, the outer radius that of one with fewer; all rows are searched within it.
    """
    count = classes.count()
    inner, outer = (level(count, *x) for x in LEVELS)
    first, _ = near_pairs(classes, inner)
    have = both_ways(first).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("c"))
    have = classes.select("id", "n").join(have, "id", "left")
    lack = materialize(have.where(F.coalesce("c", F.lit(0)) + F.least(F.col("n"), F.lit(k + 1)) - 1 < k).select("id"))
    rows = both_ways(first)
    if not lack.isEmpty():
        wide, _ = near_pairs(classes, outer, lack)
        rows = rows.unionByName(both_ways(wide)).groupBy("a", "b").agg(F.max("d").alias("d"))
    last = top(rows.select(F.col("a").alias("id"), F.col("b").alias("other"), "d"), "id", k).where(F.col("rank") == k)
    reach = F.coalesce("d", F.lit(outer.radius)).alias("rank")
    queries = classes.join(last.select("id", "d"), "id", "left").select(*classes.columns, reach)
    found = search(materialize(queries), classes.withColumn("rank", F.lit(0.0)), "reached", k, outer.radius)
    return materialize(top(found, "rep", k).select("rep", "other", "d"))


def nearest(features: DataFrame, k: int = 5, complete: bool = True) -> DataFrame:
    """(`sample`, `other`, `d`, `rank`): the k nearest samples of every sample, ties by the smaller name.

    Vectors that are equal are searched once. A sample with k found within the outer radius has its nearest from there. If `complete`, the last widening takes in everything for the others: an exact pass in
    blocks of these queries against all rows. Otherwise only neighbours within the outer radius are given.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vecs = vectors(features)
    classes = classes_of(vecs, k + 1)
    pairs = class_neighbours(classes, k)
    if complete:
        # What a class lacks: its own copies count as found.
        have = classes.select("rep", "n").join(pairs.groupBy("rep").agg(F.count("*").alias("c")), "rep", "left")
        rest = have.where(F.coalesce("c", F.lit(0)) + F.least(F.col("n"), F.lit(k + 1)) - 1 < k).select("rep")
        rest = materialize(classes.join(rest, "rep").withColumn("rank", F.lit(0.0)))
        if not rest.isEmpty():
            more = search(rest, classes.withColumn("rank", F.lit(0.0)), "nearest", k)
            pairs = pairs.join(rest.select("rep"), "rep", "left_anti").unionByName(top(more, "rep", k).select("rep", "other", "d"))
    own = classes.select("rep", F.col("rep").alias("other"), F.lit(0.0).alias("d"))
    named = classes.select(F.col("rep").alias("other"), "names")
    pairs = pairs.unionByName(own).join(named, "other").select("rep", F.explode("names").alias("other"), "d")
    members = vecs.select("sample", "cls").join(classes.select("cls", "rep"), "cls").select("sample", "rep")
    return top(members.join(pairs, "rep").where("sample <> other"), "sample", k).select("sample", "other", "d", "rank")
