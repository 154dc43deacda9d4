"""Pairs of units that share a key, without a task or a row explosion for keys that very many share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import materialize

#: Columns of a key's row. Rows of keys known as hot are spread by `salt` and never gathered.
KEYS = "key long, unit long, salt int, hot boolean"
#: Share of the units from which hot keys are learned, and how often one must be seen there to count as hot.
HOT_SAMPLE, HOT_SEEN = 0.01, 100
Batches = Iterator[pa.RecordBatch]


def key_rows(key: np.ndarray, unit: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Distinct rows of keys (as 64-bit patterns) and units."""
    key = key.astype(np.int64)
    order = np.lexsort((unit, key))
    key, unit = key[order], unit[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
    key, unit = key[new], unit[new]
    known = np.isin(key, hot)
    salt = np.where(known, unit % 64, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(unit), pa.array(salt), pa.array(known)], ["key", "unit", "salt", "hot"])


def grouped(limit: int) -> Callable[[Batches], Batches]:
    """Of rows sorted by key and unit: pairs (0, a, b) of units with the same key; of keys that more than `limit` units
    share or that are known as hot, the rows themselves (key, a, null)."""

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), b], ["key", "a", "b"])

    def work(batches: Batches) -> Batches:
        nothing = np.empty(0, np.int64)
        key, unit, overflown = nothing, nothing, None
        for batch in batches:
            k, u, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            if h.any():
                yield out(k[h], u[h], pa.nulls(int(h.sum()), pa.int64()))
                k, u = k[~h], u[~h]
            key, unit = np.concatenate([key, k]), np.concatenate([unit, u])
            if not len(key):
                continue
            before = overflown
            last = int(np.searchsorted(key, key[-1])) if key[-1] != overflown else 0
            if len(key) - last > limit:
                # The last group is too large already: all of its rows are handed on, now and later.
                overflown = key[-1]
            keep = len(key) if key[-1] == overflown else last
            # The rest of the group that overflowed before may stand in front of one that does now.
            yield from pairs(key[:keep], unit[:keep], (before, overflown))
            key, unit = key[keep:], unit[keep:]
        yield from pairs(key, unit, (overflown,))

    def pairs(key: np.ndarray, unit: np.ndarray, overflown: tuple[int | None, ...]) -> Batches:
        if not len(key):
            return
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
        key, unit = key[new], unit[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        large = (size > limit) | np.isin(key[start], [k for k in overflown if k is not None])
        rows = np.repeat(large, size)
        if rows.any():
            yield out(key[rows], unit[rows], pa.nulls(int(rows.sum()), pa.int64()))
        for g in np.unique(size[~large & (size > 1)]):
            group = unit[start[(size == g) & ~large][:, None] + np.arange(g)]
            a, b = np.triu_indices(g, 1)
            x, y = group[:, a].ravel(), group[:, b].ravel()
            yield out(np.zeros(len(x), np.int64), x, pa.array(y))

    return work


def hot_keys(units: DataFrame, keys: Callable[[np.ndarray], Callable[[Batches], Batches]]) -> np.ndarray:
    """Keys that a sample shows to be very frequent (at most 10,000): their rows are spread over tasks at once.

    The sample only decides which way a row goes; every row goes one of the two.
    """
    some = units.sample(HOT_SAMPLE, 7).mapInArrow(keys(np.empty(0, np.int64)), KEYS)
    rows = some.groupBy("key").count().where(f"count >= {HOT_SEEN}").orderBy(F.desc("count")).limit(10_000).collect()
    return np.array(sorted(r.key for r in rows), np.int64)


def together(units: DataFrame, keys: Callable[[np.ndarray], Callable[[Batches], Batches]], limit: int) -> DataFrame:
    """(key, a, b): pairs of units that share a key, once for each; of keys that more than `limit` units share the rows
    (key, a, null). `keys`, given the hot keys, makes KEYS of units; these are shuffled once."""
    rows = units.mapInArrow(keys(hot_keys(units, keys)), KEYS).repartition("key", "salt").sortWithinPartitions("key", "unit")
    return materialize(rows.mapInArrow(grouped(limit), "key long, a long, b long"))
