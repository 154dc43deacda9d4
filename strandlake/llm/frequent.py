"""Most frequent items in bounded memory: space-saving summaries, merged in a tree, then exact counts of the survivors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import materialize

#: Summaries that one task of the merge tree takes.
FAN_IN = 8
SUMMARY = "part int, total long, floor long, items binary, counts binary, errors binary"
#: Turns a batch into (items, weights or None for 1 each).
Reader = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]


class SpaceSaving:
    """At most `capacity` counters; item, count (never too small) and error (how much too large at most).

    `floor` bounds the count of any item without a counter and is at most total / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.total, self.floor = capacity, 0, 0
        self.items = self.counts = self.errors = np.empty(0, np.int64)

    def add(self, items: np.ndarray, counts: np.ndarray, errors: np.ndarray | None = None, floor: int = 0) -> None:
        """Add another summary, or exact counts of distinct items (without errors and floor)."""
        if errors is None:
            self.total += int(counts.sum())
            if len(items) > self.capacity:
                # Exact counts of many items become a summary first, so that what is merged stays small.
                order = np.argpartition(counts, len(items) - self.capacity)
                drop, keep = order[: -self.capacity], order[-self.capacity :]
                floor, items, counts = int(counts[drop].max()), items[keep], counts[keep]
        errors = np.zeros(len(items), np.int64) if errors is None else errors
        every = np.union1d(self.items, items)
        out = []
        for own, c, e, low in ((self.items, self.counts, self.errors, self.floor), (items, counts, errors, floor)):
            order = np.argsort(own)
            count, error = np.full(len(every), low), np.full(len(every), low)
            at = np.searchsorted(every, own[order])
            count[at], error[at] = c[order], e[order]
            out.append((count, error))
        self.items, self.counts, self.errors = every, out[0][0] + out[1][0], out[0][1] + out[1][1]
        self.floor += floor
        if len(every) > self.capacity:
            order = np.argpartition(self.counts, len(every) - self.capacity)
            drop, keep = order[: -self.capacity], np.sort(order[-self.capacity :])
            self.floor = max(self.floor, int(self.counts[drop].max()))
            self.items, self.counts, self.errors = self.items[keep], self.counts[keep], self.errors[keep]

    def row(self, part: int) -> pa.RecordBatch:
        pack = lambda x: pa.array([x.astype("<i8").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([self.total], pa.int64()),
                pa.array([self.floor], pa.int64()),
                pack(self.items),
                pack(self.counts),
                pack(self.errors),
            ],
            ["part", "total", "floor", "items", "counts", "errors"],
        )


def grouped(items: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(items, return_counts=True)
    found, back = np.unique(items, return_inverse=True)
    return found, np.bincount(back, weights, len(found)).astype(np.int64)


def _summarise(read: Reader, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = SpaceSaving(capacity)
        for batch in batches:
            items, weights = read(batch)
            if len(items):
                summary.add(*grouped(items, weights))
        yield summary.row(TaskContext.get().partitionId())

    return work


def _merge(capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, SpaceSaving] = {}
        for batch in batches:
            for r in batch.to_pylist():
                s = merged.setdefault(r["part"], SpaceSaving(capacity))
                s.add(*(np.frombuffer(r[k], "<i8") for k in ("items", "counts", "errors")), r["floor"])
                s.total += r["total"]
        for part, s in merged.items():
            yield s.row(part)

    return work


def summary(rows: DataFrame, read: Reader, capacity: int) -> SpaceSaving:
    """The merged summary of all rows: one per partition, then a tree of fan-in FAN_IN; a summary has bounded size."""
    level = materialize(rows.mapInArrow(_summarise(read, capacity), SUMMARY))
    n = (level.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        n = -(-n // FAN_IN)
        level = level.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartition(n, "part")
        level = level.mapInArrow(_merge(capacity), SUMMARY)
    out = SpaceSaving(capacity)
    for r in level.collect():  # one row
        out.add(*(np.frombuffer(r[k], "<i8") for k in ("items", "counts", "errors")), r["floor"])
        out.total += r["total"]
    return out


def _recount(read: Reader, wanted: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            items, weights = read(batch)
            at = np.minimum(np.searchsorted(wanted, items), len(wanted) - 1)
            hit = wanted[at] == items
            counts += np.bincount(at[hit], None if weights is None else weights[hit], len(wanted)).astype(np.int64)
        seen = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(counts[seen])], ["item", "count"])

    return work


def frequent(rows: DataFrame, read: Reader, share: float, slack: int = 4) -> DataFrame:
    """Items that make up at least `share` of the total weight: `item`, `count` (exact), `total`, `estimate`, `error`.

    First pass: space-saving with slack / share counters a partition, so no item of that share is missed and an estimate
    exceeds the truth by at most `error`. Second pass: exact counts of the candidates, at most slack / share of them,
    which is why they may travel to every task. Rows are read twice: pass a materialised input.
    """
    capacity = int(np.ceil(slack / share))
    s = summary(rows, read, capacity)
    least = ceil(Fraction(str(share)) * s.total)
    keep = s.counts >= least
    wanted = s.items[keep]
    spark = rows.sparkSession
    schema = "item long, estimate long, error long"
    if not len(wanted):
        return spark.createDataFrame([], schema + ", count long, total long")
    said = spark.createDataFrame(list(zip(*(x[keep].tolist() for x in (s.items, s.counts, s.errors)))), schema)
    exact = rows.mapInArrow(_recount(read, wanted), "item long, count long").groupBy("item").agg(F.sum("count").alias("count"))
    return exact.where(F.col("count") >= least).join(F.broadcast(said), "item").withColumn("total", F.lit(s.total))
