"""Overlap sizes between many large sets: range-partitioned runs, merged with a heap, counted in pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.repetition import mix

#: Identifiers that one range is to hold, counted over all sets.
RANGE_ROWS = 1_000_000
#: Tasks that merge ranges, unless the session asks for more.
MOST_TASKS = 8192
#: Input rows that are sorted into runs together.
RUN_ROWS = 1 << 20
#: Elements of a run that enter the merge at a time.
BLOCK = 4096
#: Merged elements that are counted at a time; pair codes that are held before they are added up.
CHUNK, CODES = 1 << 16, 1 << 21
#: Pair counters that a task holds before it hands them on.
HELD = 1 << 20


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows`, but for the last."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _runs(bits: int):
    """Of each million input rows: per range and set one sorted run of distinct identifiers.

    Identifiers are mixed first, which is one to one, so ranges of equal width hold about equally many, whatever the
    identifiers are; a range is named by its top bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, RUN_ROWS):
            names = batch.column(0).dictionary_encode()
            sets = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64))
            order = np.lexsort((ids, sets))
            sets, ids = sets[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (sets[1:] != sets[:-1]) | (ids[1:] != ids[:-1])
            sets, ids = sets[new], ids[new]
            part = (ids >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
            ids = (ids ^ np.uint64(1 << 63)).view(np.int64)  # in the same order with a sign
            cut = np.flatnonzero(np.r_[True, (sets[1:] != sets[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[cut[1:], len(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cut], pa.int64()),
                    names.dictionary.take(pa.array(sets[cut])).cast(pa.string()),
                    pa.array([ids[a:b].astype("<i8").tobytes() for a, b in zip(cut, ends)], pa.binary()),
                ],
                ["part", "name", "run"],
            )

    return work


def merged(runs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of sorted runs (set, identifiers): chunks of (identifiers, sets), sorted and without repeats.

    A heap holds the next block of each run by its first identifier. Whatever lies below the heap's top is complete
    and leaves in order; no identifier is split over two chunks.
    """
    heap = [(int(ids[0]), k, 0) for k, (_, ids) in enumerate(runs) if len(ids)]
    heapq.heapify(heap)
    taken: list[tuple[np.ndarray, int]] = []
    held = 0

    def flush(limit: int | None):
        nonlocal taken, held
        ids = np.concatenate([x for x, _ in taken])
        sets = np.repeat(np.array([s for _, s in taken]), [len(x) for x, _ in taken])
        order = np.lexsort((sets, ids))
        ids, sets = ids[order], sets[order]
        end = len(ids) if limit is None else int(np.searchsorted(ids, limit))
        rest_ids, rest_sets = ids[end:], sets[end:]
        taken = [(rest_ids[rest_sets == s], int(s)) for s in np.unique(rest_sets)]
        held = len(rest_ids)
        ids, sets = ids[:end], sets[:end]
        new = np.ones(end, bool)
        new[1:] = (ids[1:] != ids[:-1]) | (sets[1:] != sets[:-1])
        return ids[new], sets[new]

    due = CHUNK
    while heap:
        _, k, at = heapq.heappop(heap)
        name, ids = runs[k]
        block = ids[at : at + BLOCK]
        taken.append((block, name))
        held += len(block)
        if at + BLOCK < len(ids):
            heapq.heappush(heap, (int(ids[at + BLOCK]), k, at + BLOCK))
        if held >= due and heap:
            yield flush(heap[0][0])
            due = held + CHUNK
    if taken:
        yield flush(None)


class PairCounters:
    """Counts of (set, set) pairs as sorted codes; equal pairs are added up whenever many have come together."""

    def __init__(self, sets: int):
        self.sets, self.codes, self.counts = sets, np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((codes, counts))
        self.held += len(codes)
        if self.held >= CODES:
            self.settle()

    def settle(self) -> None:
        codes = np.concatenate([self.codes, *(c for c, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.codes, back = np.unique(codes, return_inverse=True)
        self.counts = np.bincount(back, counts, len(self.codes)).astype(np.int64)
        self.waiting, self.held = [], 0

    def count(self, ids: np.ndarray, sets: np.ndarray) -> Iterator[None]:
        """Add all pairs of sets, a set with itself included, of each identifier in a merged chunk. Stops whenever HELD
        counters have come together, so that the caller takes them out."""
        if not len(ids):
            return
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[start, len(ids)])
        own = np.bincount(sets, minlength=self.sets)
        there = np.flatnonzero(own)
        self.add(there * self.sets + there, own[there])
        for g in np.unique(size[size > 1]):
            # Identifiers with the same sets are counted once, with their number.
            rows, times = np.unique(sets[start[size == g][:, None] + np.arange(g)], axis=0, return_counts=True)
            step = max(1, CODES // int(g))
            for k in range(0, len(rows), step):
                part, weight = rows[k : k + step], times[k : k + step]
                for i in range(g - 1):
                    codes = part[:, i : i + 1] * self.sets + part[:, i + 1 :]
                    self.add(codes.ravel(), np.repeat(weight, codes.shape[1]))
                    if len(self.codes) >= HELD:
                        yield

    def rows(self, names: list[str]) -> pa.RecordBatch:
        self.settle()
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(self.codes // self.sets)),
                pa.array(names, pa.string()).take(pa.array(self.codes % self.sets)),
                pa.array(self.counts, pa.int64()),
            ],
            ["a", "b", "n"],
        )
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        return out


def _count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each range (they arrive sorted by range) and hand on its pair counters."""

    def counted(found: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        names = sorted({n for n, _ in found})
        place = {n: i for i, n in enumerate(names)}
        counters = PairCounters(len(names))
        for ids, sets in merged([(place[n], np.frombuffer(r, "<i8")) for n, r in found]):
            for _ in counters.count(ids, sets):
                yield counters.rows(names)
        yield counters.rows(names)

    part, found = None, []
    for batch in batches:
        for p, n, r in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and found:
                yield from counted(found)
                found = []
            part = p
            found.append((n, r))
    if found:
        yield from counted(found)


def overlap_counters(sets: DataFrame, name: str, identifier: str) -> DataFrame:
    """(a, b, n): the identifiers that sets a <= b share; a = b gives a set's size. Pairs that share nothing are absent.

    One shuffle: sorted runs per input batch, set and identifier range, already without repeats, go to the range's task,
    which merges them with a heap. A set of any size is spread over all ranges, a repeated row disappears before the
    shuffle, and a task holds one range (about RANGE_ROWS identifiers) and at most HELD counters.
    Null names or identifiers are left out; an empty table gives no rows.
    """
    spark = sets.sparkSession
    rows = sets.select(F.col(name).alias("__name"), F.col(identifier).cast("long").alias("__id")).where(
        "__name IS NOT NULL AND __id IS NOT NULL"
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(least, -(-rows.count() // RANGE_ROWS)) - 1).bit_length()
    # Many ranges go through one task, one after another, where there are more than tasks may be.
    tasks = min(1 << bits, max(least, MOST_TASKS))
    runs = rows.mapInArrow(_runs(bits), "part long, name string, run binary")
    parts = runs.repartitionById(tasks, F.expr(f"cast(part * {tasks} DIV {1 << bits} AS INT)")).sortWithinPartitions("part")
    return parts.mapInArrow(_count_ranges, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def overlaps(sets: DataFrame, name: str, identifier: str, classes: DataFrame | None = None) -> DataFrame:
    """Every pair of sets that share an identifier, with sizes and shares.

    Columns `set_a` < `set_b`, `shared`, `size_a`, `size_b`, `jaccard`, `containment` (share of the smaller set) and,
    with `classes` (name, color), `color_a`, `color_b`. Sets without a class are left out if `classes` is given.
    """
    from strandlake.runtime import join_small, materialize

    found = materialize(overlap_counters(sets, name, identifier))
    one = found.where("a = b").select(F.col("a").alias("__s"), F.col("n").alias("__n"))
    if classes is not None:
        known = classes.where("color IS NOT NULL").groupBy(F.col(name).alias("__s")).agg(F.min("color").alias("__c"))
        one = one.join(known, "__s")
    out = found.where("a < b").withColumnsRenamed({"a": "set_a", "b": "set_b", "n": "shared"})
    for side in "ab":
        own = one.withColumnsRenamed({"__s": f"set_{side}", "__n": f"size_{side}", "__c": f"color_{side}"})
        out = join_small(out, own, f"set_{side}")
    return out.withColumns(
        {
            "jaccard": F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")),
            "containment": F.col("shared") / F.least("size_a", "size_b"),
        }
    )
