"""Items of varying length into containers of fixed capacity: bulk-synchronous best-fit.

A round range-sorts the unplaced items and the gaps of open containers together. A sweep from large to small gives each
item the smallest gap before it that no larger item took, as closing brackets meet opening ones; at most one item a gap, so
no two conflict. Sorted parts are swept apart, what is left of each is matched by rank over the parts' carries, gaps are
updated, and the next round begins. When nothing fits any more, as many containers are opened as the rest needs at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import materialize, numbered

#: Rows (items and gaps) of a sorted part. When no more are left altogether, one task does the remaining rounds.
PART_ROWS = 1 << 20
#: Items of at most a SMALL-th of a container are put into bundles of about a BUNDLE-th first, so that a container takes few
#: rounds to fill; bundles that no gap holds are opened again.
SMALL, BUNDLE = 64, 32


def sweep(value: np.ndarray, kind: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows from large to small (a gap, kind 0, before the items, kind 1, of its size), and of these the gaps and the items
    that meet: the item takes the smallest gap that is still free."""
    order = np.lexsort((ident, kind, -value))
    item = kind[order] == 1
    depth = np.cumsum(np.where(item, -1, 1))
    # A gap opens a level, the next item on that level closes it.
    level = depth + item
    by = np.lexsort((np.arange(len(order)), level))
    a, b = by[:-1], by[1:]
    hit = (level[a] == level[b]) & ~item[a] & item[b]
    return order, order[a[hit]], order[b[hit]]


def bundles(sizes: np.ndarray, ids: np.ndarray, capacity: int) -> np.ndarray:
    """The bundle of each item, named by one of its items; an item that is not small is alone."""
    unit = ids.copy()
    order = np.lexsort((ids, -sizes))
    order = order[sizes[order] <= capacity // SMALL]
    if len(order):
        cut = (np.cumsum(sizes[order]) - sizes[order]) // max(1, capacity // BUNDLE)
        head = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        unit[order] = np.repeat(ids[order[head]], np.diff(np.r_[head, len(order)]))
    return unit


def meet(sizes: np.ndarray, ids: np.ndarray, gaps: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of sweeps until nothing fits: the container of each item (-1: none), and the gaps after that."""
    box, gaps = np.full(len(ids), -1, np.int64), gaps.copy()
    left = np.arange(len(ids))
    while len(left):
        open_ = np.flatnonzero(gaps >= sizes[left].min())
        kind = np.r_[np.zeros(len(open_), np.int8), np.ones(len(left), np.int8)]
        _, g, i = sweep(np.r_[gaps[open_], sizes[left]], kind, np.r_[boxes[open_], ids[left]])
        if not len(g):
            break
        g, i = open_[g], i - len(open_)
        box[left[i]] = boxes[g]
        gaps[g] -= sizes[left[i]]
        left = np.delete(left, i)
    return box, gaps


def fill_all(sizes: np.ndarray, ids: np.ndarray, gaps: np.ndarray, boxes: np.ndarray, first: int, capacity: int) -> np.ndarray:
    """The container of every item, with new ones from number `first` on: what the rounds of `packed` do, in one task."""
    box = np.full(len(ids), -1, np.int64)
    while True:
        for bundle in (True, False):
            left = np.flatnonzero(box < 0)
            unit = bundles(sizes[left], ids[left], capacity) if bundle else ids[left]
            names, back = np.unique(unit, return_inverse=True)
            whole = np.bincount(back, sizes[left], len(names)).astype(np.int64)
            found, gaps = meet(whole, names, gaps, boxes)
            box[left] = found[back]
        left = np.flatnonzero(box < 0)
        if not len(left):
            return box
        count = -(-int(sizes[left].sum()) // capacity)
        new = left[np.lexsort((ids[left], -sizes[left]))[:count]]
        box[new] = first + np.arange(count)
        boxes, gaps = np.r_[boxes, box[new]], np.r_[gaps, capacity - sizes[new]]
        boxes, gaps, first = boxes[gaps > 0], gaps[gaps > 0], first + count


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return (np.empty(0, np.int64),) * 3
    table = pa.Table.from_batches(held)
    return tuple(table[c].to_numpy().astype(np.int64) for c in ("value", "kind", "id"))


def _finish(first: int, capacity: int):
    """Rows (value, kind, id) of everything that is left: (item, container)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, kind, ident = _columns(batches)
        item = kind == 1
        box = fill_all(value[item], ident[item], value[~item], ident[~item], first, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(ident[item]), pa.array(box)], ["item", "container"])

    return work


MATCH = "part int, kind int, id long, value long, rank long, box long, gap long"


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part: items that meet a gap here (kind 2, with `box` and `gap`), and what is left with its rank."""
    value, kind, ident = _columns(batches)
    part = TaskContext.get().partitionId()
    order, g, i = sweep(value, kind, ident)
    met = np.zeros(len(value), bool)
    met[g] = met[i] = True
    out = [(np.full(len(i), 2), ident[i], value[i], np.zeros(len(i), np.int64), ident[g], value[g])]
    rest = order[~met[order]]
    for k in (0, 1):
        own = rest[kind[rest] == k]
        none = np.zeros(len(own), np.int64)
        out.append((np.full(len(own), k), ident[own], value[own], np.arange(len(own)), none, none))
    kinds, ids, values, ranks, boxes, gaps = (np.concatenate(c) for c in zip(*out))
    columns = [np.full(len(ids), part, np.int32), kinds.astype(np.int32), ids, values, ranks, boxes, gaps]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in MATCH.split(", ")])


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which leftovers of parts meet: (part, kind, first rank, end, number of the first match, direction), from the parts'
    numbers of items and gaps left (part, items, gaps), in the order of the parts. One row a part goes in."""
    stack: list[list[int]] = []
    out, number = [], 0
    for part, items, gaps in sorted(left):
        at = 0
        while at < items and stack:
            source, free = stack[-1]
            n = min(free, items - at)
            out.append((part, 1, at, at + n, number, 1))
            out.append((source, 0, free - n, free, number, -1))
            at, number = at + n, number + n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def _round(items: DataFrame, gaps: DataFrame, parts: int) -> DataFrame:
    """(item, size, box, gap): the items that find a gap in one sweep over all parts."""
    spark = items.sparkSession
    rows = gaps.select(F.col("gap").alias("value"), F.lit(0).alias("kind"), F.col("box").alias("id"))
    rows = rows.unionByName(items.select(F.col("size").alias("value"), F.lit(1).alias("kind"), F.col("item").alias("id")))
    rows = rows.repartitionByRange(parts, F.desc("value"), "kind", "id")
    swept = materialize(rows.mapInArrow(_part, MATCH))
    left = swept.where("kind < 2").groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("i"), F.count_if(F.col("kind") == 0).alias("g"))
    spans = carried([(r.part, r.i, r.g) for r in left.collect()])
    met = swept.where("kind = 2").select(F.col("id").alias("item"), F.col("value").alias("size"), "box", "gap")
    if not spans:
        return materialize(met)
    # At most two rows a part and match, so few and small.
    known = spark.createDataFrame(spans, "part int, kind int, lo long, hi long, number long, way int")
    named = swept.where("kind < 2").join(F.broadcast(known), ["part", "kind"]).where("rank >= lo AND rank < hi")
    number = F.when(F.col("way") == 1, F.col("number") + F.col("rank") - F.col("lo")).otherwise(F.col("number") + F.col("hi") - 1 - F.col("rank"))
    named = named.select("kind", "id", "value", number.alias("m"))
    one = named.where("kind = 1").select("m", F.col("id").alias("item"), F.col("value").alias("size"))
    two = named.where("kind = 0").select("m", F.col("id").alias("box"), F.col("value").alias("gap"))
    return materialize(met.unionByName(one.join(two, "m").drop("m")))


def _bundled(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        ids, sizes = table["item"].to_numpy(), table["size"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(bundles(sizes, ids, capacity))], ["item", "size", "unit"])


def packed(documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """(`doc_id`, `piece`, `start`, `n_tokens`, `container`) of documents (`doc_id`, `n_tokens`).

    A document longer than a container is cut into full containers and a rest; no other is cut. Documents without tokens
    are left out. Full pieces fill containers of their own. The others go through rounds (see the module) over range-sorted
    parts of about PART_ROWS rows, which one task holds; what travels to the driver is one row a part. As soon as a single
    part is left, its task does the remaining rounds, which are the same. Containers are opened only when the rest needs
    them, as many as its sum asks for at least.
    """
    pieces = documents.where("n_tokens > 0").select(
        "doc_id", "n_tokens", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) DIV {capacity})")).alias("piece")
    )
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("n_tokens"))
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()))
    spark = documents.sparkSession
    rest = pieces.where(F.col("n_tokens") < capacity).select("item", F.col("n_tokens").alias("size"))
    # Full pieces have the first numbers, in the order of their items.
    whole = numbered(pieces.where(F.col("n_tokens") == capacity).select("item"), ["item"], "container", 0)
    gaps, first, placed = spark.createDataFrame([], "box long, gap long"), whole.count(), [whole]
    while True:
        n, total = rest.agg(F.count("*"), F.sum("size")).first()
        if not n:
            break
        every = n + gaps.count()
        if every <= PART_ROWS:
            rows = gaps.select(F.col("gap").alias("value"), F.lit(0).alias("kind"), F.col("box").alias("id"))
            rows = rows.unionByName(rest.select(F.col("size").alias("value"), F.lit(1).alias("kind"), F.col("item").alias("id")))
            placed.append(materialize(rows.coalesce(1).mapInArrow(_finish(first, capacity), "item long, container long")))
            break
        parts = -(-every // PART_ROWS)
        for bundle in (True, False):
            if gaps.isEmpty() or rest.isEmpty():
                break
            units = rest.withColumn("unit", F.col("item"))
            if bundle:
                units = rest.repartitionByRange(parts, F.desc("size"), "item")
                units = units.mapInArrow(lambda b: _bundled(b, capacity), "item long, size long, unit long")
            units = materialize(units)
            open_ = materialize(units.groupBy(F.col("unit").alias("item")).agg(F.sum("size").alias("size")))
            found = []
            while True:
                met = _round(open_, gaps, parts)
                if met.isEmpty():
                    break
                found.append(met.select(F.col("item").alias("unit"), F.col("box").alias("container")))
                open_ = materialize(open_.join(met.select("item"), "item", "left_anti"))
                gaps = gaps.join(met.select("box", F.col("size").alias("taken")), "box", "left")
                gaps = materialize(gaps.select("box", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"))
            for met in found:
                placed.append(units.join(met, "unit").select("item", "container"))
            rest = materialize(units.join(open_.select(F.col("item").alias("unit")), "unit", "left_semi").select("item", "size"))
        total = rest.agg(F.sum("size")).first()[0]
        if total is None:
            break
        count = -(-total // capacity)
        ranked = materialize(numbered(rest.withColumn("down", -F.col("size")), ["down", "item"], "rank", 0))
        new = ranked.where(F.col("rank") < count).select("item", "size", (F.col("rank") + first).alias("box"))
        placed.append(new.select("item", F.col("box").alias("container")))
        gaps = materialize(gaps.unionByName(new.select("box", (F.lit(capacity) - F.col("size")).alias("gap")).where("gap > 0")))
        rest, first = ranked.where(F.col("rank") >= count).select("item", "size"), first + count
    return pieces.join(reduce(DataFrame.unionByName, placed), "item").select("doc_id", "piece", "start", "n_tokens", "container")


def fill(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of all places that is filled, and the least number of containers possible."""
    used = rows.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("filled"),
        F.ceil(F.sum("n") / capacity).alias("least_containers"),
    )
