"""Long exact spans shared between records: recompression names symbols alike wherever the text is alike.

A record is a sequence of tokens. Each round names maximal runs of one symbol and then pairs of neighbours of which the
left has coin 0 and the right coin 1. Names and coins are 64-bit hashes of what they stand for, so every task names
globally alike without a dictionary or a shuffle, and equal spans get equal interior symbols but for a few at either end.
Which these are is kept for each symbol: the tokens on which it depends. Some borders between high-level symbols, with the
names of the symbols around them, are anchors; records that share these symbols are candidates, verified exactly. Spans
too poor in borders to hold an anchor go by their whole windows, so that none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions.windows import flat
from strandlake.llm import groups
from strandlake.llm.repetition import VALUE, chunks, mix, prefix, spans
from strandlake.runtime import join_small, materialize

#: Tokens of a record that are parsed as one piece; neighbours overlap by the least span, so no span falls between.
PIECE, PIECE_BITS = 1 << 16, 20
#: Tokens that are worked on at once, so few that their arrays stay in the cache.
CHUNK = 1 << 16
#: Records that may share an anchor before their windows decide instead of the anchor.
GROUP = 16
ROUND = np.uint64(0xA24BAED4963EE407)
NEXT = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Shape:
    """What follows from the least span: tokens on either side of a border that its key covers at least, rounds, borders
    that compete for an anchor."""

    least: int

    @property
    def side(self) -> int:
        return max(1, self.least // 6)

    @property
    def rounds(self) -> int:
        return max(1, int(log(max(1.0, self.least / 25)) / log(4 / 3)))

    @property
    def rivals(self) -> int:
        return max(1, min(7, self.least // 7))


@dataclass
class Symbols:
    """Symbols of all parts in order: name, first token, and the tokens [low, high) on which name and place depend.

    Wherever these tokens stand, the symbol stands. A dependence on a part's border reaches one token beyond it, which no
    span does.
    """

    name: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _runs(values: np.ndarray, part: np.ndarray, name: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Runs of symbols of one name: name, first token, dependence, number of symbols."""
    n = len(name)
    own = part[at]
    edge = np.ones(n, bool)  # a part begins here
    edge[1:] = own[1:] != own[:-1]
    head = edge.copy()
    head[1:] |= name[1:] != name[:-1]
    start = np.flatnonzero(head)
    tail = np.append(start[1:], n) - 1
    edge, place = edge[start], at[start]
    after, end = np.append(edge[1:], True), np.append(place[1:], len(values))
    # A run ends where another name follows. That it is another shows in the first token if this differs from the
    # run's, else only in all on which that name depends; likewise before the run.
    token, bound = values[place], high[start]
    seen = np.where(after | (np.append(token[1:], token[:1]) != token), end + 1, np.append(bound[1:], bound[:1]))
    new_high = np.maximum(high[tail], seen)
    token, bound = values[end - 1], low[tail]
    seen = np.where(edge | (np.append(token[-1:], token[:-1]) != token), place - 1, np.append(bound[-1:], bound[:-1]))
    new_low = np.minimum(low[start], seen)
    return name[start], place, new_low, new_high, tail - start + 1


def recompress(values: np.ndarray, part: np.ndarray, rounds: int, frozen: int) -> Symbols:
    """The symbols of all parts after `rounds` rounds.

    `part` numbers the parts (non-decreasing); no symbol crosses from one to the next. A symbol of `frozen` tokens or
    more (a long repeat of a short period) is not paired any further, so its borders stay.
    """
    name, at = values, np.arange(len(values))
    low, high = at, at + 1
    for level in range(rounds):
        n = len(name)
        if not n:
            break
        if level == 0:
            # A run of tokens depends on the two next to it.
            head = np.ones(n, bool)
            head[1:] = (values[1:] != values[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(head)
            end = np.r_[at[1:], n]
            name, run, low, high = values[at], end - at, at - 1, end + 1
        else:
            name, at, low, high, run = _runs(values, part, name, at, low, high)
        many = np.flatnonzero(run > 1)
        name[many] = mix(name[many] ^ (run[many].astype(np.uint64) * ROUND))
        n, own = len(name), part[at]
        end = np.append(at[1:], len(values))
        salt = np.uint64((level + 1) * int(ROUND) % (1 << 64))
        right = (mix(name + salt) & np.uint64(1)).astype(bool)
        fit = end - at < frozen
        left, right = fit & ~right, fit & right
        edge = np.flatnonzero(own[1:] != own[:-1])
        pair = left[:-1] & right[1:]
        pair[edge] = False
        # A symbol that may be the left one of a pair depends on the next, one that may be the right one on the one before.
        beside = np.append(high[1:], len(values) + 1)
        beside[edge] = end[edge] + 1
        new_high = np.where(left, np.maximum(high, beside), high)
        beside = np.append(-1, low[:-1])
        beside[edge + 1] = at[edge + 1] - 1
        new_low = np.where(right, np.minimum(low, beside), low)
        first = np.flatnonzero(pair)
        name[first] = mix(name[first] * ROUND + name[first + 1] * NEXT + np.uint64(level))
        keep = np.ones(n, bool)
        keep[first + 1] = False
        keep = np.flatnonzero(keep)
        name, at, low, high = name[keep], at[keep], new_low[keep], new_high[keep]
    return Symbols(name, at, low, high)


def anchors(values: np.ndarray, part: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, end, key) of a chunk's anchors and of the windows without one.

    A border between two symbols has as key the names of the symbols around it that cover `side` tokens on either side;
    of `rivals` borders in a row the least is an anchor. All this depends on tokens that are known (`Symbols`), so an
    anchor that depends on the tokens of one window of the least span alone occurs wherever this window does. Windows that
    hold no such anchor (text of few letters or short periods, places near a record's ends) are keys themselves: two
    records with a window in common always have a key in common.
    """
    side, rivals, least = shape.side, shape.rivals, shape.least
    window = part[: max(0, len(values) - least + 1)] == part[least - 1 :]
    if not window.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    s = recompress(values, part, shape.rounds, 2 * side)
    at, n = s.at, len(s.at)
    own = part[at]
    border = np.flatnonzero(own[1:] == own[:-1]) + 1
    place = at[border]
    low, high = np.maximum(place - side, 0), np.minimum(place + side, len(values)) - 1
    began = np.zeros(len(values), np.int64)
    began[at] = 1
    began = np.cumsum(began)
    l, r = began[low] - 1, began[high]
    there = (place >= side) & (place + side <= len(values))
    there &= (part[low] == own[border]) & (part[high] == own[border])
    l, r = np.where(there, l, border - 1), np.where(there, r, border + 1)
    m = len(border) - rivals + 1
    found = np.empty(0, np.int64)
    cover = np.zeros(len(values) + 2, np.int64)
    if m > 0:
        rank = mix(s.name[border - 1] * ROUND + s.name[border] * NEXT)
        # The first of the least ranks of so many borders in a row; twice as many each time.
        best, many = np.arange(len(rank)), 1
        while many < rivals:
            step = min(many, rivals - many)
            less = rank[step:] < rank[:-step]
            rank, best = np.where(less, rank[step:], rank[:-step]), np.where(less, best[step:], best[:-step])
            many += step
        low = s.low[np.minimum(border[:m] - 1, l[best])]
        high = s.high[np.maximum(border[rivals - 1 :], r[best] - 1)]
        ok = there[best] & (high - low <= least) & (border[rivals - 1 :] - border[:m] == rivals - 1)
        found = best[ok]
        found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
        # Windows [i, i + least) of which the dependence is a part.
        cover += np.bincount(np.maximum(high[ok] - least, 0), minlength=len(cover))
        cover -= np.bincount(low[ok] + 1, minlength=len(cover))
    bare = np.flatnonzero(window & (np.cumsum(cover)[: len(window)] <= 0))
    first, end = at[l[found]], np.r_[at, len(values)][r[found]]
    key = spans(prefix(s.name), l[found], r[found])
    return (
        np.concatenate([first, bare]),
        np.concatenate([end, bare + least]),
        np.concatenate([key, spans(prefix(values), bare, bare + least) if len(bare) else np.empty(0, np.uint64)]),
    )


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Chunks of a batch (unit, tokens): values, part of each value, row of each value, first row."""
    column = batch.column(1)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        raw, offsets = flat(column)
        for a, b in chunks(offsets, CHUNK):
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            yield VALUE[raw[offsets[a] : offsets[b]]], row, row, a
    else:
        offsets = column.offsets.to_numpy()
        items = column.values
        place = items.field(0).to_numpy(zero_copy_only=False)
        value = items.field(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        for a, b in chunks(offsets, CHUNK):
            part = slice(offsets[a], offsets[b])
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            cut = np.r_[0, (np.diff(place[part]) != 1) | (np.diff(row) != 0)] if len(row) else row
            yield mix(value[part] * ROUND), np.cumsum(cut), row, a


def _keys(shape: Shape, hot: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy(zero_copy_only=False)
            for values, part, row, first in _tokens(batch):
                at, _, key = anchors(values, part, shape)
                yield groups.key_rows(key, units[first + row[at]], hot)

    return work


def windows(values: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of `least` tokens inside one part."""
    at = np.arange(max(0, len(values) - least + 1))
    at = at[part[at] == part[at + least - 1]]
    return at, spans(prefix(values), at, at + least)


def _held_windows(shape: Shape):
    """Of (unit, tokens, keys): the windows of the least span that hold the tokens of one of the keys, with their places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2)
            edge, keys = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            wanted = np.sort(mix(keys[edge[0] : edge[-1]].astype(np.uint64) ^ (owner.astype(np.uint64) * NEXT)))
            for values, part, row, first in _tokens(batch):
                at, end, key = anchors(values, part, shape)
                own = mix(key ^ ((first + row[at]).astype(np.uint64) * NEXT))
                hit = np.zeros(len(own), bool)
                if len(wanted):
                    hit = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                cover = np.zeros(len(values) + 2, np.int64)
                np.add.at(cover, np.maximum(end[hit] - shape.least, 0), 1)
                np.add.at(cover, at[hit] + 1, -1)
                place, window = windows(values, part, shape.least)
                held = np.cumsum(cover)[place] > 0
                place, window = place[held], window[held]
                start = np.searchsorted(row, row[place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.astype(np.int64)), pa.array(units[first + row[place]]), pa.array(place - start)],
                    ["key", "unit", "at"],
                )

    return work


def in_both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys of either side the other has too, by sorting them once."""
    key = np.concatenate([a, b])
    if not len(a) or not len(b):
        return np.zeros(len(a), bool), np.zeros(len(b), bool)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    of_b = np.add.reduceat((order >= len(a)).astype(np.int64), start)
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat((of_b > 0) & (of_b < size), size)
    return hit[: len(a)], hit[len(a) :]


def _verify(least: int):
    """Of candidate pairs with both token sequences: the merged stretches of either side that occur in the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                yield from found(batch.slice(k, 2000))

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sides = []
        for unit, tokens in ((0, 2), (1, 3)):
            got = [[], [], []]
            for values, part, row, first in _tokens(batch.select([unit, tokens])):
                at, window = windows(values, part, least)
                start = np.searchsorted(row, row[at])
                got[0].append(row[at] + first)
                got[1].append(at - start)
                got[2].append(mix(window ^ ((row[at] + first + 1).astype(np.uint64) * NEXT)))
            sides.append([np.concatenate(x) if x else np.empty(0, np.int64) for x in got])
        columns = [[], [], [], []]
        for k, hit in enumerate(in_both(sides[0][2], sides[1][2])):
            row, at = (x[hit] for x in sides[k][:2])
            if not len(row):
                continue
            head = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(at) > least)])
            tail = np.r_[head[1:], len(row)] - 1
            columns[0].append(row[head])
            columns[1].append(np.full(len(head), k))
            columns[2].append(at[head])
            columns[3].append(at[tail] + least)
        if columns[0]:
            row, side, start, end = (np.concatenate(c) for c in columns)
            a, b = (batch.column(i).take(pa.array(row)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [a, b, pa.array(side == 1), pa.array(start), pa.array(end)], ["unit_a", "unit_b", "of_b", "start", "end"]
            )

    return work


def text_units(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(unit, tokens): texts in pieces of PIECE tokens that overlap by `least`; a token is a byte of the text."""
    return (
        df.where(F.col(key).isNotNull() & (F.length(text) >= least))
        .select(F.col(key).alias("__k"), F.col(text).alias("__t"))
        .select("*", F.explode(F.expr(f"sequence(0L, (length(__t) - 1) DIV {PIECE})")).alias("__p"))
        .select(
            (F.col("__k") * (1 << PIECE_BITS) + F.col("__p")).alias("unit"),
            F.expr(f"substring(__t, cast(__p * {PIECE} + 1 AS INT), {PIECE + least})").alias("tokens"),
        )
    )


def list_units(df: DataFrame, key: str, place: str, value: str, least: int) -> DataFrame:
    """(unit, tokens): rows of one token each, gathered in the order of their places, in pieces of bounded length.

    A null value or a missing place ends a run: no span goes over it. Repeated rows count once; of two values at one
    place the smaller holds.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(place).isNotNull() & F.col(value).isNotNull())
    rows = rows.groupBy(F.col(key).cast("long").alias("__k"), F.col(place).cast("long").alias("place")).agg(F.min(value).alias("value"))
    own = f"place DIV {PIECE}"
    rows = rows.withColumn("__p", F.explode(F.expr(
        f"CASE WHEN place % {PIECE} < {least} AND place >= {PIECE} THEN array({own} - 1, {own}) ELSE array({own}) END"
    )))
    return (
        rows.groupBy((F.col("__k") * (1 << PIECE_BITS) + F.col("__p")).alias("unit"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("tokens"))
        .where(F.size("tokens") >= least)
    )


def shared_anchors(units: DataFrame, shape: Shape) -> DataFrame:
    """(key, a, b): pairs of units (a, b) that share an anchor; of anchors that more than GROUP units share the rows
    (key, a, null). One shuffle of anchors: 16 bytes, one in about 12 tokens."""
    return groups.together(units, partial(_keys, shape), GROUP)


def held_windows(units: DataFrame, keys: DataFrame, shape: Shape) -> DataFrame:
    """(key, unit, at): windows of the least span, by hash, around the anchors (unit, key)."""
    # The anchors of a unit are at most as many as its tokens, which are bounded.
    keys = keys.groupBy("unit").agg(F.collect_set("key").alias("keys"))
    held = join_small(units, keys, "unit").select("unit", "tokens", "keys")
    return held.mapInArrow(_held_windows(shape), "key long, unit long, at long")


def shared_spans(units: DataFrame, least: int) -> DataFrame:
    """Stretches of at least `least` tokens that two units share: `unit_a` < `unit_b`, `of_b`, `start`, `end`.

    A row is a maximal stretch of either side (`of_b`: of the second) that occurs in the other. No texts are shuffled but
    of those that share an anchor. No pair is missed: `anchors`.
    """
    shape = Shape(least)
    found = shared_anchors(units, shape)
    pairs = found.where("b IS NOT NULL").select("a", "b")
    many = found.where("b IS NULL").select(F.col("a").alias("unit"), "key")
    if not many.isEmpty():
        # Anchors that many share: only units with the same whole window go together, so every pair is a true one.
        held = held_windows(units, many, shape).select("key", "unit", F.lit(0).alias("salt"), F.lit(False).alias("hot"))
        held = held.repartition("key").sortWithinPartitions("key", "unit")
        held = materialize(held.mapInArrow(groups.grouped(GROUP), "key long, a long, b long"))
        pairs = pairs.unionByName(held.where("b IS NOT NULL").select("a", "b"))
        alike = held.where("b IS NULL").select("key", "a")
        if not alike.isEmpty():
            pairs = pairs.unionByName(alike.join(alike.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b"))
    pairs = materialize(pairs.distinct())
    named = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    texts = materialize(join_small(units, named, "unit"))
    both = join_small(texts.select(F.col("unit").alias("a"), F.col("tokens").alias("tokens_a")), pairs, "a")
    both = both.join(texts.select(F.col("unit").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(
        _verify(least), "unit_a long, unit_b long, of_b boolean, start long, end long"
    )


def shared_pairs(units: DataFrame, least: int) -> DataFrame:
    """Records that share a span: `key_a` < `key_b`."""
    df = shared_spans(units, least).where("NOT of_b")
    a, b = (F.shiftrightunsigned(f"unit_{s}", PIECE_BITS) for s in "ab")
    return df.select(F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")).where("key_a < key_b").distinct()


def shared_windows(units: DataFrame, least: int) -> DataFrame:
    """(`unit`, `at`): the windows of `least` tokens that another record has too.

    The windows around shared anchors are grouped by their 64-bit hash; a window stays if its smallest and its largest
    record differ. No pairs of records are made, and a window that very many have is aggregated before the shuffle.
    """
    shape = Shape(least)
    found = shared_anchors(units, shape)
    # Units of groups up to GROUP come as pairs without their key: all of their anchors count.
    some = found.where("b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    own = units.mapInArrow(_keys(shape, np.empty(0, np.int64)), groups.KEYS).select("key", "unit")
    many = found.where("b IS NULL").select(F.col("a").alias("unit"), "key")
    keys = join_small(own, some, "unit").select("unit", "key").unionByName(many)
    held = materialize(held_windows(units, keys, shape))
    record = F.shiftrightunsigned("unit", PIECE_BITS)
    again = held.groupBy("key").agg(F.min(record).alias("lo"), F.max(record).alias("hi")).where("lo < hi")
    return held.join(again.select("key"), "key").select("unit", "at")


def stretches(shared: DataFrame, least: int) -> DataFrame:
    """(`key`, `start`, `end`): places of a record that its shared windows (`unit`, `at`) cover, merged."""
    key, piece = F.shiftrightunsigned("unit", PIECE_BITS), F.col("unit").bitwiseAND((1 << PIECE_BITS) - 1)
    rows = shared.select(key.alias("key"), (F.col("at") + piece * PIECE).alias("at")).distinct()
    own = W.partitionBy("key").orderBy("at")
    rows = rows.withColumn("new", (F.col("at") - F.lag("at").over(own) > least).cast("int"))
    rows = rows.withColumn("part", F.sum(F.coalesce("new", F.lit(1))).over(own))
    return rows.groupBy("key", "part").agg(F.min("at").alias("start"), (F.max("at") + least).alias("end")).drop("part")


def shared_lengths(units: DataFrame, least: int) -> DataFrame:
    """(`key`, `shared`): tokens of each record that lie in a stretch of at least `least` that another record has too.

    For units made by `text_units`. Records that share nothing are absent.
    """
    rows = stretches(shared_windows(units, least), least)
    return rows.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("shared"))


def shared_places(units: DataFrame, least: int) -> DataFrame:
    """(`key`, `shared`): as `shared_lengths`, for units made by `list_units`: tokens are told apart by their places."""
    rows = shared_windows(units, least).join(units, "unit")
    held = F.expr(f"slice(tokens.place, cast(at + 1 AS INT), {least})")
    places = rows.select(F.shiftrightunsigned("unit", PIECE_BITS).alias("key"), F.explode(held).alias("place")).distinct()
    return places.groupBy("key").agg(F.count("*").alias("shared"))


def shared_classes(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(`key`, `class_id`, `n_links`): each record once, with the smallest key of those of the same text and the number of
    other texts that share a span with it. Copies are not expanded into pairs."""
    rows = df.where(F.col(key).isNotNull() & (F.length(text) >= least))
    same = rows.groupBy(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")).agg(F.min(key).alias("class_id"))
    named = rows.select(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")).distinct()
    member = materialize(named.join(same, ["h1", "h2"]).select("key", "class_id"))
    first = rows.join(member.where("key = class_id").select(F.col("key").alias(key)), key, "left_semi")
    pairs = shared_pairs(text_units(first, key, text, least), least)
    ends = pairs.select(F.explode(F.array("key_a", "key_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return member.join(ends, "class_id", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
