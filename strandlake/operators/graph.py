"""The de Bruijn graph that a set of k-mers implies: edges, connected components, component cutting, unitigs.

Vertices are canonical LONG codes; two are joined if one follows the other on either strand. Everything is joins on
codes; iterations write their state to the shared folder each round, so lineage stays short and lost executors cost one
round. `keys` in these functions are columns (a sample, a component) that keep graphs apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.functions.runs import flipped, split
from strandlake.functions.windows import window_rows
from strandlake.runtime import discard, join_small, materialize, numbered


def oriented(vertices: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `fw`, `rc`): each k-mer once for either strand; a k-mer that is its own complement once."""
    both = vertices.select(*keys, "kmer").withColumn("rc", dna.code_revcomp("kmer", k))
    both = both.select(*keys, F.col("kmer").alias("fw"), "rc")
    return both.unionByName(both.where("fw <> rc").select(*keys, F.col("rc").alias("fw"), F.col("fw").alias("rc")))


def steps(nodes: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `fw`, `rc`, `next_fw`, `next_rc`, `next`): the four possible followers of each oriented k-mer."""
    each = []
    for letter in range(4):
        fw, rc = dna.code_step("fw", "rc", k, letter)
        each.append(F.struct(fw.alias("next_fw"), rc.alias("next_rc")))
    rows = nodes.select(*keys, "fw", "rc", F.explode(F.array(*each)).alias("s"))
    rows = rows.select(*keys, "fw", "rc", "s.next_fw", "s.next_rc")
    return rows.withColumn("next", F.least("next_fw", "next_rc"))


def edges(vertices: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `src`, `dst`): both directions of every edge between different vertices.

    Only the followers with a larger code look for their vertex, and the reverse is added: half the shuffle.
    """
    rows = steps(oriented(vertices, k, *keys), k, *keys)
    rows = rows.select(*keys, F.least("fw", "rc").alias("src"), F.col("next").alias("dst")).where("dst > src").distinct()
    rows = rows.join(vertices.select(*keys, F.col("kmer").alias("dst")).distinct(), [*keys, "dst"], "left_semi")
    return rows.select(*keys, "src", "dst").unionByName(
        rows.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    )


#: Edges up to which the rest of a graph is finished in one task: 16 bytes each there.
ONE_TASK = 4_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node of each one's component: hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            ahead = root[root]
            if (ahead == root).all():
                break
            root = ahead
    return nodes, nodes[root]


def _contract(rows: int | None):
    """Edges to stars, in chunks of so many rows or all of a partition together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if rows and count >= rows:
                yield star(held)
                held, count = [], 0
        if held:
            yield star(held)

    def star(held) -> pa.RecordBatch:
        node, root = roots(*(np.concatenate(x) for x in zip(*held)))
        far = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["u", "v"])

    return work


def connected(edge_rows: DataFrame) -> DataFrame:
    """(`node`, `label`) of every node with an edge (`src`, `dst`); the label is the smallest node of the component.

    Edges first contract to stars inside tasks. Up to ONE_TASK edges that are left are finished in one task. More go through alternating large-star and small-star
    joins: every round points the larger neighbours of a node at its smallest, then all smaller ones. The number of
    rounds grows with the logarithm of the graph, not with its diameter, and the edges never become more.
    """
    now = edge_rows.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now = materialize(now.mapInArrow(_contract(2_000_000), "u long, v long").distinct())
    said, n = None, now.count()
    while n > ONE_TASK:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        n, new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == said:
            break
        said = new
    if n <= ONE_TASK:
        now = materialize(now.coalesce(1).mapInArrow(_contract(None), "u long, v long"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def labelled(vertices: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """`vertices` with `label`; a vertex without an edge is a component of its own."""
    known = connected(edge_rows).select(F.col("node").alias("kmer"), "label")
    return vertices.join(known, "kmer", "left").withColumn("label", F.coalesce("label", "kmer"))


def cut_components(counts: DataFrame, k: int, least: int = 1000, most: int = 10000) -> tuple[DataFrame, DataFrame]:
    """Components of (`kmer`, `freq`) of `least` to `most` k-mers, cutting larger ones at rising frequencies.

    At threshold t all remaining k-mers' components are found together: smaller ones are dropped, fitting ones kept with
    threshold t, and of larger ones the k-mers of frequency t + 1 or more go on to the next level; thresholds between
    frequencies that occur are passed over. Returns
    (`comp_no`, `size`, `weight`, `freq_threshold`) and (`comp_no`, `kmer`); numbers follow threshold, then descending
    weight and size, then the smallest k-mer.
    """
    now = materialize(counts.select("kmer", "freq"))
    edge_rows = materialize(edges(now, k))
    kept: list[DataFrame] = []
    t = 1
    while True:
        rows = materialize(labelled(now, edge_rows))
        sizes = rows.groupBy("label").agg(F.count("*").alias("size"), F.sum("freq").alias("weight"))
        sizes = sizes.where(F.col("size") >= least)
        fit = sizes.where(F.col("size") <= most)
        kept.append(rows.join(fit, "label").withColumn("freq_threshold", F.lit(t)).select("kmer", "label", "size", "weight", "freq_threshold"))
        large = sizes.where(F.col("size") > most).select("label")
        rest = rows.join(large, "label", "left_semi")
        low = rest.agg(F.min("freq")).first()[0]
        if low is None:
            break
        # Thresholds up to the least frequency that is left take nothing away.
        t = max(t, low)
        now = materialize(rest.where(F.col("freq") > t).select("kmer", "freq"))
        if now.isEmpty():
            break
        for side in ("src", "dst"):
            edge_rows = edge_rows.join(now.select(F.col("kmer").alias(side)), side, "left_semi").select("src", "dst")
        edge_rows = materialize(edge_rows)
        t += 1
    every = materialize(reduce(DataFrame.unionByName, kept))
    return number_components(every)


def number_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component rows and k-mer rows of (`kmer`, `label`, `size`, `weight`, `freq_threshold`), numbered from 1 in order."""
    comps = rows.groupBy("freq_threshold", "label").agg(F.first("size").alias("size"), F.first("weight").alias("weight"))
    comps = comps.withColumns({"__w": -F.col("weight"), "__s": -F.col("size")})
    comps = numbered(comps, ["freq_threshold", "__w", "__s", "label"], "comp_no", 1).withColumn("comp_no", F.col("comp_no").cast("int"))
    comps = materialize(comps.select("comp_no", "size", "weight", "freq_threshold", "label"))
    kmers = rows.join(comps.select("comp_no", "freq_threshold", "label"), ["freq_threshold", "label"]).select("comp_no", "kmer")
    return comps.drop("label"), kmers


def colored_components(
    colors: DataFrame, k: int, share: float = 0.9, n_groups: int = 3, separate: bool = False, n_comps: int = -1
) -> DataFrame:
    """(`color`, `label`, `kmer`): components grown around the k-mers of each colour.

    `colors` has (`kmer`, `c0`, `c1`, `c2`). For a colour the graph has its own k-mers and, unless `separate`, the
    neutral ones, which several colours may share; only components with a k-mer of the colour stay. With `n_comps` above
    0 those with the smallest k-mers are kept, so many per colour.
    """
    named = materialize(colors.select("kmer", dna.dominant_color("c0", "c1", "c2", share=share).alias("color")))
    edge_rows = materialize(edges(named, k))
    out = []
    for c in range(n_groups):
        fit = F.col("color") == c if separate else F.col("color").isin(c, -1)
        own = named.where(fit)
        links = edge_rows
        for side in ("src", "dst"):
            links = links.join(own.select(F.col("kmer").alias(side)), side, "left_semi")
        rows = materialize(labelled(own, links.select("src", "dst")))
        seeds = rows.where(F.col("color") == c).select("label").distinct()
        if n_comps > 0:
            seeds = seeds.orderBy("label").limit(n_comps)
        out.append(rows.join(seeds, "label", "left_semi").select(F.lit(c).alias("color"), "label", "kmer"))
    return reduce(DataFrame.unionByName, out)


def extensions(vertices: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `fw`, `rc`, `n_right`, `next_fw`): how many vertices follow each oriented k-mer, and which if one."""
    nodes = oriented(vertices, k, *keys)
    there = vertices.select(*keys, F.col("kmer").alias("next")).distinct()
    found = steps(nodes, k, *keys).join(there, [*keys, "next"], "left_semi").distinct()
    found = found.groupBy(*keys, "fw").agg(F.count("*").alias("n_right"), F.max("next_fw").alias("next_fw"))
    return nodes.join(found, [*keys, "fw"], "left").fillna(0, ["n_right"])


def branching(vertices: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `kmer`): vertices with more than one follower on either side."""
    rows = extensions(vertices, k, *keys).where("n_right > 1")
    return rows.select(*keys, F.least("fw", "rc").alias("kmer")).distinct()


#: Oriented k-mers that are joined to pieces together, and letters of the shared words that bring neighbours together.
PIECE_ROWS, WORD = 1 << 20, 10
LETTERS = np.frombuffer(b"ACGT", np.uint8)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def joints(fw: np.ndarray, rc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k - 1 letters that k-mers share with those before and with those after, on the strand where they are smaller."""
    letters = (1 << (2 * k - 2)) - 1
    return np.minimum(fw >> 2, rc & letters), np.minimum(fw & letters, rc >> 2)


def nearness(joint: np.ndarray, k: int) -> np.ndarray:
    """A number that most neighbouring joints share: the smallest hash of the words of either strand."""
    m = min(WORD, k - 1)
    mask, best = (1 << (2 * m)) - 1, None
    for x in (joint, flipped(joint, k - 1)) if k > 1 else (joint,):
        for i in range(max(1, k - m)):
            word = ((x >> (2 * i)) & mask).astype(np.uint64) + np.uint64(1)
            word = (word ^ (word >> np.uint64(7))) * SPREAD
            word = (word ^ (word >> np.uint64(32))) >> np.uint64(1)
            best = word if best is None else np.minimum(best, word)
    return best.astype(np.int64)


def _placed(keys: list[str], k: int, hot: np.ndarray):
    """K-mers (keys, kmer, freq) with the places where their joints meet: once, or twice if these differ."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fw = batch.column(len(keys)).to_numpy()
            ends = joints(fw, flipped(fw, k), k)
            places = []
            for joint in ends:
                near = nearness(joint, k)
                # A word that very many joints share doesn't bring them together: each joint has a place of its own.
                own = ((joint.astype(np.uint64) + np.uint64(1)) * SPREAD >> np.uint64(1)).astype(np.int64)
                places.append(np.where(np.isin(near, hot), own, near) if len(hot) else near)
            same = places[0] == places[1]
            for rows, place, left, right in ((same, places[0], True, True), (~same, places[0], True, False), (~same, places[1], False, True)):
                n = int(rows.sum())
                some = batch.filter(pa.array(rows))
                columns = [*some.columns, pa.array(place[rows]), pa.array(np.full(n, left)), pa.array(np.full(n, right))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "kmer", "freq", "place", "left", "right"])

    return work


def _pieces(keys: list[str], k: int):
    """Join the k-mers of whole places to pieces: all k-mers that share a joint of a place are there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if count >= PIECE_ROWS:
                # Rows are sorted by place; a chunk ends where a place ends.
                place, last = batch["place"].to_numpy(), held[-1]["place"][-1].as_py()
                end = int(np.searchsorted(place, last, side="right")) if place[0] == last else 0
                held.append(batch.slice(0, end))
                if end < batch.num_rows:
                    yield from joined(pa.Table.from_batches(held).combine_chunks())
                    held, count = [], 0
                batch = batch.slice(end)
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
        if count:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.zeros(table.num_rows, np.int64)
        for c in keys:
            code = table[c].combine_chunks().dictionary_encode()
            group = group * (len(code.dictionary) + 1) + code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
        kmer, freq = table["kmer"].to_numpy(), table["freq"].to_numpy().astype(np.int64)
        # A k-mer whose two joints have different places may be here twice, if both places are in this chunk.
        order = np.lexsort((kmer, group))
        new = np.ones(len(order), bool)
        new[1:] = (kmer[order][1:] != kmer[order][:-1]) | (group[order][1:] != group[order][:-1])
        head = np.flatnonzero(new)
        sides = [np.logical_or.reduceat(table[c].to_numpy(zero_copy_only=False)[order], head) for c in ("left", "right")]
        row = order[head]
        kmer, freq, group = kmer[row], freq[row], group[row]
        rc = flipped(kmer, k)
        # Oriented k-mers; one that is its own complement once.
        twice = np.flatnonzero(rc != kmer)
        n = len(kmer)
        fw, other = np.concatenate([kmer, rc[twice]]), np.concatenate([rc, kmer[twice]])
        src = np.concatenate([np.arange(n), twice])
        before = np.concatenate([sides[0], sides[1][twice]])  # the joint on the left is complete here
        after = np.concatenate([sides[1], sides[0][twice]])
        before[:n] |= (rc == kmer) & sides[1]
        after[:n] |= (rc == kmer) & sides[0]
        owner = group[src]
        letters = (1 << (2 * k - 2)) - 1
        # Who leads into a joint, who out of it, read in the direction of the oriented k-mer.
        into = np.flatnonzero(after)
        out = np.flatnonzero(before)
        text = np.concatenate([fw[into] & letters, fw[out] >> 2])
        node = np.concatenate([into, out])
        kind = np.concatenate([np.zeros(len(into), np.int8), np.ones(len(out), np.int8)])
        own = owner[node]
        sort = np.lexsort((kind, text, own))
        text, node, kind, own = text[sort], node[sort], kind[sort], own[sort]
        cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (own[1:] != own[:-1])]) if len(text) else np.empty(0, np.int64)
        size = np.diff(np.r_[cut, len(text)])
        n_out = np.add.reduceat(kind.astype(np.int64), cut) if len(cut) else size
        one = cut[(size == 2) & (n_out == 1)]
        m = len(fw)
        prev = np.full(m, -1, np.int64)
        nxt = np.full(m, -1, np.int64)
        a, b = node[one], node[one + 1]
        nxt[a], prev[b] = b, a
        at = np.where(prev < 0, np.arange(m), prev)
        place = (prev >= 0).astype(np.int64)
        # Pointer doubling inside the chunk; what never reaches a first k-mer is a cycle.
        while True:
            ahead = at[at]
            moved = ahead != at
            if not moved.any() or place.max() > 2 * m:
                break
            place = place + np.where(moved, place[at], 0)
            at = ahead
        rows = np.flatnonzero(prev[at] < 0)
        if not len(rows):
            return
        rows = rows[np.lexsort((place[rows], at[rows]))]
        head = np.flatnonzero(np.r_[True, at[rows][1:] != at[rows][:-1]])
        tail = np.r_[head[1:], len(rows)] - 1
        first, final = rows[head], rows[tail]
        # A first k-mer whose joint on the left lies elsewhere is the last of another piece, which has its letter.
        open_ = ~before[first]
        length = np.diff(np.r_[head, len(rows)])
        keep = ~(open_ & (length == 1))
        inside = np.ones(len(rows), bool)
        inside[head[open_]] = False
        counted = rows[inside]
        own = np.repeat(np.arange(len(head)), length)[inside]
        own_first = np.searchsorted(own, np.flatnonzero(keep))
        if not keep.any():
            return
        text = LETTERS[fw[counted] & 3].tobytes()
        offsets = np.r_[own_first, len(counted)].astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(keep.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        f = freq[src[counted]]
        first, final, open_ = first[keep], final[keep], open_[keep]
        columns = [table[c].combine_chunks().take(pa.array(row[src[first]])) for c in keys]
        columns += [
            pa.array(fw[first]),
            pa.array(open_),
            pa.array(fw[final], mask=after[final]),
            pa.array(fw[final]),
            texts.cast(pa.large_string()).cast(pa.string()),
            pa.array(np.add.reduceat(f, own_first)),
            pa.array(np.minimum.reduceat(f, own_first)),
            pa.array(np.maximum.reduceat(f, own_first)),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*keys, *PIECE])

    return work


PIECE = ("head", "open", "next", "tail", "letters", "mass", "least", "most")
#: Share of the k-mers from which hot words are learned, and how often one must be seen there.
HOT_SAMPLE, HOT_SEEN = 0.01, 5_000


def pieces(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `head`, `open`, `next`, `tail`, `letters`, `mass`, `least`, `most`): parts of unbranched paths on either strand.

    K-mers meet at the k - 1 letters that they share. All that share a joint come to one place, named by a word in the
    joint that most neighbouring joints have too, so that one shuffle of k-mers (some twice) finds all joints and joins
    whole runs inside tasks. A piece whose last k-mer's next joint has its place elsewhere goes on (`next`) in the piece
    that starts `open` with this k-mer, which leaves its letter and frequency to the former.
    """
    kinds = dict(counts.dtypes)
    named = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    schema = named + f"kmer long, freq {kinds['freq']}, place long, left boolean, right boolean"
    rows = counts.select(*keys, "kmer", "freq")
    # The sample only decides where joints meet, alike for all k-mers.
    some = rows.sample(HOT_SAMPLE, 7).mapInArrow(_placed(list(keys), k, np.empty(0, np.int64)), schema)
    hot = some.groupBy("place").count().where(f"count >= {HOT_SEEN}").orderBy(F.desc("count")).limit(10_000).collect()
    rows = rows.mapInArrow(_placed(list(keys), k, np.array(sorted(r.place for r in hot), np.int64)), schema)
    rows = rows.repartition("place").sortWithinPartitions("place")
    return rows.mapInArrow(_pieces(list(keys), k), named + "head long, open boolean, next long, tail long, letters string, mass long, least long, most long")


def _ranked(keys: list[str]):
    """Of all pieces (keys, piece, to): the first piece of each one's path and how many lie before it; none for cycles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n, group = table.num_rows, np.zeros(table.num_rows, np.int64)
        for c in keys:
            code = table[c].combine_chunks().dictionary_encode()
            group = group * (len(code.dictionary) + 1) + code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
        piece, to = table["piece"].to_numpy(), table["to"].combine_chunks()
        source = np.flatnonzero(to.is_valid().to_numpy(zero_copy_only=False))
        wanted = to.drop_null().to_numpy()
        # The pieces that are wanted, found by sorting both kinds together.
        owner, name = np.r_[group, group[source]], np.r_[piece, wanted]
        kind, row = np.r_[np.zeros(n, np.int8), np.ones(len(source), np.int8)], np.r_[np.arange(n), source]
        sort = np.lexsort((kind, name, owner))
        owner, name, kind, row = owner[sort], name[sort], kind[sort], row[sort]
        hit = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 0) & (name[1:] == name[:-1]) & (owner[1:] == owner[:-1]))
        before = np.full(n, -1, np.int64)
        before[row[hit]] = row[hit + 1]
        at, place = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
        while True:
            ahead = at[at]
            moved = ahead != at
            if not moved.any() or place.max() > 2 * n:
                break
            place = place + np.where(moved, place[at], 0)
            at = ahead
        fine = np.flatnonzero(before[at] < 0)
        columns = [table[c].combine_chunks().take(pa.array(fine)) for c in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(piece[fine]), pa.array(piece[at[fine]]), pa.array(place[fine])], [*keys, "piece", "first", "place"])

    return work


def chains(parts: DataFrame, *keys: str) -> DataFrame:
    """`parts` with `start` (the head of the first piece of its path) and `place` (pieces before it).

    Pointer doubling on predecessors: each round joins only the pieces whose pointer doesn't end at a start yet, the
    logarithm of the longest path in rounds. Up to ONE_TASK pieces are ranked by one task, which sees no letters. Pieces of
    pure cycles, which no start leads to, are left out.
    """
    # A start and an open piece may have the same first k-mer.
    parts = parts.withColumn("piece", F.col("head") * 2 + F.col("open").cast("long"))
    if "to" not in parts.columns:
        parts = parts.withColumn("to", F.col("next") * 2 + 1)
    if parts.count() <= ONE_TASK:
        kinds = dict(parts.dtypes)
        schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "piece long, first long, place long"
        ends = materialize(parts.select(*keys, "piece", "to").coalesce(1).mapInArrow(_ranked(list(keys)), schema))
        return _placed_pieces(parts, ends, keys)
    links = parts.where("to IS NOT NULL").select(*keys, F.col("to").alias("piece"), F.col("piece").alias("before"))
    now = materialize(
        parts.select(*keys, "piece", "open").join(links, [*keys, "piece"], "left").select(
            *keys,
            "piece",
            F.coalesce("before", "piece").alias("at"),
            F.col("before").isNotNull().cast("long").alias("place"),
            F.col("before").isNull().alias("done"),
        )
    )
    left = now.where("NOT done").count()
    while left:
        ahead = now.select(*keys, F.col("piece").alias("at"), F.col("at").alias("at2"), F.col("place").alias("place2"), F.col("done").alias("done2"))
        moved = now.where("NOT done").join(ahead, [*keys, "at"])
        moved = moved.select(*keys, "piece", F.col("at2").alias("at"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"))
        former, now = now, materialize(now.where("done").unionByName(moved))
        discard(former)
        open_before, left = left, now.where("NOT done").count()
        if left == open_before:
            break
    return _placed_pieces(parts, now.where("done").select(*keys, "piece", F.col("at").alias("first"), "place"), keys)


def _placed_pieces(parts: DataFrame, ends: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Null keys are groups of their own, so they meet as equal."""
    if not keys:
        return parts.join(ends, "piece").withColumn("start", F.shiftright("first", 1))
    one, two = parts.alias("p"), ends.alias("e")
    same = F.col("p.piece") == F.col("e.piece")
    for c in keys:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))
    return one.join(two, same).select("p.*", "e.first", "e.place").withColumn("start", F.shiftright("first", 1))


def unitigs(counts: DataFrame, k: int, min_length: int = 0, *keys: str) -> DataFrame:
    """(`keys`, `seq`, `length`, `av_weight`, `min_weight`, `max_weight`, `kmers`, `sum_weight`) of the maximal unbranched paths.

    `counts` has (`keys`, `kmer`, `freq`), each k-mer once per key. One strand of each: that which starts at the smaller
    of the canonical end k-mers, or, if these are the same, the smaller sequence. Weights are of the k-mers' frequencies,
    the mean cut to a whole number. Pure cycles give none.
    """
    return united(materialize(pieces(counts, k, *keys)), k, min_length, *keys)


def united(table: DataFrame, k: int, min_length: int = 0, *keys: str) -> DataFrame:
    """The unitigs that pieces make up."""
    rows = chains(table, *keys)
    parts = F.sort_array(F.collect_list(F.struct("place", "letters")))
    found = rows.groupBy(*keys, "start", "first").agg(
        F.array_join(F.transform(parts, lambda x: x["letters"]), "").alias("letters"),
        F.max_by("tail", "place").alias("end"),
        F.sum("mass").alias("mass"),
        F.min("least").alias("min_weight"),
        F.max("most").alias("max_weight"),
    )
    found = found.withColumns({"kmers": F.length("letters").cast("long"), "one": F.least("start", dna.code_revcomp("start", k))})
    found = found.withColumns({"two": F.least("end", dna.code_revcomp("end", k)), "seq": F.concat(dna.decode("start", k), F.expr("substring(letters, 2)"))})
    found = found.where((F.col("one") < F.col("two")) | ((F.col("one") == F.col("two")) & (F.col("seq") <= dna.revcomp("seq"))))
    mean = F.expr("mass DIV kmers").alias("av_weight")
    out = found.select(*keys, "seq", F.length("seq").alias("length"), mean, "min_weight", "max_weight", "kmers", F.col("mass").alias("sum_weight"))
    return out.where(F.col("length") >= min_length).distinct()


def plain_unitigs(reads: DataFrame, k: int, min_length: int = 0) -> DataFrame:
    """What `unitigs` gives for all k-mers of reads (`sample`, `seq`) but those at forks, with the number of samples as frequency.

    K-mers that no other read touches stay together as their read has them; only the others are counted and joined.
    """
    rows = split(reads, k, min_length)
    core = rows.where("kind = 0").select("kmer", "sample").repartition("kmer")
    core = materialize(core.groupBy("kmer").agg(F.count_distinct("sample").cast("int").alias("freq")))
    # A piece goes on where its last k-mer is the head of an open one; a piece of a read says which one follows.
    ends = pieces(core, k).withColumn("to", F.coalesce("next", "tail") * 2 + 1).drop("next")
    one = F.lit(1).cast("long")
    inner = rows.where("kind = 1").select(
        F.col("kmer").alias("head"), "open", "tail", F.col("text").alias("letters"), F.col("kmers").alias("mass"), one.alias("least"), one.alias("most"), "to"
    )
    every = materialize(ends.unionByName(inner))
    discard(core)
    joined = united(every, k, min_length)
    alone = rows.where("kind = 2").select(
        F.col("text").alias("seq"), F.length("text").alias("length"), one.alias("av_weight"), one.alias("min_weight"), one.alias("max_weight"), "kmers", F.col("kmers").alias("sum_weight")
    )
    return joined.unionByName(alone)


def links(units: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `a`, `a_strand`, `b`, `b_strand`): which unitigs (`keys`, `id`, `seq`) overlap by k - 1 letters end to end.

    One of the two readings of a link, the one with the smaller (a, strand).
    """
    ends = []
    for strand, seq in (("+", F.col("seq")), ("-", dna.revcomp("seq"))):
        ends.append(units.select(*keys, "id", F.lit(strand).alias("strand"), F.substring(seq, 1, k - 1).alias("head"), F.right(seq, F.lit(k - 1)).alias("tail")))
    both = ends[0].unionByName(ends[1])
    a = both.select(*keys, F.col("id").alias("a"), F.col("strand").alias("a_strand"), F.col("tail").alias("over"))
    b = both.select(*keys, F.col("id").alias("b"), F.col("strand").alias("b_strand"), F.col("head").alias("over"))
    out = a.join(b, [*keys, "over"]).drop("over")
    flip = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    here, there = F.struct("a", "a_strand", "b", "b_strand"), F.struct(
        F.col("b").alias("a"), flip("b_strand").alias("a_strand"), F.col("a").alias("b"), flip("a_strand").alias("b_strand")
    )
    return out.select(*keys, F.least(here, there).alias("l")).select(*keys, "l.*").distinct()


def n50(lengths: DataFrame, length: str = "length") -> DataFrame:
    """`n50`: the length at which the longest sequences make up half of all letters.

    Running sums over the distinct lengths, of which there are few, not over the sequences.
    """
    from pyspark.sql import Window as W

    rows = lengths.groupBy(F.col(length).alias("len")).agg(F.sum(length).alias("mass"))
    down = W.partitionBy(F.lit(0)).orderBy(F.desc("len"))
    rows = rows.withColumns({"upto": F.sum("mass").over(down), "every": F.sum("mass").over(W.partitionBy(F.lit(0)))})
    return rows.where("2 * upto >= every").agg(F.max("len").cast("long").alias("n50"))


def sequence_components(sequences: DataFrame, k: int, key: str) -> DataFrame:
    """(`key`, `size`, `weight`, `kmers`): each sequence as the set of its canonical k-mers; weight counts repeats."""
    w = F.transform(dna.windows("seq", k), lambda x: dna.encode(F.least(x, F.reverse(F.translate(x, "ACGT", "TGCA")))))
    rows = sequences.where(F.length("seq") >= k).select(key, w.alias("w"))
    return rows.select(key, F.size(F.array_distinct("w")).cast("long").alias("size"), F.size("w").cast("long").alias("weight"), F.sort_array(F.array_distinct("w")).alias("kmers"))


def paths(sequences: DataFrame, component_kmers: DataFrame, k: int, key: str, min_length: int = 50, most: int | None = None) -> DataFrame:
    """(`comp_no`, `key`, `start`, `length`, `path`): runs of consecutive k-mers of a sequence that lie in a component.

    Gaps and islands: places of found k-mers minus their row number. `most` keeps the longest so many per component.
    """
    from pyspark.sql import Window as W

    rows = window_rows(sequences, k, key)
    inside = rows.join(component_kmers.select("comp_no", "kmer").distinct(), "kmer").select("comp_no", key, "place")
    own = W.partitionBy("comp_no", key).orderBy("place")
    inside = inside.withColumn("island", F.col("place") - F.row_number().over(own))
    found = inside.groupBy("comp_no", key, "island").agg(F.min("place").alias("start"), (F.count("*") + k - 1).alias("length"))
    found = found.where(F.col("length") >= min_length).join(sequences.select(key, "seq"), key)
    found = found.select("comp_no", key, "start", "length", F.expr("substring(seq, cast(start + 1 AS INT), cast(length AS INT))").alias("path"))
    if most:
        rank = F.row_number().over(W.partitionBy("comp_no").orderBy(F.desc("length"), key, "start"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return found


def position_coverage(positions: DataFrame, alignments: DataFrame, *keys: str) -> DataFrame:
    """`positions` (`keys`, `pos`) with `depth`: how many intervals (`keys`, `start`, `end`, both inside) cover each.

    Begin and end events, summed along each contig; no interval is expanded into its positions.
    """
    from pyspark.sql import Window as W

    events = alignments.select(*keys, F.col("start").alias("pos"), F.lit(1).alias("e")).unionByName(
        alignments.select(*keys, (F.col("end") + 1).alias("pos"), F.lit(-1).alias("e"))
    )
    events = events.groupBy(*keys, "pos").agg(F.sum("e").alias("e"))
    # A contig is summed in stretches of places; what stands before a stretch comes from the stretches' sums.
    chunk = F.expr(f"pos DIV {STRETCH}").alias("__chunk")
    sums = events.groupBy(*keys, chunk).agg(F.sum("e").alias("e"))
    rows = positions.select(*keys, "pos", F.lit(True).alias("asked")).join(events, [*keys, "pos"], "full").withColumn("__chunk", chunk)
    asked = rows.select(*keys, "__chunk").distinct()
    until = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = asked.join(sums, [*keys, "__chunk"], "left").select(*keys, "__chunk", F.coalesce(F.sum("e").over(until), F.lit(0)).alias("__before"))
    run = W.partitionBy(*keys, "__chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("depth", F.coalesce(F.sum("e").over(run), F.lit(0))).where("asked")
    return rows.join(sums, [*keys, "__chunk"]).select(*keys, "pos", (F.col("depth") + F.col("__before")).alias("depth"))


#: Places of a contig that one task sums.
STRETCH = 1 << 16


def sequence_stats(sequences: DataFrame, *keys: str) -> DataFrame:
    """(`keys`, `n`, `letters`, `longest`, `kmers`, `sum_weight`, `n50`) of unitigs."""
    rows = sequences.groupBy(*keys, "length").agg(
        F.count("*").alias("c"), F.sum("length").alias("mass"), F.sum("kmers").alias("k"), F.sum("sum_weight").alias("w")
    )
    from pyspark.sql import Window as W

    own = W.partitionBy(*(keys or [F.lit(0)]))
    rows = rows.withColumns({"upto": F.sum("mass").over(own.orderBy(F.desc("length"))), "every": F.sum("mass").over(own)})
    return rows.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum("mass").alias("letters"),
        F.max("length").cast("long").alias("longest"),
        F.sum("k").alias("kmers"),
        F.sum("w").alias("sum_weight"),
        F.max(F.when(2 * F.col("upto") >= F.col("every"), F.col("length"))).cast("long").alias("n50"),
    )


def component_graph(component_kmers: DataFrame, k: int, counts: DataFrame | None = None, mode: str = "samples") -> tuple[DataFrame, DataFrame]:
    """The compacted graph of each component: segments (`comp_no`, `id`, `seq`, `length`, `coverage`) and links (`comp_no`,
    `a`, `a_strand`, `b`, `b_strand`).

    Ids are `n_i<comp_no>`, n counting the component's sequences in their order. `mode`: what a k-mer's coverage is: the
    number of `samples` of `counts` that have it, its summed `freq`, or `one`, which needs no counts. A sequence's coverage
    is that of its k-mers, the last one counting k times. Pure cycles give no segment.
    """
    rows = component_kmers.where("comp_no IS NOT NULL AND kmer IS NOT NULL").select("comp_no", "kmer").distinct()
    if mode == "one" or counts is None:
        depth = rows.select("kmer").distinct().withColumn("freq", F.lit(1).cast("long"))
    else:
        amount = {"samples": F.count_distinct("sample"), "freq": F.least(F.sum("freq"), F.lit(dna.FREQ_MAX)).cast("long")}[mode]
        depth = counts.groupBy("kmer").agg(amount.alias("freq"))
    units = unitigs(rows.withColumn("freq", F.lit(1)), k, k, "comp_no")
    units = materialize(numbered(units.select("comp_no", "seq"), ["comp_no", "seq"], "no", 1))
    first = units.groupBy("comp_no").agg(F.min("no").alias("first"))
    name = F.concat((F.col("no") - F.col("first") + 1).cast("string"), F.lit("_i"), F.col("comp_no").cast("string"))
    units = materialize(join_small(units, first, "comp_no").select("comp_no", name.alias("id"), "seq"))
    places = window_rows(units, k, "comp_no", "id").join(depth, "kmer", "left").fillna(0, ["freq"])
    size = units.select("comp_no", "id", "seq", F.length("seq").alias("length"))
    total = F.sum(F.col("freq") * F.when(F.col("place") == F.col("length") - k, k).otherwise(1)).cast("long").alias("coverage")
    sums = places.join(size.select("comp_no", "id", "length"), ["comp_no", "id"]).groupBy("comp_no", "id").agg(total)
    return size.join(sums, ["comp_no", "id"]).select("comp_no", "id", "seq", "length", "coverage"), links(units, k, "comp_no")


def compared(contigs: DataFrame, component_kmers: DataFrame, alignments: DataFrame, k: int, key: str) -> DataFrame:
    """(`key`, `pos`, `comp_no`, `depth`): for every k-mer of contigs (`key`, `seq`) its place from 0, the component that
    holds it (0: none; of several the smallest) and how many alignments (`key`, `start`, `end`, places from 1) cover its last
    letter."""
    rows = window_rows(contigs, k, key)
    own = component_kmers.where("kmer IS NOT NULL").groupBy("kmer").agg(F.min("comp_no").alias("comp_no"))
    rows = rows.join(own, "kmer", "left").select(key, (F.col("place") + k).alias("pos"), F.coalesce("comp_no", F.lit(0)).alias("comp_no"))
    rows = materialize(rows)
    depth = position_coverage(rows, alignments, key)
    return rows.join(depth, [key, "pos"]).select(key, (F.col("pos") - k).alias("pos"), "comp_no", "depth")


def comparison(rows: DataFrame) -> DataFrame:
    """One row of what `compared` gives: `both`, `only_reads`, `only_components`."""
    there, read = F.col("comp_no") > 0, F.col("depth") > 0
    return rows.agg(F.count_if(there & read).alias("both"), F.count_if(~there & read).alias("only_reads"), F.count_if(there & ~read).alias("only_components"))


def leftward_walk(counts: DataFrame, fragment: str, k: int, bound: int, shift: int = 0, distance: int = 50) -> DataFrame:
    """(`depth`, `n_kmers`, `freq`): k-mers found leftwards of a constant fragment, by depth, the start being depth 1.

    `counts` (`kmer`, `freq`) has canonical codes. The fragment's k-mers but the first gain bound + 1, so that they pass;
    the walk starts at the k-mer `shift` letters into the fragment and takes forward k-mers whose count is above `bound`,
    down to depth `distance` + `shift`.
    """
    spark = counts.sparkSession
    if len(fragment) < shift + k:
        raise ValueError("the fragment is shorter than its start")
    own = spark.createDataFrame([(fragment, i) for i in range(len(fragment) - k + 1)], "seq string, i int")
    own = own.select("i", F.expr(f"substring(seq, i + 1, {k})").alias("w")).select("i", dna.encode("w").alias("fw"), dna.encode(dna.canonical("w")).alias("kmer"))
    gain = own.where("i > 0").groupBy("kmer").agg(F.lit(bound + 1).cast("long").alias("freq"))
    all_counts = counts.select("kmer", F.col("freq").cast("long").alias("freq")).unionByName(gain).groupBy("kmer").agg(F.least(F.sum("freq"), F.lit(dna.FREQ_MAX)).alias("freq"))
    start = own.where(F.col("i") == shift).select(F.col("fw").alias("kmer"), F.col("kmer").alias("own"))
    first = start.join(all_counts.withColumnRenamed("kmer", "own"), "own", "left").select("kmer", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
    have = all_counts.where(F.col("freq") > bound)
    both = have.unionByName(have.select(dna.code_revcomp("kmer", k).alias("kmer"), "freq")).distinct()
    both = both.join(first.select("kmer"), "kmer", "left_anti").unionByName(first)
    rows = leftward_levels(both, first, k, distance + shift - 1)
    return rows.select((F.col("depth") + 1).alias("depth"), "n_kmers", "freq")


def leftward_levels(counts: DataFrame, seeds: DataFrame, k: int, depth: int) -> DataFrame:
    """(`depth`, `n_kmers`, `freq`): k-mers first reached by so many steps to the left of the seeds, and their frequencies.

    `counts` has forward codes (`kmer`, `freq`), `seeds` forward codes (`kmer`). A bounded breadth-first walk: each level is a
    join of the last level's four predecessors with the counts, without those reached before.
    """
    have = materialize(counts.select("kmer", "freq"))
    level = have.join(seeds.select("kmer"), "kmer", "left_semi")
    seen = materialize(level.withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        last = seen.where(F.col("depth") == step - 1)
        before = F.array(*[F.shiftright("kmer", 2).bitwiseOR(F.lit(n << (2 * k - 2)).cast("long")) for n in range(4)])
        fresh = last.select(F.explode(before).alias("kmer")).distinct()
        fresh = have.join(fresh, "kmer", "left_semi").join(seen.select("kmer"), "kmer", "left_anti")
        seen = materialize(seen.unionByName(fresh.withColumn("depth", F.lit(step))))
    return seen.groupBy("depth").agg(F.count("*").alias("n_kmers"), F.sum("freq").cast("long").alias("freq"))


