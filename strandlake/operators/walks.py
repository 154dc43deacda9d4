"""Greedy walks from given k-mers: inherently sequential inside a connected component, parallel over components.

Both walks take a component's starts in ascending order, so results don't depend on partitioning. A component must fit
in one task; its k-mers and their frequencies are 16 bytes each.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.graph import edges, flipped, labelled
from strandlake.runtime import materialize, numbered


class Strands:
    """The k-mers of one component as an oriented graph over forward codes, worked out for all k-mers together."""

    def __init__(self, kmers, k: int):
        own = np.unique(np.array(list(kmers), np.int64))
        other = flipped(own, k)
        fw = np.concatenate([own, other])
        self.have = set(own.tolist())
        self.rc = dict(zip(fw.tolist(), np.concatenate([other, own]).tolist()))
        self.low = dict(zip(fw.tolist(), np.concatenate([own, own]).tolist()))
        self.ahead: dict[int, list[int]] = {x: [] for x in self.rc}
        fw = np.unique(fw)
        for letter in range(4):
            after = ((fw << 2) & ((1 << (2 * k)) - 1)) | letter
            there = np.isin(np.minimum(after, flipped(after, k)), own)
            for x, y in zip(fw[there].tolist(), after[there].tolist()):
                self.ahead[x].append(y)

    def flip(self, fw: int) -> int:
        return self.rc[fw]

    def canonical(self, fw: int) -> int:
        return self.low[fw]

    def after(self, fw: int) -> list[int]:
        """Forward codes of the k-mers that follow on the right, by letter."""
        return self.ahead[fw]

    def run(self, fw: int, taken: set[int], here: set[int] = frozenset()) -> list[int]:
        """The unbranched path from fw on (fw included), up to a fork, an end or a k-mer that is taken or `here`."""
        path, own = [fw], {self.canonical(fw)}
        while len(ahead := self.after(path[-1])) == 1:
            c = self.canonical(ahead[0])
            if c in taken or c in own or c in here:
                break
            own.add(c)
            path.append(ahead[0])
        return path


def grow(graph: Strands, pivots: list[int], depth: int) -> list[tuple[list[int], int]]:
    """Components (k-mers, pivots in them) around the pivots.

    From a pivot both ways: an unbranched path is followed whatever it holds. At a fork each branch is probed and joins
    if its path meets a pivot after its first k-mer; growth goes on from its end. With depth 1 a probe is the branch's
    unbranched run; with more it may pass depth - 1 further forks and takes the path with most pivots (the first by
    letters among equals). Probed k-mers are used up whether they join or not.
    """
    special, taken, out = set(pivots), set(), []

    def probe(fw: int, left: int) -> tuple[list[int], int, list[int]]:
        """Best path from fw, its pivots after the first k-mer, and all k-mers looked at."""
        path = graph.run(fw, taken)
        seen = [graph.canonical(x) for x in path]
        hits = sum(c in special for c in seen[1:])
        best: tuple[list[int], int] = ([], 0)
        if left > 1:
            own = set(seen)
            for x in graph.after(path[-1]):
                c = graph.canonical(x)
                if c in taken or c in own:
                    continue
                more, found, looked = probe(x, left - 1)
                found += c in special
                seen += looked
                own.update(looked)
                if found > best[1]:
                    best = more, found
        return path + best[0], hits + best[1], seen

    for pivot in sorted(special & graph.have):
        if pivot in taken:
            continue
        members = [pivot]
        taken.add(pivot)
        ends = deque([pivot, graph.flip(pivot)])
        while ends:
            ahead = [x for x in graph.after(ends.popleft()) if graph.canonical(x) not in taken]
            if len(ahead) == 1:
                path = graph.run(ahead[0], taken)
                fresh = [graph.canonical(x) for x in path]
                members += fresh
                taken.update(fresh)
                ends.append(path[-1])
                continue
            for x in ahead:
                if graph.canonical(x) in taken:
                    continue
                path, hits, seen = probe(x, depth)
                if hits:
                    fresh = list(dict.fromkeys(graph.canonical(y) for y in path if graph.canonical(y) not in taken))
                    members += fresh
                    ends.append(path[-1])
                taken.update(seen)
        out.append((members, sum(c in special for c in members)))
    return out


def linear(graph: Strands, own: list[int]) -> list[list[int]]:
    """Unbranching components around a colour's k-mers: at a fork the branch whose run holds most of them goes on; the walk
    ends there if no branch holds any.

    A k-mer of the colour joins one component only; others may join several, but each only once, so a cycle ends where it
    closes.
    """
    special, taken, out = set(own), set(), []
    for start in sorted(special & graph.have):
        if start in taken:
            continue
        members, here = [start], {start}
        taken.add(start)
        for end in (start, graph.flip(start)):
            while True:
                ahead = [x for x in graph.after(end) if graph.canonical(x) not in taken and graph.canonical(x) not in here]
                if not ahead:
                    break
                runs = [graph.run(x, taken, here) for x in ahead]
                held = [sum(graph.canonical(x) in special for x in p) for p in runs]
                if len(runs) > 1 and not max(held):
                    break
                path = runs[held.index(max(held))]
                fresh = [graph.canonical(x) for x in path]
                members += fresh
                here.update(fresh)
                taken.update(special.intersection(fresh))
                end = path[-1]
        out.append(members)
    return out


def each_component(rows: DataFrame, columns: list[str], schema: str, walk: Callable[..., list[tuple]]) -> DataFrame:
    """Rows that `walk` makes of the columns (as lists) of each component, named by `label`.

    Components are sorted together in their partitions and cut out of the batches as they pass: one worker call handles
    many small components and holds one at a time.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(part: pd.DataFrame) -> list[tuple]:
            return walk(*(part[c].tolist() for c in columns))

        for batch in batches:
            if not len(batch):
                continue
            label = batch["label"].to_numpy()
            cut = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1), len(label)]
            out: list[tuple] = []
            for a, b in zip(cut, cut[1:]):
                if held and held[0]["label"].iloc[0] != label[a]:
                    out += done(pd.concat(held) if len(held) > 1 else held[0])
                    held = []
                held.append(batch.iloc[a:b])
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(done(pd.concat(held)), columns=names)

    sorted_rows = rows.select("label", *columns).repartition("label").sortWithinPartitions("label")
    return sorted_rows.mapInPandas(work, schema)


def _by_component(vertices: DataFrame, k: int) -> DataFrame:
    now = materialize(vertices)
    return materialize(labelled(now, edges(now, k)))


def pivot_components(counts: DataFrame, pivots: DataFrame, k: int, depth: int = 1) -> DataFrame:
    """(`comp_no`, `kmer`, `n_pivot`): components of the graph of `counts` (`kmer`, `freq`) grown around pivot k-mers.

    Pivots that are not in the graph are left out. Components are numbered by descending weight and size, then by their
    smallest k-mer.
    """
    marked = counts.select("kmer", "freq").join(pivots.select("kmer").distinct().withColumn("pivot", F.lit(True)), "kmer", "left").fillna(False, ["pivot"])
    rows = _by_component(marked, k)
    # Components without a pivot can't give anything.
    rows = rows.join(rows.where("pivot").select("label").distinct(), "label", "left_semi")

    def walk(kmers: list[int], pivot: list[bool]) -> list[tuple]:
        found = grow(Strands(kmers, k), [x for x, p in zip(kmers, pivot) if p], depth)
        return [(min(m), c, n) for m, n in found for c in m]

    grown = materialize(each_component(rows, ["kmer", "pivot"], "own long, kmer long, n_pivot long", walk))
    sizes = grown.join(counts.select("kmer", "freq"), "kmer").groupBy("own").agg((-F.sum("freq")).alias("w"), (-F.count("*")).alias("s"))
    names = numbered(sizes, ["w", "s", "own"], "comp_no", 1)
    return grown.join(names.select("own", F.col("comp_no").cast("int")), "own").select("comp_no", "kmer", "n_pivot")


def _linear(k: int, c: int):
    def walk(kmers: list[int], colors: list[int]) -> list[tuple]:
        found = linear(Strands(kmers, k), [x for x, own in zip(kmers, colors) if own == c])
        return [(c, min(m), x) for m in found for x in m]

    return walk


def linear_components(colors: DataFrame, k: int, share: float = 0.9, n_groups: int = 3, separate: bool = False) -> DataFrame:
    """(`color`, `label`, `kmer`): as `colored_components`, but each component is one path; named by its smallest k-mer."""
    named = materialize(colors.select("kmer", dna.dominant_color("c0", "c1", "c2", share=share).alias("color")))
    out = None
    for c in range(n_groups):
        fit = F.col("color") == c if separate else F.col("color").isin(c, -1)
        rows = _by_component(named.where(fit), k)
        rows = rows.join(rows.where(F.col("color") == c).select("label").distinct(), "label", "left_semi")

        own = each_component(rows, ["kmer", "color"], "color int, label long, kmer long", _linear(k, c))
        out = own if out is None else out.unionByName(own)
    return out
