import random

import pytest

from strandlake.functions import dna
from strandlake.operators import graph as G
from strandlake.operators import walks
from tests import models as M


def genome(n, seed):
    random.seed(seed)
    return "".join(random.choice("ACGT") for _ in range(n))


def mixed(k, seed=5):
    """K-mers with forks, repeats, a cycle, low-complexity runs and single ones, and frequencies."""
    g = genome(300, seed)
    ring = genome(40, seed + 1)
    texts = [g, g[50:120] + genome(30, seed + 2), genome(25, seed + 3) + g[200:230] + genome(25, seed + 4), ring + ring[: k - 1]]
    texts += ["A" * 30, "ACACACACACACACACACAC", genome(k, seed + 6), g[10:60] + M.rc(g[10:60])]
    counts = {}
    for t in texts:
        for x in M.kmers(t, k):
            counts[x] = counts.get(x, 0) + 1
    return counts


def table(spark, counts):
    return spark.createDataFrame([(M.encode(x), f) for x, f in counts.items()], "kmer long, freq int")


@pytest.mark.parametrize("k", [7, 8, 21, 31])
def test_edges_and_components(spark, k):
    counts = mixed(k)
    df = table(spark, counts)
    edges = G.edges(df, k)
    want = {(M.encode(x), M.encode(y)) for x in counts for y in M.neighbours(x) if y in counts}
    assert {tuple(r) for r in edges.select("src", "dst").collect()} == want
    got = {}
    for r in G.labelled(df, edges).collect():
        got.setdefault(r.label, set()).add(M.decode(r.kmer, k))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, M.components(counts)))
    assert all(M.decode(label, k) == min(own) for label, own in got.items())


@pytest.mark.parametrize("k,limit", [(7, 1 << 20), (8, 0), (11, 1 << 20), (21, 0)])
def test_unitigs(spark, monkeypatch, k, limit):
    """With pieces ranked by one task, and by rounds of joins."""
    monkeypatch.setattr(G, "ONE_TASK", limit)
    counts = mixed(k)
    rows = G.unitigs(table(spark, counts), k).collect()
    got = {(min(r.seq, M.rc(r.seq)), r.av_weight, r.min_weight, r.max_weight) for r in rows}
    assert got == M.unitigs(counts) and len(rows) == len(got)
    assert all(r.length == len(r.seq) == r.kmers + k - 1 for r in rows)


def test_unitigs_over_many_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE_ROWS", 64)
    counts = mixed(11, 8)
    rows = G.unitigs(table(spark, counts), 11).collect()
    assert {(min(r.seq, M.rc(r.seq)), r.av_weight, r.min_weight, r.max_weight) for r in rows} == M.unitigs(counts)


def test_unitigs_by_key_and_empty(spark):
    a, b = mixed(11, 1), mixed(11, 2)
    rows = [(n, M.encode(x), f) for n, c in (("a", a), ("b", b), (None, a)) for x, f in c.items()]
    df = spark.createDataFrame(rows, "sample string, kmer long, freq int")
    got = {}
    for r in G.unitigs(df.where("sample IS NOT NULL"), 11, 0, "sample").collect():
        got.setdefault(r.sample, set()).add((min(r.seq, M.rc(r.seq)), r.av_weight, r.min_weight, r.max_weight))
    assert got == {"a": M.unitigs(a), "b": M.unitigs(b)}
    assert G.unitigs(table(spark, a).limit(0), 11).isEmpty()
    assert G.labelled(table(spark, a).limit(0), G.edges(table(spark, a).limit(0), 11)).isEmpty()


def test_cutting_large_components(spark):
    counts = mixed(11, 3)
    random.seed(2)
    counts = {x: random.randint(1, 4) for x in counts}
    comps, kmers = G.cut_components(table(spark, counts), 11, 5, 60)
    members = {}
    for r in kmers.collect():
        members.setdefault(r.comp_no, []).append(M.decode(r.kmer, 11))
    rows = comps.orderBy("comp_no").collect()
    got = [(r.freq_threshold, r.size, r.weight, min(members[r.comp_no])) for r in rows]
    assert sorted(got) == M.cut(counts, 5, 60)
    assert [r.comp_no for r in rows] == list(range(1, len(rows) + 1))
    assert got == sorted(got, key=lambda x: (x[0], -x[2], -x[1], x[3]))


def test_branching(spark):
    counts = mixed(11)
    want = set()
    for x in counts:
        for y in (x, M.rc(x)):
            if sum(M.canon(y[1:] + c) in counts for c in "ACGT") > 1:
                want.add(x)
    assert {M.decode(r.kmer, 11) for r in G.branching(table(spark, counts), 11).collect()} == want


def test_colored_components(spark):
    counts = mixed(11)
    random.seed(4)
    color = {x: random.choice([0, 1, -1]) for x in counts}
    c = {0: (1, 0, 0), 1: (0, 1, 0), -1: (1, 1, 0)}
    df = spark.createDataFrame([(M.encode(x), *c[color[x]]) for x in counts], "kmer long, c0 long, c1 long, c2 long")
    for separate in (False, True):
        got = {}
        for r in G.colored_components(df, 11, separate=separate).collect():
            got.setdefault((r.color, r.label), set()).add(M.decode(r.kmer, 11))
        want = []
        for g in (0, 1):
            own = [x for x in counts if color[x] == g or (color[x] == -1 and not separate)]
            want += [(g, sorted(p)) for p in M.components(own) if any(color[x] == g for x in p)]
        assert sorted((g, sorted(p)) for (g, _), p in got.items()) == sorted(want)


def test_pivot_walks_keep_their_promises(spark):
    counts = mixed(11, 9)
    pivots = sorted(counts)[::7]
    df = table(spark, counts)
    p = spark.createDataFrame([(M.encode(x),) for x in pivots] + [(3,)], "kmer long")
    for depth in (1, 3):
        comps = {}
        for r in walks.pivot_components(df, p, 11, depth).collect():
            comps.setdefault(r.comp_no, []).append((M.decode(r.kmer, 11), r.n_pivot))
        every = [x for own in comps.values() for x, _ in own]
        assert len(every) == len(set(every)) and set(every) <= set(counts)
        for own in comps.values():
            names = {x for x, _ in own}
            assert len(M.components(names)) == 1
            assert own[0][1] == len(names & set(pivots)) >= 1


def test_linear_walk_ends_on_a_cycle():
    ring = genome(50, 12)
    k = 11
    have = {M.encode(x) for x in M.kmers(ring + ring[: k - 1], k)}
    out = walks.linear(walks.Strands(have, k), [min(have)])
    assert len(out) == 1 and len(out[0]) == len(set(out[0])) == len(have)


def test_links_paths_n50_coverage_levels(spark):
    k = 5
    units = spark.createDataFrame([(1, "ACGTTGC"), (2, "TTGCAAC"), (3, "GGGGGA")], "id int, seq string")
    rows = {tuple(r) for r in G.links(units, k).collect()}
    ends = [(i, s, q if s == "+" else M.rc(q)) for i, q in ((1, "ACGTTGC"), (2, "TTGCAAC"), (3, "GGGGGA")) for s in "+-"]
    want = {(a, sa, b, sb) for a, sa, x in ends for b, sb, y in ends if x[-4:] == y[:4]}
    flip = {"+": "-", "-": "+"}
    assert rows == {min((a, sa, b, sb), (b, flip[sb], a, flip[sa])) for a, sa, b, sb in want}
    seqs = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, "TTT"), (3, None)], "sid int, seq string")
    inside = spark.createDataFrame([(7, M.encode(M.canon(x))) for x in ("ACGTT", "CGTTG", "TGCAA")], "comp_no int, kmer long")
    got = {(r.comp_no, r.sid, r.start, r.path) for r in G.paths(seqs, inside, k, "sid", 5).collect()}
    assert got == {(7, 1, 0, "ACGTTG"), (7, 1, 3, "TTGCAA")}  # TTGCA is TGCAA on the other strand
    lengths = spark.createDataFrame([(x,) for x in (2, 3, 5, 5, 10)], "length int")
    assert G.n50(lengths).first()[0] == 5
    places = spark.createDataFrame([("c", i) for i in range(1, 6)], "contig string, pos int")
    al = spark.createDataFrame([("c", 2, 3), ("c", 3, 9), ("d", 1, 5)], "contig string, start int, end int")
    assert sorted(tuple(r) for r in G.position_coverage(places, al, "contig").collect()) == [("c", 1, 0), ("c", 2, 1), ("c", 3, 2), ("c", 4, 1), ("c", 5, 1)]
    t = "ACGTTGCAACG"
    fwd = spark.createDataFrame([(M.encode(t[i : i + 5]), i + 1) for i in range(len(t) - 4)], "kmer long, freq int")
    seed = spark.createDataFrame([(M.encode(t[4:9]),)], "kmer long")
    assert sorted(tuple(r) for r in G.leftward_levels(fwd, seed, 5, 3).collect()) == [(0, 1, 5), (1, 1, 4), (2, 1, 3), (3, 1, 2)]


def test_sequence_components(spark):
    df = spark.createDataFrame([("a", "ACACACA"), ("b", "AC")], "name string, seq string")
    r = G.sequence_components(df, 3, "name").collect()
    assert [(x.name, x.size, x.weight) for x in r] == [("a", len(set(M.kmers("ACACACA", 3))), 5)]
    assert r[0].kmers == sorted(M.encode(x) for x in set(M.kmers("ACACACA", 3)))
    assert dna.FREQ_MAX == 32767


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, limit):
    """Star rounds (no edge is few enough for one task) give the same labels as one task."""
    monkeypatch.setattr(G, "ONE_TASK", limit)
    random.seed(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000 + random.randrange(200), 1000 + random.randrange(200)) for _ in range(150)] + [(7, 7)]
    own = {}
    def find(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x
    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            own[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in G.connected(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(own)}


def test_unitigs_with_hot_words_and_small_chunks(spark, monkeypatch):
    """Joints of words that very many share have places of their own; chunks end between places."""
    monkeypatch.setattr(G, "HOT_SAMPLE", 0.999)
    monkeypatch.setattr(G, "HOT_SEEN", 3)
    counts = mixed(11)
    rows = G.unitigs(table(spark, counts), 11).collect()
    assert {(min(r.seq, M.rc(r.seq)), r.av_weight, r.min_weight, r.max_weight) for r in rows} == M.unitigs(counts)
    assert all(r.sum_weight // r.kmers == r.av_weight for r in rows)


def test_linear_walks_stop_where_no_branch_has_the_colour():
    k, text = 15, genome(60, 21)
    other = text[:20] + genome(20, 22)
    have = {M.encode(x) for t in (text, other) for x in M.kmers(t, k)}
    graph = walks.Strands(have, k)
    own = [M.encode(M.canon(text[i : i + k])) for i in (0, 2)]
    (found,) = walks.linear(graph, own)
    assert set(own) <= set(found) and not set(found) & {M.encode(x) for x in M.kmers(text[20:], k)}
    # With the colour behind the fork the walk goes on that way, and neutral k-mers may be used by other walks.
    more = own + [M.encode(M.canon(text[30 : 30 + k]))]
    (found,) = walks.linear(graph, more)
    assert set(more) <= set(found)


def test_component_graph_and_comparison(spark):
    k, g = 5, genome(60, 31)
    comps = {1: M.kmers(g[:30], k), 2: M.kmers(g[30:], k)}
    rows = [(c, i, M.encode(x)) for c, own in comps.items() for i, x in enumerate(own)] + [(1, 99, None), (None, 1, 5)]
    kmers = spark.createDataFrame(rows, "comp_no int, pos int, kmer long")
    counts = spark.createDataFrame([(s, M.encode(x), n) for s, n in (("a", 2), ("b", 3)) for x in set(comps[1])], "sample string, kmer long, freq int")
    by = {}
    for mode in ("samples", "freq", "one"):
        segments, links = G.component_graph(kmers, k, counts, mode)
        by[mode] = {r.id: (r.seq, r.coverage) for r in segments.collect()}
    assert by["samples"].keys() == by["one"].keys() and all(x.endswith(("_i1", "_i2")) for x in by["one"])
    for name, (seq, cover) in by["one"].items():
        assert cover == len(seq)
        assert by["samples"][name][1] >= (2 * len(seq) if name.endswith("_i1") else 0)
        assert by["freq"][name][1] >= (5 * len(seq) if name.endswith("_i1") else 0)
    contigs = spark.createDataFrame([("c", g)], "contig string, seq string")
    al = spark.createDataFrame([("c", 1, 20), ("c", 10, 40)], "contig string, start int, end int")
    out = G.compared(contigs, kmers, al, k, "contig")
    got = {r.pos: (r.comp_no, r.depth) for r in out.collect()}
    for p in range(len(g) - k + 1):
        x = M.canon(g[p : p + k])
        held = [c for c, own in comps.items() if x in own]
        assert got[p] == (min(held, default=0), sum(a <= p + k <= b for a, b in ((1, 20), (10, 40))))
    r = G.comparison(out).first()
    assert r.both + r.only_reads + r.only_components == sum(c > 0 or d > 0 for c, d in got.values())


def test_walk_from_a_fragment(spark):
    k, g = 5, genome(50, 41)
    fragment = g[20:40]
    counts = {}
    for x in M.kmers(g, k):
        counts[x] = counts.get(x, 0) + 2
    df = spark.createDataFrame([(M.encode(x), n) for x, n in counts.items()], "kmer long, freq long")
    got = {r.depth: (r.n_kmers, r.freq) for r in G.leftward_walk(df, fragment, k, 1, 3, 10).collect()}
    have = dict(counts)
    for x in {M.canon(fragment[i : i + k]) for i in range(1, len(fragment) - k + 1)}:
        have[x] = have.get(x, 0) + 2
    level, seen, want, depth = {fragment[3 : 3 + k]}, {fragment[3 : 3 + k]}, {}, 1
    while level and depth <= 13:
        want[depth] = (len(level), sum(have.get(M.canon(x), 0) for x in level))
        level = {c + x[:-1] for x in level for c in "ACGT" if have.get(M.canon(c + x[:-1]), 0) > 1} - seen
        seen |= level
        depth += 1
    assert got == want
    with pytest.raises(ValueError):
        G.leftward_walk(df, "ACGT", k, 1)
