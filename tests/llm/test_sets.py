"""Overlaps, distinct counts and frequent items against plain sets and counters."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import catalog, distinct, frequent, overlap


def sets_of(seed, n=14):
    random.seed(seed)
    base = [random.getrandbits(60) for _ in range(300)]
    return {f"s{i}": set(random.sample(base, random.randint(0, 200))) | {base[0]} for i in range(n)}


def test_overlaps_with_repeats_nulls_and_other_columns(spark):
    sets = sets_of(1)
    rows = [(s, x, 7, "y") for s, own in sets.items() for x in own]
    rows += rows[:100] * 3 + [(None, 5, 1, "y"), ("s1", None, 1, "y")]
    df = spark.createDataFrame(rows, "sample string, kmer long, n int, part string")
    classes = spark.createDataFrame([(s, i % 3) for i, s in enumerate(sets) if i] + [("s3", 0), ("s0", None)], "sample string, color int")
    for c in (None, classes):
        got = {(r.set_a, r.set_b): (r.shared, r.size_a, r.size_b) for r in overlap.overlaps(df, "sample", "kmer", c).collect()}
        names = sorted(sets) if c is None else sorted(set(sets) - {"s0"})
        want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in names for b in names if a < b and sets[a] & sets[b]}
        assert got == want
    assert overlap.overlaps(df.limit(0), "sample", "kmer", classes).isEmpty()


def test_merge_and_counters_in_small_blocks(monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 3)
    monkeypatch.setattr(overlap, "CHUNK", 8)
    monkeypatch.setattr(overlap, "CODES", 16)
    sets = list(sets_of(2, 9).values())
    runs = [(i, np.array(sorted(s)[a : a + 50], np.int64)) for i, s in enumerate(sets) for a in range(0, len(s), 40)]
    counters, seen = overlap.PairCounters(len(sets)), []
    for ids, own in overlap.merged(runs):
        seen += list(zip(ids.tolist(), own.tolist()))
        for _ in counters.count(ids, own):
            pass
    assert seen == sorted({(x, i) for i, s in enumerate(sets) for x in s})
    counters.settle()
    got = dict(zip(counters.codes.tolist(), counters.counts.tolist()))
    assert got == {i * 9 + j: n for i in range(9) for j in range(i, 9) if (n := len(sets[i] & sets[j]))}


def test_an_identifier_that_every_set_repeats(spark):
    rows = [(f"s{i % 50}", 42) for i in range(3000)] + [(f"s{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "sample string, kmer long")
    out = overlap.overlaps(df, "sample", "kmer")
    assert out.count() == 50 * 49 // 2 and out.where("shared <> 1 AND set_a <> 's42' AND set_b <> 's42'").isEmpty()


def p3_rows(spark, seed):
    random.seed(seed)
    rows = [(random.choice("de"), random.randint(0, 2), random.randint(0, 150)) for _ in range(1500)]
    rows = [r for r in rows if not (r[0] == "e" and r[1] == 2)]
    return rows, spark.createDataFrame(rows + [(None, 1, 1), ("d", None, 1), ("d", 1, None)], "day string, color int, id long")


def exact(rows, by_day=True):
    out = {}
    for day in {r[0] for r in rows} if by_day else {None}:
        own = [r for r in rows if day is None or r[0] == day]
        for colors in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)):
            part = [r for r in own if r[1] in colors]
            if {r[1] for r in part} == set(colors):
                out[(day, "+".join(map(str, colors)))] = (len({r[2] for r in part}), len(part))
    return out


def test_distinct_counts_and_merging(spark):
    rows, df = p3_rows(spark, 1)
    s = distinct.state(df, "day", "color", ["id"])
    assert {(r.day, r.colors): (r.n_ids, r.n_rows) for r in distinct.counts(s).collect()} == exact(rows)
    halves = [distinct.state(df.where(F.col("id") % 2 == i), "day", "color", ["id"]) for i in (0, 1)]
    both = distinct.merge(halves + [halves[0].limit(0)], ["id"])
    assert {(r.day, r.colors): (r.n_ids, r.n_rows) for r in distinct.counts(both).collect()} == exact(rows)
    days = distinct.merge([s], ["id"], by_day=False)
    assert {(None, r.colors): (r.n_ids, r.n_rows) for r in distinct.counts(days).collect()} == exact(rows, False)
    assert distinct.counts(distinct.state(df.limit(0), "day", "color", ["id"])).isEmpty()


def test_estimates_keep_their_bound(spark):
    df = spark.range(40000).select(F.lit("d").alias("day"), (F.col("id") % 3).cast("int").alias("color"), (F.col("id") % 20000).alias("id"))
    kept = 128
    got = distinct.counts(distinct.state(df, "day", "color", ["id"], kept), kept).collect()
    true = {"0": 13333, "1": 13333, "2": 13333}
    for r in got:
        want = true.get(r.colors, 20000)
        assert r.error_bound > 0 and abs(r.n_ids - want) <= r.error_bound
    assert len(got) == 7


def reader():
    def ints(batch):
        return batch.column(0).to_numpy(), batch.column(1).to_numpy() if batch.num_columns > 1 else None

    return ints


@pytest.mark.parametrize("weighted", [False, True])
def test_frequent_items(spark, weighted):
    random.seed(5)
    items = [min(int(random.paretovariate(0.6)), 10**9) for _ in range(20000)] + list(range(10**6, 10**6 + 4000))
    weights = [random.randint(1, 9) for _ in items]
    df = spark.createDataFrame(list(zip(items, weights)), "item long, w long").repartition(20)
    count = Counter()
    for x, w in zip(items, weights):
        count[x] += w if weighted else 1
    total, share = sum(count.values()), 0.01
    df = df if weighted else df.select("item")
    got = frequent.frequent(df, reader(), share).collect()
    assert {r.item: r["count"] for r in got} == {x: n for x, n in count.items() if n >= share * total}
    assert all(r.estimate >= r["count"] >= r.estimate - r.error and r.total == total for r in got)
    assert frequent.frequent(df.limit(0), reader(), share).isEmpty()


def test_summaries_keep_their_promise():
    rng = np.random.default_rng(1)
    parts, true = [], Counter()
    for i in range(9):
        s = frequent.SpaceSaving(50)
        for _ in range(5):
            x = rng.zipf(1.3, 400)
            true.update(x.tolist())
            s.add(*frequent.grouped(x, None))
        parts.append(s)
    out = frequent.SpaceSaving(50)
    for s in parts:
        out.add(s.items, s.counts, s.errors, s.floor)
        out.total += s.total
    assert out.total == sum(true.values()) and out.floor <= out.total / 51
    for x, c, e in zip(out.items.tolist(), out.counts.tolist(), out.errors.tolist()):
        assert c - e <= true[x] <= c
    have = set(out.items.tolist())
    assert all(n <= out.floor for x, n in true.items() if x not in have)


def test_counters_are_handed_on_inside_a_chunk(monkeypatch):
    """Identifiers that very many sets have: counters leave as soon as so many have come together."""
    monkeypatch.setattr(overlap, "CODES", 1000)
    monkeypatch.setattr(overlap, "HELD", 500)
    sets = np.tile(np.arange(80), 3)
    ids = np.repeat(np.arange(3), 80)
    ids[80:] = np.repeat([1, 2], 80)
    counters, total, most = overlap.PairCounters(80), {}, 0
    names = [f"s{i:02d}" for i in range(80)]
    for _ in counters.count(ids, sets):
        most = max(most, len(counters.codes))
        for r in counters.rows(names).to_pylist():
            total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0) + r["n"]
    for r in counters.rows(names).to_pylist():
        total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0) + r["n"]
    assert 500 <= most < 3000 and set(total.values()) == {3} and len(total) == 80 * 81 // 2


def test_groups_are_a_parameter(spark):
    df = spark.createDataFrame([("d", g, i) for g in ("x", "y") for i in range(10 if g == "x" else 5)], "day string, color string, id long")
    got = {r.colors: (r.n_ids, r.n_rows) for r in distinct.counts(distinct.state(df, "day", "color", ["id"], groups=("x", "y")), groups=("x", "y")).collect()}
    assert got == {"x": (10, 10), "y": (5, 5), "x+y": (10, 15)}
    with pytest.raises(Exception, match="a group that is not counted"):
        distinct.state(df, "day", "color", ["id"], groups=("x",)).collect()


def test_p3_estimates_count_all_identifiers(spark, tmp_path):
    """A few days with few identifiers, some of very many rows: nothing is scaled up from a part of them."""
    random.seed(8)
    kmers = [(f"s{i % 3}", x, 1 + j, f"2024-01-0{1 + i % 4} 00:00:00") for i in range(60) for x in [random.getrandbits(40)] for j in range(50 if i % 9 == 0 else 1)]
    reads = [(i, f"s{i % 3}", f"r{i}", "".join(random.choice("ACGT") for _ in range(30)), f"2024-01-0{1 + i % 4} 00:00:00") for i in range(40)]
    time = F.to_timestamp("run_at").alias("run_at")
    spark.createDataFrame(kmers, "sample string, kmer long, freq int, run_at string").select("sample", "kmer", "freq", time).write.parquet(f"{tmp_path}/kmer_counts.parquet")
    spark.createDataFrame(reads, "read_no long, sample string, read_id string, seq string, run_at string").select("read_no", "sample", "read_id", "seq", time).write.parquet(f"{tmp_path}/seq_reads.parquet")
    spark.createDataFrame([(f"s{i}", i) for i in range(3)], "sample string, color int").write.parquet(f"{tmp_path}/classes.parquet")
    want = {}
    for origin, rows in (("kmer_counts", [(s, x, day) for s, x, _, day in kmers]), ("seq_reads", [(s, seq, day) for _, s, _, seq, day in reads])):
        for day in sorted({d for _, _, d in rows}):
            for colors in ("0", "1", "2", "0+1", "0+2", "1+2", "0+1+2"):
                own = [(s, x) for s, x, d in rows if d == day and s[1] in colors]
                if {s[1] for s, _ in own} == set(colors.split("+")):
                    want[origin, day[:10], colors] = len({x for _, x in own}), len(own), 0.0
    got = {(r.origin, r.run_day, r.colors): (r.n_ids, r.n_rows, r.error_bound) for r in catalog.p3_estimates(spark, str(tmp_path)).collect()}
    assert got == want
