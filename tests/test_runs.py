"""Runs of windows against plain models, and what the queries that are made of them shuffle."""

import datetime as dt
import random

import pytest

from strandlake.functions import dna, runs, windows
from strandlake.operators import counts as counts_of
from strandlake.operators import graph
from strandlake.streaming import counting
from tests import models as M


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def texts(seed=3):
    """Reads of either strand of a few texts with faults, so that their graph has forks."""
    rng = random.Random(seed)
    sources = ["".join(rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(200)) for _ in range(4)]
    out = [None, "", "A" * 60, "ACGT" * 20]
    for _ in range(300):
        i = rng.randrange(180)
        s = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in rng.choice(sources)[i : i + rng.randrange(3, 90)])
        out.append(M.rc(s) if rng.random() < 0.5 else s)
    return out


def kmers(reads, k):
    return {min(w, M.rc(w)) for s in reads if s for w in (s[i : i + k] for i in range(len(s) - k + 1))}


@pytest.mark.parametrize("k, chunk", [(4, 1 << 17), (11, 1 << 17), (12, 8), (21, 1 << 17), (21, 8), (31, 1 << 17)])
def test_forks(spark, monkeypatch, k, chunk):
    """Also in parts, if a bucket is larger than a chunk."""
    monkeypatch.setattr(runs, "CHUNK", chunk)
    reads = texts()
    have = kmers(reads, k)
    follow = lambda x: sum(min(y, M.rc(y)) in have for y in (x[1:] + c for c in "ACGT"))
    want = {x for x in have if follow(x) > 1 or follow(M.rc(x)) > 1}
    rows = runs.forks(spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3), k)
    got = [r[0] for r in rows.select(dna.decode("kmer", k)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_forks_of_nothing(spark):
    assert runs.forks(spark.createDataFrame([(None,), ("ACG",)], "seq string"), 5).isEmpty()


def test_branching_kmers_shuffles_little(spark):
    """Less than twice the letters; the followers of all k-mers, as before, were 64 times the letters here."""
    import __spark_entry__

    before = shuffled(spark)
    n = __spark_entry__.queries()["branching_kmers"](spark, "/root/testdata/sf0.001").count()
    letters = sum(len(r[0]) for r in spark.read.parquet("/root/testdata/sf0.001/seq_reads.parquet").where("seq IS NOT NULL").select("seq").collect())
    assert n and shuffled(spark) - before < 2 * letters


@pytest.mark.parametrize("chunk", [1 << 21, 300])
def test_group_counts(spark, monkeypatch, chunk):
    """Whole groups, null keys too; a group larger than some chunks goes by parts."""
    monkeypatch.setattr(windows, "GATHERED", chunk)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), s) for s in texts() for _ in range(2)] + [("big", 1, s) for s in texts(4)]
    want = {}
    for a, b, s in rows:
        for x in M.kmers(s or "", 11):
            want[a, b, x] = want.get((a, b, x), 0) + 1
    out = windows.group_counts(spark.createDataFrame(rows, "a string, b int, seq string"), 11, 2, "a", "b")
    got = out.select("a", "b", dna.decode("kmer", 11).alias("kmer"), "freq").collect()
    assert {tuple(r)[:3]: r.freq for r in got} == {key: n for key, n in want.items() if n > 2} and len(got) == sum(n > 2 for n in want.values())


def test_stream_kmers_shuffles_reads(spark, tmp_path):
    """The same as the running counts in state, with several batches; k-mers are not shuffled."""
    day = dt.datetime(2020, 1, 1, 5)
    rows = [(i, "s_r1" if i % 2 else None, s, day + dt.timedelta(hours=i)) for i, s in enumerate(texts())]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "read_no long, sample string, seq string, run_at timestamp")
    df.repartitionByRange(3, "read_no").write.parquet(str(tmp_path / "in"))
    stream = lambda: counting.good_stream(counting.read_stream(spark, str(tmp_path / "in"), df.schema, 1))
    want = counting.drained(counting.stream_kmers(stream(), 21), ["day", "sample", "kmer"]).where("freq > 1")
    want = sorted(want.collect(), key=str)
    got = sorted(counting.kmers_by_day(stream(), 21, 1).collect(), key=str)
    assert got == want and len(got) > 50
    before = shuffled(spark)
    import __spark_entry__

    __spark_entry__.queries()["stream_kmers"](spark, "/root/testdata/sf0.001").count()
    letters = sum(len(r[0]) for r in spark.read.parquet("/root/testdata/sf0.001/seq_reads.parquet").where("seq IS NOT NULL").select("seq").collect())
    assert shuffled(spark) - before < 4 * letters


def test_stream_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", None, None)], "read_no long, sample string, seq string, run_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    assert counting.kmers_by_day(counting.good_stream(counting.read_stream(spark, str(tmp_path / "in"), df.schema)), 21).isEmpty()


@pytest.mark.parametrize("k, chunk, gathered, one_task", [(11, 1 << 17, 1 << 21, 4_000_000), (12, 8, 2000, 0), (21, 8, 1 << 21, 4_000_000), (21, 1 << 17, 3000, 0)])
def test_plain_unitigs(spark, monkeypatch, k, chunk, gathered, one_task):
    """As unitigs of all k-mers without those at forks, though most k-mers stay in their reads."""
    monkeypatch.setattr(runs, "CHUNK", chunk)
    monkeypatch.setattr(runs, "GATHERED", gathered)
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rows = [(f"s{i % 3}", s) for seed in (3, 8) for i, s in enumerate(texts(seed))]
    rows += [("s1", s) for s in ("".join(random.Random(i).choice("ACGT") for _ in range(120)) for i in range(40))] + rows[:20]
    reads = spark.createDataFrame(rows, "sample string, seq string").repartition(3)
    counts = counts_of.kmer_counts(reads, k, 0)
    support = counts.groupBy("kmer").agg({"sample": "count"}).toDF("kmer", "freq")
    want = graph.unitigs(support.join(graph.branching(support, k), "kmer", "left_anti"), k, k + 2)
    out = graph.plain_unitigs(reads, k, k + 2).select(*want.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and not out.isEmpty()
