import random

from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import counts as C
from tests import models as M

A, B = ["AACATAAGC", "GAAGCCAAC"], ["TAACATAA", "AAGCCAATT"]


def reads(spark):
    rows = [("a", s) for s in A] + [("b", s) for s in B] + [("b", None), ("b", "ACG"), ("b", "")]
    return spark.createDataFrame(rows, "sample string, seq string")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tiny_counts(spark):
    df = C.kmer_counts(reads(spark), 5, 0).withColumn("k", dna.decode("kmer", 5))
    want = sorted((s, k, 1) for s, rs in (("a", A), ("b", B)) for r in rs for k in M.kmers(r, 5))
    assert got(df, "sample", "k", "freq") == want and len(want) == 19
    assert C.kmer_counts(reads(spark), 5, 1).isEmpty()
    both = C.kmer_counts(reads(spark), 5, 1, ()).select(dna.decode("kmer", 5))
    assert sorted(r[0] for r in both.collect()) == ["AACAT", "AAGCC", "ACATA", "AGCCA", "CATAA", "GCCAA"]


def test_reads_with_other_letters_and_clashing_columns(spark):
    rows = [("x", "ACGNACGTAC", 1, 2), (None, "ACGTA", 1, 2)]
    df = spark.createDataFrame(rows, "sample string, seq string, kmer int, freq int")
    out = C.kmer_counts(df, 5, 0).withColumn("k", dna.decode("kmer", 5))
    want = sorted([("x", k, n) for k, n in ((k, M.kmers("ACGTAC", 5).count(k)) for k in set(M.kmers("ACGTAC", 5)))], key=str)
    assert sorted(got(out.where("sample = 'x'"), "sample", "k", "freq"), key=str) == want
    assert out.where("sample IS NULL").count() == 1


def test_empty_table(spark):
    none = reads(spark).limit(0)
    assert C.kmer_counts(none, 5, 0).isEmpty()
    counts = C.kmer_counts(none, 5, 0)
    classes = spark.createDataFrame([], "sample string, color int")
    assert C.colored(counts, classes).isEmpty() and C.samples_per_kmer(counts).isEmpty()
    assert C.unique_kmers(counts, counts).isEmpty() and C.kmers_filter(counts, counts).isEmpty()


def test_saturation_and_threshold_before_sum(spark):
    rows = [("s", 1, 30000), ("s", 1, 30000), ("s", 2, 1), ("s", 2, 1), ("s", 2, 5), ("s", None, 5), (None, 1, 5), ("s", 3, None)]
    df = spark.createDataFrame(rows, "sample string, kmer long, freq int")
    assert got(C.table_counts(df, 1), "sample", "kmer", "freq") == [("s", 1, 32767), ("s", 2, 5)]


def sample_counts(spark):
    random.seed(3)
    rows = [(f"s{i}", k, random.randint(1, 4)) for i in range(9) for k in range(12) if random.random() < 0.5]
    classes = [(f"s{i}", i % 3) for i in range(8)] + [("s8", None), ("s0", 0)]
    return rows, dict(classes[:8]), spark.createDataFrame(rows, "sample string, kmer long, freq int"), spark.createDataFrame(classes, "sample string, color int")


def test_set_filters_against_model(spark):
    rows, color, df, classes = sample_counts(spark)
    by = lambda c: df.join(classes.where(F.col("color") == c).distinct(), "sample").drop("color")
    high = [(s, k, f) for s, k, f in rows if f > 1]
    neg = {k for s, k, f in high if color.get(s) == 1}
    own = [(s, k, f) for s, k, f in high if color.get(s) == 0]
    assert got(C.kmers_filter(by(0), by(1)), "sample", "kmer", "freq") == sorted(x for x in own if x[1] in neg)
    uniq = {k for _, k, _ in own} - neg
    u = C.unique_kmers(by(0), by(1))
    assert {r.kmer for r in u.collect()} == uniq
    n = {k: len({s for s, k2, _ in own if k2 == k}) for k in uniq}
    assert got(C.unique_levels(u, 1, 3), "level", "kmer") == sorted((i, k) for k in uniq for i in range(1, n[k] + 1) if i <= 3)
    seen = {k: [sum(color.get(s) == g for s, k2, _ in high if k2 == k) for g in range(3)] for k in {k for _, k, _ in high}}
    assert got(C.colored(df, classes), "kmer", "c0", "c1", "c2") == sorted((k, *v) for k, v in seen.items() if sum(v))
    kept = spark.createDataFrame([(0,), (99,)], "kmer long")
    assert got(C.grouped_samples(kept, df, classes), "kmer", "n_0", "n_1", "n_2") == sorted([(0, *seen.get(0, [0, 0, 0])), (99, 0, 0, 0)])


def test_dense_matrix_and_double_view(spark):
    rows, _, df, _ = sample_counts(spark)
    out = C.kmers_per_sample(df, 50)
    common = {k for k in range(12) if sum(k2 == k for _, k2, _ in rows) >= 4}
    have = {(k, s): f for s, k, f in rows}
    assert got(out, "kmer", "sample", "freq") == sorted((k, s, have.get((k, s), 0)) for k in common for s in {r[0] for r in rows})
    left, right = (spark.createDataFrame(x, "kmer long, freq int") for x in ([(1, 2), (2, 3)], [(2, 9), (7, 1)]))
    assert got(C.double_view(left, right), "kmer", "left_count", "right_count") == [(1, 2, 0), (2, 3, 9)]


def test_bitmap_ranges_against_sets(spark):
    random.seed(239)
    have = {k: set(random.sample(range(130), random.randint(1, 129))) for k in range(20)}
    df = spark.createDataFrame([(f"s{i}", k, 1) for k, own in have.items() for i in own], "sample string, kmer long, freq int")
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(130)], "sample string, idx int")
    maps = C.presence_bitmap(df, samples)
    for a, b in ((0, 130), (0, 64), (64, 128), (10, 70), (63, 65), (128, 130), (5, 5)):
        out = {r[0]: r[1] for r in maps.select("kmer", C.cardinality("words", a, b)).collect()}
        assert out == {k: sum(a <= i < b for i in own) for k, own in have.items()}


def test_bottom_cut(spark):
    df = spark.createDataFrame([("s", k, f) for k, f in enumerate([1] * 10 + [2] * 5 + [2000] * 1)], "sample string, kmer long, freq int")
    assert got(C.bottom_cut(df, 1, "sample"), "sample", "threshold") == [("s", 2)]
    assert got(C.bottom_cut(df, 0, "sample"), "sample", "threshold") == [("s", 0)]
    assert got(C.bottom_cut(df, 100, "sample"), "sample", "threshold") == [("s", 1024)]


def plain_minimum(freqs):
    stat = [0] * 1025
    for f in freqs:
        stat[min(f, 1023)] += 1
    v, seen = 1, 0
    while stat[v] * v > stat[v + 1] * (v + 1):
        seen += stat[v]
        if 2 * seen > sum(freqs):
            break
        v += 1
    return v


def test_first_minimum(spark):
    random.seed(6)
    cases = {f"s{i}": [random.choice([1, 1, 1, 2, 2, 3, 5, 9, 2000][: 3 + i % 7]) for _ in range(5 + 3 * i)] for i in range(25)}
    cases |= {"only2": [2, 2], "one": [1] * 9, "gap": [1] * 30 + [2] * 5 + [4] * 50}
    rows = [(s, k, f) for s, fs in cases.items() for k, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "sample string, kmer long, freq int")
    assert got(C.first_minimum(df, "sample"), "sample", "threshold") == sorted((s, plain_minimum(fs)) for s, fs in cases.items())
