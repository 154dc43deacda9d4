import random

from strandlake.operators import counts as C
from strandlake.plans import pipelines as P
from strandlake.streaming import counting
from tests import models as M


def genome(n, seed):
    random.seed(seed)
    return "".join(random.choice("ACGT") for _ in range(n))


def shotgun(g, n, seed, length=60):
    random.seed(seed)
    return [g[i : i + length] for i in (random.randint(0, len(g) - length) for _ in range(n))]


def test_distance_pipeline_against_models(spark):
    a, b = genome(600, 1), genome(600, 2)
    by = {"x": shotgun(a, 120, 3) + shotgun(b, 60, 4), "y": shotgun(a, 120, 5), "z": shotgun(b, 120, 6) + shotgun(a, 40, 7)}
    reads = spark.createDataFrame([(s, r) for s, rs in by.items() for r in rs], "sample string, seq string")
    k, got = 15, None
    got = P.distance_matrix(reads, k, 1, 40, 50, 5000)
    counts, shared = {}, {}
    for s, rs in by.items():
        c = {}
        for r in rs:
            for x in M.kmers(r, k):
                c[x] = c.get(x, 0) + 1
        counts[s] = {x: f for x, f in c.items() if f > 1}
        for seq, *_ in M.unitigs(counts[s]):
            if len(seq) >= 40:
                for x in M.kmers(seq, k):
                    shared[x] = shared.get(x, 0) + 1
    parts = [p for p in M.components(shared) if 50 <= len(p) <= 5000]
    vec = {s: [sum(c.get(x, 0) for x in p) for p in parts] for s, c in counts.items()}
    want = {
        (i, j): sum(abs(p - q) for p, q in zip(vec[i], vec[j])) / (sum(vec[i]) + sum(vec[j])) for i in by for j in by if i < j
    }
    assert {(r.sample_i, r.sample_j): round(r.dist, 9) for r in got.distances.collect()} == {x: round(d, 9) for x, d in want.items()}
    assert got.components.count() == len(parts) and got.order.count() == 3
    assert P.distance_matrix(reads.limit(0), k).distances.isEmpty()


def test_class_pipelines(spark):
    own, common = genome(200, 11), genome(200, 12)
    rows = []
    for i in range(12):
        text = common + (own if i % 2 == 0 else "")
        for x in M.kmers(text, 15):
            rows.append((f"s{i}", M.encode(x), random.randint(2, 9)))
    counts = C.table_counts(spark.createDataFrame(rows, "sample string, kmer long, freq int"))
    classes = spark.createDataFrame([(f"s{i}", i % 2) for i in range(12)], "sample string, color int")
    pos, neg = (C.with_class(counts, classes).where(f"color = {c}").drop("color") for c in (0, 1))
    planted = {M.encode(x) for x in M.kmers(own, 15)}
    for out in (P.unique_features(pos, neg, 15, 1, 6), P.stats_features(counts, classes, 15)):
        chosen = {r.kmer for r in out.selected.collect()}
        assert planted <= chosen and len(chosen) < len(planted) + 20
        assert {r.sample for r in out.features.collect()} == {f"s{i}" for i in range(0, 12, 2)}
        assert planted <= {r.kmer for r in out.component_kmers.collect()}
        assert out.sequences.agg({"length": "max"}).first()[0] >= 200
    assert P.specific_features(counts, classes).where("f_0 > 0 AND f_1 = 0").select("kmer").distinct().count() >= len(planted)
    assert P.colored_features(counts, classes, 15).where("color = 0").count() >= 6
    assert P.supergraph(counts, 15, 1).count() >= 1 and P.supergraph(counts, 15, percent=1).count() >= 1


def test_streaming_drops_repeats_and_adds_late_files(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2020, 1, 1, 5)
    rows = [(i, "s_r1" if i % 2 else "s", f"r{i}", "ACGTACGTAA" if i % 3 else "acgtn", day + dt.timedelta(hours=i)) for i in range(30)]
    rows += [(100, "s", "x", None, day), (101, "s", "x", "ACGTT", None)]
    df = spark.createDataFrame(rows, "read_no long, sample string, read_id string, seq string, run_at timestamp")
    for part in (df.where("read_no < 20"), df.where("read_no >= 15")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = counting.good_stream(counting.read_stream(spark, str(tmp_path / "in"), df.schema, 1))
    got = sorted(tuple(r) for r in counting.drained(counting.stream_days(stream), ["day", "sample"]).collect())
    want = {}
    for _, _, _, s, t in rows[:30]:
        if "n" not in s:
            d = t.strftime("%Y-%m-%d")
            want[d] = want.get(d, 0) + 1
    assert got == sorted((d, "s", n, 10 * n) for d, n in want.items())
    stream = counting.good_stream(counting.read_stream(spark, str(tmp_path / "in"), df.schema, 1))
    kmers = {(r.day, r.kmer): r.freq for r in counting.drained(counting.stream_kmers(stream, 5), ["day", "sample", "kmer"]).collect()}
    assert kmers == {(d, x): n * M.kmers("ACGTACGTAA", 5).count(x) for d, n in want.items() for x in M.kmers("ACGTACGTAA", 5)}
