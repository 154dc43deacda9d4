import gzip
import random
import struct

import pytest

from strandlake import catalog
from strandlake.operators import counts as C
from strandlake.operators import features as V
from strandlake.sources import binary, reads, text


def test_fasta(spark, tmp_path):
    (tmp_path / "smp_r1.fa").write_text(">read_1 length=6\nACG\r\nTTT\n>read_2\n\n>read_3\nacgn\n")
    got = sorted(tuple(r) for r in reads.fasta(spark, str(tmp_path / "smp_r1.fa")).collect())
    assert got == [("smp", "read_1 length=6", "ACGTTT"), ("smp", "read_3", "ACGN")]
    assert reads.good(reads.fasta(spark, str(tmp_path / "smp_r1.fa"))).count() == 1


@pytest.mark.parametrize("split", [7, 50, 1000, 1 << 20])
def test_fastq_in_splits(spark, tmp_path, split):
    random.seed(split)
    rows = []
    for i in range(60):
        n = random.randint(1, 30)
        rows.append((f"r{i} x", "".join(random.choice("ACGT") for _ in range(n)), "".join(random.choice("@+!I") for _ in range(n))))
    body = "".join(f"@{a}\n{s}\n+\n{q}\n" for a, s, q in rows)
    (tmp_path / "one.fastq").write_text(body)
    with gzip.open(tmp_path / "two_R2.fq.gz", "wt") as f:
        f.write(body)
    got = reads.fastq(spark, str(tmp_path), split).collect()
    for name in ("one", "two"):
        assert sorted((r.read_id, r.seq, r.qual) for r in got if r.sample == name) == sorted(rows)


def test_kmers_round_trip(spark, tmp_path):
    random.seed(1)
    rows = [(f"s{i % 3}", random.getrandbits(62), random.randint(1, 40000)) for i in range(500)]
    df = spark.createDataFrame(rows, "sample string, kmer long, freq int")
    written = binary.write_kmers(df, str(tmp_path / "k"), 5, rows=100)
    assert sum(r.rows for r in written.collect()) == sum(f > 5 for _, _, f in rows)
    back = binary.kmers(spark, str(tmp_path / "k"), split=16)
    assert sorted(tuple(r) for r in back.collect()) == sorted((s, k, min(f, 32767)) for s, k, f in rows if f > 5)
    high = binary.kmers(spark, str(tmp_path / "k"), min_freq=1000)
    assert high.count() == sum(f > 1000 for _, _, f in rows)
    assert C.table_counts(high).count() == high.count()
    packed = df.selectExpr("sample", "kmer", "cast(freq as long) * 1048577 as packed")
    binary.write_kmers(packed, str(tmp_path / "c"), -1, "packed", True)
    assert sorted(tuple(r) for r in binary.kmers(spark, str(tmp_path / "c"), long=True).collect()) == sorted((s, k, f * 1048577) for s, k, f in rows)
    first = next((tmp_path / "k").glob("*.bin")).read_bytes()
    assert len(first) % 10 == 0 and struct.unpack(">qh", first[:10])[1] > 5
    (tmp_path / "k" / "bad.kmers.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        binary.kmers(spark, str(tmp_path / "k")).count()


def test_components_round_trip(spark, tmp_path):
    comps = spark.createDataFrame([(1, 10), (2, 7)], "comp_no int, weight long")
    kmers = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "comp_no int, kmer long")
    assert binary.write_components(comps, kmers, str(tmp_path / "components.bin")) == 2
    got = sorted(tuple(r) for r in binary.components(spark, str(tmp_path / "components.bin")).collect())
    assert got == [(1, 2, 10, 3), (1, 2, 10, 5), (2, 1, 7, 9)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("a\t0\nb\t2\n")
    assert sorted(tuple(r) for r in text.classes(spark, str(tmp_path / "classes.txt")).collect()) == [("a", 0), ("b", 2)]
    (tmp_path / "a.vec").write_text("3\n\n0\n7\n")
    assert sorted(tuple(r) for r in text.vector(spark, str(tmp_path / "a.vec")).collect()) == [("a", 1, 3.0), ("a", 2, 0.0), ("a", 3, 7.0)]
    d = spark.createDataFrame([("a", "b", 0.25), ("c", "a", 1.0), ("b", "c", 0.5)], "sample_i string, sample_j string, dist double")
    lines = text.matrix_lines(d, ["a", "c", "b"])
    assert lines[:2] == ["#\ta\tc\tb", "a\t0.0000\t1.0000\t0.2500"]
    text.write_lines(lines, str(tmp_path / "m.txt"))
    assert text.parse_matrix((tmp_path / "m.txt").read_text().splitlines()) == [("a", "c", 1.0), ("a", "b", 0.25), ("c", "b", 0.5)]
    assert text.parse_matrix(["0\t0.5", "0.5\t0"]) == [("1 library", "2 library", 0.5)]
    with pytest.raises(ValueError):
        text.parse_matrix(["0\t1", "1"])
    (tmp_path / "x.sam").write_text("@HD\nr1\t0\tc1\t5\t60\t10M\t*\nr2\t0\tc1\t7\t60\t3M2D\t*\nr3\t4\t*\t0\t0\t*\t*\n")
    assert [tuple(r) for r in text.sam(spark, str(tmp_path / "x.sam")).collect()] == [("c1", 5, 14)]
    (tmp_path / "p.txt").write_text("#ff0000\n\n#00ff00\n")
    assert text.colors_file(spark, str(tmp_path / "p.txt")) == ["#ff0000", "#00ff00"]
    f = spark.createDataFrame([("a", 2, 5), ("a", 1, 4)], "sample string, comp_no int, value long")
    text.write_vectors(f, str(tmp_path / "v"))
    assert next((tmp_path / "v" / "sample=a").glob("*.txt")).read_text() == "4\n5\n"


def test_pictures_and_graph_lines(spark):
    import numpy as np

    d = np.array([[0, 0.5], [0.5, 0]])
    merges, order = V.average_linkage(d)
    svg = text.heatmap_svg(["a<", "b"], d.tolist(), merges)
    assert svg.count("<rect") == 4 and svg.count("<path") == 1 and "a&lt;" in svg and order == [0, 1]
    assert text.shade(0) == "#ffffff" and text.shade(2) == "#0c3d8a"
    units = spark.createDataFrame([(1, "ACGTA")], "id int, seq string")
    counts = spark.createDataFrame([(6, 2), (27, 3)], "kmer long, freq int")  # ACG, CGT = ACG on the other strand
    seg = text.gfa_segments(units, counts, 3)
    assert seg.first().coverage == 2 + 2 + 0 and seg.first().length == 5
    links = spark.createDataFrame([(1, "+", 1, "-")], "a int, a_strand string, b int, b_strand string")
    assert [r.value for r in text.gfa_lines(seg, links, 3).collect()] == ["S\t1\tACGTA\tLN:i:5\tKC:i:4", "L\t1\t+\t1\t-\t2M"]
    u = spark.createDataFrame([("CC", 2, 1, 1, 1), ("AC", 2, 5, 4, 6)], "seq string, length int, av_weight long, min_weight long, max_weight long")
    assert sorted(r.value for r in text.fasta_lines(u).collect())[0] == ">1 length=2 av_weight=5 min_weight=4 max_weight=6\nAC"
    assert sorted(r.value for r in text.kmer_fasta(counts, 3).collect()) == [">1\nACG", ">2\nCGT"]
    assert sorted(r.value for r in text.kmer_lines(counts, 3).collect()) == ["ACG\t2", "CGT\t3"]


def test_kmer_view_keeps_the_most_abundant(spark, tmp_path):
    """A sample's count saturates at 32,767, the sum over the samples does not, and no k-mer is left out."""
    rows = [("a", 5, 20_000), ("b", 5, 15_000), ("a", 6, 40_000), ("b", 7, 3)]
    df = spark.createDataFrame(rows, "sample string, kmer long, freq long").selectExpr("*", "timestamp'2024-01-01' AS run_at", "timestamp'2024-01-02' AS loaded_at")
    df.write.parquet(f"{tmp_path}/kmer_counts.parquet")
    got = sorted(int(r.value.split("\t")[1]) for r in catalog.kmer_view(spark, str(tmp_path)).collect())
    assert got == [3, 32_767, 35_000]


def test_png_ranks_and_dense_vectors(spark, tmp_path):
    import struct
    import zlib

    png = text.heatmap_png([[0.0, 1.0], [0.5, 0.0]])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (2 * text.CELL, 2 * text.CELL)
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert len(raw) == 2 * text.CELL * (1 + 6 * text.CELL) and raw[1:4] == b"\xff\xff\xff" and raw[1 + 3 * text.CELL :][:3] == bytes(text.DARK)
    (tmp_path / "ranks").write_text("ACGT 3\n\nTTTT\t0\nxx 1\n")
    assert sorted(tuple(r) for r in text.ranks(spark, str(tmp_path / "ranks")).collect()) == [(27, 3.0), (255, 0.0)]
    df = spark.createDataFrame([("a", 3, 7), ("b", 1, 5)], "sample string, comp_no int, value long")
    comps = spark.createDataFrame([(1,), (2,), (3,)], "comp_no int")
    text.write_vectors(df, str(tmp_path / "v"), components=comps)
    read = lambda s: [x for p in (tmp_path / "v" / f"sample={s}").glob("*.txt") for x in p.read_text().split()]
    assert (read("a"), read("b")) == (["0", "0", "7"], ["5", "0", "0"])
