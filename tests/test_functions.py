import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.functions import dna, windows
from tests import models as M


def test_letters_and_codes(spark):
    random.seed(1)
    rows = [("".join(random.choice("ACGT") for _ in range(k)),) for k in (1, 2, 5, 8, 31) for _ in range(5)]
    df = spark.createDataFrame(rows, "s string")
    for r in df.select("s", dna.revcomp("s").alias("r"), dna.canonical("s").alias("c"), dna.encode("s").alias("e")).collect():
        assert (r.r, r.c, r.e) == (M.rc(r.s), M.canon(r.s), M.encode(r.s))
    for k in (1, 2, 5, 8, 31):
        some = df.where(F.length("s") == k).withColumn("e", dna.encode("s"))
        some = some.select("s", dna.decode("e", k).alias("d"), dna.code_revcomp("e", k).alias("r"), dna.neighbours("s").alias("n"))
        for r in some.collect():
            assert r.d == r.s and r.r == M.encode(M.rc(r.s))
            assert set(r.n) == M.neighbours(M.canon(r.s))


def test_windows_of_short_null_and_mixed(spark):
    df = spark.createDataFrame([("ACG",), ("AC",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(dna.windows("s", 3)).collect()] == [["ACG"], [], None, []]


@pytest.mark.parametrize("k", [1, 2, 5, 21, 31])
def test_vectorised_windows(k):
    random.seed(k)
    seqs = ["".join(random.choice("ACGTNacgt") for _ in range(random.choice([0, 3, 20, 50]))) for _ in range(60)] + [None, ""]
    got = windows.canonical_kmers(*windows.flat(pa.array(seqs)), k)
    assert got.tolist() == [M.encode(x) for s in seqs if s for x in M.kmers(s.upper(), k)]
    assert len(windows.canonical_kmers(*windows.flat(pa.array([], pa.string())), k)) == 0
    assert got.dtype == np.int64


def test_packed_counters(spark):
    df = spark.range(1).select(F.lit(0).cast("long").alias("p"))
    df = df.withColumn("p", dna.color_set("p", 0, 5)).withColumn("p", dna.color_set("p", 2, 1 << 30))
    df = df.withColumn("q", dna.color_add(dna.color_add("p", 1, 7), 2)).withColumn("z", dna.color_clear("q", 0))
    r = df.select("p", "q", "z", *[dna.color_get("q", c).alias(f"c{c}") for c in range(3)], dna.color_get("z", 0).alias("z0")).first()
    assert (r.c0, r.c1, r.c2, r.z0) == (5, 7, dna.COLOR_MAX, 0)


def test_dominant_color(spark):
    rows = [(0, 0, 0, -1), (9, 1, 0, 0), (1, 9, 0, 1), (0, 0, 3, 2), (8, 2, 0, -1)]
    df = spark.createDataFrame(rows, "a long, b long, c long, want int")
    assert df.where(dna.dominant_color("a", "b", "c") != F.col("want")).isEmpty()
