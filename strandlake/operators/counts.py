"""Operators on count tables (`sample`, `kmer`, `freq`): counting, thresholds, set filters, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions import dna
from strandlake.functions.windows import window_counts
from strandlake.runtime import join_small


def kmer_counts(reads: DataFrame, k: int = 31, min_freq: int = 1, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Canonical k-mers of `seq` per key, with frequencies above `min_freq`, saturated at 16 bits.

    One shuffle on (key, k-mer), pre-aggregated in the tasks. Reads shorter than k and null reads add nothing.
    `by=()` counts all reads as one sample.
    """
    counted = window_counts(reads, k, *by).withColumn("freq", dna.saturated(F.col("freq")))
    return counted.where(F.col("freq") > min_freq)


def table_counts(rows: DataFrame, min_freq: int = 0) -> DataFrame:
    """A count table as loaded: rows above `min_freq` first, then summed per sample and k-mer with saturation.

    `rows` may hold a sample in several runs. Null samples, k-mers or frequencies are left out.
    """
    rows = rows.where(F.col("sample").isNotNull() & F.col("kmer").isNotNull() & (F.col("freq") > min_freq))
    return rows.groupBy("sample", "kmer").agg(dna.saturated(F.sum("freq")).alias("freq"))


def pooled(counts: DataFrame, min_freq: int = 0) -> DataFrame:
    """All samples of a count table as one (`kmer`, `freq`)."""
    return counts.where(F.col("freq") > min_freq).groupBy("kmer").agg(dna.saturated(F.sum("freq")).alias("freq"))


def histogram(counts: DataFrame, *by: str) -> DataFrame:
    """Number of k-mers of each frequency, over all rows whatever a later threshold drops."""
    return counts.groupBy(*by, "freq").agg(F.count("*").alias("n_kmers"))


def clamped_histogram(counts: DataFrame, top: int = 1023, *by: str) -> DataFrame:
    """The same with frequencies above `top` counted as `top`."""
    return counts.groupBy(*by, F.least("freq", F.lit(top)).alias("freq")).agg(F.count("*").alias("n_kmers"))


def bottom_cut(counts: DataFrame, percent: int, *by: str) -> DataFrame:
    """Threshold per key: the smallest frequency below which at least `percent` of all frequency mass lies.

    On the clamped histogram, at most 1023 rows a key; shares are whole numbers, rounded down.
    """
    h = clamped_histogram(counts, 1023, *by).withColumn("mass", F.col("freq") * F.col("n_kmers"))
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("mass").over(every.orderBy("freq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumns({"below": below, "upto": below + F.col("mass"), "goal": F.expr(f"sum(mass) OVER (PARTITION BY {', '.join(by) or '0'}) * {percent} DIV 100")})
    return h.groupBy(*by).agg(
        F.min(F.when(F.col("goal") <= 0, F.lit(0)).when(F.col("upto") >= F.col("goal"), F.col("freq") + 1)).alias("threshold")
    )


def first_minimum(counts: DataFrame, *by: str) -> DataFrame:
    """Threshold per key: the first frequency v from 1 on whose mass (v times its k-mers) is not above that of v + 1.

    The search ends early where the k-mers up to v are more than half of the summed frequencies. On the clamped
    histogram; a frequency that no k-mer has counts as mass 0.
    """
    h = clamped_histogram(counts, 1023, *by).where("freq > 0").withColumn("mass", F.col("freq") * F.col("n_kmers"))
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    run = every.orderBy("freq")
    total = counts.groupBy(*by).agg(F.sum(F.col("freq").cast("long")).alias("total"))
    h = h.withColumns(
        {
            "next": F.lead("freq").over(run),
            "more": F.lead("mass").over(run),
            "before": F.coalesce(F.lag("freq").over(run), F.lit(0)),
            "upto": F.sum("n_kmers").over(run),
        }
    )
    h = h.join(total, list(by)) if by else h.crossJoin(total)  # one row
    here = (F.coalesce(F.col("next"), F.lit(-1)) == F.col("freq") + 1) & (F.col("mass") <= F.col("more"))
    stop = (
        F.when((F.col("before") == 0) & (F.col("freq") > 1), F.lit(1))
        .when(here | (2 * F.col("upto") > F.col("total")), F.col("freq"))
        .when(F.coalesce(F.col("next"), F.lit(-1)) != F.col("freq") + 1, F.col("freq") + 1)
    )
    return h.groupBy(*by).agg(F.min(stop).cast("int").alias("threshold"))


def samples_per_kmer(counts: DataFrame, min_freq: int = 1) -> DataFrame:
    """In how many samples each k-mer has a frequency above `min_freq`."""
    return counts.where(F.col("freq") > min_freq).groupBy("kmer").agg(F.count_distinct("sample").alias("n_samples"))


def with_class(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of samples with a class, with `color`. The class table is broadcast if counting shows it small."""
    known = classes.where("sample IS NOT NULL AND color IS NOT NULL").groupBy("sample").agg(F.min("color").alias("color"))
    return join_small(counts, known, "sample")


def present(color: int) -> Column:
    return F.count_if(F.col("color") == color)


def grouped_samples(kmers: DataFrame, counts: DataFrame, classes: DataFrame, min_freq: int = 1) -> DataFrame:
    """For each k-mer of a given set: in how many samples of class 0, 1, 2 it occurs; zeros stay."""
    seen = with_class(counts.where(F.col("freq") > min_freq), classes)
    wanted = kmers.select("kmer").distinct()
    seen = seen.join(wanted, "kmer", "left_semi").groupBy("kmer").agg(*[present(g).alias(f"n_{g}") for g in range(3)])
    return wanted.join(seen, "kmer", "left").fillna(0, [f"n_{g}" for g in range(3)])


def kmers_per_sample(counts: DataFrame, percent: int = 20, min_freq: int = 0, skip_first: bool = False) -> DataFrame:
    """Dense (k-mer, sample) counts of k-mers that occur in at least `percent` of the samples (whole number, rounded down).

    `skip_first` leaves the first sample by name out of the support, as some published results do.
    """
    counts = counts.where(F.col("freq") > min_freq)
    samples = counts.select("sample").distinct()
    n = samples.count()
    support = counts
    if skip_first:
        first = samples.agg(F.min("sample")).first()[0]
        support = counts.where(F.col("sample") != F.lit(first))
    common = support.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= n * percent // 100).select("kmer")
    dense = common.crossJoin(samples)  # the dense matrix is the result
    return dense.join(counts, ["kmer", "sample"], "left").select("kmer", "sample", F.coalesce("freq", F.lit(0)).alias("freq"))


def kmers_filter(counts: DataFrame, filters: DataFrame, min_freq: int = 1, max_thresh: int = 0) -> DataFrame:
    """Rows above `min_freq` whose k-mer has in the filter samples a frequency sum above `max_thresh` a sample."""
    strong = filters.where(F.col("freq") > min_freq)
    n = filters.select("sample").distinct().count()
    kept = pooled(strong).where(F.col("freq") > max_thresh * n).select("kmer")
    return counts.where(F.col("freq") > min_freq).join(kept, "kmer", "left_semi")


def multiple_filters(counts: DataFrame, sets: list[DataFrame], min_freq: int = 1) -> DataFrame:
    """Rows above `min_freq` with the values `f_0`, `f_1`, ... of their k-mer in each set (`kmer`, `n_samples`), 0 if absent."""
    out = counts.where(F.col("freq") > min_freq)
    for i, s in enumerate(sets):
        out = out.join(s.select("kmer", F.col("n_samples").alias(f"f_{i}")), "kmer", "left")
    return out.fillna(0, [f"f_{i}" for i in range(len(sets))])


def in_any(filtered: DataFrame) -> DataFrame:
    named = [c for c in filtered.columns if c.startswith("f_")]
    return filtered.where(F.greatest(*named) > 0)


def unique_kmers(counts: DataFrame, filters: DataFrame, min_freq: int = 1) -> DataFrame:
    """K-mers of the input (summed over its samples) that no filter sample has above `min_freq`.

    Columns `kmer`, `freq`, `n_samples`: the number of input samples lets callers ask for k-mers of at least i samples.
    """
    own = counts.where(F.col("freq") > min_freq).groupBy("kmer").agg(
        dna.saturated(F.sum("freq")).alias("freq"), F.count_distinct("sample").alias("n_samples")
    )
    return own.join(filters.where(F.col("freq") > min_freq).select("kmer"), "kmer", "left_anti")


def unique_levels(unique: DataFrame, least: int = 1, most: int = 1) -> DataFrame:
    """Nested results of `unique_kmers`: (`level`, `kmer`, `freq`) for level = least .. most input samples at least."""
    levels = F.sequence(F.lit(least), F.least(F.lit(most), F.col("n_samples").cast("int")))
    return unique.where(F.col("n_samples") >= least).select(F.explode(levels).alias("level"), "kmer", "freq")


def colored(counts: DataFrame, classes: DataFrame, min_freq: int = 1, values: bool = False) -> DataFrame:
    """Per k-mer the samples (or with `values` the frequencies) of class 0, 1, 2: `c0`, `c1`, `c2`, saturated at 20 bits."""
    rows = with_class(counts.where(F.col("freq") > min_freq), classes)
    amount = F.col("freq").cast("long") if values else F.lit(1).cast("long")
    each = [F.sum(F.when(F.col("color") == g, amount).otherwise(0)) for g in range(3)]
    return rows.groupBy("kmer").agg(*[F.least(c, F.lit(dna.COLOR_MAX)).alias(f"c{g}") for g, c in enumerate(each)])


def double_view(left: DataFrame, right: DataFrame) -> DataFrame:
    """(`kmer`, `left_count`, `right_count`): every k-mer of the first pooled table, 0 where the second has none."""
    a, b = left.select("kmer", F.col("freq").alias("left_count")), right.select("kmer", F.col("freq").alias("right_count"))
    return a.join(b, "kmer", "left").fillna(0, ["right_count"])


def presence_bitmap(counts: DataFrame, samples: DataFrame, min_freq: int = 0) -> DataFrame:
    """(`kmer`, `words`): bit i of the bitmap, 64 to a word, is set if sample number i has the k-mer above `min_freq`.

    `samples` (`sample`, `idx`) numbers the samples from 0. Words without a bit are 0.
    """
    rows = join_small(counts.where(F.col("freq") > min_freq), samples, "sample")
    n_words = (samples.agg(F.max("idx")).first()[0] or 0) // 64 + 1
    word = rows.groupBy("kmer", F.expr("cast(idx DIV 64 AS INT)").alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(idx % 64 AS INT))")).alias("__bits"))
    found = word.groupBy("kmer").agg(F.map_from_entries(F.collect_list(F.struct("__w", "__bits"))).alias("__m"))
    every = F.sequence(F.lit(0), F.lit(n_words - 1))
    return found.select("kmer", F.transform(every, lambda w: F.coalesce(F.col("__m")[w], F.lit(0).cast("long"))).alias("words"))


def cardinality(words: str | Column, start: int, end: int) -> Column:
    """Set bits of a bitmap in [start, end)."""
    w = dna.col(words)

    def inside(x: Column, i: Column) -> Column:
        low, high = F.greatest(F.lit(start) - i * 64, F.lit(0)), F.least(F.lit(end) - i * 64, F.lit(64))
        all_set = F.lit(-1).cast("long")
        ones = lambda n: F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", all_set, (64 - n).cast("int")))
        mask = ones(F.greatest(high, F.lit(0))).bitwiseAND(F.bitwise_not(ones(F.least(low, F.lit(64)))))
        return F.bit_count(x.bitwiseAND(mask))

    return F.aggregate(F.transform(w, inside), F.lit(0), lambda a, b: a + b)
