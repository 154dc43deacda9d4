"""The input tables and what counts as a row of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Rows delivered again count once: distinct over `columns`, by default all but `loaded_at`.

    The distinct is pre-aggregated before its shuffle, so a row repeated any number of times costs one row per task.
    """
    keep = columns or tuple(c for c in df.columns if c != "loaded_at")
    return df.select(*keep).distinct()


def sample_name(column: str | Column) -> Column:
    """The sample of a read file: its name without a mate suffix."""
    return F.regexp_replace(F.col(column) if isinstance(column, str) else column, "_[rR][12]$", "")


def members(kmer_counts: DataFrame, *columns: str) -> DataFrame:
    """Rows of a count table that state an occurrence: non-null k-mer, frequency of at least 1; delivered rows once."""
    return once(kmer_counts.where("kmer IS NOT NULL AND freq >= 1"), *columns)


def good_reads(seq_reads: DataFrame, repeated: bool = False) -> DataFrame:
    """Reads with letters only from ACGT, in upper case, under the sample's name; delivered rows once.

    `repeated` leaves rows that were delivered again in, for what doesn't count reads: no shuffle.
    """
    df = seq_reads.where(F.col("seq").isNotNull() & ~F.upper("seq").contains("N"))
    return (df if repeated else once(df)).withColumns({"seq": F.upper("seq"), "sample": sample_name("sample")})
