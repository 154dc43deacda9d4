"""Counting as reads arrive: a stream of reads to k-mer counts and daily totals, with late and repeated rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandlake.functions import dna
from strandlake.functions.windows import group_counts, window_codes
from strandlake.runtime import own_dir
from strandlake.tables import sample_name


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files under `path`, new ones included as they come; of a single file, that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(jvm_path).isFile():
        return reader.option("pathGlobFilter", jvm_path.getName()).parquet(jvm_path.getParent().toString())
    return reader.parquet(path)


def good_stream(reads: DataFrame, late: str = "60 days") -> DataFrame:
    """Good reads of a stream under their sample's name. A read delivered again within `late` is dropped by its number."""
    rows = reads.where(F.col("seq").isNotNull() & ~F.upper("seq").contains("N") & F.col("run_at").isNotNull())
    rows = rows.withColumns({"run_at": F.col("run_at").cast("timestamp"), "seq": F.upper("seq"), "sample": sample_name("sample")})
    return rows.withWatermark("run_at", late).dropDuplicatesWithinWatermark(["read_no"])


def stream_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Running counts (`day`, `sample`, `kmer`, `freq`) of a good stream; a day's state is dropped after the watermark."""
    rows = reads.select("run_at", "sample", F.explode(window_codes("seq", k)).alias("kmer"))
    rows = rows.groupBy(F.window("run_at", "1 day").alias("w1"), "sample", "kmer").agg(F.count("*").alias("freq"))
    return rows.select(F.date_format("w1.start", "yyyy-MM-dd").alias("day"), "sample", dna.decode("kmer", k).alias("kmer"), "freq")


def stream_days(reads: DataFrame) -> DataFrame:
    """Reads and letters per day and sample of a good stream."""
    rows = reads.groupBy(F.window("run_at", "1 day").alias("w1"), "sample").agg(
        F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("letters")
    )
    return rows.select(F.date_format("w1.start", "yyyy-MM-dd").alias("day"), "sample", "n_reads", "letters")


def kmers_by_day(reads: DataFrame, k: int, above: int = 0) -> DataFrame:
    """(`day`, `sample`, `kmer`, `freq`): what `stream_kmers` counts more than `above` times in all that is there.

    The stream's state is the numbers of the reads, not a row for every k-mer: reads that it lets pass are written as they
    come and counted by day and sample when they are asked for.
    """
    rows = arrived(reads.select(F.date_format("run_at", "yyyy-MM-dd").alias("day"), "sample", "seq"))
    return group_counts(rows, k, above, "day", "sample").select("day", "sample", dna.decode("kmer", k).alias("kmer"), "freq")


def arrived(stream: DataFrame) -> DataFrame:
    """Run a stream in append mode over all that is there; its rows, from a table in the shared folder."""
    return _run(stream, "append").drop("__batch")


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over all that is there; the last row of each key, from a table in the shared folder."""
    rows = _run(stream, "update")
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "__batch").alias(c) for c in rest])


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of all batches with `__batch`.

    Each batch writes to a folder of its own number, so a batch that is run again after a failure overwrites itself.
    """
    spark = stream.sparkSession
    base = os.path.join(own_dir(spark), "streams", uuid.uuid4().hex)
    schema = StructType([*stream.schema.fields, StructField("__batch", IntegerType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/out/batch-{number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    except Exception as e:  # no batch wrote anything
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
