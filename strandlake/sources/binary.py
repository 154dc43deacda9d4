"""Fixed-width binary k-mer tables and component files, read in splits and written one file per sample."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from strandlake.functions.dna import FREQ_MAX
from strandlake.sources.reads import Range, listed, opened

#: Big-endian records, a LONG k-mer with a SHORT frequency or with a LONG of packed counters.
SHORT, LONG = np.dtype([("kmer", ">i8"), ("value", ">i2")]), np.dtype([("kmer", ">i8"), ("value", ">i8")])
SPLIT_RECORDS = 4 << 20


class KmersSource(DataSource):
    """Options: `path`, `long` (records of two LONGs), `min_freq` (rows up to it are dropped in the scan)."""

    @classmethod
    def name(cls) -> str:
        return "strandlake_kmers"

    def schema(self) -> str:
        return "file string, kmer long, value long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return KmersReader(dict(self.options))


class KmersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.least = options["path"], int(options.get("min_freq", -1))
        self.kind = LONG if options.get("long", "false") == "true" else SHORT
        self.step = int(options.get("split", SPLIT_RECORDS)) * self.kind.itemsize

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            if size % self.kind.itemsize:
                raise ValueError(f"{path}: {size} bytes are no whole number of records of {self.kind.itemsize}")
            out += [Range(path, s, min(size, s + self.step)) for s in range(0, size, self.step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, name = opened(part.path)
        with fs.open_input_file(name) as f:
            rows = np.frombuffer(f.read_at(part.end - part.start, part.start), self.kind)
        rows = rows[rows["value"] > self.least] if self.least >= 0 else rows
        for i in range(0, len(rows), 1 << 18):
            some = rows[i : i + (1 << 18)]
            columns = [pa.array([part.path]).take(pa.array(np.zeros(len(some), np.int8))), *(pa.array(some[c].astype(np.int64)) for c in some.dtype.names)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "kmer", "value"])


def kmers(spark: SparkSession, path: str, min_freq: int = -1, long: bool = False, split: int = SPLIT_RECORDS) -> DataFrame:
    """(`sample`, `kmer`, `freq`), or with `long` (`sample`, `kmer`, `packed`), of .kmers.bin files; the sample is the file's name."""
    spark.dataSource.register(KmersSource)
    reader = spark.read.format("strandlake_kmers").option("path", path).option("split", str(split))
    rows = reader.option("min_freq", str(min_freq)).option("long", str(long).lower()).load()
    sample = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(\.part-\d+)?\.kmers\.bin$", "")
    value = F.col("value").alias("packed") if long else F.col("value").cast("int").alias("freq")
    return rows.select(sample.alias("sample"), "kmer", value)


def write_kmers(counts: DataFrame, folder: str, min_freq: int = 0, value: str = "freq", long: bool = False, rows: int = 64 << 20) -> DataFrame:
    """Write a count table as one or more files a sample: `sample.part-N.kmers.bin`; returns (`sample`, `file`, `rows`).

    Rows above `min_freq`, frequencies kept at the 16-bit maximum. A sample's rows are spread over parts of about `rows`
    by a hash of the k-mer, so no task writes a whole large sample.
    """
    kind = LONG if long else SHORT
    table = counts.where(F.col(value) > min_freq)
    parts = max(1, -(-table.count() // rows))
    table = table.select("sample", "kmer", F.col(value).cast("long").alias("value"), F.pmod(F.xxhash64("kmer"), F.lit(parts)).cast("int").alias("part"))
    table = table.repartition("sample", "part").sortWithinPartitions("sample", "part", "kmer")
    fs, name = opened(folder)
    fs.create_dir(name, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = opened(folder)
        key, out, done = None, None, []
        for batch in batches:
            samples, part = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            data = np.empty(batch.num_rows, kind)
            data["kmer"] = batch.column(1).to_numpy()
            v = batch.column(2).to_numpy()
            data["value"] = v if long else np.minimum(v, FREQ_MAX)
            keys = list(zip(samples, part))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    if out:
                        out.close()
                    key = keys[a]
                    file = f"{name}/{key[0]}.part-{key[1]}.kmers.bin"
                    out = fs.open_output_stream(file)
                    done.append([key[0], file, 0])
                out.write(data[a:b].tobytes())
                done[-1][2] += b - a
        if out:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["sample", "file", "rows"])

    written = table.mapInArrow(work, "sample string, file string, rows long").collect()  # one row a file
    return counts.sparkSession.createDataFrame(written, "sample string, file string, rows long")


class ComponentsSource(DataSource):
    """Component files: a count, then per component its size, weight and k-mers; numbered from 1. A file is a split."""

    @classmethod
    def name(cls) -> str:
        return "strandlake_components"

    def schema(self) -> str:
        return "file string, comp_no int, size long, weight long, kmer long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ComponentsReader(self.options["path"])


class ComponentsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        return [Range(p, 0, s) for p, s in listed(self.path)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, name = opened(part.path)
        with fs.open_input_stream(name) as f:
            (n,) = struct.unpack(">i", f.read(4))
            for no in range(1, n + 1):
                size, weight = struct.unpack(">iq", f.read(12))
                codes = np.frombuffer(f.read(8 * size), ">i8").astype(np.int64)
                same = lambda x, t, size=size: pa.array([x], t).take(pa.array(np.zeros(size, np.int8)))
                columns = [same(part.path, pa.string()), same(no, pa.int32()), same(size, pa.int64()), same(weight, pa.int64()), pa.array(codes)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "comp_no", "size", "weight", "kmer"])


def components(spark: SparkSession, path: str) -> DataFrame:
    """(`comp_no`, `size`, `weight`, `kmer`), a row a k-mer."""
    spark.dataSource.register(ComponentsSource)
    return spark.read.format("strandlake_components").option("path", path).load().drop("file")


def write_components(comps: DataFrame, kmers: DataFrame, file: str) -> int:
    """Write one component file in the order of `comp_no`; returns the number of components.

    The format is a single sequential file, so rows stream to the driver partition by partition, never all at once.
    """
    rows = kmers.groupBy("comp_no").agg(F.sort_array(F.collect_list("kmer")).alias("k")).join(comps.select("comp_no", "weight"), "comp_no")
    n = rows.count()
    fs, name = opened(file)
    with fs.open_output_stream(name) as out:
        out.write(struct.pack(">i", n))
        for r in rows.orderBy("comp_no").toLocalIterator():
            out.write(struct.pack(">iq", len(r.k), r.weight))
            out.write(np.array(r.k, ">i8").tobytes())
    return n
