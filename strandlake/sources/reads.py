"""Reads from FASTA and FASTQ files, splittable unless compressed."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandlake.tables import sample_name

SPLIT = 64 << 20
BATCH = 10_000
EXTENSIONS = r"(\.(fa|fasta|fna|fq|fastq|fn))?(\.gz)?$"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def listed(paths: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a comma-separated list of files and folders names."""
    out = []
    for p in paths.split(","):
        fs, name = opened(p)
        info = fs.get_file_info(name)
        found = fs.get_file_info(pafs.FileSelector(name)) if info.type == pafs.FileType.Directory else [info]
        prefix = p.split("://")[0] + "://" if "://" in p else ""
        out += [(prefix + i.path, i.size) for i in found if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted(out)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(`sample`, `read_id`, `seq`): sequences may run over several lines; the sample is the file's name.

    Empty sequences and blank records are left out. Letters are upper-cased.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"))
    body = F.regexp_replace("value", r"^>", "")
    head = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), r"\r$", ""))
    seq = F.upper(F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), length(substring_index(regexp_replace(value, '^>', ''), '\\n', 1)) + 2)"), r"\s", ""))
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), EXTENSIONS, "")
    return rows.select(sample_name(name).alias("sample"), head.alias("read_id"), seq.alias("seq")).where("length(seq) > 0")


class FastqSource(DataSource):
    """FASTQ records of four lines. A split starts at the first line from its start that can only be a header: it begins
    with @, the second after it with +, and the sequence is as long as the qualities."""

    @classmethod
    def name(cls) -> str:
        return "strandlake_fastq"

    def schema(self) -> str:
        return "file string, read_id string, seq string, qual string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options["path"], int(self.options.get("split", SPLIT)))


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            step = max(size, 1) if path.endswith(".gz") else self.split
            out += [Range(path, s, min(size, s + step)) for s in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows: list[tuple] = []
        for head, seq, qual in records(part):
            rows.append((part.path, head, seq, qual))
            if len(rows) >= BATCH:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["file", "read_id", "seq", "qual"])


def records(part: Range) -> Iterator[tuple[str, str, str]]:
    """Records whose header starts inside the range."""
    fs, name = opened(part.path)
    with fs.open_input_stream(name, compression=None) if part.path.endswith(".gz") else fs.open_input_file(name) as raw:
        if part.path.endswith(".gz"):
            source, at, end = gzip.open(raw), 0, None
        else:
            source, at, end = io.BufferedReader(raw, 1 << 20), part.start, part.end
            if at:
                # The line that the range starts in belongs to the range before, unless it starts just here.
                source.seek(at - 1)
                at += len(source.readline()) - 1
        held: list[tuple[int, bytes]] = []

        def line() -> bool:
            nonlocal at
            text = source.readline()
            if text:
                held.append((at, text.rstrip(b"\r\n")))
                at += len(text)
            return bool(text)

        synced = part.start == 0 or end is None
        while True:
            while len(held) < 4 and line():
                pass
            if len(held) < 4:
                return
            fits = held[0][1][:1] == b"@" and held[2][1][:1] == b"+" and len(held[1][1]) == len(held[3][1])
            if not fits:
                if synced and held[0][1]:
                    raise ValueError(f"{part.path}: no record at byte {held[0][0]}")
                held.pop(0)
                if held and end is not None and held[0][0] >= end:
                    return
                continue
            if end is not None and held[0][0] >= end:
                return
            synced = True
            yield held[0][1][1:].decode(), held[1][1].decode().upper(), held[3][1].decode()
            held.clear()


def fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(`sample`, `read_id`, `seq`, `qual`) of FASTQ files, also .gz; the sample is the file's name without mate suffix."""
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("strandlake_fastq").option("path", path).option("split", str(split)).load()
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), EXTENSIONS, "")
    return rows.select(sample_name(name).alias("sample"), "read_id", "seq", "qual")


def good(reads: DataFrame) -> DataFrame:
    """Reads without other letters than ACGT."""
    return reads.where(F.col("seq").isNotNull() & ~F.col("seq").rlike("[^ACGT]"))
