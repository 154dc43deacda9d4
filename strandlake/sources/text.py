"""Text formats: sequences, graphs, vectors, matrices, class tables, alignments, heat maps."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.functions.windows import window_rows
from strandlake.runtime import numbered
from strandlake.sources.reads import opened

#: Fixed values of the heat map: cell size in pixels, colour of distance 1 (0 is white).
CELL, DARK = 40, (12, 61, 138)


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(`sample`, `color`) of a tab-separated class file."""
    return spark.read.csv(path, sep="\t", schema="sample string, color int")


def vector(spark: SparkSession, path: str) -> DataFrame:
    """(`sample`, `comp_no`, `value`) of vector files, a number a line; blank lines don't count. A file is one row to split."""
    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    sample = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.(vec|breadth)$", "")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return rows.select(sample.alias("sample"), F.posexplode(lines).alias("i", "v")).select("sample", (F.col("i") + 1).alias("comp_no"), F.col("v").cast("double").alias("value"))


def write_vectors(features: DataFrame, folder: str, value: str = "value", components: DataFrame | None = None) -> None:
    """One folder a sample with its values in the order of `comp_no`, a number a line.

    With `components` (`comp_no`) a sample has a line for each of them, 0 where it has no row; without, line i is component
    i only if the features are dense.
    """
    if components is not None:
        every = features.select("sample").distinct().crossJoin(components.select("comp_no").distinct())  # the dense table is the result
        features = every.join(features.select("sample", "comp_no", value), ["sample", "comp_no"], "left").fillna(0, [value])
    rows = features.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("comp_no", F.col(value).alias("v")))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: x["v"].cast("string")), "\n")
    rows.select("sample", text.alias("value")).write.partitionBy("sample").text(folder)


def matrix_lines(distances: DataFrame, samples: list[str], digits: int = 4) -> list[str]:
    """A symmetric matrix as tab-separated lines under a # header; `samples` gives the order and is its size."""
    place = {s: i for i, s in enumerate(samples)}
    cells = [["0" if i == j else "" for j in samples] for i in samples]
    for i in range(len(samples)):
        cells[i][i] = f"{0:.{digits}f}"
    for r in distances.where(F.col("sample_i").isin(samples) & F.col("sample_j").isin(samples)).collect():
        i, j = place[r.sample_i], place[r.sample_j]
        cells[i][j] = cells[j][i] = f"{r.dist:.{digits}f}"
    return ["\t".join(["#", *samples]), *("\t".join([s, *c]) for s, c in zip(samples, cells))]


def parse_matrix(lines: list[str]) -> list[tuple[str, str, float]]:
    """(`sample_i`, `sample_j`, `dist`) above the diagonal of such lines; without a header samples are named by number."""
    rows = [x.split("\t") for x in lines if x.strip()]
    if rows and rows[0][0].startswith("#"):
        names, rows = rows[0][1:], [r[1:] for r in rows[1:]]
    else:
        names = [f"{i + 1} library" for i in range(len(rows))]
    if any(len(r) != len(names) for r in rows) or len(rows) != len(names):
        raise ValueError("not a square matrix")
    return [(names[i], names[j], float(rows[i][j])) for i in range(len(names)) for j in range(i + 1, len(names))]


def write_lines(lines, file: str) -> None:
    fs, name = opened(file)
    with fs.open_output_stream(name) as out:
        for x in lines:
            out.write((x + "\n").encode())


def colors_file(spark: SparkSession, path: str) -> list[str]:
    """#RRGGBB lines: a palette, read by the driver."""
    found = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    if any(len(x) != 7 or x[0] != "#" for x in found):
        raise ValueError("a line is no #RRGGBB")
    return found


def shade(dist: float) -> str:
    """White at 0 to DARK at 1, linear, clamped."""
    t = min(max(dist, 0.0), 1.0)
    return "#" + "".join(f"{round(255 + (c - 255) * t):02x}" for c in DARK)


def heatmap_svg(names: list[str], dist: list[list[float]], merges=()) -> str:
    """Heat map of a matrix in its order, with the dendrogram of `merges` (features.Merge) to the left if given.

    Leaves of `merges` are numbers of `names` before ordering; pass names and matrix in leaf order.
    """
    n, tree = len(names), 160 if merges else 0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{tree + CELL * n + 200}" height="{CELL * n + 200}">']
    for i in range(n):
        for j in range(n):
            out.append(f'<rect x="{tree + CELL * j}" y="{CELL * i}" width="{CELL}" height="{CELL}" fill="{shade(dist[i][j])}"/>')
        safe = names[i].replace("&", "&amp;").replace("<", "&lt;")
        out.append(f'<text x="{tree + CELL * n + 8}" y="{CELL * i + CELL // 2 + 4}" font-size="12">{safe}</text>')
        at = tree + CELL * i + CELL // 2
        out.append(f'<text x="{at}" y="{CELL * n + 12}" font-size="12" transform="rotate(90 {at} {CELL * n + 12})">{safe}</text>')
    spot = {i: (float(tree), CELL * i + CELL / 2) for i in range(n)}
    top = max((m.height for m in merges), default=1) or 1
    for step, m in enumerate(merges):
        x = tree - (tree - 10) * m.height / top
        (x1, y1), (x2, y2) = spot[m.left], spot[m.right]
        out.append(f'<path d="M{x1:.1f} {y1:.1f} H{x:.1f} V{y2:.1f} H{x2:.1f}" fill="none" stroke="black"/>')
        spot[n + step] = (x, (y1 + y2) / 2)
    return "\n".join([*out, "</svg>"])


def heatmap_png(dist: list[list[float]]) -> bytes:
    """The cells of a heat map in the matrix's order as a PNG picture, without names."""
    rgb = [[bytes.fromhex(shade(x)[1:]) for x in row] for row in dist]
    lines = b"".join((b"\0" + b"".join(c * CELL for c in row)) * CELL for row in rgb)
    size = struct.pack(">II", CELL * len(dist[0]) if dist else 0, CELL * len(dist))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = chunk(b"IHDR", size + bytes([8, 2, 0, 0, 0]))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """(`kmer`, `rank`) of a rank file: letters of a k-mer and a number a line, apart by blanks; other lines don't count."""
    f = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.size(f) >= 2).select(f[0].alias("w"), f[1].cast("double").alias("rank"))
    return rows.where("w RLIKE '^[ACGT]+$' AND rank IS NOT NULL").select(dna.encode("w").alias("kmer"), "rank")


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """(`value`): header and sequence of unitigs, numbered in the order of their sequences."""
    rows = numbered(sequences, ["seq"], "no", 1)
    head = F.format_string(">%d length=%d av_weight=%d min_weight=%d max_weight=%d", "no", "length", "av_weight", "min_weight", "max_weight")
    return rows.select(F.concat_ws("\n", head, "seq").alias("value"))


def kmer_fasta(kmers: DataFrame, k: int) -> DataFrame:
    """(`value`): k-mers as FASTA records numbered by code, or with `comp_no` as records of their component."""
    if "comp_no" in kmers.columns:
        rows = kmers.select("comp_no", F.concat_ws("\n", F.concat(F.lit(">comp_"), "comp_no"), dna.decode("kmer", k)).alias("value"))
        return rows
    rows = numbered(kmers.select("kmer"), ["kmer"], "no", 1)
    return rows.select(F.concat_ws("\n", F.concat(F.lit(">"), "no"), dna.decode("kmer", k)).alias("value"))


def kmer_lines(counts: DataFrame, k: int, *values: str) -> DataFrame:
    """(`value`): tab-separated letters and values of k-mers."""
    return counts.select(F.concat_ws("\t", dna.decode("kmer", k), *[F.col(v).cast("string") for v in values or ("freq",)]).alias("value"))


def gfa_segments(units: DataFrame, counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `id`, `seq`, `length`, `coverage`): unitigs with the summed coverage of their letters.

    Coverage is that of all k-mers plus, for the k - 1 letters that the last one ends with, that of the last k-mer.
    """
    rows = window_rows(units.select(*keys, "id", "seq"), k, *keys, "id")
    rows = rows.join(units.select(*keys, "id", F.length("seq").alias("length")), [*keys, "id"])
    rows = rows.join(counts.select("kmer", "freq"), "kmer", "left").fillna(0, ["freq"])
    last = F.col("place") == F.col("length") - k
    total = F.sum(F.col("freq") * F.when(last, k).otherwise(1)).alias("coverage")
    return units.select(*keys, "id", "seq", F.length("seq").alias("length")).join(rows.groupBy(*keys, "id").agg(total), [*keys, "id"])


def gfa_lines(segments: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(`value`): S and L lines."""
    s = segments.select(F.format_string("S\t%s\t%s\tLN:i:%d\tKC:i:%d", F.col("id").cast("string"), "seq", "length", "coverage").alias("value"))
    to = F.format_string(f"L\t%s\t%s\t%s\t%s\t{k - 1}M", F.col("a").cast("string"), "a_strand", F.col("b").cast("string"), "b_strand")
    return s.unionByName(links.select(to.alias("value")))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(`contig`, `start`, `end`) of the alignments of a SAM file whose CIGAR is a single match NNM; places from 1."""
    f = F.split(F.col("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(f) > 5))
    n = F.regexp_extract(f[5], r"^(\d+)M$", 1)
    rows = rows.select(f[2].alias("contig"), f[3].cast("int").alias("start"), n.alias("n")).where("n <> '' AND contig <> '*'")
    return rows.select("contig", "start", (F.col("start") + F.col("n").cast("int") - 1).alias("end"))
