"""Queries of the training-data operators by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import windows
from strandlake.llm import (
    clusters,
    distinct,
    frequent,
    mixing,
    neighbours,
    overlap,
    packing,
    repetition,
    spans,
    tokens,
)
from strandlake.runtime import join_small, materialize
from strandlake.tables import good_reads, members, sample_name, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


P1_SETS = """
WITH d AS (SELECT DISTINCT sample, kmer FROM kmer_counts WHERE kmer IS NOT NULL AND freq >= 1 AND sample IS NOT NULL),
c AS (SELECT sample, min(color) AS color FROM classes WHERE color IS NOT NULL GROUP BY sample),
s AS (SELECT d.sample, color, count(*) AS n FROM d JOIN c ON d.sample = c.sample GROUP BY d.sample, color),
o AS (SELECT x.sample AS a, y.sample AS b, count(*) AS shared FROM d x JOIN d y ON x.kmer = y.kmer AND x.sample < y.sample
      GROUP BY x.sample, y.sample)
"""


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kmer_counts").where("freq >= 1")
    return overlap.overlaps(rows, "sample", "kmer", table(spark, sf_dir, "classes"))


@query(
    P1_SETS
    + """SELECT a AS sample_a, b AS sample_b FROM o JOIN s x ON x.sample = a JOIN s y ON y.sample = b
WHERE x.color <> y.color AND shared >= 0.5 * least(x.n, y.n)"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of different classes that share at least half of the smaller one's k-mers."""
    near = _p1(spark, sf_dir).where("color_a <> color_b AND 2 * shared >= least(size_a, size_b)")
    return near.select(F.col("set_a").alias("sample_a"), F.col("set_b").alias("sample_b"))


@query(
    P1_SETS
    + """SELECT a AS set_a, b AS set_b, shared, x.n AS size_a, y.n AS size_b, x.color AS color_a, y.color AS color_b,
round(shared / (x.n + y.n - shared), 9) AS jaccard, round(shared / least(x.n, y.n), 9) AS containment
FROM o JOIN s x ON x.sample = a JOIN s y ON y.sample = b"""
)
def p1_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of samples that share k-mers, with sizes, shares and classes."""
    df = _p1(spark, sf_dir)
    return df.withColumns({c: F.round(c, 9) for c in ("jaccard", "containment")})


P3_ROWS = """
WITH c AS (SELECT sample, min(color) AS color FROM classes WHERE color IS NOT NULL GROUP BY sample),
k AS (SELECT DISTINCT sample, kmer, freq, run_at FROM kmer_counts WHERE kmer IS NOT NULL AND freq >= 1),
r AS (SELECT DISTINCT read_no, sample, read_id, seq, run_at FROM seq_reads
      WHERE seq IS NOT NULL AND sample IS NOT NULL AND upper(seq) NOT LIKE '%N%'),
x AS (SELECT 'kmer_counts' AS origin, strftime(run_at, '%Y-%m-%d') AS run_day, color, CAST(kmer AS VARCHAR) AS id
      FROM k JOIN c ON k.sample = c.sample
      UNION ALL
      SELECT 'seq_reads', strftime(run_at, '%Y-%m-%d'), color, upper(seq)
      FROM r JOIN c ON regexp_replace(r.sample, '_[rR][12]$', '') = c.sample),
g AS (SELECT * FROM (VALUES ('0', 0), ('1', 1), ('2', 2), ('0+1', 0), ('0+1', 1), ('0+2', 0), ('0+2', 2), ('1+2', 1),
      ('1+2', 2), ('0+1+2', 0), ('0+1+2', 1), ('0+1+2', 2)) v(colors, color)),
n AS (SELECT colors, count(*) AS parts FROM g GROUP BY colors),
t AS (SELECT origin, run_day, x_colors AS colors, count(DISTINCT id) AS n_ids, count(*) AS n_rows, count(DISTINCT x_color) AS parts
      FROM (SELECT origin, run_day, id, x.color AS x_color, g.colors AS x_colors FROM x JOIN g ON x.color = g.color) y
      GROUP BY origin, run_day, x_colors),
d AS (SELECT t.* FROM t JOIN n ON t.colors = n.colors AND t.parts = n.parts)
"""


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    known = classes.where("color IS NOT NULL").groupBy("sample").agg(F.min("color").alias("color"))
    return join_small(rows, known, "sample")


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "classes")
    day = F.date_format("run_at", "yyyy-MM-dd").alias("day")
    kmers = members(table(spark, sf_dir, "kmer_counts").where("sample IS NOT NULL"), "sample", "kmer", "freq", "run_at")
    kmers = _with_class(kmers, classes).select(day, "color", "kmer")
    reads = table(spark, sf_dir, "seq_reads").where(F.col("sample").isNotNull() & ~F.upper("seq").contains("N"))
    # A read is told from others by its number and two hashes, a sequence by 128 bits of hash.
    reads = reads.select(
        sample_name("sample").alias("sample"),
        "run_at",
        "read_no",
        F.xxhash64("sample", "read_id", "seq").alias("rest"),
        F.xxhash64(F.upper("seq")).alias("h1"),
        F.xxhash64(F.lit("strandlake"), F.upper("seq")).alias("h2"),
    )
    reads = _with_class(reads.distinct(), classes).select(day, "color", "h1", "h2")
    out = [
        distinct.counts(distinct.state(kmers, "day", "color", ["kmer"])).withColumn("origin", F.lit("kmer_counts")),
        distinct.counts(distinct.state(reads, "day", "color", ["h1", "h2"])).withColumn("origin", F.lit("seq_reads")),
    ]
    return out[0].unionByName(out[1]).withColumnRenamed("day", "run_day")


@query(P3_ROWS + "SELECT origin, run_day, colors FROM d WHERE n_ids <= 0.6 * n_rows")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and combinations of classes whose distinct identifiers are at most 0.6 of their rows."""
    return _p3(spark, sf_dir).where("10 * n_ids <= 6 * n_rows").select("origin", "run_day", "colors")


@query(P3_ROWS + "SELECT origin, run_day, colors, n_ids, n_rows, CAST(0 AS DOUBLE) AS error_bound FROM d")
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers and rows per origin, day and combination of classes; exact."""
    return _p3(spark, sf_dir).select("origin", "run_day", "colors", "n_ids", "n_rows", "error_bound")


@query()
def p3_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_counts: all hash ranges are counted, so the error bound is 0."""
    return _p3(spark, sf_dir).select("origin", "run_day", "colors", "n_ids", "n_rows", "error_bound")


P6_ROWS = """
WITH r AS (SELECT DISTINCT read_no, sample, read_id, seq, run_at FROM seq_reads
           WHERE seq IS NOT NULL AND upper(seq) NOT LIKE '%N%'),
w AS (SELECT substr(upper(seq), i, 21) AS km FROM r, unnest(range(1, length(seq) - 19)) t(i)),
s AS (SELECT least(km, reverse(translate(km, 'ACGT', 'TGCA'))) AS km, count(*) AS n FROM w GROUP BY 1),
st AS (SELECT sum(n) AS total FROM s),
sf AS (SELECT km, n FROM s, st WHERE n >= 0.0001 * total),
sc AS (SELECT km, n, sum((strpos('ACGT', substr(km, i, 1)) - 1) * CAST(power(4, 21 - i) AS BIGINT)) AS kmer
       FROM sf, unnest(range(1, 22)) t(i) GROUP BY km, n),
k AS (SELECT DISTINCT sample, kmer, freq, run_at FROM kmer_counts WHERE kmer IS NOT NULL AND freq >= 1),
kt AS (SELECT sum(freq) AS total FROM k),
kc AS (SELECT kmer, sum(freq) AS n FROM k GROUP BY kmer),
f AS (SELECT 'seq_reads' AS origin, CAST(kmer AS BIGINT) AS kmer, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM sc, st
      UNION ALL SELECT 'kmer_counts', kmer, CAST(n AS BIGINT), CAST(total AS BIGINT) FROM kc, kt WHERE n >= 0.002 * total)
"""


def _windows(batch):
    return windows.canonical_kmers(*windows.flat(batch.column(0)), 21), None


def _frequencies(batch):
    return tuple(c.to_numpy(zero_copy_only=False).astype("int64") for c in batch.columns)


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = good_reads(table(spark, sf_dir, "seq_reads")).select("seq")
    kmers = members(table(spark, sf_dir, "kmer_counts"), "sample", "kmer", "freq", "run_at").select("kmer", "freq")
    out = [
        frequent.frequent(materialize(reads), _windows, 0.0001).withColumn("origin", F.lit("seq_reads")),
        frequent.frequent(materialize(kmers), _frequencies, 0.002).withColumn("origin", F.lit("kmer_counts")),
    ]
    return out[0].unionByName(out[1]).withColumnRenamed("item", "kmer")


@query(P6_ROWS + "SELECT origin, kmer FROM f")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers that make up the stated shares of all windows of the reads and of all frequencies."""
    return _p6(spark, sf_dir).select("origin", "kmer")


@query(P6_ROWS + "SELECT origin, kmer, n, total FROM f")
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their exact counts and the totals."""
    return _p6(spark, sf_dir).select("origin", "kmer", F.col("count").alias("n"), "total")


P9_ROWS = f"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS tk FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS i FROM d),
w AS (SELECT doc_id, i, concat_ws(' ', tok, {", ".join(f"lead(tok, {n}) OVER o" for n in range(1, 10))}) AS k, lead(tok, 9) OVER o AS last
      FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM w WHERE last IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p) AS repeated FROM a, unnest(range(i, i + 10)) y(p) WHERE rn > 1 GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok) AS n_types FROM t GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(repeated, 0) AS repeated, coalesce(n_types, 0) AS n_types
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id)
"""
#: Posterior from which on a document counts as repetitive, and the definition that an exact check goes by.
P9_LEAST, P9_TRUE = 0.5, "n_tokens >= 50 AND 10 * repeated >= 3 * n_tokens"


@query(P9_ROWS + f"SELECT doc_id FROM m WHERE {P9_TRUE}")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least 50 tokens of which at least 0.3 lie in repeated runs of 10: those that the rules' posterior
    calls repetitive, then checked exactly."""
    df = repetition.scored(table(spark, sf_dir, "documents"))
    return df.where(F.col("p_repetitive") >= P9_LEAST).where(P9_TRUE).select("doc_id")


@query(P9_ROWS + "SELECT * FROM m")
def p9_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, repeated tokens and distinct tokens of every document."""
    return repetition.measured(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "repeated", "n_types")


@query()
def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the posterior alone does against the definition: precision and recall."""
    df = repetition.scored(table(spark, sf_dir, "documents"))
    return repetition.quality(df, F.col("p_repetitive") >= P9_LEAST, F.expr(P9_TRUE))


@query()
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the share of its tokens that repeats earlier ones and the posterior of being repetitive."""
    df = repetition.scored(table(spark, sf_dir, "documents"))
    share = F.when(F.col("n_tokens") > 0, F.col("repeated") / F.col("n_tokens"))
    return df.select("doc_id", "n_tokens", share.alias("repeated_share"), F.round("p_repetitive", 6).alias("p_repetitive"))


P5_READS = """
WITH r AS (SELECT DISTINCT read_no, upper(seq) AS s FROM seq_reads
           WHERE seq IS NOT NULL AND upper(seq) NOT LIKE '%N%' AND length(seq) >= 50),
w AS (SELECT DISTINCT read_no, substr(s, i, 50) AS k FROM r, unnest(range(1, length(s) - 48)) t(i)),
c AS (SELECT comp_no, pos, min(kmer) AS kmer FROM component_kmers WHERE kmer IS NOT NULL GROUP BY comp_no, pos),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY comp_no ORDER BY pos) AS run FROM c),
l AS (SELECT comp_no, run, list(kmer ORDER BY pos) AS v FROM g GROUP BY comp_no, run HAVING count(*) >= 20),
cw AS (SELECT DISTINCT comp_no, v[i : i + 19] AS k FROM l, unnest(range(1, len(v) - 18)) t(i))
"""


def _p5_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "seq_reads").where(F.col("seq").isNotNull() & ~F.upper("seq").contains("N"))
    return spans.text_units(reads.select("read_no", F.upper("seq").alias("seq")), "read_no", "seq", 50)


def _p5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spans.list_units(table(spark, sf_dir, "component_kmers"), "comp_no", "pos", "kmer", 20))


@query(
    P5_READS
    + """SELECT DISTINCT 'read' AS record_kind, a.read_no AS key_a, b.read_no AS key_b FROM w a JOIN w b ON a.k = b.k AND a.read_no < b.read_no
UNION ALL SELECT DISTINCT 'component', CAST(a.comp_no AS BIGINT), CAST(b.comp_no AS BIGINT)
FROM cw a JOIN cw b ON a.k = b.k AND a.comp_no < b.comp_no"""
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that share at least 50 letters and components that share a run of at least 20 k-mers."""
    reads = spans.shared_pairs(_p5_reads(spark, sf_dir), 50).withColumn("record_kind", F.lit("read"))
    comps = spans.shared_pairs(_p5_components(spark, sf_dir), 20).withColumn("record_kind", F.lit("component"))
    return reads.unionByName(comps).select("record_kind", "key_a", "key_b")


P2_ROWS = """
WITH f AS (SELECT sample, comp_no, max(value) AS v FROM features WHERE value > 0 AND sample IS NOT NULL GROUP BY sample, comp_no),
s AS (SELECT sample, sum(v) AS total FROM f GROUP BY sample),
m AS (SELECT a.sample AS a, b.sample AS b, sum(least(a.v, b.v)) AS common FROM f a JOIN f b
      ON a.comp_no = b.comp_no AND a.sample <> b.sample GROUP BY a.sample, b.sample),
d AS (SELECT x.sample AS sample, y.sample AS other,
      CAST(x.total + y.total - 2 * coalesce(common, 0) AS DOUBLE) / CAST(x.total + y.total AS DOUBLE) AS d
      FROM s x JOIN s y ON x.sample <> y.sample LEFT JOIN m ON m.a = x.sample AND m.b = y.sample),
n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d, other) AS rank FROM d),
k AS (SELECT * FROM n WHERE rank <= 5)
"""


@query(P2_ROWS + "SELECT DISTINCT least(sample, other) AS sample_a, greatest(sample, other) AS sample_b FROM k WHERE d <= 0.35")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples at a distance of at most 0.35 of which one is among the five nearest of the other."""
    near = neighbours.nearest(table(spark, sf_dir, "features"), 5, complete=False)
    pair = F.least("sample", "other").alias("sample_a"), F.greatest("sample", "other").alias("sample_b")
    return near.where("d <= 0.35").select(*pair).distinct()


@query(P2_ROWS + "SELECT sample, other, round(d, 9) AS d, rank FROM k")
def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest samples of every sample."""
    return neighbours.nearest(table(spark, sf_dir, "features"), 5).withColumn("d", F.round("d", 9))


P4_ROWS = """
WITH RECURSIVE f AS (SELECT sample, comp_no, max(value) AS v FROM features WHERE value > 0 AND sample IS NOT NULL GROUP BY sample, comp_no),
s AS (SELECT sample, sum(v) AS total FROM f GROUP BY sample),
k AS (SELECT DISTINCT sample FROM features WHERE sample IS NOT NULL),
m AS (SELECT a.sample AS a, b.sample AS b, sum(least(a.v, b.v)) AS common FROM f a JOIN f b
      ON a.comp_no = b.comp_no AND a.sample < b.sample GROUP BY a.sample, b.sample),
e AS (SELECT a, b FROM m JOIN s x ON x.sample = a JOIN s y ON y.sample = b
      WHERE CAST(x.total + y.total - 2 * common AS DOUBLE) / CAST(x.total + y.total AS DOUBLE) <= 0.35
      UNION
      SELECT least(sample_i, sample_j), greatest(sample_i, sample_j) FROM distances
      WHERE dist <= 0.35 AND sample_i <> sample_j AND NOT (sample_i IN (SELECT sample FROM k) AND sample_j IN (SELECT sample FROM k))),
bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
c(sample, label) AS (SELECT a, min(b) FROM bo GROUP BY a
      UNION SELECT bo.a, c.label FROM c JOIN bo ON bo.b = c.sample),
l AS (SELECT sample, min(label) AS cluster_key FROM c GROUP BY sample),
z AS (SELECT cluster_key, count(*) AS size FROM l GROUP BY cluster_key HAVING count(*) >= 3)
"""


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.density_peaks(table(spark, sf_dir, "features"), table(spark, sf_dir, "distances"))


@query(P4_ROWS + "SELECT cluster_key, sample FROM l WHERE cluster_key IN (SELECT cluster_key FROM z)")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in clusters of at least three mutually near samples."""
    return clusters.clusters(_p4(spark, sf_dir)).select("cluster_key", "sample")


@query(
    P4_ROWS
    + """, w AS (SELECT l.sample, cluster_key, 1 + count(DISTINCT bo.b) FILTER (WHERE bo.b <> bo.a) AS density FROM l JOIN bo ON bo.a = l.sample GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY density DESC, sample) AS rank FROM w)
SELECT t.cluster_key, size, string_agg(sample, ',' ORDER BY rank) AS typical FROM t JOIN z ON z.cluster_key = t.cluster_key WHERE rank <= 3 GROUP BY 1, 2"""
)
def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters with their sizes and most typical samples."""
    return clusters.described(_p4(spark, sf_dir))


@query()
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in containers of 2048 tokens: which piece of which document lies in which container."""
    return packing.packed(tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id"))


@query()
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill(p7_pack(spark, sf_dir))


def _p8(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "source")
    targets = table(spark, sf_dir, "mix_targets")
    total = documents.agg(F.sum("n_tokens")).first()[0] if whole else None
    return mixing.mixed(documents, targets, total), targets, documents


@query()
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, in the order of the schedule's slots; as many tokens as the scarcest source allows at its share."""
    return _p8(spark, sf_dir)[0]


@query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, and what it has, sources without a target or documents included."""
    return mixing.shares(*_p8(spark, sf_dir))


@query()
def p8_mix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the whole corpus: scarce sources are repeated as often as they may be and then end."""
    return _p8(spark, sf_dir, True)[0]


@query()
def p8_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that mix reaches."""
    return mixing.shares(*_p8(spark, sf_dir, True))


@query(
    P5_READS
    + """, d AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT w.read_no, p FROM (SELECT read_no, i, substr(s, i, 50) AS k FROM r, unnest(range(1, length(s) - 48)) t(i)) w
        JOIN d ON w.k = d.k, unnest(range(w.i, w.i + 50)) u(p))
SELECT cov.read_no, max(length(s)) AS length, count(*) AS shared FROM cov JOIN r ON cov.read_no = r.read_no GROUP BY cov.read_no"""
)
def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many letters of each read lie in stretches of at least 50 that other reads have too."""
    rows = spans.shared_lengths(_p5_reads(spark, sf_dir), 50).withColumnRenamed("key", "read_no")
    reads = table(spark, sf_dir, "seq_reads").where(F.col("seq").isNotNull() & ~F.upper("seq").contains("N"))
    lengths = reads.groupBy("read_no").agg(F.max(F.length("seq")).cast("long").alias("length"))
    return rows.join(lengths, "read_no").select("read_no", "length", "shared")


@query(
    P5_READS
    + """, d AS (SELECT k FROM cw GROUP BY k HAVING count(*) > 1),
x AS (SELECT comp_no, run, i, v[i : i + 19] AS k FROM l, unnest(range(1, len(v) - 18)) t(i)),
cov AS (SELECT DISTINCT x.comp_no, x.run, p FROM x JOIN d ON x.k = d.k, unnest(range(x.i, x.i + 20)) u(p)),
n AS (SELECT comp_no, count(*) AS length FROM c WHERE comp_no IS NOT NULL AND pos IS NOT NULL GROUP BY comp_no)
SELECT CAST(cov.comp_no AS BIGINT) AS comp_no, max(length) AS length, count(*) AS shared FROM cov JOIN n ON cov.comp_no = n.comp_no
GROUP BY cov.comp_no"""
)
def p5_shared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many k-mers of each component lie in runs of at least 20 that other components have too."""
    rows = spans.shared_places(_p5_components(spark, sf_dir), 20).withColumnRenamed("key", "comp_no")
    kmers = table(spark, sf_dir, "component_kmers").where("comp_no IS NOT NULL AND pos IS NOT NULL AND kmer IS NOT NULL")
    lengths = kmers.groupBy(F.col("comp_no").cast("long").alias("comp_no")).agg(F.count_distinct("pos").alias("length"))
    return rows.join(lengths, "comp_no").select("comp_no", "length", "shared")


@query(
    """WITH r AS (SELECT DISTINCT read_no AS key, upper(seq) AS s FROM seq_reads
           WHERE read_no IS NOT NULL AND seq IS NOT NULL AND upper(seq) NOT LIKE '%N%' AND length(seq) >= 50),
c AS (SELECT s, min(key) AS class_id FROM r GROUP BY s),
w AS (SELECT DISTINCT class_id, substr(s, i, 50) AS k FROM c, unnest(range(1, length(s) - 48)) t(i)),
l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n FROM w a JOIN w b ON a.k = b.k AND a.class_id <> b.class_id GROUP BY a.class_id)
SELECT r.key AS read_no, c.class_id, coalesce(n, 0) AS n_links FROM r JOIN c ON r.s = c.s LEFT JOIN l ON l.class_id = c.class_id"""
)
def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every good read of at least 50 letters with the class of reads of the same text and its number of linked texts."""
    reads = table(spark, sf_dir, "seq_reads").where(F.col("seq").isNotNull() & ~F.upper("seq").contains("N"))
    rows = spans.shared_classes(reads.select("read_no", F.upper("seq").alias("seq")), "read_no", "seq", 50)
    return rows.withColumnRenamed("key", "read_no")
