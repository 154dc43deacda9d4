"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.runtime import materialize

#: Tokens of a block, the unit in which sources take turns.
BLOCK = 4096
#: Fraction of the golden ratio: multiples of it, modulo 1, spread as evenly as points can.
GOLDEN = 0.6180339887498949
#: Slots and documents whose order one task works out.
SLOTS, DOCS = 1 << 16, 50_000


@dataclass(frozen=True)
class Source:
    """A source's name, share among the sources that have documents, tokens, and how often a document may come."""

    name: str
    share: float
    tokens: int
    repeats: int


def sources_of(documents: DataFrame, targets: DataFrame) -> list[Source]:
    """The sources with a target, tokens and repeats. One row per source of the target table comes to the driver."""
    goal = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    goal = goal.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    have = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    rows = goal.join(have, "source").orderBy("source").collect()
    total = sum(r.share for r in rows)
    return [Source(r.source, r.share / total, r.tokens, r.repeats) for r in rows]


def slots(spark, sources: list[Source], count: int) -> DataFrame:
    """(`slot`, `source`, `block`): slot i goes to the source in whose share of [0, 1) the i-th point falls; `block`
    numbers the slots of a source."""
    ends, so_far = [], 0.0
    for s in sources:
        so_far += s.share
        ends.append(so_far)
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    index = F.when(F.lit(False), 0)
    for i, end in enumerate(ends[:-1]):
        index = index.when(point < end, i)
    rows = spark.range(count).select(F.col("id").alias("slot")).withColumn("source", index.otherwise(len(sources) - 1))
    rows = rows.withColumn("chunk", F.expr(f"slot DIV {SLOTS}"))
    counts = rows.groupBy("chunk", "source").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    firsts = counts.select("chunk", "source", F.coalesce(before, F.lit(0)).alias("first"))
    local = F.row_number().over(W.partitionBy("chunk", "source").orderBy("slot")) - 1
    return rows.withColumn("local", local).join(firsts, ["chunk", "source"]).select(
        "slot", F.col("source").alias("index"), (F.col("local") + F.col("first")).alias("block")
    )


def upto(rows: DataFrame, limit: str, bits: int) -> DataFrame:
    """`rows` in shuffled order, round by round, as long as a source's tokens stay within its `limit`: with `end`, the tokens
    up to and with a document.

    Order is that of a hash, so its top bits split a source into parts whose sums give each part's offset: no task sorts or
    sums a whole source.
    """
    rows = rows.withColumn("part", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    keys = ["index", "round", "part"]
    sums = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy("index").orderBy("round", "part").rowsBetween(W.unboundedPreceding, -1))
    firsts = sums.select(*keys, F.coalesce(before, F.lit(0)).alias("first"))
    local = F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("local", local).join(firsts, keys).withColumn("end", F.col("local") + F.col("first"))
    return rows.where(F.col("end") <= F.col(limit)).drop("part", "local", "first")


#: How often what is missing is filled with documents that still fit.
FILLED = 3


def stream(documents: DataFrame, sources: list[Source], wanted: list[float], seed: int) -> DataFrame:
    """Every source's documents in shuffled order, again for each further round, until `wanted` tokens: with `block`.

    The order breaks off before the first document that doesn't fit; what is missing then is filled FILLED times with the
    next ones that do. A document belongs to the block in which its middle falls. Long documents stand anywhere in the order.
    """
    spark = documents.sparkSession
    plan = [(s.name, i, s.tokens, min(s.repeats, int(-(-w // s.tokens))), float(w)) for i, (s, w) in enumerate(zip(sources, wanted))]
    goal = spark.createDataFrame(plan, "source string, index int, tokens long, rounds int, wanted double")
    bits = max(0, (max(1, documents.count()) // DOCS).bit_length())
    rows = documents.where("n_tokens > 0").join(F.broadcast(goal), "source").where("rounds > 0")
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "round"))
    rows = materialize(rows.select("source", "index", "doc_id", "n_tokens", "round", "hash", "wanted").withColumn("used", F.lit(0.0)))
    drawn = None
    for _ in range(1 + FILLED):
        fit = rows.where(F.col("n_tokens") <= F.col("wanted") - F.col("used")).withColumn("left", F.col("wanted") - F.col("used"))
        now = materialize(upto(fit, "left", bits).withColumn("middle", F.col("used") + F.col("end") - F.col("n_tokens") / 2))
        drawn = now if drawn is None else drawn.unionByName(now)
        # One row a source.
        more = now.groupBy("index").agg(F.sum("n_tokens").alias("more"))
        rows = rows.join(now.select("doc_id", "round", "index"), ["doc_id", "round", "index"], "left_anti")
        rows = materialize(rows.join(F.broadcast(more), "index", "left").withColumn("used", F.col("used") + F.coalesce("more", F.lit(0))).drop("more"))
    return drawn.withColumn("block", F.floor(F.col("middle") / BLOCK))


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1) -> DataFrame:
    """(`slot`, `source`, `doc_id`, `round`, `n_tokens`): the documents of each slot of the schedule.

    Shares are taken among the sources that have a target and documents; others can't or mustn't contribute. Without
    `total` as many tokens are drawn as the scarcest source allows at its share and repeats. With a larger `total` such a
    source ends early and its reached share is lower. Documents with a null source or without tokens are left out.
    """
    sources = sources_of(documents, targets)
    spark = documents.sparkSession
    if not sources:
        return spark.createDataFrame([], "slot long, source string, doc_id long, round int, n_tokens long")
    most = min(s.tokens * s.repeats / s.share for s in sources)
    total = most if total is None else total
    wanted = [min(total * s.share, s.tokens * s.repeats) for s in sources]
    # The points' discrepancy is logarithmic: so many slots more give every source a slot for each of its blocks.
    blocks = [int(-(-w // BLOCK)) for w in wanted]
    count = max(int((b + 8 + 2 * sum(blocks).bit_length()) / s.share) + 1 for s, b in zip(sources, blocks))
    docs = materialize(stream(documents, sources, wanted, seed).select("index", "block", "source", "doc_id", "round", "n_tokens"))
    need = {r["index"]: r.n for r in docs.groupBy("index").agg((F.max("block") + 1).alias("n")).collect()}  # one row a source
    while True:
        plan = materialize(slots(spark, sources, count))
        have = {r["index"]: r.n for r in plan.groupBy("index").agg(F.count("*").alias("n")).collect()}
        if all(have.get(i, 0) >= n for i, n in need.items()):
            break
        count += count // 8 + 1  # else a document would fall between block and slot
    return docs.join(plan, ["index", "block"]).select("slot", "source", "doc_id", "round", "n_tokens")


def shares(rows: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Per source of the targets or documents: its target, the share wanted of it among the sources that can contribute, its
    tokens (`available` once, `tokens` drawn), the reached share and how often its most used document came.

    A source without a target, documents or repeats has no wanted share and isn't drawn.
    """
    uses = rows.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    used = uses.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("uses").alias("most_uses"))
    total = used.agg(F.sum("tokens").alias("total"))
    goal = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = documents.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    can = [(s.name, s.share) for s in sources_of(documents, targets)]
    wanted = rows.sparkSession.createDataFrame(can, "source string, wanted_share double")
    out = goal.join(have, "source", "full").join(wanted, "source", "left").join(used, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "source",
        "target_share",
        F.round("wanted_share", 6).alias("wanted_share"),
        "max_repeats",
        zero("available").alias("available"),
        zero("tokens").alias("tokens"),
        zero("most_uses").alias("most_uses"),
        F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("reached_share"),
    )
