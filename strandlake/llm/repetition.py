"""Repetition inside a document: measures, rules that vote or abstain, and a posterior from expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.windows import flat
from strandlake.runtime import materialize

#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20
MEASURES = ("n_tokens", "repeated", "repeated5", "line_tokens", "paragraph_tokens", "n_lines", "n_paragraphs", "n_types", "top3")
#: name: (measure as SQL, votes "repetitive" from this on, votes "not" up to this, abstains where this is false)
RULES = {
    "run10": ("repeated / n_tokens", 0.3, 0.15, "n_tokens >= 50"),
    "run5": ("repeated5 / n_tokens", 0.4, 0.2, "n_tokens >= 50"),
    "lines": ("line_tokens / n_tokens", 0.3, 0.15, "n_lines >= 5"),
    "paragraphs": ("paragraph_tokens / n_tokens", 0.25, 0.1, "n_paragraphs >= 3"),
    "types": ("1 - n_types / n_tokens", 0.85, 0.7, "n_tokens >= 50"),
    "top3": ("3 * top3 / n_tokens", 0.15, 0.08, "n_tokens >= 50"),
}
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as many as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for base in (BASE, BASE_INVERSE):
                x = np.full(max(n, 2 * len(self.up)), base, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * POWERS.of(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of what `sums` is the prefix of; equal for equal spans at any place."""
    return mix((sums[end] - sums[start]) * POWERS.of(len(sums))[1][start])


def later(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occurred earlier; first place and number of occurrences of each distinct key."""
    if not len(keys):
        return np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys)
    start = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    first = np.minimum.reduceat(order, start)
    again = np.ones(len(keys), bool)
    again[first] = False
    return again, first, np.diff(np.r_[start, len(keys)])


def measures(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each text of a chunk. A token lies in a repeated run if the run occurred, starting earlier."""
    docs = len(offsets) - 1
    out = {k: np.zeros(docs, np.int64) for k in MEASURES}
    word = WORD[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = (word[0], word[-1]) if len(raw) else (False, False)
    edge[1:-1] = word[1:] != word[:-1]
    # A text's first and last byte may be word bytes of neighbours in the chunk.
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
    both = inner[word[inner] & word[inner - 1]] if len(inner) else inner
    at = np.flatnonzero(edge)
    at = np.sort(np.concatenate([at, both, both]))
    start, end = at[::2], at[1::2]
    if not len(start):
        return out
    doc = np.searchsorted(offsets, start, side="right") - 1
    salt = mix((doc + 1).astype(np.uint64) * BASE)
    token = spans(prefix(VALUE[raw]), start, end)
    sums = prefix(token)
    n = len(token)
    out["n_tokens"] = np.bincount(doc, minlength=docs)

    _, first, _ = later(token ^ salt)
    out["n_types"] = np.bincount(doc[first], minlength=docs)
    for length, name in ((10, "repeated"), (5, "repeated5"), (3, "top3")):
        at = np.arange(max(0, n - length + 1))
        at = at[doc[at] == doc[at + length - 1]]
        again, first, count = later(spans(sums, at, at + length) ^ salt[at])
        if name == "top3":
            np.maximum.at(out[name], doc[at[first]], np.where(count > 1, count, 0))
        else:
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, at[again], 1)
            np.add.at(cover, at[again] + length, -1)
            out[name] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)

    line = np.cumsum(raw == 10, dtype=np.int32)[start]
    for gap, name, count in ((1, "line_tokens", "n_lines"), (2, "paragraph_tokens", "n_paragraphs")):
        head = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(line) >= gap)])
        tail = np.r_[head[1:], n]
        again, _, _ = later(spans(sums, head, tail) ^ salt[head])
        out[count] = np.bincount(doc[head], minlength=docs)
        out[name] = np.bincount(doc[head[again]], (tail - head)[again], docs).astype(np.int64)
    return out


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of about `size` bytes, whole values only."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = flat(batch.column(1))
        for a, b in chunks(offsets, CHUNK_BYTES):
            found = measures(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            columns = [pa.array(found[k], pa.int64()) for k in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], ["doc_id", *MEASURES])


def measured(documents: DataFrame) -> DataFrame:
    """`doc_id` and MEASURES of every document; a null or empty text has no tokens. Whole texts, no shuffle of texts."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    return documents.select("doc_id", "text").mapInArrow(_measure, schema).distinct()


def votes(df: DataFrame) -> DataFrame:
    """A column vote_RULE for each rule: 2 repetitive, 1 not, 0 abstains."""
    said = {}
    for name, (measure, bad, good, able) in RULES.items():
        value = F.expr(measure.replace("/ n_tokens", "/ nullif(n_tokens, 0)"))
        said[f"vote_{name}"] = (
            F.when(~F.expr(able) | value.isNull(), 0).when(value >= bad, 2).when(value <= good, 1).otherwise(0)
        )
    return df.withColumns(said)


#: Log-odds that a vote of the trusted rule has at least, and any other rule's vote at most.
TRUST, DOUBT = 25.0, 2.0


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, trusted: int | None = None) -> np.ndarray:
    """Probability that a document with each vote pattern is repetitive.

    Expectation-maximisation over two hidden kinds of document: each rule has its own probabilities of voting 2, 1 or 0
    for either kind, estimated from how the rules agree, with one pseudo-document for each vote. Starts at the
    majority; a pattern in which all abstain keeps the prior. With a `trusted` rule (its number), one that states what is
    looked for, the model knows its accuracy beforehand: its votes have log-odds of TRUST at least, the others' of DOUBT at
    most, so that no corpus makes the others outweigh it.
    """
    if not len(patterns):
        return np.empty(0)
    told = (patterns > 0).sum(1)
    p = (np.where(patterns == 2, 1.0, 0).sum(1) + 0.1) / (told + 0.2)
    active = np.where(told > 0, counts, 0).astype(float)
    for _ in range(rounds):
        prior = (active @ p + 1) / (active.sum() + 2)
        score = np.log(prior / (1 - prior)) * np.ones(len(patterns))
        for j in range(patterns.shape[1]):
            # Votes only: an abstention says nothing about the kind.
            share = []
            for weight in (active * p, active * (1 - p)):
                w = np.array([weight[patterns[:, j] == v].sum() + 1 for v in (1, 2)])
                share.append(w / w.sum())
            ratio = np.log(share[0] / share[1])
            if trusted is not None:
                ratio = np.array([min(ratio[0], -TRUST), max(ratio[1], TRUST)]) if j == trusted else np.clip(ratio, -DOUBT, DOUBT)
            score += np.where(patterns[:, j] == 2, ratio[1], np.where(patterns[:, j] == 1, ratio[0], 0))
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def scored(documents: DataFrame) -> DataFrame:
    """Every document with its measures, the rules' votes and `p_repetitive`.

    The votes are counted by pattern (at most 3^6 patterns, whatever the corpus), the model is fitted on these counts of
    all documents, and each pattern's posterior goes back to its documents.
    """
    df = votes(materialize(measured(documents)))
    names = [f"vote_{r}" for r in RULES]
    seen = df.groupBy(*names).count().collect()
    patterns = np.array([r[:-1] for r in seen], np.int64).reshape(-1, len(names))
    p = posterior(patterns, np.array([r[-1] for r in seen], np.int64), trusted=list(RULES).index("run10"))
    rows = [(*map(int, pattern), float(x)) for pattern, x in zip(patterns, p)]
    known = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", p_repetitive double")
    return df.join(F.broadcast(known), names)


def quality(rows: DataFrame, found: Column, true: Column) -> DataFrame:
    """One row: how many rows are `found` and `true`, both, precision and recall (null where nothing is found or true)."""
    out = rows.agg(F.count_if(found).alias("n_found"), F.count_if(true).alias("n_true"), F.count_if(found & true).alias("n_both"))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_both") / F.col(n))
    return out.withColumns({"precision": share("n_found"), "recall": share("n_true")})
