"""K-mers of whole batches of sequences as flat arrays: the counting path, where strings for every window cost too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A=0 C=1 G=2 T=3 in either case, 4: anything else.
CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i

#: Windows that are pre-aggregated together before they leave a task.
GATHERED = 1 << 21


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its values; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def kmer_windows(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward codes, codes of the other strand, and places of all windows of k letters ACGT inside a value.

    A code has 2 bits a letter, so numeric order is alphabetic order; k is at most 31.
    """
    assert 1 <= k <= 31
    n = len(raw) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    code = CODE[raw]
    start = np.zeros(len(raw) + 1, np.int32)
    ends = np.maximum(offsets[1:] - k + 1, offsets[:-1])
    np.add.at(start, offsets[:-1], 1)
    np.add.at(start, ends, -1)
    ok = np.cumsum(start[:n]) > 0
    bad = np.concatenate([[0], np.cumsum(code == 4, dtype=np.int32)])
    ok &= bad[k:] == bad[:-k]
    fw = code.astype(np.int64) & 3
    rc = 3 - fw
    # Windows of 1, 2, 4, ... letters, put together by the binary digits of k.
    width, out_fw, out_rc, done = 1, None, None, 0
    while True:
        if k & width:
            if out_fw is None:
                out_fw, out_rc = fw, rc
            else:
                m = len(fw) - done
                out_fw = (out_fw[:m] << (2 * width)) | fw[done:]
                out_rc = out_rc[:m] | (rc[done:] << (2 * done))
            done += width
        if width * 2 > k:
            break
        fw, rc = (fw[:-width] << (2 * width)) | fw[width:], rc[:-width] | (rc[width:] << (2 * width))
        width *= 2
    at = np.flatnonzero(ok)
    return out_fw[at], out_rc[at], at


def canonical_kmers(raw: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Canonical codes (the smaller of both strands) of all windows."""
    fw, rc, _ = kmer_windows(raw, offsets, k)
    return np.minimum(fw, rc)


def _count(k: int, keys: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHERED:
                yield from counted(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if held:
            yield from counted(pa.Table.from_batches(held).combine_chunks())

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        # One number per combination of keys.
        group = np.zeros(table.num_rows, np.int64)
        for c in keys:
            code = table[c].combine_chunks().dictionary_encode()
            own = code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
            group = group * (len(code.dictionary) + 1) + own
        raw, offsets = flat(table["seq"])
        fw, rc, at = kmer_windows(raw, offsets, k)
        kmer = np.minimum(fw, rc)
        row = np.searchsorted(offsets, at, side="right") - 1
        own = group[row]
        order = np.lexsort((kmer, own)) if keys else np.argsort(kmer)
        kmer, own, row = kmer[order], own[order], row[order]
        if not len(kmer):
            return
        head = np.flatnonzero(np.r_[True, (kmer[1:] != kmer[:-1]) | (own[1:] != own[:-1])])
        count = np.diff(np.r_[head, len(kmer)])
        at = pa.array(row[head])
        columns = [table[c].combine_chunks().take(at) for c in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kmer[head]), pa.array(count)], [*keys, "kmer", "freq"])

    return work


def window_counts(reads: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `kmer`, `freq`): canonical k-mers of `seq` in all reads of a key, counted.

    Windows are counted in the task first, so a k-mer leaves it once per gathered batch; one shuffle adds them up.
    """
    kinds = dict(reads.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "kmer long, freq long"
    rows = reads.select(*keys, "seq").where(F.length("seq") >= k).mapInArrow(_count(k, list(keys)), schema)
    return rows.groupBy(*keys, "kmer").agg(F.sum("freq").alias("freq"))


def _whole(k: int, keys: list[str], above: int):
    """Counts of rows sorted by keys: a chunk ends where a group ends, so each k-mer has its whole count."""

    def numbers(table: pa.Table) -> np.ndarray:
        group = np.zeros(table.num_rows, np.int64)
        for c in keys:
            code = table[c].combine_chunks().dictionary_encode()
            group = group * (len(code.dictionary) + 1) + code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)
        return group

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if size >= GATHERED and batch.num_rows:
                group = numbers(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]))
                other = np.flatnonzero(group != group[0])
                end = int(other[0]) - 1 if len(other) else batch.num_rows
                held.append(batch.slice(0, end))
                size += held[-1].nbytes
                if end < batch.num_rows:
                    yield from counted(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                batch = batch.slice(end)
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from counted(pa.Table.from_batches(held).combine_chunks())

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = numbers(table)
        raw, offsets = flat(table["seq"])
        # A group that is larger than some chunks goes by parts of its k-mers.
        parts = -(-len(raw) // (4 * GATHERED))
        cuts = np.r_[np.searchsorted(offsets, np.arange(0, len(raw), GATHERED)), len(offsets) - 1]
        for p in range(parts):
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                fw, rc, at = kmer_windows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                kmer, row = np.minimum(fw, rc), np.searchsorted(offsets, at + offsets[a], side="right") - 1
                if parts > 1:
                    own = kmer % parts == p
                    kmer, row = kmer[own], row[own]
                found.append((kmer, row))
            kmer, row = (np.concatenate(x) for x in zip(*found))
            own = group[row]
            order = np.lexsort((kmer, own))
            kmer, own, row = kmer[order], own[order], row[order]
            head = np.flatnonzero(np.r_[True, (kmer[1:] != kmer[:-1]) | (own[1:] != own[:-1])]) if len(kmer) else np.empty(0, np.int64)
            count = np.diff(np.r_[head, len(kmer)])
            head, count = head[count > above], count[count > above]
            at = pa.array(row[head])
            columns = [table[c].combine_chunks().take(at) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kmer[head]), pa.array(count)], [*keys, "kmer", "freq"])

    return work


def group_counts(reads: DataFrame, k: int, above: int, *keys: str) -> DataFrame:
    """(`keys`, `kmer`, `freq`): canonical k-mers of `seq` that occur more than `above` times in all reads of a key.

    The reads of a key come to one task, so reads are shuffled and not their k-mers: for many keys of which none has most
    of the reads. A large key is counted in parts of its k-mers.
    """
    kinds = dict(reads.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "kmer long, freq long"
    rows = reads.select(*keys, "seq").where(F.length("seq") >= k).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_whole(k, list(keys), above), schema)


def window_rows(sequences: DataFrame, k: int, *keys: str) -> DataFrame:
    """(`keys`, `place`, `kmer`): every window of k letters ACGT of `seq`, its place from 0 and its canonical code."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(len(keys)))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GATHERED, side="right")) - 1)
                part = offsets[at : end + 1] - offsets[at]
                fw, rc, place = kmer_windows(raw[offsets[at] : offsets[end]], part, k)
                row = np.searchsorted(part, place, side="right") - 1
                own = [batch.column(i).take(pa.array(row + at)) for i in range(len(keys))]
                columns = [*own, pa.array((place - part[row]).astype(np.int32)), pa.array(np.minimum(fw, rc))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "place", "kmer"])
                at = end

    kinds = dict(sequences.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "place int, kmer long"
    return sequences.where(F.length("seq") >= k).select(*keys, "seq").mapInArrow(work, schema)


def window_codes(seq: str | Column, k: int) -> Column:
    """Canonical codes of all windows of k letters ACGT as an array, by Arrow batches: for plans that must stay expressions,
    such as streams with a watermark."""
    @F.pandas_udf("array<long>")
    def codes(texts: pd.Series) -> pd.Series:
        raw, offsets = flat(pa.array(texts, pa.string(), from_pandas=True))
        fw, rc, at = kmer_windows(raw, offsets, k)
        row = np.searchsorted(offsets, at, side="right") - 1
        return pd.Series(np.split(np.minimum(fw, rc), np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else [])

    return codes(seq)
