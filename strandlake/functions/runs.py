"""Reads as runs of windows that share a word: what holds the same window meets in one bucket, at a ninth of the bytes of its k-mers.

Neighbouring windows mostly have the same smallest word (by hash, on either strand), so a read falls into runs of about six
windows. A run is at most 32 letters, one LONG. All runs of a window go to the bucket of its word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.windows import CODE, GATHERED, flat, kmer_windows
from strandlake.runtime import discard, materialize

#: Letters of the words, bits of a bucket's number, windows of a run at most (four bits).
WORD, BUCKET_BITS, LONGEST = 10, 12, 15
#: Runs that are worked on together.
CHUNK = 1 << 17


def flipped(codes: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of codes of k letters."""
    x = codes.astype(np.uint64)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0xFFFFFFFF)):
        m, n = np.uint64(mask), np.uint64(bits)
        x = ((x >> n) & m) | ((x & m) << n)
    return (~x >> np.uint64(64 - 2 * k)).astype(np.int64)


def runs_of(raw: np.ndarray, offsets: np.ndarray, width: int, flanks: bool) -> tuple[np.ndarray, ...]:
    """Runs of windows of `width` letters: bucket, code (letters from the top of 64 bits), windows, whether a letter before
    and after belongs to it, place of the first window.

    With `flanks` a run has the letters before and after it too, where the read goes on there.
    """
    _, _, at = kmer_windows(raw, offsets, width)
    n = len(at)
    if not n:
        return (np.empty(0, np.int64),) * 6
    m = min(WORD, width)
    one, two, where = kmer_windows(raw, offsets, m)
    word = np.minimum(one, two).astype(np.uint32) + np.uint32(1)
    word = (word ^ (word >> np.uint32(9))) * np.uint32(0x9E3779B1)
    least = np.full(len(raw), 0xFFFFFFFF, np.uint32)
    least[where] = word ^ (word >> np.uint32(15))
    # The least of all words of a window, by windows of 1, 2, 4, ... words.
    words, size = width - m + 1, 1
    while size * 2 <= words:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[at], least[at + words - size])
    on = at[1:] == at[:-1] + 1
    head = np.flatnonzero(np.r_[True, ~on | (least[1:] != least[:-1])])
    rank = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
    head = np.flatnonzero(rank % min(LONGEST, 33 - width - 2 * flanks) == 0)
    count = np.diff(np.r_[head, n])
    before, after = np.zeros(len(head), bool), np.zeros(len(head), bool)
    if flanks:
        before[1:] = on[head[1:] - 1]
        after[:-1] = before[1:]
    letters = np.r_[CODE[raw] & 3, np.zeros(32, np.uint8)].astype(np.uint32)
    for size in (1, 2, 4, 8):
        letters = (letters[:-size] << np.uint32(2 * size)) | letters[size:]
    start = at[head] - before
    code = (letters[start].astype(np.uint64) << np.uint64(32)) | letters[start + 16]
    rest = (64 - 2 * (width + count - 1 + before + after)).astype(np.uint64)
    bucket = (least[head] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
    return bucket.astype(np.int32), (code >> rest) << rest, count, before, after, at[head]


def _scattered(width: int):
    """Texts to rows (bucket, runs, info): the different runs of gathered batches, packed by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += batch.nbytes
            if size >= GATHERED:
                yield from packed(pa.chunked_array(held))
                held, size = [], 0
        if held:
            yield from packed(pa.chunked_array(held))

    def packed(texts: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        bucket, code, count, before, after, _ = runs_of(*flat(texts), width, True)
        info = (count + 16 * before + 32 * after).astype(np.uint8)
        order = np.lexsort((info, code, bucket))
        bucket, code, info = bucket[order], code[order], info[order]
        # A window alone, with nothing before or after it, joins nothing.
        new = info != 1
        new[1:] &= (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1]) | (info[1:] != info[:-1])
        bucket, code, info = bucket[new], code[new], info[new]
        if not len(bucket):
            return
        head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[head, len(bucket)]
        columns = [pa.array(bucket[head])]
        for x in (code, info):
            columns.append(pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())]))
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "runs", "info"])

    return work


def occurrences(code: np.ndarray, info: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Each window of the runs on the strand where it is smaller, letters before (bits 0 to 3) and after (4 to 7) it there,
    whether that is the other strand (1; 2: both are the same), its run and its place in it."""
    count, before, after = (info & 15).astype(np.int64), (info >> 4) & 1, (info >> 5) & 1
    row = np.repeat(np.arange(len(code)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    x, off = code[row], j + before[row]
    shift = lambda end: np.maximum(64 - 2 * end, 0).astype(np.uint64)
    window = ((x >> shift(off + width)) & np.uint64((1 << (2 * width)) - 1)).astype(np.int64)
    has_in, has_out = off > 0, (j < count[row] - 1) | (after[row] > 0)
    a = ((x >> shift(np.maximum(off, 1))) & np.uint64(3)).astype(np.uint8)
    b = ((x >> shift(off + width + 1)) & np.uint64(3)).astype(np.uint8)
    one = np.uint8(1)
    mask = np.where(has_in, one << a, 0).astype(np.uint8) | np.where(has_out, np.uint8(16) << b, 0).astype(np.uint8)
    turned = np.where(has_out, one << (3 - b), 0).astype(np.uint8) | np.where(has_in, np.uint8(16) << (3 - a), 0).astype(np.uint8)
    other = flipped(window, width)
    mask = np.where(other < window, turned, np.where(other == window, mask | turned, mask))
    strand = np.where(other < window, 1, np.where(other == window, 2, 0)).astype(np.int8)
    return np.minimum(window, other), mask, strand, row, j


def masks(code: np.ndarray, info: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows on the strand where they are smaller, sorted and once, and the letters seen before and after them."""
    return gathered(*occurrences(code, info, width)[:2])


def gathered(window: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(window, kind="stable")
    window, mask = window[order], mask[order]
    head = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.empty(0, np.int64)
    return window[head], np.bitwise_or.reduceat(mask, head) if len(head) else mask


def _forks(k: int):
    """K-mers of whole buckets that more than one other follows on some side."""
    width = k - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, count = None, [], 0
        for batch in batches:
            for bucket, runs, info in zip(*(batch.column(i) for i in range(3))):
                bucket, runs, info = bucket.as_py(), np.frombuffer(runs.as_buffer(), np.uint64), np.frombuffer(info.as_buffer(), np.uint8)
                # Rows are sorted by bucket; a chunk ends where a bucket ends.
                if count >= CHUNK and bucket != last:
                    yield forked(held, count)
                    held, count = [], 0
                held.append((runs, info))
                count += len(runs)
                last = bucket
        if held:
            yield forked(held, count)

    def forked(held: list[tuple[np.ndarray, np.ndarray]], count: int) -> pa.RecordBatch:
        # A bucket that is larger than a chunk goes by parts of its windows, each with all that touches it.
        parts = -(-count // (4 * CHUNK))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([part(held, p, parts) for p in range(parts)])))], ["kmer"])

    def part(held: list[tuple[np.ndarray, np.ndarray]], p: int, parts: int) -> np.ndarray:
        done, some, size = [], [], 0
        for i, (runs, info) in enumerate(held):
            some.append((runs, info))
            size += len(runs)
            if size >= CHUNK or i == len(held) - 1:
                window, mask = masks(*(np.concatenate(x) for x in zip(*some)), width)
                if parts > 1:
                    own = window % parts == p
                    window, mask = window[own], mask[own]
                done.append((window, mask))
                some, size = [], 0
        window, mask = gathered(*(np.concatenate(x) for x in zip(*done))) if len(done) > 1 else done[0]
        many = lambda x: (x & (x - np.uint8(1))) != 0
        into, out = mask & np.uint8(15), mask >> np.uint8(4)
        found = []
        for letter in range(4):
            own = many(out) & ((into >> np.uint8(letter)) & 1 > 0)
            found.append((np.int64(letter) << np.int64(2 * width)) | window[own])
            own = many(into) & ((out >> np.uint8(letter)) & 1 > 0)
            found.append((window[own] << 2) | letter)
        kmer = np.concatenate(found)
        return np.unique(np.minimum(kmer, flipped(kmer, k)))

    return work


# Which windows of which reads occur elsewhere too. Reads stand in blocks, so that what is found needs a place in a block only.


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (sample, seq) to blocks, compressed."""
    held, size = [], 0

    def body() -> pa.RecordBatch:
        table, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["body"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield body()
            held, size = [], 0
    if held:
        yield body()


def _block(body: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(body).read_all().combine_chunks()
    return table, *flat(table["seq"])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, the first of all, then the second of all, ...: small numbers compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _spread(width: int):
    """Blocks (block, body) to rows (bucket, block, runs, info, at): all runs with their places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch["block"].to_pylist(), batch["body"].to_pylist()):
                _, raw, offsets = _block(body)
                bucket, code, count, before, after, at = runs_of(raw, offsets, width, True)
                info = (count + 16 * before + 32 * after).astype(np.uint8)
                order = np.lexsort((at, bucket))
                order = order[info[order] != 1]
                if not len(order):
                    continue
                bucket, code, info, at = bucket[order], code[order], info[order], at[order]
                head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                step = np.diff(at, prepend=0).astype(np.int32)
                step[head] = at[head]
                ends = np.r_[head, len(bucket)]
                parts = [[_planes(x[a:b]) for a, b in zip(ends[:-1], ends[1:])] for x in (code, info, step)]
                columns = [pa.array(bucket[head]), pa.array(np.full(len(head), block)), *(pa.array(x, pa.binary()) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "runs", "info", "at"])

    return work


def _shared(width: int):
    """Of whole buckets, rows (block, at, n, kind): runs of n places of windows that occur more than once, or are the same on
    both strands. kind 1: several letters come before the window, 2: several come after it, 3: both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, count = None, [], 0
        for batch in batches:
            for bucket, block, *rest in zip(*(batch.column(i) for i in range(5))):
                bucket = bucket.as_py()
                if count >= CHUNK and bucket != last:
                    yield from found(held, count)
                    held, count = [], 0
                code, info, step = (_numbers(x.as_buffer(), kind) for x, kind in zip(rest, (np.uint64, np.uint8, np.int32)))
                held.append((np.full(len(code), block.as_py()), code, info, np.cumsum(step, dtype=np.int64)))
                count += len(code)
                last = bucket
        if held:
            yield from found(held, count)

    def found(held: list[tuple[np.ndarray, ...]], count: int) -> Iterator[pa.RecordBatch]:
        block, code, info, at = (np.concatenate(x) for x in zip(*held))
        parts = -(-count // (4 * CHUNK))
        for p in range(parts):
            some = []
            for i in range(0, count, CHUNK):
                window, mask, strand, row, j = occurrences(code[i : i + CHUNK], info[i : i + CHUNK], width)
                own = slice(None) if parts == 1 else window % parts == p
                some.append((window[own], mask[own], strand[own], block[row[own] + i], at[row[own] + i] + j[own]))
            yield shared(*(np.concatenate(x) for x in zip(*some)))

    def shared(window, mask, strand, block, at) -> pa.RecordBatch:
        order = np.argsort(window, kind="stable")
        window, mask, strand, block, at = (x[order] for x in (window, mask, strand, block, at))
        head = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.empty(0, np.int64)
        n = np.diff(np.r_[head, len(window)])
        every = np.repeat(np.bitwise_or.reduceat(mask, head), n) if len(head) else mask
        keep = (np.repeat(n, n) > 1) | (strand == 2)
        every, strand, block, at = every[keep], strand[keep], block[keep], at[keep]
        into, out = every & np.uint8(15), every >> np.uint8(4)
        into, out = (into & (into - np.uint8(1))) != 0, (out & (out - np.uint8(1))) != 0
        kind = np.where(strand == 1, out + 2 * into, into + 2 * out).astype(np.int32)
        order = np.lexsort((at, block))
        block, at, kind = block[order], at[order], kind[order]
        new = np.ones(len(at), bool)
        new[1:] = (block[1:] != block[:-1]) | (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.r_[head, len(at)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(block[head]), pa.array(at[head].astype(np.int32)), pa.array(n), pa.array(kind[head])], ["block", "at", "n", "kind"])

    return work


TURN = bytes.maketrans(b"ACGT", b"TGCA")
SPLIT = "kind int, sample string, kmer long, open boolean, to long, tail long, text string, kmers long"


def _split(k: int, least: int):
    """Blocks with what is shared in them to rows of three kinds, without k-mers at forks.

    0: (sample, kmer) of k-mers that touch a shared joint. 1: pieces of either strand between these (`kmer`: the head,
    `text`: letters). 2: whole paths that no other read touches, of `least` letters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, runs in zip(batch["body"], batch["runs"]):
                runs = runs.values.flatten() if runs.is_valid else [np.empty(0, np.int32)] * 3
                yield from one(*_block(body.as_buffer()), *(np.asarray(x) for x in runs))

    def one(table: pa.Table, raw: np.ndarray, offsets: np.ndarray, start, n, kind) -> Iterator[pa.RecordBatch]:
        fw, rc, at = kmer_windows(raw, offsets, k)
        if not len(at):
            return
        shared, ins, outs = (np.zeros(len(raw) + 2, bool) for _ in range(3))
        place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        kind = np.repeat(kind, n)
        shared[place], ins[place], outs[place] = True, (kind & 1) > 0, (kind & 2) > 0
        core, dead = shared[at] | shared[at + 1], ins[at] | outs[at + 1]
        on = np.r_[False, at[1:] == at[:-1] + 1, False]  # whether k-mer i follows i - 1
        own = np.flatnonzero(core & ~dead)
        row = np.searchsorted(offsets, at[own], side="right") - 1
        code = table["sample"].combine_chunks().dictionary_encode()
        sample = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)[row].astype(np.int64)
        pair = np.unique(np.stack([np.minimum(fw[own], rc[own]), sample]), axis=1) if len(own) else np.empty((2, 0), np.int64)
        names = code.dictionary.take(pa.array(pair[1], mask=pair[1] < 0))
        yield rows(0, len(names), sample=names, kmer=pair[0])
        first = np.flatnonzero(~core & np.r_[True, core[:-1] | ~on[1:-1]])
        last = np.flatnonzero(~core & np.r_[core[1:] | ~on[1:-1], True])
        if not len(first):
            return
        left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(at) - 1)
        before, after = on[first] & ~dead[left], on[last + 1] & ~dead[right]
        text, size = raw.tobytes().upper(), last - first + 1
        alone = ~before & ~after
        x, y = np.minimum(fw[first], rc[first]), np.minimum(fw[last], rc[last])
        paths = []
        for i in np.flatnonzero(alone & (size + k - 1 >= least)):
            s = text[at[first[i]] : at[last[i]] + k]
            t = s[::-1].translate(TURN)
            paths.append((s if x[i] < y[i] else t if x[i] > y[i] else min(s, t)).decode())
        yield rows(2, len(paths), text=paths, kmers=size[alone & (size + k - 1 >= least)])
        p = np.flatnonzero(~alone)
        a, b, left, right, before, after, size = first[p], last[p], left[p], right[p], before[p], after[p], size[p]
        ahead = [text[i + k - 1 : j + k].decode() for i, j in zip(at[a], at[b])]
        back = [text[i : j + 1][::-1].translate(TURN).decode() for i, j in zip(at[a], at[b])]
        yield rows(1, len(p), kmer=np.where(before, fw[left], fw[a]), open=before, to=pa.array(fw[right] * 2, mask=~after), tail=fw[b], text=ahead, kmers=size)
        yield rows(1, len(p), kmer=np.where(after, rc[right], rc[b]), open=after, to=pa.array(rc[left] * 2, mask=~before), tail=rc[a], text=back, kmers=size)

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "sample": pa.string(), "kmer": pa.int64(), "open": pa.bool_(), "to": pa.int64(), "tail": pa.int64(), "text": pa.string(), "kmers": pa.int64()}
        columns["kind"] = np.full(n, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    return work


def split(reads: DataFrame, k: int, least: int) -> DataFrame:
    """The graph of all reads (`sample`, `seq`) without branching k-mers: what reads share as k-mers, the rest as pieces and
    whole paths, see `_split`. Runs with their places, what is shared, and compressed reads are shuffled."""
    blocks = reads.select("sample", "seq").where(F.length("seq") >= k).mapInArrow(_blocks, "body binary")
    blocks = materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "body"))
    rows = blocks.mapInArrow(_spread(k - 1), "bucket int, block long, runs binary, info binary, at binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(k - 1), "block long, at int, n int, kind int")
    places = materialize(rows)
    rows = places.groupBy("block").agg(F.collect_list(F.struct("at", "n", "kind")).alias("runs"))
    out = materialize(blocks.join(rows, "block", "left").select("body", "runs").mapInArrow(_split(k, least), SPLIT))
    discard(blocks)
    discard(places)
    return out


def forks(reads: DataFrame, k: int) -> DataFrame:
    """(`kmer`): canonical k-mers of `seq` that more than one other k-mer of the reads follows on either side.

    Runs of the k - 1 letters that k-mers share, with the letters around them, are the only thing that is shuffled.
    """
    rows = reads.select("seq").where(F.length("seq") >= k).mapInArrow(_scattered(k - 1), "bucket int, runs binary, info binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forks(k), "kmer long").distinct()
