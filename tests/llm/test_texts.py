"""Shared spans, repetition, packing and mixing against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import catalog, groups, mixing, packing, repetition, spans
from strandlake.llm.repetition import VALUE


def shared(a, b, least):
    own = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in own for i in range(len(b) - least + 1))


def sequences(seed, n=120, letters="ACGT"):
    """Reads with planted common stretches of lengths around the bound, low-complexity ones, copies and short ones."""
    random.seed(seed)
    word = lambda m: "".join(random.choice(letters) for _ in range(m))
    out = [word(random.randint(20, 150)) for _ in range(n)]
    for m in (48, 49, 50, 51, 55, 60, 90):
        for _ in range(6):
            core = word(m)
            out += [word(random.randint(0, 40)) + core + word(random.randint(0, 40)) for _ in range(2)]
    for run in ("A" * 45, "A" * 52, "A" * 70, "AC" * 24, "AC" * 26, "AC" * 40, "ACG" * 18, "ACG" * 30):
        out += [word(7) + run + word(7), run + word(30), word(30) + run]
    return out + out[:6] + ["", word(49), word(50)]


@pytest.mark.parametrize("group,seen", [(2, 100), (16, 100), (16, 3)])
def test_pairs_of_reads(spark, monkeypatch, group, seen):
    """Through anchors; through windows where more than two share one; with anchors that the sample finds hot."""
    monkeypatch.setattr(spans, "GROUP", group)
    monkeypatch.setattr(groups, "HOT_SAMPLE", 0.01 if seen == 100 else 0.999)
    monkeypatch.setattr(groups, "HOT_SEEN", seen)
    texts = sequences(group)
    df = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (None, texts[0]), (0, texts[0])], "read_no long, seq string")
    df = df.withColumn("unit", F.lit(1)).withColumn("tokens", F.lit("x"))
    got = {(r.key_a, r.key_b) for r in spans.shared_pairs(spans.text_units(df, "read_no", "seq", 50), 50).collect()}
    assert got == {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if shared(a, b, 50)}
    assert spans.shared_pairs(spans.text_units(df.limit(0), "read_no", "seq", 50), 50).isEmpty()


def test_stretches_cover_what_is_shared(spark):
    texts = sequences(7, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "read_no long, seq string")
    got = {}
    for r in spans.shared_spans(spans.text_units(df, "read_no", "seq", 50), 50).collect():
        own, other = (r.unit_b, r.unit_a) if r.of_b else (r.unit_a, r.unit_b)
        got.setdefault((own >> spans.PIECE_BITS, other >> spans.PIECE_BITS), set()).update(range(r.start, r.end))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i != j:
                want = {p for k in range(len(a) - 49) if a[k : k + 50] in b for p in range(k, k + 50)}
                assert got.get((i, j), set()) == want


def bodies(kind, rng, n):
    """n letters of one kind of text."""
    if kind == "uniform":
        return rng.integers(65, 69, n)
    if kind == "two":
        return rng.integers(65, 67, n)
    if kind == "biased":
        return 65 + rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])
    if kind == "periods":
        out = np.resize(rng.integers(65, 69, rng.integers(1, 8)), n)
        if n and rng.random() < 0.5:
            out[rng.integers(n)] = 65
        return out
    out = [np.full(rng.integers(2, 14), rng.integers(65, 69)) for _ in range(n // 2 + 1)]
    return np.concatenate(out)[:n]


KINDS = ["uniform", "two", "biased", "periods", "runs"]


@pytest.mark.parametrize("kind", KINDS)
def test_no_span_is_without_a_common_key(kind):
    """Spans of just the least length between flanks of the same kind or of uniform letters: always a key in common."""
    rng = np.random.default_rng(5)
    shape, n = spans.Shape(50), 4000
    cores = [bodies(kind, rng, 50) for _ in range(n)]
    keys = []
    for _ in range(2):
        flank = lambda: bodies(kind if rng.random() < 0.5 else "uniform", rng, int(rng.integers(0, 60)))
        texts = [np.concatenate([flank(), core, flank()]) for core in cores]
        part = np.repeat(np.arange(n), [len(t) for t in texts])
        at, _, key = spans.anchors(VALUE[np.concatenate(texts)], part, shape)
        keys.append(set(zip(part[at].tolist(), key.tolist())))
    assert {p for p, _ in keys[0] & keys[1]} == set(range(n))


def test_few_keys_where_letters_are_uniform():
    rng = np.random.default_rng(6)
    part = np.repeat(np.arange(1000), 100)
    at, end, _ = spans.anchors(VALUE[rng.integers(65, 69, len(part))], part, spans.Shape(50))
    assert len(at) < 0.1 * len(part) and (end - at == 50).sum() < 0.1 * len(at)


@pytest.mark.parametrize("kind", KINDS[1:])
def test_pairs_of_poor_texts(spark, kind):
    """End to end, with many reads of the same letters: every pair, and the share of every read without pairs."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(150):
        core = bodies(kind, rng, 50)
        for _ in range(2):
            texts.append(bytes(np.concatenate([bodies(kind, rng, 15), core, bodies("uniform", rng, 20)]).astype(np.uint8)).decode())
    own = [{t[i : i + 50] for i in range(len(t) - 49)} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "read_no long, seq string")
    units = spans.text_units(df, "read_no", "seq", 50)
    got = {(r.key_a, r.key_b) for r in spans.shared_pairs(units, 50).collect()}
    assert got == {(i, j) for i, j in combinations(range(len(texts)), 2) if own[i] & own[j]}
    often = Counter(w for x in own for w in x)
    want = {}
    for i, t in enumerate(texts):
        cover = {p for k in range(len(t) - 49) if often[t[k : k + 50]] > 1 for p in range(k, k + 50)}
        if cover:
            want[i] = len(cover)
    assert {r.key: r.shared for r in spans.shared_lengths(units, 50).collect()} == want


def test_classes_of_copies(spark):
    texts = sequences(9, 40)
    df = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (None, texts[0])], "read_no long, seq string")
    got = {r.key: (r.class_id, r.n_links) for r in spans.shared_classes(df, "read_no", "seq", 50).collect()}
    long = [(i, t) for i, t in enumerate(texts) if len(t) >= 50]
    kinds = {t for _, t in long}
    links = {t: sum(shared(t, o, 50) for o in kinds if o != t) for t in kinds}
    assert got == {i: (min(j for j, o in long if o == t), links[t]) for i, t in long}
    assert spans.shared_classes(df.limit(0), "read_no", "seq", 50).isEmpty()


def test_large_groups_cut_by_batches():
    """Two large groups in a row, each cut by the end of a batch: all rows of both go by the windows."""
    sizes = [("a", 3, 1), ("b", 20, 2), ("b", 5, 2), ("c", 30, 3), ("c", 4, 3), ("d", 2, 4)]
    unit, parts = 0, {}
    for batch, n, key in sizes:
        parts.setdefault(batch, []).extend((key, unit + i) for i in range(n))
        unit += n
    rows = [r for own in parts.values() for r in own]
    cuts = [0, 23, 58, len(rows)]
    batches = [
        pa.RecordBatch.from_pydict({"key": [k for k, _ in own], "unit": [u for _, u in own], "salt": [0] * len(own), "hot": [False] * len(own)})
        for own in (rows[a:b] for a, b in zip(cuts, cuts[1:]))
    ]
    out = [r for b in groups.grouped(16)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["key"], r["a"]) for r in out if r["b"] is None) == [r for r in rows if r[0] in (2, 3)]
    small = [[u for k, u in rows if k == key] for key in (1, 4)]
    assert sorted((r["a"], r["b"]) for r in out if r["b"] is not None) == sorted(p for own in small for p in combinations(own, 2))


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 200)
    random.seed(3)
    word = lambda m: "".join(random.choice("ACGT") for _ in range(m))
    texts = [word(1000) for _ in range(6)]
    for at in range(0, 900, 61):
        i, j = random.sample(range(6), 2)
        texts[j] = texts[j][:at] + texts[i][at : at + 50] + texts[j][at + 50 :]
    df = spark.createDataFrame(list(enumerate(texts)), "read_no long, seq string")
    got = {(r.key_a, r.key_b) for r in spans.shared_pairs(spans.text_units(df, "read_no", "seq", 50), 50).collect()}
    assert got == {(i, j) for i, j in combinations(range(6), 2) if shared(texts[i], texts[j], 50)}


@pytest.mark.parametrize("piece", [1 << 16, 50])
def test_runs_of_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    random.seed(4)
    lists = {i: [random.getrandbits(60) for _ in range(random.randint(5, 160))] for i in range(40)}
    for m in (18, 19, 20, 21, 30):
        for _ in range(5):
            i, j = random.sample(range(40), 2)
            core = [random.getrandbits(60) for _ in range(m)]
            for x in (i, j):
                at = random.randint(0, len(lists[x]))
                lists[x][at:at] = core
    for own in lists.values():
        for _ in range(2):
            own[random.randrange(len(own))] = None
    rows = [(i, p + 1, x) for i, own in lists.items() for p, x in enumerate(own)]
    rows = [r for r in rows if random.random() > 0.005]
    have = {}
    for i, p, x in rows:
        have.setdefault(i, {})[p] = x
    runs = {i: {tuple(own.get(p + q) for q in range(20)) for p in own} for i, own in have.items()}
    runs = {i: {r for r in own if None not in r} for i, own in runs.items()}
    df = spark.createDataFrame(rows + rows[:90] + [(None, 1, 5), (3, None, 5)], "comp_no int, pos int, kmer long")
    units = spans.list_units(df, "comp_no", "pos", "kmer", 20)
    got = {(r.key_a, r.key_b) for r in spans.shared_pairs(units, 20).collect()}
    assert got == {(i, j) for i, j in combinations(sorted(runs), 2) if runs[i] & runs[j]} and got


def repeated(text, n):
    tokens = re.findall("[A-Za-z0-9_]+", text or "")
    seen, cover = set(), set()
    for i in range(len(tokens) - n + 1):
        run = tuple(tokens[i : i + n])
        if run in seen:
            cover.update(range(i, i + n))
        seen.add(run)
    return len(tokens), len(cover), len(set(tokens))


def texts(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "x_1", "—", "a.b", "中文"]
    out = [None, "", "   \n", "one", "a " * 500, "ab" * 20000, "\n".join(["same line of words here"] * 40)]
    for _ in range(80):
        body = [random.choice(words) for _ in range(random.randint(0, 200))]
        for _ in range(random.randint(0, 3)):
            i = random.randint(0, len(body))
            body[i:i] = body[: random.randint(0, 30)]
        out.append(random.choice([" ", "\n", "\r\n", ", "]).join(body))
    return out


def test_repetition_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repetition, "CHUNK_BYTES", 2000)
    every = texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)] + [(3, "one")], "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    rows = {r.doc_id: r for r in repetition.scored(df).collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        n, ten, types = repeated(t, 10)
        assert (rows[i].n_tokens, rows[i].repeated, rows[i].n_types) == (n, ten, types)
        assert rows[i].repeated5 == repeated(t, 5)[1]
        lines = [tuple(re.findall("[A-Za-z0-9_]+", x)) for x in (t or "").split("\n")]
        lines = [x for x in lines if x]
        again = sum(len(x) for j, x in enumerate(lines) if x in lines[:j])
        assert (rows[i].n_lines, rows[i].line_tokens) == (len(lines), again)
        assert 0 <= rows[i].p_repetitive <= 1
    assert repetition.scored(df.limit(0)).isEmpty()


def test_posterior_finds_the_hidden_kind():
    rng = np.random.default_rng(2)
    kind = rng.random(4000) < 0.1
    accuracy = [0.95, 0.9, 0.85, 0.7, 0.9]
    said = np.stack([np.where(rng.random(4000) < a, kind, ~kind) + 1 for a in accuracy], 1)
    said[rng.random(said.shape) < 0.2] = 0
    patterns, back, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    p = repetition.posterior(patterns, counts)[back.ravel()]
    assert ((p > 0.5) == kind).mean() > 0.97
    assert len(repetition.posterior(np.zeros((0, 5), int), np.zeros(0, int))) == 0


def test_true_cases_are_found_whatever_the_other_rules_say(spark, tmp_path):
    """Three rules say "not" of a passage that comes again with other line breaks, in a corpus that makes them weighty."""
    plain = "\n\n".join(" ".join(f"p{i}x{j}" for j in range(12)) for i in range(6))
    same = "\n\n".join([" ".join(f"s{j}" for j in range(12))] * 20)
    passage = [f"t{i}" for i in range(52)]
    cut = lambda at, n: "\n\n".join(" ".join(passage[i : i + n]) for i in range(at, 52, n))
    case = cut(0, 13) + "\n\n" + " ".join(f"u{i}" for i in range(55)) + "\n\n" + cut(0, 11)
    rows = [(i, plain if i % 2 else same) for i in range(4000)] + [(9999, case)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r for r in catalog.p9_scores(spark, str(tmp_path)).where("doc_id IN (0, 1, 9999)").collect()}
    assert score[9999].p_repetitive >= catalog.P9_LEAST and repeated(case, 10)[1] >= 0.3 * repeated(case, 10)[0]
    assert {r.doc_id for r in catalog.p9_found(spark, str(tmp_path)).collect()} == {9999, *range(0, 4000, 2)}
    quality = catalog.p9_quality(spark, str(tmp_path)).first()
    assert quality.recall == 1 and quality.precision == 1 and quality.n_true == 2001


def test_the_trusted_rule_is_never_outweighed():
    rng = np.random.default_rng(1)
    patterns = np.array([[2, 1, 1, 1, 1, 1], [1, 2, 2, 2, 2, 2], [0, 2, 2, 2, 2, 2], [0, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1], [2, 2, 2, 2, 2, 2]])
    for _ in range(50):
        p = repetition.posterior(patterns, rng.integers(1, 10**rng.integers(1, 9), 6), trusted=0)
        assert p[0] > 0.5 and p[1] < 0.5 and p[5] > 0.5 and p[4] < 0.5


def documents(spark, sizes, sources=("a",)):
    rows = [(i, sources[i % len(sources)], n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


@pytest.mark.parametrize("seed,capacity,part", [(1, 100, 170), (2, 7, 1 << 20), (3, 2048, 1 << 20), (4, 1 << 20, 1 << 20)])
def test_packing(spark, monkeypatch, seed, capacity, part):
    """In rounds over many parts, and in one: nothing lost, cut or overfull, and few places left."""
    monkeypatch.setattr(packing, "PART_ROWS", part)
    random.seed(seed)
    sizes = [random.choice([0, capacity, 3 * capacity + 1, random.randint(1, max(2, capacity // 3)), random.randint(1, capacity)]) for _ in range(400)]
    sizes += [capacity // 3 + 1] * 60 + [1] * 80
    rows = packing.packed(documents(spark, sizes), capacity)
    got = rows.collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
    for i, n in enumerate(sizes):
        want = [(k, k * capacity, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
        assert sorted(pieces.get(i, [])) == want
    used = Counter()
    for r in got:
        used[r.container] += r.n_tokens
    assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
    info = packing.fill(rows, capacity).first()
    assert (info.containers, info.tokens, info.fullest) == (len(used), sum(sizes), max(used.values()))
    assert info.containers <= 1.02 * info.least_containers + 2
    assert packing.packed(documents(spark, [0, 0]), capacity).isEmpty()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_sweeps_of_parts_equal_one_sweep(parts):
    """Brackets matched part by part with carries are those of a stack."""
    rng = np.random.default_rng(parts)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        value, kind, ident = rng.integers(1, 30, n), rng.integers(0, 2, n), rng.permutation(n)
        order = np.lexsort((ident, kind, -value))
        stack, want = [], set()
        for i in order:
            if kind[i] == 0:
                stack.append(i)
            elif stack:
                want.add((int(stack.pop()), int(i)))
        got, left, rest = set(), [], {}
        for p, own in enumerate(np.array_split(order, parts)):
            _, g, i = packing.sweep(value[own], kind[own], ident[own])
            got |= set(zip(own[g].tolist(), own[i].tolist()))
            free = [x for x in own.tolist() if x not in set(own[g].tolist()) | set(own[i].tolist())]
            rest[p] = {k: [x for x in free if kind[x] == k] for k in (0, 1)}
            left.append((p, len(rest[p][1]), len(rest[p][0])))
        named = {}
        for p, k, lo, hi, number, way in packing.carried(left):
            for r in range(lo, hi):
                m = number + r - lo if way == 1 else number + hi - 1 - r
                named.setdefault(m, {})[k] = rest[p][k][r]
        got |= {(m[0], m[1]) for m in named.values()}
        assert got == want


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS", 100)
    monkeypatch.setattr(mixing, "SLOTS", 64)
    random.seed(1)
    sizes = [random.randint(0, 900) for _ in range(3000)]
    docs = documents(spark, sizes, ("a", "b", "a", "c", "a", None, "d", "a"))
    rows = [("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("e", 0.1, 2), ("b", 0.3, 3), ("d", 0.0, 5), (None, 0.1, 1)]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets)
    got = {r.source: r for r in mixing.shares(mix, targets, docs).collect()}
    for s, want in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(got[s].reached_share - want) < 0.001 and 0 < got[s].most_uses <= got[s].max_repeats
    assert got["e"].tokens == got["d"].tokens == 0
    drawn = mix.collect()
    assert len({(r.doc_id, r.round) for r in drawn}) == len(drawn) and all(r.n_tokens == sizes[r.doc_id] for r in drawn)
    assert {r.doc_id for r in drawn} == {r.doc_id for r in mixing.mixed(docs, targets).collect()}
    # Sources take turns: every tenth of the schedule has every source.
    last = max(r.slot for r in drawn)
    for i in range(10):
        assert {r.source for r in drawn if i * last <= 10 * r.slot < (i + 1) * last} == {"a", "b", "c"}
    more = mixing.mixed(docs, targets, total=10**9)
    full = {r.source: r for r in mixing.shares(more, targets, docs).collect()}
    assert {s: full[s].most_uses for s in "abc"} == {"a": 1, "b": 3, "c": 2}
    assert full["b"].tokens == 3 * sum(n for i, n in enumerate(sizes) if i % 8 == 1)
    assert got["e"].wanted_share is None and got["d"].available > 0 and got["d"].tokens == 0
    assert mixing.mixed(docs.limit(0), targets).isEmpty() and mixing.mixed(docs, targets.limit(0)).isEmpty()


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    from pathlib import Path

    from strandlake.llm import tokens

    if not Path(tokens.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, None), (3, ""), (1, "hello world <|endoftext|>"), (4, "x" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id").collect()}
    encode = tokens.encoder(tokens.VOCABULARY)
    assert got == {1: len(encode.encode_ordinary("hello world <|endoftext|>")), 2: 0, 3: 0, 4: len(encode.encode_ordinary("x" * 200_000))}


def test_shared_lengths(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 90)
    texts = sequences(9, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "read_no long, seq string")
    got = {r.key: r.shared for r in spans.shared_lengths(spans.text_units(df, "read_no", "seq", 50), 50).collect()}
    want = {}
    for i, a in enumerate(texts):
        places = {
            p for k in range(len(a) - 49) if any(a[k : k + 50] in b for j, b in enumerate(texts) if j != i) for p in range(k, k + 50)
        }
        if places:
            want[i] = len(places)
    assert got == want


def test_shared_components_beside_sql(spark, monkeypatch, tmp_path):
    """Runs cut by a gap, a run over the end of a piece, a run of 19 and one that comes twice in its own component only."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(spans, "PIECE", 50)
    random.seed(6)
    own = lambda n: [random.getrandbits(60) for _ in range(n)]
    core, short, again = own(45), own(19), own(25)
    lists = [own(30) + core + own(9), own(3) + core[:25] + [None] + core[25:], short + own(5), own(9) + short, again + own(4) + again]
    rows = [(c, p, x) for c, values in enumerate(lists) for p, x in enumerate(values) if x is not None]
    spark.createDataFrame(rows, "comp_no int, pos int, kmer long").write.parquet(f"{tmp_path}/component_kmers.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW component_kmers AS SELECT * FROM '{tmp_path}/component_kmers.parquet/*.parquet'")
    con.execute("CREATE TABLE seq_reads (read_no BIGINT, seq VARCHAR)")
    want = con.sql(catalog.SQL["p5_shared_components"]).fetchall()
    got = [tuple(r) for r in catalog.p5_shared_components(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) == [(0, 84, 45), (1, 48, 45)]


def test_keys_do_not_depend_on_chunks(monkeypatch):
    """A chunk of texts is as large as the cache likes; keys and verified stretches are the same."""
    texts = [t for t in sequences(9) if len(t) >= 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["unit", "tokens"])
    pairs = [(i, j) for i in range(0, len(texts), 3) for j in range(i + 1, min(i + 4, len(texts)))]
    a, b = (pa.array(x, pa.int64()) for x in zip(*pairs))
    both = pa.RecordBatch.from_arrays([a, b, pa.array(texts).take(a), pa.array(texts).take(b)], ["a", "b", "tokens_a", "tokens_b"])
    seen = []
    for size in (100, spans.CHUNK, 1 << 20):
        monkeypatch.setattr(spans, "CHUNK", size)
        keys = spans._keys(spans.Shape(50), np.empty(0, np.int64))(iter([batch]))
        rows = spans._verify(50)(iter([both]))
        seen.append([sorted(tuple(r.values()) for x in y for r in x.to_pylist()) for y in (keys, rows)])
    assert seen[0] == seen[1] == seen[2] and all(seen[0])
    assert {r[:2] for r in seen[0][1]} == {(i, j) for i, j in pairs if shared(texts[i], texts[j], 50)}


def test_keys_of_both_sides():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (5, 0), (40, 60), (500, 300)):
        x, y = (rng.integers(0, 100, k).astype(np.uint64) for k in (n, m))
        of_x, of_y = spans.in_both(x, y)
        assert of_x.tolist() == [v in set(y.tolist()) for v in x.tolist()]
        assert of_y.tolist() == [v in set(x.tolist()) for v in y.tolist()]
