"""Operators against brute force, on made texts and on the sf0.001 documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from sluice.llm import queries

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 12, 20, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5, 10])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    return rows + [(9000 + i, t) for i, t in enumerate([None, "", " \n", "A b c", "a B  c", "a b"])]


@pytest.mark.parametrize(("name"), sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, [tuple(r) for r in got.select(*names).collect()])) == sorted(map(repr, cur.fetchall()))


# ------------------------------------------------------------------ 1
def test_token_files_equal_the_library(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_files"](spark, sf).collect()}
    start = 0
    for i, t in sorted(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_units_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from sluice.llm.tokenizers_cached import UnitEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    library, cached = Tokenizer.from_file(path), UnitEncoder(path, keep=300)
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "'s", "'", "'t", "''s", "é", "É", "İ", "ß", "×", "÷", "´", "é", "́", "漢字", "\n", "😀",
             "the", "12", "3", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ".", ",", "...", "…", " ", "\x0b", "\x1c", "\x00", "\u0085"]
    texts = ["".join(rng.choice(parts[:rng.randint(1, len(parts))]) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None]
    ids, at = cached.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_readers_decompress_only_what_is_asked(spark, tmp_path, monkeypatch):
    from sluice.llm import token_files as tf

    monkeypatch.setattr(tf, "FRAME_BYTES", 64)
    rng = np.random.default_rng(1)
    sizes = [0, 3, 5, 100, 1, 0, 16, 17, 15, 40, 2]
    ids = rng.integers(0, 50_000, sum(sizes)).astype(np.uint32)
    at = np.append(0, np.cumsum(sizes))
    w = tf.TokenFileWriter(str(tmp_path), "part.zst")
    w.add([10 * k for k in range(6)], ids[:at[6]], at[:7])
    w.add([10 * k for k in range(6, 11)], ids[at[6]:], at[6:] - at[6])
    w.close()
    f = tf.TokenFile(str(tmp_path), "part.zst")
    for k in range(11):
        assert f.ids(k).tolist() == ids[at[k]:at[k + 1]].tolist()
    g = tf.TokenFile(str(tmp_path), "part.zst")
    (row,) = g.rows([100])
    assert g.ids(row).tolist() == ids[at[10]:].tolist() and g.frames_read == 1 < len(g.entries)
    # plain zstandard reads all ids; a flipped byte is found
    import zstandard
    raw = (tmp_path / "part.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as s:
        assert s.read()[:4 * len(ids)] == ids.tobytes()
    (tmp_path / "bad.zst").write_bytes(raw[:12] + bytes([raw[12] ^ 1]) + raw[13:])
    with pytest.raises(Exception):
        [tf.TokenFile(str(tmp_path), "bad.zst").ids(k) for k in range(11)]


def test_wanted_documents(spark, tmp_path):
    from sluice.llm import token_files as tf

    rows = [(k, "x" * k) for k in range(50)]

    def encoder():
        def encode(texts):
            n = [len(t or "") for t in texts.to_pylist()]
            return np.full(sum(n), 7, np.uint32), np.append(0, np.cumsum(n))
        return encode
    folder = str(tmp_path / "tokens")
    tf.write_token_files(spark, frame(spark, rows), folder, encoder, 1, F.col("doc_id"), F.col("text"), docs_per_file=9)
    wanted = spark.createDataFrame([(3,), (44,), (99,)], "key long")
    got = tf.read_token_files(spark, folder, tf.ids, "ids array<long>", wanted).collect()
    assert sorted((r.key, r.start, r.ids) for r in got) == [(3, 6, [7] * 3 + [1]), (44, 44 * 45 // 2, [7] * 44 + [1])]


# ------------------------------------------------------------------ 2
@pytest.mark.parametrize(("length", "gram"), [(8, 3), (12, 5), (20, 20), (6, 1)])
def test_repeats(spark, length, gram):
    from sluice.llm.suffix_dedup import without_repeats

    rng = random.Random(length)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 50)))
        elif kind < 0.7:
            t = t[:rng.randint(0, 30)] + rng.choice(base) + rng.choice(["", "a" * rng.randint(0, 30), "ab" * 9])
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "a" * 30)]
    want = brute.repeats(rows, length)
    got = without_repeats(spark, frame(spark, rows), length=length, gram=gram, memory=100).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_with_null_and_equal_ids(spark):
    from sluice.llm.suffix_dedup import without_repeats

    rng = random.Random(31)
    base = ["".join(rng.choice("abcd") for _ in range(40)) for _ in range(6)]
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randrange(30))) + rng.choice(base)[:rng.randrange(41)] + "".join(
        rng.choice("uvw") for _ in range(rng.randrange(20))) for _ in range(50)] + [base[0]] * 3 + [None, None, ""]
    names = ids_missing_and_shared(list(enumerate(texts)))
    want = brute.repeats(list(enumerate(texts)), 10)
    for kept in (True, False):
        got = without_repeats(spark, frame(spark, names), length=10, gram=4, memory=100, kept=kept).collect()
        assert sorted(map(repr, [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got])) == sorted(
            map(repr, [(name, *want[i]) for i, (name, _) in enumerate(names)]))
        if kept:
            assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_documents(spark, sf, docs):
    got = queries.QUERIES["op2_suffix_array_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(docs, 200)


@pytest.mark.parametrize(("few", "base", "batch"), [(1024, 0, 1 << 16), (2, 0, 3), (2, 8, 1 << 16), (2, 1 << 21, 3)])
def test_induced_sort(monkeypatch, few, base, batch):
    from sluice.llm import induced_sort

    for name, value in (("FEW_NAMES", few), ("BASE", base), ("BATCH", batch)):
        monkeypatch.setattr(induced_sort, name, value)
    rng = random.Random(few + base + batch)
    for _ in range(120):
        x = [rng.randint(1, rng.choice([2, 3, 10, 50])) for _ in range(rng.randint(1, 100))]
        x = x + x[:rng.randint(0, len(x))] + x if rng.random() < 0.5 else [1] * rng.randint(0, 20) + x
        x.append(0)
        order, prefix = induced_sort.suffix_array(np.array(x), memory=rng.choice([1, 200, 1 << 20]))
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert order.tolist() == want
        for k in range(1, len(x)):
            a, b = x[want[k - 1]:], x[want[k]:]
            assert prefix[k] == next((n for n, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_queues_spill_to_disk():
    from sluice.llm.induced_sort import Queues

    q = Queues(100)
    for k in range(50):
        q.push(k % 3, np.arange(k, dtype=np.int32), np.full(k, k, np.int32))
    assert q.spilled > 0 and q.held <= 100
    got = np.concatenate([p for p, _ in q.pop(1)])
    assert got.tolist() == [i for k in range(50) if k % 3 == 1 for i in range(k)]
    q.close()


# ------------------------------------------------------------------ 3
def test_spliced_counts_equal_the_library():
    import public_tokenizers

    from sluice.llm.token_counts import Counter as Tokens

    c = Tokens.of(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "é", "漢字", "\n", "😀", "the", "ing", "<0x0A>", "</s>", "abc", "   ", "́"]
    texts = ["".join(rng.choice(parts[:rng.randint(1, len(parts))]) for _ in range(rng.randint(0, 150))) for _ in range(500)]
    texts += ["a" * 3000, "ab " * 2000, "漢" * 500, ""]
    want = [len(ids) for ids in c.model.encode(texts)]
    for chunk, overlap in ((10, 2), (7, 3), (64, 8)):
        assert c.counts(texts, chunk, overlap) == want


def test_token_counts_of_documents(spark, sf, docs):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.QUERIES["op3_overlap_token_counts"](spark, sf).collect():
        t = dict(docs)[r.doc_id] or ""
        n = len(library.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)


# ------------------------------------------------------------------ 4
@pytest.mark.parametrize(("k", "num", "den", "piece"), [(3, 9, 10, 1 << 20), (5, 8, 10, 1 << 20), (2, 8, 10, 60), (3, 6, 10, 50)])
def test_jaccard(spark, k, num, den, piece):
    from sluice.llm.jaccard import similar_documents

    rows = near_copies(k + num)
    got = similar_documents(spark, frame(spark, rows), k=k, num=num, den=den, piece_shingles=piece).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows, k, num, den)


def ids_missing_and_shared(rows):
    """The rows again with some ids null and some shared by several texts."""
    return [(None if i % 7 == 0 else i - i % 3 if i % 5 == 0 else i, t) for i, t in rows]


@pytest.mark.parametrize("piece", [1 << 20, 60])
def test_jaccard_with_null_and_equal_ids(spark, piece):
    from sluice.llm.jaccard import one_of_each_group, similar_documents

    rows = near_copies(21)
    names = ids_missing_and_shared(rows)
    want = brute.jaccard(rows, 3, 9, 10)  # by row number
    groups = {}
    for (row, _), (name, _) in zip(rows, names, strict=True):
        groups.setdefault(want[row][1], []).append(name)
    expected = []
    for (row, _), (name, _) in zip(rows, names, strict=True):
        n, root = want[row]
        real = [i for i in groups[root] if i is not None]
        expected.append((name, n, (min(real) if real else None) if n else name))
    got = similar_documents(spark, frame(spark, names), k=3, num=9, den=10, piece_shingles=piece).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    # one row of each group stays, its smallest real id where it has one; texts without words stay
    kept = Counter((r.doc_id, r.text) for r in one_of_each_group(spark, frame(spark, names), k=3, num=9, den=10).collect())
    assert all(v == 1 for (name, _), v in kept.items() if name is not None)
    by_row = {}
    for (row, text), (name, _) in zip(rows, names, strict=True):
        n, root = want[row]
        if n:
            by_row.setdefault(root, []).append((name, text))
    spoken = Counter({k: v for k, v in kept.items() if k[1] and k[1].split()})
    assert sum(spoken.values()) == len(by_row)
    for members in by_row.values():
        left = [m for m in set(members) if spoken[m]]
        assert left and min((m[0] is None, m[0] or 0) for m in members) in [(m[0] is None, m[0] or 0) for m in left]
    silent = {(name, t) for (row, t), (name, _) in zip(rows, names, strict=True) if not want[row][0]}
    assert {k for k in kept if not (k[1] and k[1].split())} == silent


def test_jaccard_of_documents(spark, sf, docs):
    got = queries.QUERIES["op4_signature_tree_jaccard"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(docs, 3, 9, 10)


def test_common_passages_make_no_blocks(spark, monkeypatch):
    """Texts that quote the same short passages, and are linked otherwise or not at all, are no candidates."""
    from sluice.llm import jaccard

    rng = random.Random(8)
    passages = [" ".join(f"p{i}w{j}" for j in range(5)) for i in range(12)]
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(10**9)}" for _ in range(150 + i)]
        for passage in rng.sample(passages, 8):
            words.insert(rng.randrange(len(words)), passage)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(0, 240, 30)]
    found = []

    def seen(spark, edges):
        found.append({tuple(e) for e in edges.filter("u <> v").collect()})
        return components(spark, edges)

    components = jaccard.components
    monkeypatch.setattr(jaccard, "components", seen)
    got = jaccard.similar_documents(spark, frame(spark, rows), k=5, num=8, den=10).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows, 5, 8, 10)
    assert len(found[0]) == 8


@pytest.mark.parametrize(("num", "den"), [(8, 10), (9, 10), (1, 2)])
def test_linked_sets_keep_a_common_key(num, den):
    """Whatever order the keys have, linked sets keep one in common when each leaves out as many as its marks say."""
    from sluice.llm import jaccard

    rng = np.random.default_rng(den + num)
    classes = jaccard.SizeClasses(num, den)
    linked = 0
    for n in [*range(1, 40), *range(40, 900, 37)]:
        most = int(n * (den - num) / (den + num)) + 1
        for gone, more in [(most, most), (2 * most, 0), (0, 2 * most), (most // 2, 0)]:
            whole = rng.integers(0, 1 << 63, n + more).astype(np.uint64)
            a, b = np.sort(whole[:n]), np.sort(whole[min(gone, n - 1):])
            common = len(np.intersect1d(a, b))
            if den * common < num * (len(a) + len(b) - common):
                continue
            linked += 1
            owner = np.repeat([0, 1], [len(a), len(b)])
            doc, key, mark = jaccard.part_keys(owner, np.concatenate([a, b]), np.array([len(a), len(b)]), classes)
            sets = np.where(np.isin(key, np.intersect1d(key[doc == 0], key[doc == 1])), 9, 1).astype(np.uint32)  # the worst order: shared keys last
            kept = jaccard._rarest(doc.astype(np.uint64), key, sets, mark)
            assert len(np.intersect1d(key[kept & (doc == 0)], key[kept & (doc == 1)]))
    assert linked > 50


def test_a_large_block_is_searched_by_the_tree():
    from sluice.llm.jaccard import block_links

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(300) > 0.1 * rng.random()], rng.integers(0, 1 << 60, 9).astype(np.uint64)))
            for _ in range(150)] + [np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(60)]
    root = block_links(sets, 9, 10)
    find, join = brute.union_find(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 10 * o >= 9 * (len(sets[a]) + len(sets[b]) - o):
                join(a, b)
    groups = Counter(), Counter()
    assert {(root[i], find(i)) for i in range(len(sets))} == {(root[find(i)], find(i)) for i in range(len(sets))}
    assert len(set(root.tolist())) == len({find(i) for i in range(len(sets))}) and groups


def test_components(spark):
    from sluice.llm.components import components

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    find, join = brute.union_find(sorted({x for e in edges for x in e}))
    for a, b in edges:
        join(a, b)
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


# ------------------------------------------------------------------ 6
def test_rule_counts(spark, sf, docs):
    rows = queries.QUERIES["op6_weak_supervision"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.rule_counts(dict(docs)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_rules_tell_junk_from_prose():
    from sluice.llm.rules import RULES, posteriors

    rng = random.Random(0)
    patterns, truth = Counter(), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.85
        kind = rng.randrange(len(RULES))
        code = 0
        for k in range(len(RULES)):
            right = rng.random() < 0.98
            vote = (2 if right else 0) if good else (0 if k == kind or rng.random() < 0.2 else 2)
            code += vote * 3 ** k
        patterns[code] += 1
        truth[code, good] += 1
    p = posteriors(patterns)
    against = {code: sum(code // 3 ** k % 3 == 0 for k in range(len(RULES))) for code in p}
    assert all(p[c] > 0.9 for c, n in against.items() if n == 0) and all(p[c] < 0.1 for c, n in against.items() if n >= 2)
    kept_bad = sum(n for (code, good), n in truth.items() if p[code] >= 0.5 and not good)
    assert kept_bad < 0.05 * sum(n for (_, good), n in truth.items() if not good)
    assert posteriors({}) == {}


# ------------------------------------------------------------------ 9
def test_base_scores(spark, sf, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op9_context_mixing"](spark, sf).collect()}
    tokens = {i: brute.words(brute.lower(t)) + [None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if not brute.held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def trained_model(code, chunks):
    from sluice.llm import context_mixing as cm

    bits = cm.slot_bits(sum(len(data) for data, _ in chunks))
    counter = cm.Counter(bits)
    for data, at in chunks:
        cm.spell(counter, code, data, at)
    tables = np.stack([cm.states(c) for c in counter.counts])
    histogram = cm.Histogram(bits, tables)
    for data, at in chunks:
        cm.spell(histogram, code, data, at, np.ones(len(at) - 1))
    return cm.Model(bits, tables, *cm.learned(histogram.cells))


def test_model_is_a_probability():
    """All texts of the code: the probabilities of symbols and of bytes add up to one."""
    from sluice.llm import context_mixing as cm

    texts = ["the cat sat on the mat", "the cat ran", "a dog sat", "rare words here"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    (_, _, data, at), = cm.tx.chunks(batch)
    known = [cm.tx.span_hash(cm.tx.prefix_hash(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0]
             for w in (b"the", b"cat", b"sat", b"on")]
    code = cm.Code(np.array(known), np.array([90, 60, 60, 30]), 120, 200, np.bincount(data, minlength=256))
    model = trained_model(code, [(data, at)])

    def log_p(words):
        b = np.frombuffer(words, np.uint8)
        return cm.spell(model, code, b, np.array([0, len(b)]))[0][0]
    # prefix sums: extending by each symbol in turn shares out the probability of what stands before
    nodes = len(code.words.steps)
    assert nodes <= cm.DEPTH and (code.words.lengths >= 1).all()
    total = sum(np.exp(-np.log(2) * n) for n in code.words.lengths) if nodes < cm.DEPTH else 1
    assert total <= 1 + 1e-9
    assert log_p(b"the cat sat on the mat") > log_p(b"mat the on sat cat the") and log_p(b"") < 0


def test_model_learns(spark):
    from sluice.llm.context_mixing import text_scores

    rng = random.Random(6)
    follow = {w: [rng.choice(WORDS) for _ in range(2)] for w in WORDS}

    def text():
        w = [rng.choice(WORDS)]
        while len(w) < 200:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)
    rows = frame(spark, [(i, text()) for i in range(400)])
    got = text_scores(spark, rows, F.col("doc_id") % 5 != 1).filter("not trained").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]  # one bit a word instead of five


def test_contexts_predict_whole_words():
    """1,000 equally frequent words, paths of about ten decisions; each word has one that follows it."""
    from sluice.llm import context_mixing as cm

    texts = [" ".join(f"v{(i * 37 + 7 * j) % 1000}" for j in range(200)) for i in range(400)]

    def chunk(part):
        (_, _, data, at), = cm.tx.chunks(pa.RecordBatch.from_arrays([pa.array(part, pa.large_string())], names=["text"]))
        return data, at
    data, at = chunk(texts[:320])
    low, start, end, _, _ = cm.tx.words(data, at)
    words, counts = np.unique(cm.tx.span_hash(cm.tx.prefix_hash(low), start, end), return_counts=True)
    code = cm.Code(words, counts, 320, 0, np.bincount(low, minlength=256))
    model = trained_model(code, [chunk(texts[k:320:8]) for k in range(8)])
    log_p, tokens = cm.spell(model, code, *chunk(texts[320:]))[:2]
    assert -log_p.sum() / np.log(2) < tokens.sum()  # with contexts for six decisions four bits a word are left


def test_scores_do_not_depend_on_tasks(spark, sf):
    from sluice.llm.context_mixing import text_scores

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def scores(tasks):
        found = text_scores(spark, docs.repartition(tasks), F.col("doc_id") % 5 != 1).select("id", "score", "base_score")
        return {r.id: (r.score, r.base_score) for r in found.collect()}
    one = scores(1)
    for tasks in (8, 64):
        other = scores(tasks)
        assert other.keys() == one.keys()
        assert all(math.isclose(a, b, rel_tol=1e-9) for i in one for a, b in zip(one[i], other[i], strict=True))


def test_copies_score_apart(spark):
    """A training document is scored without its own count: only texts that also stand elsewhere look known."""
    from sluice.llm.context_mixing import text_scores

    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(500)]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(20)])
    got = {r.id: r.score / r.n_tokens for r in text_scores(spark, rows, F.col("doc_id") % 5 != 1).collect()}
    twice = [s for i, s in got.items() if i >= 1000 or i < 20 and i % 5 != 1]
    once = [s for i, s in got.items() if 20 <= i < 1000]
    apart = max(once)
    # a training document whose copy is held out has nothing to be known from
    assert sum(s > apart for s in twice) >= 0.75 * len(twice)
    held = [s for i, s in got.items() if 20 <= i < 1000 and i % 5 == 1]
    trained = [s for i, s in got.items() if 20 <= i < 1000 and i % 5 != 1]
    assert abs(sum(held) / len(held) - sum(trained) / len(trained)) < 0.05


def test_states_of_counts():
    from sluice.llm import context_mixing as cm

    counts = np.array([[0, 0], [1, 0], [0, 1], [31, 30], [31, 1], [1000, 10], [4_000_000_000, 3], [50, 60]], np.uint32)
    state = cm.states(counts.ravel()).astype(np.int64)
    odds = cm._ODDS[state]
    exact = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
    assert np.abs(odds[:5] - exact[:5]).max() < 1e-5 and np.abs(odds - exact).max() < 0.13
    less = cm._ODDS[state + 2 * cm.STATES][[2, 3, 4]]  # one bit 1 taken out
    assert np.abs(less - np.log((counts[[2, 3, 4], 1] - 0.6) / (counts[[2, 3, 4], 0] + 0.4))).max() < 1e-5
    assert state.max() < cm.STATES <= 1 << 16
    assert [cm.slot_bits(n) for n in (0, 1 << 13, 1 << 14, 1 << 18, 1 << 40)] == [16, 16, 17, 21, 22]


# ------------------------------------------------------------------ 10
def test_contamination(spark):
    from sluice.llm.decontaminate import benchmark_matches

    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS[:12]) for _ in range(rng.choice([0, 1, 3, 5, 13, 14, 30])))) for k in range(25)]
    items += [(100, None), (101, "Word, word; WORD!")]
    rows = []
    for i in range(80):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            p = rng.choice(items)[1] or ""
            w[len(w) // 2:len(w) // 2] = p.upper().split() if rng.random() < 0.5 else p.split(" ")[1:]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "word word-word")]
    want = brute.contamination(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 60):
        got = benchmark_matches(spark, frame(spark, rows), bench, block_words=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == want
        for r in got:
            assert all(0 <= m.start and m.start + m.length <= r.n_words for m in r.matches)


def test_longest_matches(spark):
    from sluice.llm.decontaminate import benchmark_matches

    item = [f"t{k}" for k in range(40)]
    text = "a b " + " ".join(item[5:35]) + " c " + " ".join(item[:12]) + " " + " ".join(item[20:33])
    got = benchmark_matches(spark, frame(spark, [(1, text)]),
                            spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).first()
    assert sorted((m.item, m.item_start, m.start, m.length) for m in got.matches) == [("7", 5, 2, 30), ("7", 20, 45, 13)]
    assert re.fullmatch("7", got["items"][0])
