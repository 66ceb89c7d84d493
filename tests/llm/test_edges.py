"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing names; models and
orders by their properties."""

import random

import pytest
from pyspark.sql import functions as F

import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("shard slot size target copies source_size row id k s b n n_words items matches node check h key tie p g r e q pi "
            "sure score p_good p_clean good votes n_tokens n_bytes over_limit _kept_id word l t o").split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "stone", "light", "garden", "window", "paper", "morning", "table", "winter"])
                    + str(rng.randrange(50)) for _ in range(n)) + "."


def rows():
    out = [(k, prose(k), "en", f"s{k % 3}", 700) for k in range(20)]
    out += [(20, None, "en", "s0", None), (21, "", None, None, 0), (22, prose(3), "en", "s1", 700), (23, " \n\t ", "de", None, 4),
            (24, "x" * 300_000, "en", "s0", 300_000), (25, "word " * 30_000, "en", None, 150_000), (None, prose(99), "en", "s0", 700)]
    return out + [out[5], out[5], out[20], out[-1]]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("kept"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(7)), (2, None), (None, "river1 stone2"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(20)] + [(3, None, 0), (None, 1, 0), (77, 0, 1), (4, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def test_shards(spark, edge, empty):
    from sluice.llm.sharding import interleaved_shards

    for buckets in (1_000_000, 3):
        got = interleaved_shards(spark, edge, 4, F.col("source"), F.col("doc_id"), rows_per_bucket=buckets)
        assert set(got.columns) == set(edge.columns)
        got = got.select("doc_id", "shard", "slot", "lang", "row").collect()
        sizes = [sum(r.shard == s for r in got) for s in range(4)]
        assert len(got) == len(rows()) and max(sizes) - min(sizes) <= 1 and all(r.row == "kept" for r in got)
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert interleaved_shards(spark, empty, 4, F.col("source"), F.col("doc_id")).count() == 0


def test_every_shard_has_the_mixture(spark):
    from sluice.llm.sharding import interleaved_shards

    rng = random.Random(1)
    data = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"s{rng.randrange(6)}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, source string")
    one = interleaved_shards(spark, df, 10, F.col("source"), F.col("doc_id"))
    counts = one.groupBy("source").pivot("shard").count().na.fill(0).collect()
    for r in counts:
        n = [r[str(s)] for s in range(10)]
        assert max(n) - min(n) <= 2, (r.source, n)
    split = interleaved_shards(spark, df, 10, F.col("source"), F.col("doc_id"), rows_per_bucket=70)
    assert one.exceptAll(split).count() == 0 and split.count() == 3000


def test_mix(spark, edge, empty):
    from sluice.llm.mixing import copied, pareto_mix, word_count

    size = word_count(F.col("text"))
    for buckets in (1_000_000, 3):
        got = pareto_mix(spark, edge, F.col("source"), F.col("doc_id"), size, rows_per_bucket=buckets)
        assert got.count() == len(rows()) and got.filter("copies < 0 or copies > 3").count() == 0
        again = pareto_mix(spark, edge, F.col("source"), F.col("doc_id"), size)
        assert sorted(map(repr, got.select("doc_id", "copies", "size").collect())) == \
            sorted(map(repr, again.select("doc_id", "copies", "size").collect()))
    assert copied(got, ["doc_id", "text"]).count() == got.agg(F.sum("copies")).first()[0]
    assert pareto_mix(spark, empty, F.col("source"), F.col("doc_id"), size).count() == 0


def test_mix_meets_targets(spark):
    from sluice.llm.mixing import pareto_mix

    rng = random.Random(2)
    data = [(i, rng.choice([None, "a", "a", "a", "b", "c", "d"]), rng.randint(0, 400), rng.random() + 0.5) for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, source string, words long, weight double")
    for weight in (None, F.col("weight")):
        got = pareto_mix(spark, df, F.col("source"), F.col("doc_id"), F.col("words"), weight=weight)
        for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"),
                                           F.max("source_size").alias("size")).collect():
            assert r.target <= 3 * r["size"] + 1e-6
            assert abs(r.taken - r.target) <= (400 if weight is None else 0.02 * r.target + 400)
    # heavier documents are taken more often
    heavy = got.filter("target < source_size").groupBy(F.col("weight") > 1).agg(F.avg("copies")).collect()
    assert dict(map(tuple, heavy))[True] > 1.2 * dict(map(tuple, heavy))[False]


def test_water_filling(spark):
    from sluice.llm.mixing import source_targets

    sizes = {"a": 10, "b": 500, "c": 20, "d": 0, "e": 3000, None: 5}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "s string, size long")
    weights = {k: (1, 2, 3)[n % 3] for n, k in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        share = {k: left * weights[k] / sum(weights[j] for j in sizes if j not in full) for k in sizes if k not in full}
        over = {k for k in share if share[k] > 3 * sizes[k]}
        if not over:
            break
        full |= over
    want = {k: 3 * sizes[k] if k in full else share[k] for k in sizes}
    got = {r.s: r.target for r in source_targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_contamination(spark, edge, empty, bench):
    from sluice.llm.decontaminate import benchmark_matches, decontaminated

    got = benchmark_matches(spark, edge, bench).select("doc_id", "text", "n_words", "n_hit", "items", "row").collect()
    want = brute.contamination([(k, r[1]) for k, r in enumerate(rows())], [(1, prose(7)), ("", "river1 stone2")])
    assert sorted((r.text or "", r.n_words, r.n_hit, r["items"]) for r in got) == \
        sorted((rows()[k][1] or "", *v) for k, v in want.items())
    kept = decontaminated(spark, edge, bench)
    assert kept.columns == edge.columns and {7} - {r.doc_id for r in kept.select("doc_id").collect()} == {7}
    assert benchmark_matches(spark, empty, bench).count() == 0
    assert benchmark_matches(spark, edge, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_rules(spark, edge, empty):
    from sluice.llm.rules import judged, with_counts

    got = judged(spark, with_counts(edge).cache())
    assert got.count() == len(rows())
    for r in got.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect():
        assert tuple(r)[1:] == brute.rule_counts(r.text)
    assert judged(spark, with_counts(empty)).count() == 0


def test_token_counts(spark, edge, empty):
    import public_tokenizers

    from sluice.llm.token_counts import with_token_counts

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = with_token_counts(edge, model, chunk=1000, overlap=16).select("text", "n_bytes", "n_tokens", "row").collect()
    whole = with_token_counts(edge, model, chunk=1 << 30).select("text", "n_bytes", "n_tokens", "row").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, whole)) and len(got) == len(rows())
    assert with_token_counts(empty, model).count() == 0


def test_token_files(spark, edge, empty, tmp_path):
    import public_tokenizers

    from sluice.llm.token_files import ids, read_token_files, write_token_files
    from sluice.llm.tokenizers_cached import UnitEncoder

    model = public_tokenizers.path("word_bpe_49k.json")
    for name, df, n in (("edge", edge, len(rows())), ("empty", empty, 0)):
        folder = str(tmp_path / name)
        write_token_files(spark, df, folder, lambda: UnitEncoder.of(model).encode, 1, F.col("doc_id"), F.col("text"), docs_per_file=7)
        got = sorted((r.start, r.key, len(r.ids)) for r in read_token_files(spark, folder, ids, "ids array<long>").collect())
        assert len(got) == n and [k for _, k, _ in got] == sorted(k for _, k, _ in got)
        assert [s for s, _, _ in got] == [sum(x[2] for x in got[:i]) for i in range(n)]


def test_jaccard(spark, edge, empty):
    from sluice.llm.jaccard import one_of_each_group, similar_documents

    got = similar_documents(spark, edge).collect()
    assert len(got) == len(rows())
    of = {r.id: (r.n_shingles, r.component_id) for r in got}
    assert of[22][1] == of[3][1] == 3 and of[20] == (0, 20) and of[23] == (0, 23) and of[24] == (1, 24)
    kept = one_of_each_group(spark, edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert ids == [(False, k) for k in [*range(22), *range(23, 26)]] + [(True, None)]
    assert similar_documents(spark, empty).count() == 0 and one_of_each_group(spark, empty).count() == 0


def test_repeats(spark, edge, empty):
    from sluice.llm.suffix_dedup import without_repeats

    got = {(r.id, r.n_bytes): (r.n_removed, r.n_spans) for r in without_repeats(spark, edge, kept=False).collect()}
    n = len(prose(3))
    assert got[3, n] == got[22, n] == (n, 1) and got[20, 0] == got[21, 0] == (0, 0) and got[24, 300_000] == (300_000, 1)
    assert got[0, len(prose(0))] == (0, 0)
    assert without_repeats(spark, edge, kept=False).count() == len(rows())
    assert without_repeats(spark, empty).count() == 0


def test_quality(spark, edge, empty, labels):
    from sluice.llm.quality import acceptable, fit_quality, scored

    models = fit_quality(spark, edge, labels)
    got = scored(spark, edge, models).select("doc_id", "score", "row").collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.row == "kept" for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert scored(spark, empty, models).count() == 0
    assert acceptable(spark, empty, labels).count() == 0
    unlabelled = acceptable(spark, edge, labels.limit(0))
    assert unlabelled.columns == edge.columns and unlabelled.count() == len(rows())


def test_quality_sample_bounds():
    """Only the labelled sample is bounded, and sums by parts are the sums."""
    import inspect

    import numpy as np

    from sluice.llm import quality as q

    options = inspect.signature(q.fit_quality).parameters
    assert options["max_labelled"].default >= 20_000 and "max_unlabelled" not in options
    keys, values = np.arange(1000) * 7 % 13, np.arange(1000.0)
    for step in (1, 64, 5000):
        assert (q._sums(keys, 15, step=step) == np.bincount(keys, minlength=15)).all()
        assert (q._sums(keys, 15, lambda part: values[part], step) == np.bincount(keys, values, 15)).all()


def test_pseudo_labels_come_from_all_documents(spark):
    """The counts of a round against a plain loop over the documents."""
    import numpy as np

    from sluice.llm import quality as q
    from sluice.llm import text as tx

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(3)
    models = [q.Model((rng.standard_normal((1 << q.BITS) + 1) * (rng.random((1 << q.BITS) + 1) < 0.3)).astype(np.float32),
                      rng.standard_normal((1 << q.PAGE_BITS) + 1).astype(np.float32), np.array([1.0, 1.0, 0.0])) for _ in range(2)]
    candidates = np.flatnonzero(rng.random(1 << q.BITS) < 0.2)
    got = q.pseudo_label_counts(spark, docs.repartition(5), models, candidates, "text", ["lang", "source"], sure=0.9)
    total, having = np.zeros((2, 2, 2)), {}
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        words = set(q.content_features(data, at)[1].tolist())
        page = set(q.page_features(data, at, [[r.lang], [r.source]])[0].tolist())
        for k, m in enumerate(models):
            odds = [sum(float(m.content[w]) for w in words) + float(m.content[-1]), sum(float(m.page[w]) for w in page) + float(m.page[-1])]
            for teacher in (0, 1):
                if abs(odds[teacher]) >= np.log(9):
                    label = int(odds[teacher] > 0)
                    total[k, 1 - teacher, label] += 1
                    for f in (words & set(candidates.tolist())) if teacher == 1 else page:
                        having[k, 1 - teacher, label, f] = having.get((k, 1 - teacher, label, f), 0) + 1
    for k in (0, 1):
        for v in (0, 1):
            assert got[k][v].total.tolist() == total[k, v].tolist()
            where = np.argwhere(got[k][v].having)
            named = [(a, b, int(candidates[b]) if v == q.CONTENT else b) for a, b in where.tolist()]
            assert {(k, v, a, name): got[k][v].having[a, b] for a, b, name in named} == {x: n for x, n in having.items() if x[:2] == (k, v)}


def test_pseudo_labels_teach_the_other_view():
    """Words that no labelled row has get their weight from documents which the page view is sure of."""
    import numpy as np

    from sluice.llm import quality as q

    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(float)
    doc = np.arange(400)
    rows = q.Rows(np.repeat(doc, 2), np.column_stack([np.where(y > 0, 1, 2), 3 + rng.integers(0, 2, 400)]).ravel().astype(np.int32), 400)
    alone = q.fit_view(rows, y, 16)
    counts = q.Counts(np.array([5000.0, 5000.0]), np.zeros((2, 16)))
    counts.having[:, 7] = 100, 4000  # seen with label 1 only among pseudo-labelled documents
    counts.having[:, 1], counts.having[:, 2] = (50, 4900), (4900, 50)
    taught = q.fit_view(rows, y, 16, counts)
    assert alone[7] == 0 and taught[7] > 0.5 and taught[1] > 0 > taught[2] and taught[3] == taught[4] == 0
    garbage = q.Counts(np.array([5000.0, 5000.0]), counts.having[::-1])  # labels turned around are not believed
    assert abs(q.fit_view(rows, y, 16, garbage)[7]) < 0.2


def test_quality_on_held_out_labels(spark):
    """Accuracy on labelled documents that the fit has not seen."""
    from sluice.llm.quality import fit_quality, scored

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    models = fit_quality(spark, docs, labels.filter("doc_id % 3 <> 0"))
    got = scored(spark, docs, models).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r for r in got if r.quality == 0]
    rude = [r for r in got if any(w in (r.text or "").lower().split() for w in ("idiot", "stupid", "moron", "scum", "trash"))]
    assert sum(r.score >= 0.5 for r in clean) >= 0.97 * len(clean)
    assert sum(r.score < 0.5 for r in junk) >= 0.9 * len(junk)
    assert sum(r.score < 0.5 for r in rude) >= 0.9 * len(rude)


def test_scores(spark, edge, empty):
    from sluice.llm.context_mixing import text_scores

    got = text_scores(spark, edge, F.col("doc_id") % 3 != 0).collect()
    assert len(got) == len(rows()) and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.id in (20, 21, 23)} == {1}
    assert len({round(r.score, 9) for r in got if r.id == 5}) == 1
    untrained = text_scores(spark, edge, F.lit(False)).collect()
    assert all(r.n_known == 0 and abs(r.base_score) < 1e-6 and r.train_tokens == 0 for r in untrained)
    assert text_scores(spark, empty, F.lit(True)).count() == 0


def test_pipeline(spark, sf):
    """Each stage against what it promises of its own input, and run() against the stages."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.persist_table(spark, stage(spark, docs, sf), f"test-{name}")
        kept[name] = (before, docs)
        if name != "shards":
            assert docs.columns == before.columns
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in kept["near_duplicates"])
    assert {i for i, _ in after} == {i for i, (_, c) in brute.jaccard(before, 5, 8, 10).items() if i == c} and len(after) < len(before)
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in kept["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in after} == {i for i, (n, h, _) in brute.contamination(before, items).items() if not (h and 20 * h >= n)}
    before, after = kept["mixture"]
    for r in before.groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect():
        assert after.filter(F.col("source").eqNullSafe(r.source)).count() > 0
    before, after = kept["shards"]
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert after.count() == before.count() and max(sizes) - min(sizes) <= 1
    final = cp.run(spark, sf)
    assert final.exceptAll(after).count() == 0 and after.exceptAll(final).count() == 0


def test_rows_that_differ_in_nulls_only_stay_apart(spark):
    """Equal ids, equal rows, and rows that differ only in where a null stands: each comes back as
    often as it went in, with a place or a copy count of its own."""
    from sluice.llm.mixing import pareto_mix
    from sluice.llm.sharding import interleaved_shards

    rows = [(None, "x", "a b", None)] * 40 + [(None, "x", None, "a b")] * 30 + [(7, "x", "a b", "n"), (7, "x", "a", "n")] \
        + [(k, "y", f"word {k}", None) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, digest string")
    cut = interleaved_shards(spark, df, 7, F.col("source"), F.col("doc_id"), rows_per_bucket=10).collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)[:4]) for r in cut)
    for shard in range(7):
        slots = sorted(r.slot for r in cut if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 7, len(rows) // 7 + 1)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    for weight in (None, F.col("size") + 0.5):
        mixed = pareto_mix(spark, df.withColumn("size", size), F.col("source"), F.col("doc_id"), F.col("size"),
                           weight=weight, rows_per_bucket=10).collect()
        assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.source, r.text, r.digest)) for r in mixed)
        if weight is None:
            for s in "xy":
                of = [r for r in mixed if r.source == s]
                assert abs(sum(r["size"] * r.copies for r in of) - of[0].target) <= max(r["size"] for r in of)
