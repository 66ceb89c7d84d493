"""Properties of splits and rankings."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators.ranking import hash_rank, range_rank
from sluice.plans.splits import build_splits
from sluice.sources import tables as tb


def test_range_rank_exact_under_skew(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        score = 5.0 if i % 3 == 0 else float(rnd.randint(0, 50))  # one value holds a third of the rows
        rows.append((i % 4, i, score, rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "g int, id long, score double, label int")
    r = range_rank(spark, df, [F.desc("score"), F.asc("id")], group_cols=["g"], running=["label"], num_buckets=16)
    got = {(x["g"], x["id"]): (x["_rank"], x["cum_label"]) for x in r.collect()}
    for g in range(4):
        part = sorted([x for x in rows if x[0] == g], key=lambda x: (-x[2], x[1]))
        cum = 0
        for k, x in enumerate(part, start=1):
            cum += x[3]
            assert got[(g, x[1])] == (k, float(cum))


def test_hash_rank_equals_full_sort(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    r = hash_rank(df, "k", tiebreak=["id"])
    got = [x["id"] for x in r.orderBy("_rank").collect()]
    want = [x["id"] for x in df.orderBy("k", "id").collect()]
    assert got == want


def test_splits_exact_disjoint_and_leak_free(spark, sf):
    f = tb.functions(spark, sf)
    s = build_splits(f, seeds=(10000, 20000)).cache()
    for seed in (10000, 20000):
        part = s.filter(F.col("seed") == seed)
        base = part.filter(F.col("split").isin("train", "val", "test"))
        hashes = [r["hash_code"] for r in base.collect()]
        assert len(hashes) == len(set(hashes))  # disjoint on content hash
        latent = f.filter((F.col("label") == 1) & (F.col("latent") == 1) & (F.col("method") == "v"))
        lat_h = {r[0] for r in latent.select(F.sha2("code", 256)).collect()}
        held = {r["hash_code"] for r in part.filter(F.col("split").isin("val", "test")).collect()}
        assert not (held & lat_h)
    n_train = s.filter((F.col("seed") == 10000) & (F.col("split") == "train")).count()
    assert n_train == 108  # floor(0.8 * 135)


def test_partition_count_invariance(spark, sf):
    f = tb.functions(spark, sf)
    a = sorted(map(tuple, build_splits(f, seeds=(10000,)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, build_splits(tb.functions(spark, sf), seeds=(10000,)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_recall_curve_monotone_and_complete(spark, sf):
    import __spark_entry__ as entry

    curve = sorted((r["p"], r["recall"]) for r in entry.queries()["recall_at_topk_lines"](spark, sf).collect())
    recalls = [r for _, r in curve]
    assert recalls == sorted(recalls)
    assert recalls[-1] == 1.0


def test_strict_purge_keeps_latest_latent_out_of_held_out(spark, sf):
    from sluice.catalog.curation import latest_latent

    f = tb.functions(spark, sf)
    s = build_splits(f, seeds=(10000,), latent_source=latest_latent(f), strict_purge=True)
    held = {r[0] for r in s.filter(F.col("split").isin("val", "test")).select("hash_code").collect()}
    aug = {r[0] for r in s.filter((F.col("split") == "train_latent") & (F.col("latent") == 1))
           .select("hash_code").collect()}
    assert aug and not (aug & held)
    # default parity: held-out sets are those of the plain split builder
    plain = build_splits(f, seeds=(10000,))
    assert sorted(map(tuple, s.filter(F.col("split").isin("val", "test")).collect())) == \
        sorted(map(tuple, plain.filter(F.col("split").isin("val", "test")).collect()))


def test_recall_at_full_loc_is_ranked_flaw_share(spark, sf):
    from sluice.catalog.effort import _line_stats, _parts
    from sluice.operators import effort as ef

    n_lines, n_flaws = _line_stats(spark, sf)
    parts = _parts(spark, sf)
    got = ef.recall_at_loc(spark, parts, n_lines, n_flaws, top_k=1.0).first()["recall"]
    ranked_flaws = parts.agg(F.sum("label")).first()[0]
    assert got == ranked_flaws / n_flaws


def test_experiment_resumes_from_written_cells(spark, sf, monkeypatch):
    from sluice.operators import models as mo
    from sluice.plans.experiment import run_experiment
    from sluice.session import scratch_path

    f = tb.functions(spark, sf)
    out = scratch_path(spark, "exp_resume")
    settings = dict(repeats=1, configs=[("regular", "train")], grid=((0.1, True),), methods=("attention", "saliency"), out_path=out)
    long1, wide1 = run_experiment(spark, f, **settings)
    first = sorted(map(tuple, wide1.collect()))
    assert len(first) == 2

    def fits_nothing(*a, **k):
        raise AssertionError("a finished cell was fitted again")
    monkeypatch.setattr(mo, "fit_function_classifier", fits_nothing)
    long2, wide2 = run_experiment(spark, f, **settings)
    assert sorted(map(tuple, wide2.collect())) == first
    # the long table has exactly the metrics that the wide one does not fill with -1
    assert long2.count() == long1.count() == sum(v != -1.0 for row in first for v in row[3:])


def _cuts_by_sorting(rows, totals):
    """Effort and recall cut-offs of rows (part, score, func_id, line_idx, label) from a full sort."""
    order = sorted(rows, key=lambda r: (r[0] == "neg", r[1] if r[0] == "neg" else -r[1], r[2], r[3]))
    n_lines, n_flaws = totals
    target, caught, inspected = int(n_flaws * 0.2), 0, len(order)
    for rank, r in enumerate(order, 1):
        caught += r[4]
        if caught == target:
            inspected = rank
            break
    return inspected, sum(r[4] for r in order[:int(n_lines * 0.01)])


def test_cut_offs_without_ordering_equal_a_full_sort(spark):
    from sluice.operators import effort as ef

    rng = random.Random(11)
    for trial, scores in enumerate([[1.0], [0.0, 1.0, 2.0], [rng.uniform(-5, 5) for _ in range(400)], [1e-300, 1e300, -1e300, 5.0]]):
        rows = [(g, rng.choice(["pos", "neg"]), rng.choice(scores) if i % 3 else scores[0], rng.randrange(40), i, int(rng.random() < 0.2))
                for g in (0, 1, 2) for i in range(1500)]
        df = spark.createDataFrame(rows, "g int, part string, score double, func_id long, line_idx int, label int")
        totals = {(0,): (1500, 290), (1,): (40_000, 3), (2,): (90, 9_000)}
        for limits in ({"small": 40, "bins": 4}, {"small": 1, "bins": 7}, {}):
            got = ef.line_cuts(spark, df, totals, group_cols=["g"], **limits)
            for (g,), total in totals.items():
                want = _cuts_by_sorting([r[1:] for r in rows if r[0] == g], total)
                assert (got[g,]["inspected"], got[g,]["caught"]) == want, (trial, g, limits)
    assert ef.line_cuts(spark, df.limit(0), {(): (10, 2)}) == {(): {"flaw_target": 0, "row_target": 0, "inspected": 0, "caught": 0}}


def test_ranks_in_the_row_equal_a_window(spark, sf):
    from sluice.operators import effort as ef

    rng = random.Random(6)
    rows = [(i, [(float(rng.randrange(4)), rng.randrange(2)) for _ in range(rng.randrange(30))]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "func_id long, lines array<struct<score:double,label:int>>")
    got = {(r.func_id, r.line_idx): (r["rank"], r.score, r.label) for r in ef.rank_in_function(df).collect()}
    assert len(got) == sum(len(ls or []) for _, ls in rows)
    for i, ls in rows:
        for rank, j in enumerate(sorted(range(len(ls or [])), key=lambda j: (-ls[j][0], j))):
            assert got[i, j] == (rank, *ls[j])
    top = ef.topk_slice(df, 3).collect()
    assert {(r.func_id, r.line_idx) for r in top} == {k for k, v in got.items() if v[0] < 3}


def test_line_labels_grow_linearly(spark):
    import time

    from sluice.functions import tokens as tk

    def lines(n):
        toks = [t for i in range(n) for t in ((f"w{i}", 1.0), (tk.NEWLINE_MARK, 1.0))]
        flaws = [f"w{i}" for i in range(0, n, 3)]
        df = spark.createDataFrame([(toks, flaws)], "tokens array<struct<tok:string,v:double>>, f array<string>")
        start = time.time()
        out = df.select(tk.segment_line_scores("tokens", "f").alias("l")).first()["l"]
        assert [r["label"] for r in out] == [int(i % 3 == 0) for i in range(n)]
        return time.time() - start

    lines(1000)
    small, large = lines(10_000), lines(100_000)
    assert large < 30 * max(small, 0.5)


def test_write_splits_replaces_only_rewritten_seeds(spark, sf):
    from sluice.session import scratch_path
    from sluice.sources.sinks import write_splits

    f = tb.functions(spark, sf)
    path = scratch_path(spark, "splits_overwrite")
    write_splits(build_splits(f, seeds=(10000, 20000)), path)
    before = spark.read.parquet(path).groupBy("seed", "split").count().collect()
    # rewrite only the (10000, train) partition with its label-1 rows: every other
    # (seed, split) partition must be untouched
    new_train = build_splits(f, seeds=(10000,)).filter((F.col("split") == "train") & (F.col("label") == 1))
    write_splits(new_train, path)
    after = {(r["seed"], r["split"]): r["count"] for r in spark.read.parquet(path).groupBy("seed", "split").count().collect()}
    for r in before:
        key = (r["seed"], r["split"])
        assert after[key] == (new_train.count() if key == (10000, "train") else r["count"])


def test_ranks_do_not_depend_on_bucket_count(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id",
                                  (F.col("id") % 7).cast("double").alias("score"))
    a = {r["id"]: r["_rank"] for r in hash_rank(df, "k", tiebreak=["id"], hex_digits=3).collect()}
    b = {r["id"]: r["_rank"] for r in hash_rank(df, "k", tiebreak=["id"], hex_digits=4).collect()}
    assert a == b
    c = {r["id"]: r["_rank"] for r in range_rank(spark, df, [F.desc("score"), F.asc("id")], num_buckets=3).collect()}
    d = {r["id"]: r["_rank"] for r in range_rank(spark, df, [F.desc("score"), F.asc("id")], num_buckets=29).collect()}
    assert c == d


def test_grouped_line_evaluation_equals_per_group_runs(spark, sf):
    from sluice.catalog.evaluation import _results
    from sluice.plans.evaluate import evaluate_lines

    res = _results(spark, sf)
    lines = tb.line_score_arrays(spark, sf)
    # group 2: other line scores and other predictions
    res2 = res.withColumn("logits", 1.0 - F.col("logits")).withColumn("y_preds", 1 - F.col("y_preds"))
    lines2 = lines.withColumn("lines", F.transform("lines", lambda e: F.struct(((e["score"] * 7) % 1000).alias("score"), e["label"])))
    per_group = {}
    for g, (r, ln) in {1: (res, lines), 2: (res2, lines2)}.items():
        per_group.update({(g, m["metric"]): m["value"] for m in evaluate_lines(spark, r, ln, name=f"pg{g}").collect()})
    both_r = res.withColumn("g", F.lit(1)).unionByName(res2.withColumn("g", F.lit(2)))
    both_l = lines.withColumn("g", F.lit(1)).unionByName(lines2.withColumn("g", F.lit(2)))
    grouped = {(m["g"], m["metric"]): m["value"]
               for m in evaluate_lines(spark, both_r, both_l, name="grp", group_cols=["g"]).collect()}
    assert grouped == per_group


def test_hash_rank_keeps_null_keys_and_groups(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 10 == 0 else f"{rng.getrandbits(64):016x}", None if i % 3 == 0 else "g") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, g string")
    want = {}
    for g in (None, "g"):
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1] is None, r[1] or "", r[0]))
        want |= {r[0]: n for n, r in enumerate(mine, 1)}
    for digits in (1, 3, 8, 15):
        got = hash_rank(df, "k", group_cols=["g"], tiebreak=["id"], hex_digits=digits).collect()
        assert {r.id: r._rank for r in got} == want


def test_range_rank_with_null_groups_and_wide_payload(spark):
    big = 1152921504606846979
    rows = [(i, i % 7, None if i % 2 else "g", None if i % 5 == 0 else big + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, score long, g string, payload long")
    got = range_rank(spark, df, [F.col("score").desc(), F.col("id")], group_cols=["g"], running=["score"], num_buckets=8,
                     totals=True).collect()
    assert len(got) == len(rows)
    for g in (None, "g"):
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        total, of = 0, {r.id: r for r in got if r.g == g}
        for n, r in enumerate(mine, 1):
            total += r[1]
            assert (of[r[0]]._rank, of[r[0]].cum_score, of[r[0]].payload) == (n, total, r[3])
            assert of[r[0]]._group_n == len(mine)


def test_report_round_is_pythons(spark):
    from sluice.functions.code import report_round

    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 2.5, 3.5, -2.675, -0.125, 1.005, 0.0, 1e300, 0.1 + 0.2]
    values += [rng.uniform(-100, 100) for _ in range(500)] + [rng.randrange(-10 ** 6, 10 ** 6) / 2000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4, 9):
        got = df.select("x", report_round("x", digits).alias("r")).collect()
        assert all(r.r == round(r.x, digits) for r in got), digits


def test_blocks_hold_every_token(spark):
    from sluice.functions import tokens as tk

    rows = [(0, ""), (1, "a b\n" * 700), (2, " ".join(f"w{i}" for i in range(1020))), (3, "x")]
    df = spark.createDataFrame(rows, "func_id long, code string")
    whole = {r.func_id: r.t for r in df.select("func_id", tk.tokenize("code").alias("t")).collect()}
    blocks = sorted(tk.token_blocks(df).collect(), key=lambda r: (r.func_id, r.block_idx))
    assert all(len(r.tokens) == 512 and r.tokens[0] == "<s>" for r in blocks)
    for i, t in whole.items():
        body = [x for r in blocks if r.func_id == i for x in r.tokens if x not in ("<s>", "</s>", "<pad>")]
        assert body == t
        assert [r.block_idx for r in blocks if r.func_id == i] == list(range(max(1, -(-len(t) // 510))))


def test_attention_is_summed_in_the_row(spark, tmp_path):
    """A18 equals the long table of weights, also for a func_id that occurs twice, and shuffles a byte a token."""
    from sluice.catalog import lines as ln

    rows = [(1, "int a;\n b = a"), (2, "x"), (2, "yy zz x"), (3, ""), (4, None), (5, "wort " * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, ln.attention_received(spark, str(tmp_path)).collect()))
    long = ln.attention_table(spark, str(tmp_path)).groupBy("func_id", "k").agg(F.sum("w").cast("long").alias("score"))
    assert got == sorted(map(tuple, long.collect())) and len(got) == 7 + 3 + 500
    plan = ln.attention_received(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "tinyint" in plan and "Generate posexplode(got" in plan


@pytest.mark.parametrize("how", ["centroid", "predict"])
def test_denoised_experiment_fits_twice(spark, sf, how):
    """M5 and M6 between the split builder and the final fit of a cell; an unknown way is refused before any work."""
    from sluice.plans.experiment import run_experiment

    f = tb.functions(spark, sf)
    _, wide = run_experiment(spark, f, repeats=1, configs=[("latent_v", "train_latent")], grid=((0.1, True), (0.01, False)), denoise=how)
    rows = wide.collect()
    assert [(r.config, r.repeat, r.method) for r in rows] == [("latent_v", 1, "attention")] and rows[0].recall >= 0
    with pytest.raises(ValueError):
        run_experiment(spark, f, denoise="other")
