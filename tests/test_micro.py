"""Hand-made micro cases (FIXTURES.md section 6) and null traps."""

from pyspark.sql import functions as F

from sluice.functions import tokens as tk
from sluice.functions.code import cosine_distance, count_flaw_lines, derive_seed, split_flaw_lines
from sluice.operators import curate as cu
from sluice.operators import effort as ef


def test_fold_micro_case(spark):
    toks = [("<s>", 0.0), ("int", 1.0), ("a;", 2.0), ("Ċ", .5), ("Ċ", .25), ("x=", 1.5), ("1", -1.5), ("Ċ", .1),
            ("y", 2.0), ("Ċ", 1.0), ("z", 3.0), ("</s>", 0.0)]
    df = spark.createDataFrame([(toks, ["x=1y", "z"])], "tokens array<struct<tok:string,v:double>>, f array<string>")
    out = df.select(tk.segment_line_scores("tokens", "f").alias("l")).first()["l"]
    assert [(r["score"], r["label"]) for r in out] == [(3.5, 0), (3.0, 1), (3.0, 1)]


def test_split_flaw_lines_char_trim(spark):
    df = spark.createDataFrame([("/~/a b/~/c/",), (None,)], "s string")
    got = [r[0] for r in df.select(split_flaw_lines("s")).collect()]
    assert got == [["a b", "c"], []]


def test_count_flaw_lines_empty_counts_one(spark):
    df = spark.createDataFrame([("",), (None,), ("1,4,9",)], "s string")
    assert [r[0] for r in df.select(count_flaw_lines("s")).collect()] == [1, 0, 3]


def test_derive_seed_matches_big_integer(spark):
    words = ["regular_corpus_default", "latent_v_corpus_default", "x"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r[0] for r in df.select(derive_seed("s")).collect()]
    assert got == [int("".join(str(ord(c)) for c in w)) % 123456 for w in words]


def test_zero_special_values(spark):
    df = spark.createDataFrame([([2.0, 1.0, 3.0, 4.0, 0.0, 0.0],)], "v array<double>")
    df = df.withColumn("last", tk.last_special_index("v"))
    assert df.select(tk.zero_special_values("v", "last")).first()[0] == [0.0, 1.0, 3.0, 0.0, 0.0, 0.0]


def test_verify_stops_at_first_missing(spark):
    df = spark.createDataFrame([(["ab", "zz", "cd"], "xxabyycd")], "enc array<string>, t string")
    assert df.select(tk.verify_flaw_lines("enc", "t")).first()[0] == ["ab"]


def _ranked(spark, labels):
    """Lines of predicted-positive functions, ranked in the given order."""
    rows = [("pos", -float(i), 1, i, lab) for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "part string, score double, func_id long, line_idx int, label int")


def test_effort_target_zero_edge_cases(spark):
    # target 0 with a flaw on top never matches: every row is inspected
    assert ef.effort_at_recall(spark, _ranked(spark, [1, 0, 0]), 10, 2).first()["inspected"] == 3
    # target 0 with a clean line on top stops at once
    assert ef.effort_at_recall(spark, _ranked(spark, [0, 1, 0]), 10, 2).first()["inspected"] == 1


def test_null_latent_is_non_latent(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 0)], "func_id long, latent int")
    non_latent, latent = cu.split_latent(df)
    assert sorted(r[0] for r in non_latent.select("func_id").collect()) == [1, 3]
    assert [r[0] for r in latent.select("func_id").collect()] == [2]


def test_link_is_null_safe(spark):
    lat = spark.createDataFrame([(10, None), (11, 5)], "func_id long, vfc long")
    train = spark.createDataFrame([(None,), (5,)], "vfc long")
    got = sorted(r[0] for r in cu.link_latent(lat, train).select("func_id").collect())
    assert got == [10, 11]


def test_zero_vector_distance_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "u array<double>, c array<double>")
    assert df.select(cosine_distance("u", "c")).first()[0] is None


def test_metric_log_stream_matches_batch(spark, sf, tmp_path):
    from sluice.sources.logs import ingest_metric_logs, metric_log_lines
    from sluice.sources.tables import read_table
    from sluice.streaming.metric_logs import start_metric_log_ingest

    logs = str(tmp_path / "logs")
    metric_log_lines(read_table(spark, sf, "labels")).write.text(logs)
    q = start_metric_log_ingest(spark, logs, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("metric", "value").collect()))
    want = sorted(map(tuple, ingest_metric_logs(spark.read.text(logs)).select("metric", "value").collect()))
    assert got == want and got


def _prob_ranked(spark, rows):
    df = spark.createDataFrame(rows, "func_id long, logits double, y_preds int, num_lines int, num_flaw_lines int")
    return ef.rank_functions_by_prob(spark, df, name="micro_prob")


def test_effort_by_prob_target_zero_stops_after_first_function(spark):
    ranked = _prob_ranked(spark, [(1, 0.9, 1, 7, 0), (2, 0.8, 1, 5, 3), (3, 0.1, 0, 4, 1)])
    # floor(0.2 * 4) = 0 flaw lines: the first function (7 lines) is inspected, then the walk stops
    assert ef.effort_at_recall_by_prob(ranked, 16, 4).first()["inspected"] == 7


def test_effort_by_prob_counts_only_predicted_positive_flaws(spark):
    ranked = _prob_ranked(spark, [(1, 0.9, 1, 7, 0), (2, 0.8, 0, 5, 9), (3, 0.7, 1, 4, 2)])
    # target floor(0.2 * 11) = 2: function 2's flaws do not count (predicted negative)
    assert ef.effort_at_recall_by_prob(ranked, 16, 11).first()["inspected"] == 16


def test_recall_by_prob_excludes_the_crossing_function(spark):
    ranked = _prob_ranked(spark, [(1, 0.9, 1, 2, 1), (2, 0.8, 1, 2, 1), (3, 0.7, 1, 5, 1)])
    # budget floor(0.2 * 20) = 4 lines: functions 1 and 2 fit (2 + 2), function 3 crosses it
    row = ef.recall_at_loc_by_prob(ranked, 20, 3).first()
    assert (row["target"], row["caught"]) == (4, 2)


def test_linear_line_fold_equals_token_fold(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        toks = []
        for _ in range(rnd.randint(0, 40)):
            if rnd.random() < 0.3:
                toks.append((rnd.choice(tk.LINE_SEPARATORS), rnd.choice([0.0, 0.5, -0.5, 1.0])))
            else:
                toks.append((rnd.choice(["a", "b", "x=", "1", "y"]), rnd.choice([0.0, 1.5, -1.5, 2.0, 0.25])))
        flaws = [rnd.choice(["a", "ab", "x=1", "y", "b"]) for _ in range(rnd.randint(0, 3))]
        rows.append((toks, flaws))
    df = spark.createDataFrame(rows, "tokens array<struct<tok:string,v:double>>, f array<string>")
    out = df.select(tk.segment_line_scores_fold("tokens", "f").alias("a"),
                    tk.segment_line_scores("tokens", "f").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out)
