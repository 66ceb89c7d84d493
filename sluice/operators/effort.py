"""Ranking-based effort metrics over line and function rankings (W3-W8, W10, U3, A5,
A7-A14, A17).

A function's lines travel as one array per function (``lines``: array<struct<score, label>>, in line
order; bounded by the function's own text), so its ranks are positions in its sorted
array and need no shuffle. Rankings over all lines use ``range_rank`` (exact ranks and running sums without
a single-task window) where the ranks themselves are the result; the metrics that only ask where the
ranking reaches a target use ``cutoff`` and order nothing but that neighbourhood. The driver only
sees scalar totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.code import count_code_lines, count_flaw_lines, has_text
from sluice.operators.cutoff import rows_at
from sluice.operators.ranking import range_rank

# Metric parameters (defaults of the reference command line).
EFFORT_AT_TOP_K = 0.2
TOP_K_RECALL_BY_LINES = 0.01
TOP_K_RECALL_BY_PRED_PROB = 0.2
TOP_K_CONSTANT = 10
TOP_K_LOCS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def result_frame(scored: DataFrame, group_cols=()) -> DataFrame:
    """F8: the per-function result frame keyed by ``func_id``: prediction, truth, line and
    flaw-line counts (C2, C3), flaw text."""
    return scored.select(*group_cols, "func_id", F.col("prob").alias("logits"), F.col("label").alias("y_trues"),
                         F.col("y_pred").alias("y_preds"),
                         count_flaw_lines("flaw_line_index").alias("num_flaw_lines"),
                         count_code_lines("code").alias("num_lines"), "flaw_line", "flaw_line_index")


def line_statistics(results: DataFrame, group_cols=()) -> DataFrame:
    """A5: total non-blank lines and total flaw lines over the whole test set (per group)."""
    return results.groupBy(*group_cols).agg(
        F.coalesce(F.sum("num_lines"), F.lit(0)).cast("long").alias("sum_lines"),
        F.coalesce(F.sum("num_flaw_lines"), F.lit(0)).cast("long").alias("sum_flaw_lines"))


def ranked_in_row(lines="lines") -> Column:
    """W3 inside the row: a function's lines by score descending, ties by ascending line index, as
    array<struct<key, line_idx, label>>; a line's rank is its 0-based position."""
    keyed = F.transform(F.col(lines) if isinstance(lines, str) else lines, lambda e, i: F.struct(
        (-e["score"]).alias("key"), i.alias("line_idx"), e["label"].alias("label"), e["score"].alias("score")))
    return F.array_sort(keyed)


def rank_in_function(lines: DataFrame, group_cols=()) -> DataFrame:
    """(group..., func_id, rank, line_idx, score, label), one row a line."""
    ranked = lines.select(*group_cols, "func_id", F.posexplode(ranked_in_row()).alias("rank", "_l"))
    return ranked.select(*group_cols, "func_id", "rank", *[F.col(f"_l.{c}").alias(c) for c in ("line_idx", "score", "label")])


def topk_slice(lines: DataFrame, k: int, group_cols=()) -> DataFrame:
    """The first ``k`` lines of each function's ranking, cut in the row."""
    first = lines.select(*group_cols, "func_id", F.posexplode(F.slice(ranked_in_row(), 1, k)).alias("rank", "_l"))
    return first.select(*group_cols, "func_id", "rank", *[F.col(f"_l.{c}").alias(c) for c in ("line_idx", "score", "label")])


def exploded(lines: DataFrame, group_cols=()) -> DataFrame:
    """(group..., func_id, line_idx, score, label), one row a line."""
    each = lines.select(*group_cols, "func_id", F.posexplode("lines").alias("line_idx", "_l"))
    return each.select(*group_cols, "func_id", "line_idx", F.col("_l.score").alias("score"), F.col("_l.label").alias("label"))


def ranked_line_parts(results: DataFrame, lines: DataFrame, threshold: float = 0.5, group_cols=()) -> DataFrame:
    """F4 + F5: lines of functions with flaw text, tagged 'pos' when the function's
    probability exceeds the threshold, else 'neg'; functions are joined, then their lines exploded."""
    k = [*group_cols, "func_id"]
    funcs = results.filter(has_text("flaw_line")).select(
        *k, F.when(F.col("logits") > F.lit(float(threshold)), "pos").otherwise("neg").alias("part"))
    return exploded(lines.join(funcs, k, "inner"), [*group_cols, "part"])


def line_order_key(neg_ascending=True) -> Column:
    """The key of W4's order inside a part: pos by score descending; neg ascending for attention
    scores, else descending. ``neg_ascending`` may be a column."""
    ascending = neg_ascending if isinstance(neg_ascending, Column) else F.lit(bool(neg_ascending))
    return F.when((F.col("part") == "neg") & ascending, F.col("score")).otherwise(-F.col("score"))


def rank_lines_global(spark: SparkSession, parts: DataFrame, neg_ascending: bool = True,
                      name: str = "line_ranks", rows: int | None = None, group_cols=()) -> DataFrame:
    """W4 + U3: ``part_rank`` (1-based) inside each part -- pos by score descending; neg
    ascending for attention scores, else descending; ties by (func_id, line_idx) -- and
    ``rank`` in the concatenation pos || neg, with the running flaw count ``cum_label``
    (per group of ``group_cols``)."""
    g = list(group_cols)
    keyed = parts.withColumn("_key", line_order_key(neg_ascending))
    r = range_rank(spark, keyed, [F.col("_key"), F.col("func_id"), F.col("line_idx")], group_cols=[*g, "part"],
                   running=["label"], name=name, rows=rows)
    # The neg part follows the pos part; offsets are the pos totals of each group
    # (one row per group: bounded by the number of groups)
    pos = r.filter(F.col("part") == "pos").groupBy(*g).agg(F.count(F.lit(1)).alias("_pn"),
                                                            F.sum("label").cast("double").alias("_pf"))
    r = r.join(F.broadcast(pos), g, "left") if g else r.crossJoin(F.broadcast(pos))
    is_neg = F.col("part") == "neg"
    return r.select(
        *[c for c in parts.columns], F.col("_rank").alias("part_rank"),
        (F.col("_rank") + F.when(is_neg, F.coalesce(F.col("_pn"), F.lit(0))).otherwise(F.lit(0))).alias("rank"),
        (F.col("cum_label") + F.when(is_neg, F.coalesce(F.col("_pf"), F.lit(0.0))).otherwise(F.lit(0.0)))
        .alias("cum_label"))


CUT_KEYS = ["_part", "_key", "func_id", "line_idx"]


def line_cuts(spark: SparkSession, parts: DataFrame, totals: dict[tuple, tuple[int, int]], neg_ascending=True, group_cols=(),
              effort_top_k: float = EFFORT_AT_TOP_K, recall_top_k: float = TOP_K_RECALL_BY_LINES, **limits) -> dict[tuple, dict]:
    """W5 and W6 for every group of ``totals`` (group -> total lines, total flaw lines): where pos || neg reaches
    floor(effort_top_k * flaws) flaw lines and floor(recall_top_k * lines) rows.

    * ``inspected``: rows up to the flaw target; all rows when the count is never met exactly (target 0 with a flaw on
      top, or too few flaws among the ranked lines);
    * ``caught``: flaw lines among the first rows of the other target.
    ``parts`` (a stored table) is passed over a few times; only the rows around the two places are ordered."""
    g = list(group_cols)
    keyed = parts.select(*g, F.when(F.col("part") == "pos", 0).otherwise(1).alias("_part"), line_order_key(neg_ascending).alias("_key"),
                         "func_id", "line_idx", "label")
    ranked = {tuple(r[c] for c in g): (r["n"], r["f"]) for r in keyed.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("f")).collect()}
    asks, out = [], {}
    for group, (lines, flaws) in totals.items():
        rows, found = ranked.get(group, (0, 0))
        flaw_target, row_target = int(flaws * effort_top_k), int(lines * recall_top_k)
        out[group] = {"flaw_target": flaw_target, "row_target": row_target, "inspected": rows, "caught": found if row_target >= rows else 0}
        # a target of no flaws is met by the first row unless that is a flaw
        asks.append((group, "flaws", flaw_target) if flaw_target else (group, "rows", 1))
        if 1 <= row_target < rows:
            asks.append((group, "rows", row_target))
    found = rows_at(spark, keyed, CUT_KEYS, "label", list(dict.fromkeys(asks)), g, **limits)
    for group, cut in out.items():
        if cut["flaw_target"]:
            cut["inspected"] = found.get((group, "flaws", cut["flaw_target"]), (cut["inspected"],))[0]
        elif found.get((group, "rows", 1), (0, 0, 1))[2] == 0:
            cut["inspected"] = 1
        if (group, "rows", cut["row_target"]) in found:
            cut["caught"] = found[group, "rows", cut["row_target"]][1]
    return out


def _cut_row(spark: SparkSession, target: int, name: str, value: int, share: str, total: int) -> DataFrame:
    """One row: target, the count, and its share of a total (null for a total of 0)."""
    return spark.createDataFrame([(target, value, value / total if total else None)], f"target long, {name} long, {share} double")


def effort_at_recall(spark: SparkSession, parts: DataFrame, sum_lines: int, sum_flaw_lines: int, top_k: float = EFFORT_AT_TOP_K,
                     neg_ascending=True) -> DataFrame:
    """Inspect pos || neg until exactly floor(top_k * flaws) flaw lines are caught (all
    rows when that count is never met exactly); effort = inspected / total lines."""
    cut = line_cuts(spark, parts, {(): (sum_lines, sum_flaw_lines)}, neg_ascending, effort_top_k=top_k)[()]
    return _cut_row(spark, cut["flaw_target"], "inspected", cut["inspected"], "effort", sum_lines)


def recall_at_loc(spark: SparkSession, parts: DataFrame, sum_lines: int, sum_flaw_lines: int, top_k: float = TOP_K_RECALL_BY_LINES,
                  neg_ascending=True) -> DataFrame:
    """Flaw lines among the first floor(top_k * lines) rows of pos || neg over all flaw lines."""
    cut = line_cuts(spark, parts, {(): (sum_lines, sum_flaw_lines)}, neg_ascending, recall_top_k=top_k)[()]
    return _cut_row(spark, cut["row_target"], "caught", cut["caught"], "recall", sum_flaw_lines)


def rank_functions_by_prob(spark: SparkSession, results: DataFrame, name: str = "prob_ranks") -> DataFrame:
    """Functions by probability descending (ties by func_id) with running line counts and
    running flaw counts of predicted-positive functions."""
    keyed = results.select("func_id", "logits", "y_preds", "num_lines",
                           (F.col("num_flaw_lines") * F.col("y_preds")).alias("pred_flaws"))
    return range_rank(spark, keyed, [F.desc("logits"), F.asc("func_id")], running=["num_lines", "pred_flaws"],
                      name=name)


def effort_at_recall_by_prob(ranked: DataFrame, sum_lines: int, sum_flaw_lines: int,
                             top_k: float = EFFORT_AT_TOP_K) -> DataFrame:
    """Lines inspected (whole functions, by probability) until the predicted-positive
    flaw count reaches floor(top_k * flaws); effort = inspected / total lines."""
    target = int(sum_flaw_lines * top_k)
    agg = ranked.agg(F.min(F.when(F.col("cum_pred_flaws") >= target, F.col("cum_num_lines"))).alias("_hit"),
                     F.coalesce(F.sum("num_lines"), F.lit(0)).alias("_all"))
    inspected = F.coalesce(F.col("_hit"), F.col("_all").cast("double"))
    return agg.select(F.lit(target).cast("long").alias("target"), inspected.cast("long").alias("inspected"),
                      F.try_divide(inspected, F.lit(float(sum_lines))).alias("effort"))


def recall_at_loc_by_prob(ranked: DataFrame, sum_lines: int, sum_flaw_lines: int,
                          top_k: float = TOP_K_RECALL_BY_PRED_PROB) -> DataFrame:
    """Predicted-positive flaw lines of the functions whose cumulative line count stays
    within floor(top_k * lines), over all flaw lines."""
    target = int(sum_lines * top_k)
    caught = F.coalesce(F.sum(F.when(F.col("cum_num_lines") <= target, F.col("pred_flaws")).otherwise(0)), F.lit(0))
    return ranked.agg(caught.cast("long").alias("caught")).select(
        F.lit(target).cast("long").alias("target"), "caught",
        F.try_divide(F.col("caught").cast("double"), F.lit(float(sum_flaw_lines))).alias("recall"))


def predicted_vulnerable_totals(ranked: DataFrame) -> DataFrame:
    """Functions predicted vulnerable (with flaw text), their lines and flaw lines."""
    pos = ranked.filter(F.col("part") == "pos")
    return pos.agg(F.count_distinct("func_id").alias("total_pred_as_vul"),
                   F.count(F.lit(1)).alias("total_pos_lines"),
                   F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("vul_as_vul"))


# ----------------------------------------------------------------- true-positive explanation
def selected_functions(results: DataFrame, mode: str = "tp", ids: DataFrame | None = None) -> DataFrame:
    """S6 + F6 + J4: the functions to explain -- true positives (default), every truly
    vulnerable function (``mode='all'``), or an external id list (``mode='ids'``, semi join)."""
    if mode == "all":
        return results.filter(F.col("y_trues") == 1)
    if mode == "ids":
        return results.join(ids.select(F.col("func_id")).distinct(), "func_id", "left_semi")
    return results.filter((F.col("y_trues") == F.col("y_preds")) & (F.col("y_trues") == 1))


def function_line_stats(selected: DataFrame, lines: DataFrame | None = None, top_k_locs=TOP_K_LOCS, top_k: int = TOP_K_CONSTANT,
                        group_cols=()) -> DataFrame:
    """Per selected function with flaw text and flaw index: in-function ranks (W3) of its
    flaw lines -> total lines, flaw lines, first/last/mean flaw rank, flaw lines within the
    top floor(n * p) for each p, and whether the first flaw is in the top ``top_k``; all in the row of
    the function, from its sorted line array. Without ``lines`` the functions carry theirs already. ``status`` is 'ok', 'no_flaw_line' (no labelled line)
    or 'defective' (no flaw text)."""
    ok_text = has_text("flaw_line") & has_text("flaw_line_index")
    k = [*group_cols, "func_id"]
    if lines is not None:
        selected = selected.join(lines.select(*k, "lines"), k, "left")
    with_lines = selected.select(*k, ok_text.alias("_text"), "lines").withColumn("_lines", F.when(F.col("_text"), F.col("lines")))
    # each expression reads the one before it once, as a column
    ranks = F.filter(F.transform(ranked_in_row("_lines"), lambda e, r: F.when(e["label"] == 1, r)), lambda r: r.isNotNull())
    per = with_lines.select(*k, "_text", F.size("_lines").alias("_n"), ranks.alias("_ranks"))
    there = F.col("_n") > 0
    flaws = F.size("_ranks")
    some = there & (flaws > 0)
    mean = F.aggregate("_ranks", F.lit(0.0), lambda a, r: a + r) / F.when(some, flaws)

    def inside(p: float) -> Column:
        return F.size(F.filter("_ranks", lambda r: r < F.floor(F.col("_n") * F.lit(float(p)))))

    within = [F.when(there, inside(p)).cast("long").alias(f"correct_{i}") for i, p in enumerate(top_k_locs)]
    out = per.select(
        *k, "_text", F.when(there, F.col("_n")).cast("long").alias("total_lines"), F.when(there, flaws).cast("long").alias("num_flaw_lines"),
        F.when(some, F.get("_ranks", F.lit(0))).alias("first_rank"), F.when(some, F.try_element_at("_ranks", F.lit(-1))).alias("last_rank"),
        F.when(some, mean).alias("mean_rank"), *within)
    status = (F.when(~F.col("_text"), "defective")
              .when(F.coalesce(F.col("num_flaw_lines"), F.lit(0)) == 0, "no_flaw_line").otherwise("ok"))
    return out.withColumn("status", status).withColumn("hit", (F.col("first_rank") < top_k).cast("int")).drop("_text")


def explanation_summary(stats: DataFrame, top_k_locs=TOP_K_LOCS, group_cols=()) -> DataFrame:
    """One row of totals and localisation metrics over 'ok' functions."""
    ok = F.col("status") == "ok"

    def s(c):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    n = F.count_if(ok)
    return stats.groupBy(*group_cols).agg(
        n.alias("total_function"),
        s("total_lines").cast("long").alias("sum_total_lines"),
        s("num_flaw_lines").cast("long").alias("total_flaw_lines"),
        s("first_rank").cast("long").alias("sum_first_rank"),
        s("last_rank").cast("long").alias("sum_last_rank"),
        F.count_if(ok & (F.col("hit") == 1)).alias("top_k_hits"),
        F.sum(F.when(ok, F.col("mean_rank"))).alias("_sum_mean_rank"),
        F.count_if(F.col("status") == "no_flaw_line").alias("na_no_flaw_line"),
        F.count_if(F.col("status") == "defective").alias("na_defective"),
    ).select(
        *group_cols, "total_function", "sum_total_lines", "total_flaw_lines", "sum_first_rank", "sum_last_rank", "top_k_hits",
        F.try_divide(F.col("sum_first_rank").cast("double"), F.col("total_function")).alias("ifa"),
        F.try_divide(F.col("top_k_hits").cast("double"), F.col("total_function")).alias("top_k_accuracy"),
        F.try_divide(F.col("sum_last_rank").cast("double"), F.col("sum_total_lines")).alias("total_effort"),
        F.try_divide(F.col("sum_first_rank").cast("double"), F.col("total_function")).alias("mean_first_rank"),
        F.round(F.try_divide(F.col("_sum_mean_rank"), F.col("total_function")), 9).alias("mean_average_rank"),
        F.floor(F.try_divide(F.col("sum_total_lines").cast("double"), F.col("total_function"))).cast("long")
        .alias("avg_line_in_one_func"),
        (F.col("na_no_flaw_line") + F.col("na_defective")).alias("na_explanation_total"),
        "na_no_flaw_line", "na_defective")


def recall_at_topk_lines(stats: DataFrame, top_k_locs=TOP_K_LOCS) -> DataFrame:
    """For each p, flaw lines ranked within floor(n * p) of their function over all flaw
    lines (11 rows)."""
    ok = F.col("status") == "ok"
    row = stats.agg(F.coalesce(F.sum(F.when(ok, F.col("num_flaw_lines"))), F.lit(0)).alias("_flaws"),
                    *[F.coalesce(F.sum(F.when(ok, F.col(f"correct_{i}"))), F.lit(0)).alias(f"c{i}")
                      for i in range(len(top_k_locs))])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"c{i}").cast("long").alias("caught"))
                      for i, p in enumerate(top_k_locs)])
    return row.select("_flaws", F.explode(pairs).alias("e")).select(
        F.col("e.p").alias("p"), F.col("e.caught").alias("caught"),
        F.try_divide(F.col("e.caught").cast("double"), F.col("_flaws").cast("double")).alias("recall"))


def recall_curve_auc(curve: DataFrame) -> DataFrame:
    """A10: trapezoid area under the recall curve (p ascending), folded in p order."""
    pts = curve.agg(F.array_sort(F.collect_list(F.struct("p", "recall"))).alias("pts"))
    return pts.select(F.aggregate(
        F.sequence(F.lit(2), F.size("pts")), F.lit(0.0),
        lambda acc, i: acc + (F.element_at("pts", i)["p"] - F.element_at("pts", i - 1)["p"])
        * (F.element_at("pts", i)["recall"] + F.element_at("pts", i - 1)["recall"]) / 2).alias("auc"))
