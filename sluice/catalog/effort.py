"""Queries for global line rankings and effort metrics, the true-positive explanation
metrics and the line-evaluation plan (W4-W8 U3 A7-A14 A17 S6 J4 J8 P3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import register
from sluice.catalog.evaluation import _results
from sluice.catalog.lines import fold_lines
from sluice.oracle import cte, sql
from sluice.operators import effort as ef
from sluice.plans.evaluate import evaluate_lines
from sluice.session import persist_table, scratch_path
from sluice.sources import tables as tb

# ------------------------------------------------------------------ oracle views
cte("eval_lines", "SELECT func_id, line_idx, score, label FROM line_scores", "line_scores")
cte("lstats", "SELECT sum(num_lines)::BIGINT AS sum_lines, sum(num_flaw_lines)::BIGINT AS sum_flaw_lines FROM results",
    "results")
cte("parts", """
SELECT l.func_id, l.line_idx, l.score, l.label, CASE WHEN r.logits > 0.5 THEN 'pos' ELSE 'neg' END AS part
FROM eval_lines l JOIN results r USING (func_id) WHERE coalesce(r.flaw_line, '') <> ''""", "eval_lines", "results")
cte("line_ranks", """
SELECT *, (sum(label) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING))::DOUBLE AS cum_label FROM (
  SELECT func_id, line_idx, score, label, part, part_rank,
         part_rank + CASE WHEN part = 'neg' THEN (SELECT count(*) FROM parts WHERE part = 'pos') ELSE 0 END AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 'neg' THEN score ELSE -score END,
                                                            func_id, line_idx) AS part_rank FROM parts))""", "parts")
cte("prob_ranks", """
SELECT *, sum(num_lines) OVER w AS cum_num_lines, sum(num_flaw_lines * y_preds) OVER w AS cum_pred_flaws,
       num_flaw_lines * y_preds AS pred_flaws
FROM results WINDOW w AS (ORDER BY logits DESC, func_id ROWS UNBOUNDED PRECEDING)""", "results")

LOCS_SQL = ", ".join(f"count_if(label = 1 AND rank < floor(n * {p!r}::DOUBLE)) AS correct_{i}"
                     for i, p in enumerate(ef.TOP_K_LOCS))
cte("tp_sel", """
SELECT func_id, (coalesce(flaw_line, '') <> '' AND coalesce(flaw_line_index, '') <> '') AS ok_text
FROM results WHERE y_trues = y_preds AND y_trues = 1""", "results")
cte("tp_stats", f"""
SELECT s.func_id, p.* EXCLUDE (func_id),
       CASE WHEN NOT s.ok_text THEN 'defective' WHEN coalesce(p.num_flaw_lines, 0) = 0 THEN 'no_flaw_line'
            ELSE 'ok' END AS status,
       (p.first_rank < {ef.TOP_K_CONSTANT})::INTEGER AS hit
FROM tp_sel s LEFT JOIN (
  SELECT func_id, count(*) AS total_lines, sum(label)::BIGINT AS num_flaw_lines,
         min(CASE WHEN label = 1 THEN rank END) AS first_rank, max(CASE WHEN label = 1 THEN rank END) AS last_rank,
         avg(CASE WHEN label = 1 THEN rank::DOUBLE END) AS mean_rank, {LOCS_SQL}
  FROM (SELECT l.*, row_number() OVER (PARTITION BY l.func_id ORDER BY l.score DESC, l.line_idx) - 1 AS rank,
               count(*) OVER (PARTITION BY l.func_id) AS n
        FROM eval_lines l WHERE l.func_id IN (SELECT func_id FROM tp_sel WHERE ok_text))
  GROUP BY func_id) p USING (func_id)""", "tp_sel", "eval_lines")
cte("tp_summary", f"""
SELECT count_if(status = 'ok')::BIGINT AS total_function,
       coalesce(sum(total_lines) FILTER (WHERE status = 'ok'), 0)::BIGINT AS sum_total_lines,
       coalesce(sum(num_flaw_lines) FILTER (WHERE status = 'ok'), 0)::BIGINT AS total_flaw_lines,
       coalesce(sum(first_rank) FILTER (WHERE status = 'ok'), 0)::BIGINT AS sum_first_rank,
       coalesce(sum(last_rank) FILTER (WHERE status = 'ok'), 0)::BIGINT AS sum_last_rank,
       count_if(status = 'ok' AND hit = 1)::BIGINT AS top_k_hits,
       sum(mean_rank) FILTER (WHERE status = 'ok') AS sum_mean_rank,
       count_if(status = 'no_flaw_line')::BIGINT AS na_no_flaw_line, count_if(status = 'defective')::BIGINT AS na_defective
FROM tp_stats""", "tp_stats")


def _div(a, b):
    return f"({a})::DOUBLE / nullif(({b}), 0)::DOUBLE"


# ------------------------------------------------------------------ Spark helpers
def _parts(spark, sf):
    return ef.ranked_line_parts(_results(spark, sf), tb.line_score_arrays(spark, sf))


def _ranked(spark, sf):
    return ef.rank_lines_global(spark, _parts(spark, sf))


def _line_stats(spark, sf):
    row = ef.line_statistics(_results(spark, sf)).first()
    return int(row["sum_lines"] or 0), int(row["sum_flaw_lines"] or 0)


def _tp_stats(spark, sf):
    return ef.function_line_stats(ef.selected_functions(_results(spark, sf)), tb.line_score_arrays(spark, sf))


# ------------------------------------------------------------------ global rankings
@register("rank_lines_global", sql("SELECT func_id, line_idx, part, part_rank, label FROM line_ranks", "line_ranks"))
def rank_lines_global(spark, sf):
    return _ranked(spark, sf).select("func_id", "line_idx", "part", "part_rank", "label")


@register("concat_rankings", sql("SELECT func_id, line_idx, rank, cum_label FROM line_ranks", "line_ranks"))
def concat_rankings(spark, sf):
    return _ranked(spark, sf).select("func_id", "line_idx", "rank", "cum_label")


@register("effort_at_recall", sql(f"""
SELECT floor(s.sum_flaw_lines * 0.2::DOUBLE)::BIGINT AS target, i.inspected::BIGINT AS inspected,
       {_div('i.inspected', 's.sum_lines')} AS effort
FROM lstats s, (SELECT coalesce((SELECT min(rank) FROM line_ranks, lstats
                                 WHERE cum_label = floor(sum_flaw_lines * 0.2::DOUBLE)),
                                (SELECT count(*) FROM line_ranks)) AS inspected) i""", "lstats", "line_ranks"))
def effort_at_recall(spark, sf):
    n_lines, n_flaws = _line_stats(spark, sf)
    return ef.effort_at_recall(spark, persist_table(spark, _parts(spark, sf), "line_parts"), n_lines, n_flaws)


@register("recall_at_loc", sql(f"""
SELECT floor(s.sum_lines * 0.01::DOUBLE)::BIGINT AS target, c.caught::BIGINT AS caught,
       {_div('c.caught', 's.sum_flaw_lines')} AS recall
FROM lstats s, (SELECT coalesce(sum(label), 0) AS caught FROM line_ranks, lstats
                WHERE rank <= floor(sum_lines * 0.01::DOUBLE)) c""", "lstats", "line_ranks"))
def recall_at_loc(spark, sf):
    n_lines, n_flaws = _line_stats(spark, sf)
    return ef.recall_at_loc(spark, persist_table(spark, _parts(spark, sf), "line_parts"), n_lines, n_flaws)


@register("effort_at_recall_by_prob", sql(f"""
SELECT floor(s.sum_flaw_lines * 0.2::DOUBLE)::BIGINT AS target, i.inspected::BIGINT AS inspected,
       {_div('i.inspected', 's.sum_lines')} AS effort
FROM lstats s, (SELECT coalesce(min(cum_num_lines) FILTER (WHERE cum_pred_flaws >= floor(sum_flaw_lines * 0.2::DOUBLE)),
                                sum(num_lines)) AS inspected FROM prob_ranks, lstats) i""", "lstats", "prob_ranks"))
def effort_at_recall_by_prob(spark, sf):
    n_lines, n_flaws = _line_stats(spark, sf)
    return ef.effort_at_recall_by_prob(ef.rank_functions_by_prob(spark, _results(spark, sf)), n_lines, n_flaws)


@register("recall_at_loc_by_prob", sql(f"""
SELECT floor(s.sum_lines * 0.2::DOUBLE)::BIGINT AS target, c.caught::BIGINT AS caught,
       {_div('c.caught', 's.sum_flaw_lines')} AS recall
FROM lstats s, (SELECT coalesce(sum(pred_flaws) FILTER (WHERE cum_num_lines <= floor(sum_lines * 0.2::DOUBLE)), 0)
                AS caught FROM prob_ranks, lstats) c""", "lstats", "prob_ranks"))
def recall_at_loc_by_prob(spark, sf):
    n_lines, n_flaws = _line_stats(spark, sf)
    return ef.recall_at_loc_by_prob(ef.rank_functions_by_prob(spark, _results(spark, sf)), n_lines, n_flaws)


@register("predicted_vulnerable_totals", sql("""
SELECT count(DISTINCT func_id) AS total_pred_as_vul, count(*) AS total_pos_lines,
       coalesce(sum(label), 0)::BIGINT AS vul_as_vul FROM line_ranks WHERE part = 'pos'""", "line_ranks"))
def predicted_vulnerable_totals(spark, sf):
    return ef.predicted_vulnerable_totals(_ranked(spark, sf))


# ------------------------------------------------------------------ true-positive explanation
@register("ifa", sql(f"""
SELECT total_function, sum_first_rank, {_div('sum_first_rank', 'total_function')} AS ifa FROM tp_summary""",
                     "tp_summary"))
def ifa(spark, sf):
    return ef.explanation_summary(_tp_stats(spark, sf)).select("total_function", "sum_first_rank", "ifa")


@register("topk_accuracy", sql(f"""
SELECT total_function, top_k_hits, {_div('top_k_hits', 'total_function')} AS top_k_accuracy FROM tp_summary""",
                               "tp_summary"))
def topk_accuracy(spark, sf):
    return ef.explanation_summary(_tp_stats(spark, sf)).select("total_function", "top_k_hits", "top_k_accuracy")


LOCS_VALUES = ", ".join(f"({p!r}::DOUBLE, {i})" for i, p in enumerate(ef.TOP_K_LOCS))
cte("recall_curve", f"""
SELECT v.p, (CASE v.i {' '.join(f'WHEN {i} THEN c{i}' for i in range(len(ef.TOP_K_LOCS)))} END)::BIGINT AS caught,
       {_div(f"CASE v.i {' '.join(f'WHEN {i} THEN c{i}' for i in range(len(ef.TOP_K_LOCS)))} END", 'flaws')} AS recall
FROM (VALUES {LOCS_VALUES}) v(p, i),
     (SELECT coalesce(sum(num_flaw_lines) FILTER (WHERE status = 'ok'), 0) AS flaws,
             {', '.join(f"coalesce(sum(correct_{i}) FILTER (WHERE status = 'ok'), 0) AS c{i}"
                        for i in range(len(ef.TOP_K_LOCS)))}
      FROM tp_stats) t""", "tp_stats")


@register("recall_at_topk_lines", sql("SELECT * FROM recall_curve", "recall_curve"))
def recall_at_topk_lines(spark, sf):
    return ef.recall_at_topk_lines(_tp_stats(spark, sf))


@register("recall_curve_auc", sql("""
SELECT round(list_reduce(list_transform(range(2, len(pts) + 1),
         lambda i: (pts[i].p - pts[i-1].p) * (pts[i].recall + pts[i-1].recall) / 2), lambda a, b: a + b), 9) AS auc
FROM (SELECT list({'p': p, 'recall': recall} ORDER BY p) AS pts FROM recall_curve)""", "recall_curve"))
def recall_curve_auc(spark, sf):
    auc = ef.recall_curve_auc(ef.recall_at_topk_lines(_tp_stats(spark, sf)))
    return auc.select(F.round("auc", 9).alias("auc"))


@register("total_effort", sql(f"""
SELECT sum_last_rank, sum_total_lines, {_div('sum_last_rank', 'sum_total_lines')} AS total_effort FROM tp_summary""",
                              "tp_summary"))
def total_effort(spark, sf):
    return ef.explanation_summary(_tp_stats(spark, sf)).select("sum_last_rank", "sum_total_lines", "total_effort")


@register("mean_ranks", sql(f"""
SELECT {_div('sum_first_rank', 'total_function')} AS mean_first_rank,
       round(sum_mean_rank / nullif(total_function, 0), 9) AS mean_average_rank FROM tp_summary""", "tp_summary"))
def mean_ranks(spark, sf):
    return ef.explanation_summary(_tp_stats(spark, sf)).select("mean_first_rank", "mean_average_rank")


@register("explanation_totals", sql(f"""
SELECT total_function, sum_total_lines, total_flaw_lines,
       floor({_div('sum_total_lines', 'total_function')})::BIGINT AS avg_line_in_one_func,
       na_no_flaw_line + na_defective AS na_explanation_total, na_no_flaw_line, na_defective
FROM tp_summary""", "tp_summary"))
def explanation_totals(spark, sf):
    return ef.explanation_summary(_tp_stats(spark, sf)).select(
        "total_function", "sum_total_lines", "total_flaw_lines", "avg_line_in_one_func", "na_explanation_total",
        "na_no_flaw_line", "na_defective")


@register("hit_miss_ids", sql("SELECT func_id, hit FROM tp_stats WHERE status = 'ok'", "tp_stats"))
def hit_miss_ids(spark, sf):
    """Functions localised (hit = 1) or not (hit = 0) within the top 10 lines, as rows
    (never collected into one list)."""
    return _tp_stats(spark, sf).filter(F.col("status") == "ok").select("func_id", "hit")


# ------------------------------------------------------------------ id lists
def _id_list(spark, sf):
    """An external id list file (toxic-labelled ids), written and read back as parquet."""
    path = scratch_path(spark, "id_list")
    tb.read_table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("func_id")) \
        .write.parquet(path)
    return spark.read.parquet(path)


@register("select_by_id_list", sql("SELECT func_id FROM results WHERE y_trues = 1", "results"))
def select_by_id_list(spark, sf):
    """S6 with the 'all' selector: every truly vulnerable test function."""
    return ef.selected_functions(_results(spark, sf), mode="all").select("func_id")


@register("restrict_to_ids", sql("""
SELECT func_id, y_trues, y_preds FROM results WHERE func_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
                                 "results"))
def restrict_to_ids(spark, sf):
    return ef.selected_functions(_results(spark, sf), mode="ids", ids=_id_list(spark, sf)).select(
        "func_id", "y_trues", "y_preds")


@register("id_list_diff", sql("""
SELECT doc_id AS func_id FROM labels WHERE toxic = 1
  AND doc_id NOT IN (SELECT func_id FROM results WHERE y_trues = y_preds AND y_trues = 1)"""
                              .replace("SELECT doc_id AS func_id", "SELECT DISTINCT doc_id AS func_id"), "results"))
def id_list_diff(spark, sf):
    """Ids of the list that are not true positives (left anti join)."""
    tps = ef.selected_functions(_results(spark, sf)).select("func_id")
    return _id_list(spark, sf).distinct().join(tps, "func_id", "left_anti")


# ------------------------------------------------------------------ P3 line evaluation
def p3_sql(fold: bool = True) -> str:
    """Oracle of P3: over folded token lines (``fold``) or over the given line scores."""
    deps = ["lstats", "line_ranks", "tp_summary"] + (["fold_lines"] if fold else [])
    overrides = {"eval_lines": "SELECT * FROM fold_lines"} if fold else {}
    inspected = ("coalesce((SELECT min(rank) FROM line_ranks, lstats WHERE cum_label = floor(sum_flaw_lines * 0.2::DOUBLE)),"
                 " (SELECT count(*) FROM line_ranks))")
    caught = "(SELECT coalesce(sum(label), 0) FROM line_ranks, lstats WHERE rank <= floor(sum_lines * 0.01::DOUBLE))"
    return sql(f"""
SELECT 'sum_lines' AS metric, sum_lines::DOUBLE AS value FROM lstats
UNION ALL SELECT 'sum_flaw_lines', sum_flaw_lines::DOUBLE FROM lstats
UNION ALL SELECT 'total_pred_as_vul', count(DISTINCT func_id)::DOUBLE FROM line_ranks WHERE part = 'pos'
UNION ALL SELECT 'inspected', {inspected}::DOUBLE
UNION ALL SELECT 'effort_at_recall', {_div(inspected, 'sum_lines')} FROM lstats
UNION ALL SELECT 'recall_at_loc', {_div(caught, 'sum_flaw_lines')} FROM lstats
UNION ALL SELECT 'ifa', {_div('sum_first_rank', 'total_function')} FROM tp_summary
UNION ALL SELECT 'top_k_accuracy', {_div('top_k_hits', 'total_function')} FROM tp_summary""",
               *deps, overrides=overrides)


@register("evaluate_lines", p3_sql(fold=True))
def evaluate_lines_q(spark, sf):
    """P3 over token scores folded into lines."""
    return evaluate_lines(spark, _results(spark, sf), fold_lines(tb.token_scores(spark, sf)))
