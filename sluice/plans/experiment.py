"""Repeated experiments -- configs x repeats -> splits -> classifier -> function
metrics -> attributions -> line metrics -> summaries.

The splits of all repeats come from one plan (seed as a column) and the tokens and term counts of all
functions from one pass; both are persisted to the shared folder. Only the model fits loop,
several at a time. A finished cell (config, repeat) is one table in the ledger: its test scores and, for
each attribution method, the line scores of the functions with flaw text. All metrics are then single
plans over the cells.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.code import has_text
from sluice.operators import denoise as dn
from sluice.operators import effort as ef
from sluice.operators import metrics as me
from sluice.operators import models as mo
from sluice.operators.curate import is_latent
from sluice.operators.linear_fit import Fits, Training, feature_matrix, numbers_of
from sluice.plans.evaluate import evaluate_lines, lines_from_token_scores
from sluice.plans.ledger import finished_cells, read_cells, write_cell
from sluice.plans.splits import build_splits
from sluice.session import persist_table, release_unreferenced, scratch_path
from sluice.sources.sinks import write_results_csv

# Experiment configurations and the training split each one uses.
CONFIGS = [("regular", "train"), ("latent_v", "train_latent")]
CELL = ["config", "repeat"]
# Slots of all models that are held at once.
MODEL_NUMBERS = 1 << 21
# Rows of the splits of one seed up to which one of them is sent to the tokens, so that these are not shuffled.
SENT_ROWS = 1 << 20
LINE_METRICS = ["effort_at_recall", "recall_at_loc", "ifa", "top_k_accuracy"]


def denoise_train(train: DataFrame, model: mo.LinearModel, how: str, alpha: float = 1.0, keep: str = "negative",
                  terms: DataFrame | None = None, sent: bool = False) -> DataFrame:
    """M5 / M6 between the split builder and training, with a model fitted on the non-latent rows of ``train``. ``terms`` are the tokenised
    functions (func_id, _slots), of which ``train`` names some; without them ``train`` is tokenised, or has the code. ``sent``: its latent rows go to the terms, which are not shuffled.

    * ``centroid``: that model's features (M3) of the training rows; keep latent rows closer to the
      centroid of non-latent positives than (alpha x) to that of non-latent negatives.
    * ``predict``: that model scores the latent rows; rows predicted positive are removed
      (``keep='negative'``, reference behaviour).
    """
    if how == "centroid":
        # functions outside the training set get a vector too, which the join leaves out: vectors are shuffled, slots are not
        with_vec = train.join(mo.embed_functions(train if terms is None else terms, model=model), "func_id")
        return dn.centroid_filter(with_vec, "embedding", alpha=alpha).drop("embedding")
    latent = train.filter(is_latent())
    latent = latent if terms is None else _of(latent.select("func_id"), terms, sent)
    scored = mo.score_functions(mo.weighed(latent, model), model.intercept)
    return dn.self_training_filter(train, scored.select("func_id", "y_pred"), keep=keep)


def _of(rows: DataFrame, table: DataFrame, sent: bool) -> DataFrame:
    """Narrow rows with the columns that a large table has for their functions; ``sent``: the rows go to the table."""
    return table.join(F.broadcast(rows) if sent else rows, "func_id")


def run_experiment(spark: SparkSession, f: DataFrame, repeats: int = 10, configs=CONFIGS, grid=mo.GRID,
                   methods=("attention",), max_iter: int = mo.MAX_ITER, denoise: str | None = None,
                   out_path: str | None = None, latent_source: DataFrame | None = None, latent_name: str = "",
                   parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """Returns ``(long, wide)``: long ``(config, repeat, method, metric, value)`` and the per-repeat
    result table, one row per (config, repeat, method), with -1 for missing metrics (a test set of one class has
    recall only). ``denoise`` inserts M5 ('centroid') or M6 ('predict') before the final fit; ``latent_source`` (and a
    ``latent_name`` for it) augments training from another latent table (P2).

    Cells are kept in a ledger below ``out_path`` (shared storage; a private scratch folder when not given)
    under a digest of the parameters, and cells already there are not fitted again, so a
    restarted driver resumes. With ``out_path`` the summary (A15) and the result table (S10, CSV) are
    written beside them."""
    if denoise not in (None, "centroid", "predict"):
        raise ValueError("denoise must be None, 'centroid' or 'predict'")
    methods = list(methods)
    given = repr((sorted(map(tuple, configs)), tuple(grid), methods, max_iter, denoise, latent_source is not None, latent_name))
    base = f"{out_path or scratch_path(spark, 'experiment')}/{hashlib.sha256(given.encode()).hexdigest()[:16]}"
    seeds = [10000 * r for r in range(1, repeats + 1)]
    all_cells = [(c, r) for r in range(1, repeats + 1) for c, _ in configs]
    done = finished_cells(spark, f"{base}/cells")
    todo = [(c, t, r, s) for r, s in enumerate(seeds, start=1) for c, t in configs if (c, str(r)) not in done]
    code = f.select("func_id", "code", "flaw_line", "flaw_line_index").withColumn("_row", F.monotonically_increasing_id())
    code = persist_table(spark, code, "experiment_code")
    if todo:
        splits_path = scratch_path(spark, "experiment_splits")
        with ThreadPoolExecutor(1) as pool:  # the sketch of the terms runs beside the small stages of the splits
            counting = pool.submit(inheritable_thread_target(spark)(mo.slots_for), code)
            splits = build_splits(f, seeds=seeds, latent_source=latent_source).select("seed", "split", "func_id", "label", "latent")
            splits.join(code.select("func_id", "_row"), "func_id").write.partitionBy("seed", "split").parquet(splits_path)
            slots = counting.result()
        splits = spark.read.parquet(splits_path)
        # functions that are in no split are not tokenised
        tokens = mo.tokenised(code.join(splits.select("_row").distinct(), "_row", "left_semi"), slots)
        tokens = persist_table(spark, tokens.select("_row", "func_id", "flaw_line", "_toks", "_slots"), "experiment_tokens")
        matrix = feature_matrix(tokens, slots)
        release_unreferenced(spark)
        sent = len(matrix.rows) <= SENT_ROWS
        # weights of a model take one number per slot, so fewer of them are held at once the more slots there are
        workers = max(1, min(parallel, MODEL_NUMBERS // slots))

    def take(seed: int, name: str, columns) -> DataFrame:
        part = splits.filter((F.col("seed") == seed) & (F.col("split") == name))
        return _of(part.select("func_id", "label", "latent"), tokens.select("func_id", *columns), sent)

    def training(rows: DataFrame) -> Training:
        known = rows.select("_row", "label").toArrow()
        return Training(matrix.place(numbers_of(known.column(0))), numbers_of(known.column(1)))

    def chosen(fits: Fits, i: int, val: Training) -> mo.LinearModel:
        return mo.fitted_model(fits, i, int(np.argmax(mo.validation_f1(fits, i, val.rows, val.labels))))  # the earliest of the best

    def fit_cells(cells: list[tuple]) -> None:
        """Fit some cells side by side, then score, explain and write each of them."""
        def split(seed: int, name: str) -> DataFrame:
            return splits.filter((F.col("seed") == seed) & (F.col("split") == name))

        def of_all(fn, *args) -> list:
            return [running.result() for running in [pool.submit(inheritable_thread_target(spark)(fn), *x) for x in zip(*args, strict=True)]]

        def in_turns(fn) -> list:
            """``fn`` of each cell's number and cell, for as many cells at once as models are held."""
            out = []
            for at in range(0, len(cells), workers):
                out += of_all(fn, range(at, min(at + workers, len(cells))), cells[at:at + workers])
                release_unreferenced(spark)  # models of finished cells are given back
            return out

        with ThreadPoolExecutor(parallel) as pool:
            val = of_all(lambda cell: training(split(cell[3], "val")), cells)
            if denoise is None:
                sets = of_all(lambda cell: training(split(cell[3], cell[1])), cells)
            else:
                first = Fits(matrix, of_all(lambda cell: training(split(cell[3], cell[1]).filter(~is_latent())), cells), grid, max_iter, mo.TOLERANCE)

                def denoised(i: int, cell: tuple) -> Training:
                    train = split(cell[3], cell[1]).select("func_id", "label", "latent", "_row")
                    return training(denoise_train(train, chosen(first, i, val[i]), denoise, terms=tokens.select("func_id", "_slots"), sent=sent))
                sets = in_turns(denoised)
                first.close()
            fits = Fits(matrix, sets, grid, max_iter, mo.TOLERANCE)

            def finish(i: int, cell: tuple) -> None:
                config, _, r, seed = cell
                model = chosen(fits, i, val[i])
                test = mo.weighed(take(seed, "test", ("flaw_line", "_toks", "_slots")), model)
                scored = mo.score_functions(test.select("func_id", "label", "_c"), model.intercept)
                relevant = mo.attributed(test.filter(has_text("flaw_line")), ["func_id", "flaw_line"], methods)
                lines = lines_from_token_scores(relevant.drop("flaw_line"), take(seed, "test", ("flaw_line",)), ["method"])
                explained = lines.groupBy("func_id").agg(F.collect_list(F.struct("method", "lines")).alias("explained"))  # one entry a method
                cell = scored.join(explained, "func_id", "left").select(
                    F.lit(config).alias("config"), F.lit(r).alias("repeat"), "func_id", "label", "prob", "y_pred", "explained")
                write_cell(cell, f"{base}/cells", (config, r))
            release_unreferenced(spark)
            in_turns(finish)
            fits.close()

    if todo:
        side = matrix.side_by_side(len(grid))
        side = -(-len(todo) // -(-len(todo) // side))  # groups of one size
        for start in range(0, len(todo), side):
            fit_cells(todo[start:start + side])

    cells = read_cells(spark, f"{base}/cells", all_cells)
    keyed = [*CELL, "method"]
    each = cells.drop("explained").withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    lines = cells.select(*CELL, "func_id", F.inline("explained"))
    function_metrics = me.single_class_metrics(each.withColumnRenamed("label", "y_true"), keyed)
    function_metrics = me.to_long(function_metrics.drop("n_classes"), keyed, ["precision", "recall", "f1"])
    results = ef.result_frame(each.join(code.drop("_row"), "func_id"), keyed)
    line_metrics = evaluate_lines(spark, results, lines, neg_ascending=F.col("method") == "attention", name="p4", group_cols=keyed)
    long = function_metrics.unionByName(line_metrics.filter(F.col("metric").isin(*LINE_METRICS)))
    long = long.filter("value is not null").select("config", F.col("repeat").cast("int"), "method", "metric", "value")
    wide = me.results_wide(long, keyed)
    if out_path:
        me.experiment_summary(long, ["config", "method"]).write.mode("overwrite").parquet(f"{base}/summary")
        write_results_csv(wide, f"{base}/results")
    return long, wide
