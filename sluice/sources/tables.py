"""Scans of the input tables and the function-table views derived from them.

The function table (one row per source function) is derived from ``documents`` and
``labels`` by a fixed rule (FIXTURES.md); every view is a lazy DataFrame, so predicates
and projections reach the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.code import code_lines

FUNCTION_SCHEMA = T.StructType([
    T.StructField("func_id", T.LongType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("latent", T.IntegerType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("vfc", T.LongType(), True),
    T.StructField("flaw_line", T.StringType(), True),
    T.StructField("flaw_line_index", T.StringType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_functions(spark: SparkSession, path: str, schema: T.StructType = FUNCTION_SCHEMA) -> DataFrame:
    """Scan a stored function table with a declared schema (no inference)."""
    return spark.read.schema(schema).parquet(path)


def scan_projects(spark: SparkSession, paths: dict[str, str], schema: T.StructType = FUNCTION_SCHEMA) -> DataFrame:
    """The function tables of several projects, read from the path of each, as one table with the
    project's name and the ``file`` of every row. Columns are matched by name and brought to the declared types; a
    column that a project's files lack is null, further columns are left out."""
    parts = []
    for project, path in paths.items():
        found = spark.read.parquet(path)
        kinds = dict(found.dtypes)
        columns = [(F.col(f"`{f.name}`") if f.name in kinds else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        parts.append(found.select(F.lit(project).alias("project"), *columns, F.col("_metadata.file_path").alias("file")))
    return reduce(DataFrame.unionByName, parts)


def _is_flaw_text(line: Column) -> Column:
    return (F.length(line) > 0) & (F.length(line) % 5 == 0)


def functions(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The function table over ``documents`` + ``labels``.

    Labelled rows are originals (vulnerable when toxic or low quality); unlabelled even ids
    are latent positives traced by method 'v' or 'b' with parent ``vfc``; unlabelled odd ids
    are vulnerable originals. Flaw lines of vulnerable rows are the non-empty lines whose
    length is a multiple of 5 ('/~/'-joined text, ','-joined 1-based numbers). ``extra``
    carries further ``documents`` columns (e.g. ``source``).
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", *extra)
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    j = d.join(lab, d.doc_id == lab.l_id, "left")
    unlabelled_even = F.col("l_id").isNull() & (F.col("doc_id") % 2 == 0)
    label = (F.when(F.col("l_id").isNotNull(),
                    F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
             .when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    # Lambdas iterate the line array itself: an outer expression referenced inside a lambda
    # would be re-evaluated for every element.
    ls = code_lines("text")
    flaw_text = F.array_join(F.filter(ls, _is_flaw_text), "/~/")
    flaw_index = F.array_join(F.filter(F.transform(ls, lambda x, i: F.when(_is_flaw_text(x), (i + 1).cast("string"))),
                                       lambda x: x.isNotNull()), ",")
    vuln = label == 1
    return j.select(
        F.col("doc_id").alias("func_id"),
        F.col("text").alias("code"),
        label.cast("int").alias("label"),
        F.when(unlabelled_even, 1).otherwise(0).cast("int").alias("latent"),
        F.when(unlabelled_even, F.when(F.col("doc_id") % 3 == 0, "b").otherwise("v")).alias("method"),
        F.when(unlabelled_even, F.col("doc_id") - F.col("doc_id") % 10).otherwise(F.col("doc_id")).alias("vfc"),
        F.when(vuln, flaw_text).alias("flaw_line"),
        F.when(vuln, flaw_index).alias("flaw_line_index"),
        *extra,
    )


def uniform_hash(key: Column) -> Column:
    """A double in [0, 1) from the first 8 hex digits of SHA-256(key)."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def score_hash_model(f: DataFrame, key: Column | None = None) -> DataFrame:
    """Deterministic stand-in scorer: ``prob = 0.6 u + 0.4 label``, ``y_pred = prob > 0.5``.

    ``u`` hashes the code by default, so exact copies share a score.
    """
    u = uniform_hash(F.col("code") if key is None else key)
    prob = F.lit(0.6) * u + F.lit(0.4) * F.col("label").cast("double")
    return f.withColumn("prob", prob).withColumn("y_pred", (F.col("prob") > 0.5).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored function table (all rows)."""
    return score_hash_model(functions(spark, sf_dir))


def lines_of(f: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Non-blank lines: func_id, line_idx (0-based over non-blank lines), line_no (1-based), line.

    Positions of non-blank lines are filtered inside the row, then exploded with their
    ordinal, so no window or shuffle is needed.
    """
    numbered = F.transform(code_lines("code"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    nb = F.filter(numbered, lambda s: F.length(s["line"]) > 0)
    ex = f.select("func_id", *extra, F.posexplode(nb).alias("line_idx", "_l"))
    return ex.select("func_id", *extra, "line_idx", F.col("_l.line_no").alias("line_no"), F.col("_l.line").alias("line"))


def line_score_arrays(spark: SparkSession, sf_dir: str, test_set: bool = True) -> DataFrame:
    """Given line scores: (func_id, lines array<struct<score, label>>) of the non-blank lines, of the
    non-latent functions (the test set of the metrics) or of all.

    ``score`` is an integer-valued hash of ``func_id|line_no`` (exact sums), ``label`` is 1
    for lines of vulnerable functions whose length is a multiple of 5.
    """
    f = functions(spark, sf_dir)
    f = f.filter(F.col("latent") == 0) if test_set else f
    numbered = F.transform(code_lines("code"), lambda x, i: F.struct((i + 1).alias("line_no"), F.length(x).alias("len")))
    own = f.select("func_id", F.col("label").alias("f_label"), F.filter(numbered, lambda s: s["len"] > 0).alias("_nb"))
    return own.select("func_id", F.transform("_nb", lambda s: F.struct(
        (F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("func_id"), s["line_no"]), 256), 1, 6), 16, 10)
         .cast("bigint") % 1000).cast("double").alias("score"),
        ((F.col("f_label") == 1) & (s["len"] % 5 == 0)).cast("int").alias("label"))).alias("lines"))


def token_scores(spark: SparkSession, sf_dir: str, test_set: bool = True) -> DataFrame:
    """Given token scores of the non-latent functions (the test set of the metrics) or of all, as
    one array per function.

    Each line is split on spaces (score = token length) and closed by a newline marker
    token with score 1; ``tokens`` is ``array<struct<tok string, v double>>``.
    """
    f = functions(spark, sf_dir)
    return token_scores_of(f.filter(F.col("latent") == 0) if test_set else f)


# Fixed value: newline marker of the subword vocabulary.
NEWLINE_TOKEN = "Ċ"


def token_scores_of(f: DataFrame) -> DataFrame:
    per_line = F.transform(
        code_lines("code"),
        lambda line: F.concat(
            F.transform(F.filter(F.split(line, " "), lambda t: t != ""),
                        lambda t: F.struct(t.alias("tok"), F.length(t).cast("double").alias("v"))),
            F.array(F.struct(F.lit(NEWLINE_TOKEN).alias("tok"), F.lit(1.0).alias("v")))))
    return f.select("func_id", "label", "flaw_line", F.flatten(per_line).alias("tokens"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors with a class role: positive (label < 3), negative (3..6), latent (>= 7)."""
    e = read_table(spark, sf_dir, "embeddings")
    role = (F.when(F.col("label") < 3, "pos").when(F.col("label") <= 6, "neg").otherwise("latent"))
    return e.select(F.col("vec_id"), F.col("embedding"), F.col("label").alias("class_label"), role.alias("role"))
