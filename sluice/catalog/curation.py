"""Queries for sources, filters, curation, joins and the split builder (S1 S2 F1-F3 F7 F9 C1
A1 A2 U1 U2 J1 J2 W1 W2 W11 P1 P2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import register
from sluice.oracle import SEEDS10, cte, sql
from sluice.operators import curate as cu
from sluice.operators.ranking import hash_rank
from sluice.plans import splits as sp
from sluice.session import scratch_path
from sluice.sources import tables as tb

FUNC_COLS = "func_id, code, label, latent, method, vfc, flaw_line, flaw_line_index"


def _f(spark, sf):
    return tb.functions(spark, sf)


def splits10(spark, sf):
    return sp.build_splits(_f(spark, sf), seeds=sp.DEFAULT_SEEDS)


def splits1(spark, sf):
    return sp.build_splits(_f(spark, sf), seeds=(10000,))


# ------------------------------------------------------------------ sources
@register("scan_functions", sql(f"SELECT {FUNC_COLS} FROM functions", "functions"))
def scan_functions(spark, sf):
    """The function table stored as a file, scanned back with its declared schema."""
    path = scratch_path(spark, "function_table")
    _f(spark, sf).write.parquet(path)
    return tb.scan_functions(spark, path)


def _even_source():
    return F.substring(F.col("source"), 4, 10).cast("int") % 2 == 0


def project_files(spark, sf):
    """The function table as one folder of files per project: {project: path}. Odd-numbered projects
    ship without ``latent`` and ``method`` and with wider labels (ragged schemas)."""
    f = tb.functions(spark, sf, extra=("source",)).withColumnRenamed("source", "project")
    base = scratch_path(spark, "project_files")
    even = f.withColumnRenamed("project", "source").filter(_even_source()).withColumnRenamed("source", "project")
    odd = f.withColumnRenamed("project", "source").filter(~_even_source()).withColumnRenamed("source", "project")
    even.write.partitionBy("project").parquet(f"{base}/full")
    odd.drop("latent", "method").withColumn("label", F.col("label").cast("long")).write.partitionBy("project").parquet(f"{base}/ragged")
    paths = {}
    for kind in ("full", "ragged"):  # one row a project
        for r in spark.read.parquet(f"{base}/{kind}").select("project").distinct().collect():
            paths[r["project"]] = f"{base}/{kind}/project={r['project']}"
    return paths


def projects(spark, sf):
    """The files of all projects as one table."""
    return tb.scan_projects(spark, project_files(spark, sf))


cte("fsrc", """
SELECT f.*, d.source AS project FROM functions f JOIN documents d ON f.func_id = d.doc_id""", "functions")
cte("projects", """
SELECT project, func_id, label, latent, method, vfc FROM fsrc WHERE substr(project, 4)::INTEGER % 2 = 0
UNION ALL
SELECT project, func_id, label, NULL::INTEGER, NULL::VARCHAR, vfc FROM fsrc WHERE substr(project, 4)::INTEGER % 2 = 1""",
    "fsrc")


@register("scan_projects", sql("SELECT *, 'project=' || project AS folder FROM projects", "projects"))
def scan_projects(spark, sf):
    """S2 with the folder each row was read from."""
    p = projects(spark, sf)
    return p.select("project", "func_id", "label", "latent", "method", "vfc", F.element_at(F.split("file", "/"), -2).alias("folder"))


# ------------------------------------------------------------------ filters
@register("select_cohorts", sql("""
SELECT func_id, CASE WHEN label=1 AND latent=0 THEN 'vuln' WHEN label=0 AND latent=0 THEN 'non_vuln'
                     ELSE 'latent' END AS cohort
FROM functions WHERE (label=1 AND latent=0) OR (label=0 AND latent=0) OR (label=1 AND latent=1 AND method='v')""",
                                "functions"))
def select_cohorts(spark, sf):
    return cu.select_cohorts(_f(spark, sf)).select("func_id", "cohort")


@register("split_latent", sql("""
SELECT project, func_id, CASE WHEN latent IS NOT DISTINCT FROM 1 THEN 'latent' ELSE 'non_latent' END AS part
FROM projects""", "projects"))
def split_latent(spark, sf):
    non_latent, latent = cu.split_latent(projects(spark, sf))
    return (non_latent.select("project", "func_id", F.lit("non_latent").alias("part"))
            .unionByName(latent.select("project", "func_id", F.lit("latent").alias("part"))))


@register("class_partition", sql("""
SELECT func_id, CASE WHEN latent IS NOT DISTINCT FROM 1 THEN 'latent' WHEN label=1 THEN 'pos' ELSE 'neg' END AS part
FROM splits WHERE split='train_latent'""", "splits"))
def class_partition(spark, sf):
    """F2 + F3 in one pass: latent rows, then non-latent positives / negatives."""
    train = splits1(spark, sf).filter(F.col("split") == "train_latent")
    part = F.when(cu.is_latent(), "latent").when(F.col("label") == 1, "pos").when(F.col("label") == 0, "neg")
    return train.select("func_id", part.alias("part")).filter(F.col("part").isNotNull())


@register("tag_latent", sql("""
SELECT project, func_id, latent FROM projects WHERE latent IS NOT NULL
UNION ALL
SELECT project, func_id, CASE WHEN vfc = func_id THEN 0 ELSE 1 END FROM projects WHERE latent IS NULL""",
                            "projects"))
def tag_latent(spark, sf):
    p = projects(spark, sf)
    tagged = p.filter(F.col("latent").isNotNull())
    ragged = p.filter(F.col("latent").isNull())
    originals = cu.tag_latent(ragged.filter(F.col("vfc") == F.col("func_id")), 0)
    traced = cu.tag_latent(ragged.filter(F.col("vfc") != F.col("func_id")), 1)
    return (tagged.select("project", "func_id", "latent")
            .unionByName(originals.select("project", "func_id", "latent"))
            .unionByName(traced.select("project", "func_id", "latent")))


@register("code_hash", sql("SELECT func_id, sha256(code) AS hash_code FROM functions", "functions"))
def code_hash(spark, sf):
    return cu.with_hash(_f(spark, sf)).select("func_id", "hash_code")


# ------------------------------------------------------------------ de-duplication, unions
@register("dedup_code", sql("""
SELECT cohort, func_id, hash_code FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort, hash_code ORDER BY func_id) AS rn FROM (
    SELECT func_id, hash_code, CASE WHEN label=1 AND latent=0 THEN 'vuln' WHEN label=0 AND latent=0 THEN 'non_vuln'
                                    ELSE 'latent' END AS cohort
    FROM hashed WHERE (label=1 AND latent=0) OR (label=0 AND latent=0) OR (label=1 AND latent=1 AND method='v')))
WHERE rn=1""", "hashed"))
def dedup_code(spark, sf):
    c = cu.with_hash(cu.select_cohorts(_f(spark, sf)))
    d = cu.dedup_first(c.select("cohort", "func_id", "hash_code").withColumn("prio", F.lit(0)),
                       key=["cohort", "hash_code"])
    return d.select("cohort", "func_id", "hash_code")


@register("union_classes", sql("SELECT func_id, hash_code, label FROM sp_base", "sp_base"))
def union_classes(spark, sf):
    c = cu.with_hash(cu.select_cohorts(_f(spark, sf)))
    vuln = c.filter(F.col("cohort") == cu.VULN).select("func_id", "hash_code", "label")
    non_vuln = c.filter(F.col("cohort") == cu.NON_VULN).select("func_id", "hash_code", "label")
    return cu.union_classes(vuln, non_vuln)


@register("augment_train", sql("""
SELECT seed, func_id, hash_code, label, latent FROM splits WHERE split='train_latent'""", "splits"))
def augment_train(spark, sf):
    return splits1(spark, sf).filter(F.col("split") == "train_latent").select(
        "seed", "func_id", "hash_code", "label", "latent")


# ------------------------------------------------------------------ joins
@register("purge_leakage", sql("""
SELECT seed, split, func_id, label FROM splits WHERE split IN ('val','test')""", "splits"))
def purge_leakage(spark, sf):
    return splits1(spark, sf).filter(F.col("split").isin("val", "test")).select("seed", "split", "func_id", "label")


cte("sp_linked", """
SELECT s.seed, l.func_id, l.vfc, l.hash_code FROM seeds s, sp_lat l
WHERE EXISTS (SELECT 1 FROM sp_train t WHERE t.seed=s.seed AND t.func_id IS NOT DISTINCT FROM l.vfc)""",
    "seeds", "sp_lat", "sp_train")


def _linked(spark, sf, drop_func_id: bool):
    f = _f(spark, sf)
    h = cu.with_hash(f)
    c = h.withColumn("cohort", cu.cohort())
    base = cu.dedup_first(c.filter(F.col("cohort").isin(cu.VULN, cu.NON_VULN))
                          .withColumn("prio", F.when(F.col("cohort") == cu.VULN, 0).otherwise(1))
                          .select("func_id", "hash_code", "label", "vfc", "prio"))
    latent = cu.dedup_first(c.filter(F.col("cohort") == cu.LATENT)
                            .select("func_id", "hash_code", "vfc").withColumn("prio", F.lit(0)))
    train = sp.assign_splits(base.withColumn("seed", F.lit(10000).cast("long"))).filter(F.col("split") == "train")
    train = train.select("seed", *([c for c in ["func_id"] if not drop_func_id]), "vfc")
    lat = latent.withColumn("seed", F.lit(10000).cast("long"))
    return cu.link_latent(lat, train, by=["seed"]).select("seed", "func_id", "vfc", "hash_code")


@register("link_latent", sql("SELECT * FROM sp_linked", "sp_linked"))
def link_latent(spark, sf):
    return _linked(spark, sf, drop_func_id=False)


@register("resolve_link_key", sql("""
SELECT s.seed, l.func_id, l.vfc, l.hash_code FROM seeds s, sp_lat l
WHERE EXISTS (SELECT 1 FROM sp_train t WHERE t.seed=s.seed AND t.vfc IS NOT DISTINCT FROM l.vfc)""",
                                  "seeds", "sp_lat", "sp_train"))
def resolve_link_key(spark, sf):
    return _linked(spark, sf, drop_func_id=True)


# ------------------------------------------------------------------ ranking and splits
@register("seeded_shuffle", sql("SELECT seed, func_id, hash_code, rk AS rank FROM sp_assigned", "sp_assigned",
                                 overrides={"seeds": SEEDS10}))
def seeded_shuffle(spark, sf):
    base = _base(spark, sf)
    keyed = sp._with_seeds(base, sp.DEFAULT_SEEDS).withColumn("_okey", sp.order_key())
    r = hash_rank(keyed, "_okey", group_cols=["seed"], tiebreak=["hash_code"])
    return r.select("seed", "func_id", "hash_code", F.col("_rank").alias("rank"))


def _base(spark, sf):
    c = cu.with_hash(_f(spark, sf)).withColumn("cohort", cu.cohort())
    return cu.dedup_first(c.filter(F.col("cohort").isin(cu.VULN, cu.NON_VULN))
                          .withColumn("prio", F.when(F.col("cohort") == cu.VULN, 0).otherwise(1))
                          .select("func_id", "hash_code", "label", "prio"))


@register("split_train_val_test", sql("SELECT seed, func_id, split FROM sp_assigned", "sp_assigned",
                                      overrides={"seeds": SEEDS10}))
def split_train_val_test(spark, sf):
    return sp.assign_splits(sp._with_seeds(_base(spark, sf), sp.DEFAULT_SEEDS)).select("seed", "func_id", "split")


@register("row_index", sql("""
SELECT seed, func_id, (row_number() OVER (PARTITION BY seed ORDER BY rk) - 1) AS "index"
FROM sp_assigned WHERE split='test'""", "sp_assigned", overrides={"seeds": SEEDS10}))
def row_index(spark, sf):
    """0-based ordinal of each test row in file (permutation) order, per seed."""
    s = sp.assign_splits(sp._with_seeds(_base(spark, sf), sp.DEFAULT_SEEDS)).filter(F.col("split") == "test")
    s = s.withColumn("_okey", sp.order_key())
    r = hash_rank(s.drop("_rank"), "_okey", group_cols=["seed"], tiebreak=["hash_code"])
    return r.select("seed", "func_id", (F.col("_rank") - 1).alias("index"))


@register("build_splits", sql("SELECT * FROM splits", "splits", overrides={"seeds": SEEDS10}))
def build_splits(spark, sf):
    return splits10(spark, sf)


LATEST_LAT = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_code ORDER BY func_id) AS rn
  FROM (SELECT func_id, label, latent, 'v' AS method, vfc, hash_code FROM hashed WHERE latent=1)
  WHERE label=1 AND latent=1 AND method='v') WHERE rn=1"""


def latest_latent(f):
    """The 'latest' latent table: every traced row, attributed to the 'v' tracer."""
    return f.filter(F.col("latent") == 1).withColumn("method", F.lit("v"))


@register("build_splits_latest", sql("SELECT * FROM splits WHERE split='train_latent'", "splits",
                                     overrides={"seeds": SEEDS10, "sp_lat_aug": LATEST_LAT}))
def build_splits_latest(spark, sf):
    f = _f(spark, sf)
    s = sp.build_splits(f, seeds=sp.DEFAULT_SEEDS, latent_source=latest_latent(f))
    return s.filter(F.col("split") == "train_latent")


@register("label_counts", sql("""
SELECT seed, split, label, latent, count(*) AS n FROM splits GROUP BY ALL""", "splits",
                              overrides={"seeds": SEEDS10}))
def label_counts(spark, sf):
    return cu.label_counts(splits10(spark, sf), "seed", "split", "label", "latent")


def mixed_latent(f_src, latest_projects):
    """Latent source chosen per project: the 'latest' table for ``latest_projects``, the plain
    latent rows elsewhere (one project's tracer output may be missing)."""
    latest = latest_latent(f_src).filter(F.col("source").isin(*latest_projects))
    plain = f_src.filter(~F.col("source").isin(*latest_projects))
    return latest.unionByName(plain)


# Projects whose latent rows come from the 'latest' table in the mixed P2 variant.
LATEST_PROJECTS = ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9"]
MIXED_LAT = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_code ORDER BY func_id) AS rn FROM (
    SELECT h.func_id, h.label, h.latent,
           CASE WHEN d.source IN ({", ".join(repr(p) for p in LATEST_PROJECTS)}) AND h.latent = 1 THEN 'v'
                ELSE h.method END AS method,
           h.vfc, h.hash_code
    FROM hashed h JOIN documents d ON h.func_id = d.doc_id
    WHERE NOT (d.source IN ({", ".join(repr(p) for p in LATEST_PROJECTS)}) AND h.latent <> 1))
  WHERE label=1 AND latent=1 AND method='v') WHERE rn=1"""


@register("build_splits_latest_mixed", sql("SELECT * FROM splits WHERE split='train_latent'", "splits",
                                           overrides={"seeds": SEEDS10, "sp_lat_aug": MIXED_LAT}))
def build_splits_latest_mixed(spark, sf):
    """P2 with a per-project latent source ('latest' for half the projects, plain elsewhere)."""
    f = tb.functions(spark, sf, extra=("source",))
    s = sp.build_splits(f.drop("source"), seeds=sp.DEFAULT_SEEDS, latent_source=mixed_latent(f, LATEST_PROJECTS))
    return s.filter(F.col("split") == "train_latent")
