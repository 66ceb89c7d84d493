"""Queries for centroid and self-training denoising."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import register
from sluice.catalog.curation import splits1
from sluice.oracle import cte, sql
from sluice.operators import denoise as dn
from sluice.operators.curate import is_latent
from sluice.session import persist_table
from sluice.sources import tables as tb

cte("emb", """
SELECT vec_id, embedding::DOUBLE[] AS embedding,
       CASE WHEN label < 3 THEN 'pos' WHEN label <= 6 THEN 'neg' ELSE 'latent' END AS role
FROM embeddings""")
cte("centroids", """
SELECT role, list(m ORDER BY dim) AS centroid FROM (
  SELECT role, dim, avg(x) AS m FROM (
    SELECT role, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM emb
    WHERE role IN ('pos', 'neg'))
  GROUP BY role, dim)
GROUP BY role""", "emb")
COS = ("1.0 - list_inner_product({v}, {c}) / nullif(sqrt(list_inner_product({v}, {v})) * "
       "sqrt(list_inner_product({c}, {c})), 0.0)")
cte("emb_dist", f"""
SELECT e.vec_id, e.role, {COS.format(v='e.embedding', c='p.centroid')} AS d_pos,
       {COS.format(v='e.embedding', c='n.centroid')} AS d_neg
FROM emb e, (SELECT centroid FROM centroids WHERE role = 'pos') p, (SELECT centroid FROM centroids WHERE role = 'neg') n""",
    "emb", "centroids")


def _emb(spark, sf):
    return tb.embeddings(spark, sf)


def _pair(spark, sf):
    e = _emb(spark, sf)
    c = dn.class_centroids(e.filter(F.col("role").isin("pos", "neg")), "embedding", "role")
    return dn.centroid_pair(c, "role", "pos", "neg")


@register("class_centroids", sql("""
SELECT role, (generate_subscripts(centroid, 1) - 1)::INTEGER AS dim, round(unnest(centroid), 9) AS value
FROM centroids""", "centroids"))
def class_centroids(spark, sf):
    e = _emb(spark, sf)
    c = dn.class_centroids(e.filter(F.col("role").isin("pos", "neg")), "embedding", "role")
    return c.select("role", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 9))


@register("cosine_distance", sql("SELECT vec_id, round(d_pos, 9) AS d_pos FROM emb_dist", "emb_dist"))
def cosine_distance(spark, sf):
    d = dn.centroid_distance(_emb(spark, sf), "embedding", _pair(spark, sf))
    return d.select("vec_id", F.round("d_pos", 9).alias("d_pos"))


@register("centroid_distance", sql("""
SELECT vec_id, round(d_pos, 9) AS d_pos, round(d_neg, 9) AS d_neg FROM emb_dist WHERE role = 'latent'""", "emb_dist"))
def centroid_distance(spark, sf):
    latent = _emb(spark, sf).filter(F.col("role") == "latent")
    d = dn.centroid_distance(latent, "embedding", _pair(spark, sf))
    return d.select("vec_id", F.round("d_pos", 9).alias("d_pos"), F.round("d_neg", 9).alias("d_neg"))


@register("centroid_filter", sql("SELECT vec_id FROM emb_dist WHERE role = 'latent' AND d_pos < 1.0 * d_neg",
                                 "emb_dist"))
def centroid_filter(spark, sf):
    return _filtered(spark, sf).filter(F.col("role") == "latent").select("vec_id")


def _filtered(spark, sf):
    """M5 over the vectors: centroids of the two original classes, latent rows kept by distance."""
    role = F.col("role")
    train = _emb(spark, sf).select("vec_id", "embedding", "role", F.when(role == "latent", 1).otherwise(0).alias("latent"),
                                   F.when(role == "pos", 1).when(role == "neg", 0).alias("label"))
    return dn.centroid_filter(train, "embedding", alpha=1.0)


@register("rebuild_train", sql("""
SELECT vec_id, role FROM emb_dist WHERE role <> 'latent'
UNION ALL SELECT vec_id, role FROM emb_dist WHERE role = 'latent' AND d_pos < 1.0 * d_neg""", "emb_dist"))
def rebuild_train_q(spark, sf):
    """U4 on the centroid path: non-latent vectors plus the kept latent vectors."""
    return _filtered(spark, sf).select("vec_id", "role")


# ------------------------------------------------------------------ self-training path
cte("st_latent", """
SELECT s.func_id, s.label, s.latent,
  ((0.6::DOUBLE * (('0x'||substr(sha256(f.code),1,8))::BIGINT / 4294967296::DOUBLE) + 0.4::DOUBLE * s.label::DOUBLE)
    > 0.5)::INTEGER AS y_pred
FROM splits s JOIN functions f USING (func_id)
WHERE s.split = 'train_latent' AND s.latent IS NOT DISTINCT FROM 1""", "splits", "functions")


def _train_latent(spark, sf):
    """The augmented training split (seed 10000), persisted once: it is read twice (latent
    rows to score, and the rebuild)."""
    return persist_table(spark, splits1(spark, sf).filter(F.col("split") == "train_latent"), "train_latent")


def _scored_latent(spark, sf, train):
    """Scores of the latent training rows by the stand-in scorer (given scores)."""
    code = tb.functions(spark, sf).select("func_id", "code")
    lat = train.filter(is_latent()).join(code, "func_id")
    return tb.score_hash_model(lat).select("func_id", "y_pred")


@register("drop_flagged", sql("SELECT func_id FROM st_latent WHERE y_pred <> 1", "st_latent"))
def drop_flagged(spark, sf):
    train = _train_latent(spark, sf)
    flagged = _scored_latent(spark, sf, train).filter(F.col("y_pred") == 1)
    return dn.drop_flagged(train.filter(is_latent()), flagged).select("func_id")


@register("self_training_filter", sql("""
SELECT func_id, label, latent FROM splits WHERE split = 'train_latent' AND NOT (latent IS NOT DISTINCT FROM 1)
UNION ALL SELECT func_id, label, latent FROM st_latent WHERE y_pred <> 1""", "splits", "st_latent"))
def self_training_filter(spark, sf):
    train = _train_latent(spark, sf)
    return dn.self_training_filter(train.select("func_id", "label", "latent"), _scored_latent(spark, sf, train),
                                   keep="negative")
