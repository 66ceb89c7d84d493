"""Curation operators: cohort filters, content-hash de-duplication, ordered unions.

De-duplication is a hash aggregate keyed by ``hash_code`` that keeps the row with the
smallest ``(prio, func_id)``: partial aggregation runs map-side, so a hash shared by a
third of all rows is reduced to one row per task before the shuffle. ``dropDuplicates``
is never used because the row it keeps is undefined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.code import code_hash

# Cohort names (fixed values of the split builder).
VULN, NON_VULN, LATENT = "vuln", "non_vuln", "latent"


def cohort(method: str = "v") -> Column:
    """original vulnerable (label=1, latent=0), non-vulnerable (label=0, latent=0),
    latent (label=1, latent=1, traced by ``method``). NULL latent belongs to no cohort."""
    lab, lat = F.col("label"), F.col("latent")
    return (F.when((lab == 1) & (lat == 0), F.lit(VULN))
            .when((lab == 0) & (lat == 0), F.lit(NON_VULN))
            .when((lab == 1) & (lat == 1) & (F.col("method") == method), F.lit(LATENT)))


def select_cohorts(f: DataFrame, method: str = "v") -> DataFrame:
    return f.withColumn("cohort", cohort(method)).filter(F.col("cohort").isNotNull())


def is_latent() -> Column:
    """``latent <=> 1``; NULL counts as non-latent."""
    return F.col("latent").eqNullSafe(1)


def split_latent(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(non-latent, latent) halves of a table."""
    return df.filter(~is_latent()), df.filter(is_latent())


def tag_latent(df: DataFrame, value: int) -> DataFrame:
    """overwrite ``latent`` with a constant per source."""
    return df.withColumn("latent", F.lit(int(value)).cast("int"))


def with_hash(df: DataFrame) -> DataFrame:
    """C1 as a column ``hash_code``."""
    return df.withColumn("hash_code", code_hash("code"))


def dedup_first(df: DataFrame, key="hash_code", order: tuple[str, ...] = ("prio", "func_id"),
                drop: tuple[str, ...] = ("prio",)) -> DataFrame:
    """A2: one row per ``key`` (a column or list of columns), the one with the smallest
    ``order`` tuple."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    out = picked.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])
    return out.select(*[c for c in df.columns if c not in drop])


def ordered_union(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name, tagging each part with its position as ``prio`` (0 first)."""
    tagged = [p.withColumn("prio", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_classes(vuln: DataFrame, non_vuln: DataFrame) -> DataFrame:
    """Vulnerable and non-vulnerable; a hash present in both resolves to vulnerable."""
    return dedup_first(ordered_union(vuln, non_vuln))


def augment_train(latent: DataFrame, train: DataFrame, key="hash_code") -> DataFrame:
    """Latent rows before training rows; on a shared hash (or ``key``) the latent row wins."""
    return dedup_first(ordered_union(latent, train), key=key)


def rebuild_train(non_latent: DataFrame, kept_latent: DataFrame) -> DataFrame:
    """U4: UNION ALL without de-duplication."""
    return non_latent.unionByName(kept_latent, allowMissingColumns=True)


def label_counts(df: DataFrame, *keys: str) -> DataFrame:
    """A1: row count per key tuple."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def link_key(df: DataFrame) -> str:
    """the training-side link key: ``func_id`` when the column exists, else ``vfc``."""
    return "func_id" if "func_id" in df.columns else "vfc"


def link_latent(latent: DataFrame, train: DataFrame, by=()) -> DataFrame:
    """Latent rows whose parent ``vfc`` is a key of the training split (null-safe), within the groups ``by``
    (e.g. the seed)."""
    keys = train.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(link_key(train)).alias("_k"))
    on = latent["vfc"].eqNullSafe(keys["_k"])
    for i, c in enumerate(by):
        on = on & (latent[c] == keys[f"_by{i}"])
    return latent.join(keys, on, "left_semi")


def purge_leakage(split: DataFrame, latent: DataFrame) -> DataFrame:
    """Drop val/test rows (label 0 or 1) whose code hash occurs in the latent set."""
    hashes = latent.select(F.col("hash_code").alias("_h"))
    return split.join(hashes, (split["hash_code"] == hashes["_h"]) & split["label"].isin(0, 1), "left_anti")
