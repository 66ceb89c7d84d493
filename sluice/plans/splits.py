"""Leakage-free, seeded train/val/test splits augmented with latent positives.

One plan for all seeds: the seed is a column (rows are generated per seed, not joined),
so ten permutations, purges and augmentations share each shuffle. Only narrow key
columns travel through the shuffles, the content hash as its 32 bytes; code text is joined back at
the end when asked for. The keyed table, the de-duplicated base and the ranked splits are each
computed once and stored below the shared folder; training, held-out, link and augmentation
branches read the stored ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.curate import (LATENT, NON_VULN, VULN, augment_train, cohort, dedup_first, link_latent,
                                     purge_leakage, with_hash)
from sluice.operators.ranking import hash_rank, hex_digits_for
from sluice.session import persist_table

KEY_COLS = ["func_id", "hash_code", "label", "latent", "method", "vfc"]
SPLIT_COLS = ["seed", "split"] + KEY_COLS
# Split fractions of the reference recipe.
TRAIN_FRACTION = 0.8
VAL_FRACTION_OF_REST = 0.5
DEFAULT_SEEDS = tuple(10000 * r for r in range(1, 11))


def _with_seeds(df: DataFrame, seeds) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))


def order_key(seed="seed", hash_code="hash_code"):
    """Seeded permutation key; reproducible and independent of partitioning. ``hash_code`` is hex text."""
    return F.sha2(F.concat_ws("|", F.col(seed), F.col(hash_code) if isinstance(hash_code, str) else hash_code), 256)


def assign_splits(base: DataFrame, train_fraction: float = TRAIN_FRACTION,
                  val_fraction: float = VAL_FRACTION_OF_REST, hex_digits: int = 3) -> DataFrame:
    """W1 + W2: exact-size split by seeded rank: train = first floor(0.8 n); of the rest r,
    val = next floor(0.5 r); test = remainder."""
    binary = dict(base.dtypes)["hash_code"] == "binary"
    keyed = base.withColumn("_okey", order_key(hash_code=F.lower(F.hex("hash_code")) if binary else "hash_code"))
    ranked = hash_rank(keyed, "_okey", group_cols=["seed"], tiebreak=["hash_code"], hex_digits=hex_digits)
    n = F.col("_group_n")
    n_train = F.floor(n * F.lit(float(train_fraction)))
    n_val = F.floor((n - n_train) * F.lit(float(val_fraction)))
    split = (F.when(F.col("_rank") <= n_train, F.lit("train"))
             .when(F.col("_rank") <= n_train + n_val, F.lit("val"))
             .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_okey", "_group_n")


def build_splits(f: DataFrame, seeds=(10000,), method: str = "v", latent_source: DataFrame | None = None,
                 with_code: bool = False, strict_purge: bool = False) -> DataFrame:
    """P1 (and P2 when ``latent_source`` gives the 'latest' latent table).

    Val/test are always purged against the latent rows of ``f`` (P2 reuses P1's held-out
    sets). ``strict_purge`` additionally drops augmenting latent rows whose hash occurs in that
    seed's val/test (the reference does not re-purge the 'latest' rows; default parity).

    Returns rows ``(seed, split, func_id, hash_code, label, latent, method, vfc)`` with split in
    train / val / test / train_latent.
    """
    spark = f.sparkSession

    def keyed(t: DataFrame) -> DataFrame:
        named = with_hash(t.select(*[c for c in KEY_COLS if c != "hash_code"], "code")).select(*KEY_COLS)
        return named.withColumn("hash_code", F.unhex("hash_code"))

    # SHA-256 over the code is computed a single time however many jobs read the keys
    h = persist_table(spark, keyed(f), "keyed_functions")
    c = h.withColumn("cohort", cohort(method))
    # U1 + A2: per-cohort and cross-cohort keep-first collapse into one de-duplication
    # ordered by (vulnerable first, smallest func_id).
    classes = (c.filter(F.col("cohort").isin(VULN, NON_VULN))
                .withColumn("prio", F.when(F.col("cohort") == VULN, 0).otherwise(1))
                .drop("cohort"))
    base = persist_table(spark, dedup_first(classes), "split_base")
    purge_latent = dedup_first(c.filter(F.col("cohort") == LATENT).drop("cohort").withColumn("prio", F.lit(0)))
    if latent_source is None:
        latent = purge_latent
    else:
        lat = keyed(latent_source).filter((F.col("label") == 1) & (F.col("latent") == 1) & (F.col("method") == method))
        latent = dedup_first(lat.withColumn("prio", F.lit(0)))

    # bucket count from the size of the base (stored, so counting is cheap)
    ranked = assign_splits(_with_seeds(base, seeds), hex_digits=hex_digits_for(base.count()))
    splits = persist_table(spark, ranked.select(*SPLIT_COLS), "ranked_splits")
    train = splits.filter(F.col("split") == "train")
    # Purge val/test rows whose hash occurs among the latent rows (label 0 or 1).
    held = purge_leakage(splits.filter(F.col("split") != "train"), purge_latent)
    # F9 + J2: latent rows whose parent is a training key (null-safe, per seed).
    linked = link_latent(_with_seeds(latent, seeds), train, by=["seed"])
    if strict_purge:
        held_h = held.select("seed", "hash_code")
        linked = linked.join(held_h, ["seed", "hash_code"], "left_anti")
    # U2 + A2: latent before train; on a shared hash the latent row wins.
    aug = augment_train(linked, train.drop("split"), key=["seed", "hash_code"]).withColumn("split", F.lit("train_latent"))
    out = train.unionByName(held).unionByName(aug.select(*train.columns))
    out = out.withColumn("hash_code", F.lower(F.hex("hash_code"))).select(*SPLIT_COLS)
    if with_code:
        code = f.select("func_id", "code", "flaw_line", "flaw_line_index")
        out = out.join(code, "func_id", "inner")
    return out
