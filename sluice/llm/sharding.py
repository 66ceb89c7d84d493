"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order inside each stratum (the source), every row gets its
fractional rank ``(rank - 1/2) / stratum size``, all rows are sorted by that fraction, and
the sorted sequence is cut into shards of equal row counts (at most one apart). A shard is
thus a slice of the same width of every stratum, so each shard has the mixture of the whole.

Scale: no window spans a stratum or the table. The seeded key is uniform, so its leading
bits deal a stratum into buckets; bucket counts become rank offsets (one narrow pass). The
position of the fraction's buckets in the whole order needs no second pass: how many rows
of a stratum of n rows lie below a fraction is a closed formula of n. There are as many buckets
as shuffle partitions, or rows / ``rows_per_bucket`` if that is more; the offset tables have one
entry a bucket and stratum and are joined without a broadcast hint. Only keys and a digest of
each row are ranked, equal rows as one; whole rows are shuffled once, to get their places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.columns import hash_bits, put_back, row_digest, unpacked

KEY_DIGITS = 15


def interleaved_shards(spark: SparkSession, df: DataFrame, n_shards: int, stratum: Column, key: Column,
                       seed: int = 17, tie: Column | None = None, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``n_shards`` - 1) and ``slot`` (long, gapless from 0 in
    each shard).

    Null strata are one stratum; null keys hash as the empty string. Rows with equal keys are
    ordered by ``tie`` (default: a hash of the whole row), so only rows equal in every column
    can swap places, which changes nothing. An empty input gives an empty result with the same
    columns; with fewer rows than shards some shards stay empty. Input columns named ``shard``
    or ``slot`` are replaced.
    """
    columns = df.columns
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in columns]) if tie is None else tie
    rows = df.select(stratum.cast("string").alias("s"), hash_bits(seed, key, KEY_DIGITS).alias("k"), key.alias("id"),
                     tie.alias("tie"), row_digest(df).alias("digest"))
    narrow = rows.groupBy("s", "k", "id", "tie", "digest").agg(F.count(F.lit(1)).alias("n")).checkpoint()

    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, math.ceil(total / rows_per_bucket), min(total, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bits = math.ceil(math.log2(slices))
    def bucket_of(k):
        return F.shiftright(k, 4 * KEY_DIGITS - bits) if bits else F.lit(0).cast("long")
    counts = narrow.groupBy("s", bucket_of(F.col("k")).alias("b")).agg(F.sum("n").alias("n"))
    in_stratum = Window.partitionBy("s")
    ranks = counts.select("s", "b", (F.sum("n").over(in_stratum.orderBy("b")) - F.col("n")).alias("below"),
                          F.sum("n").over(in_stratum).alias("ns")).checkpoint()

    strata = ranks.groupBy("s").agg(F.max("ns").alias("ns"))
    # rows of a stratum whose fraction lies below g / slices, in whole numbers
    lower = strata.select("ns", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("g"))
    lower = lower.groupBy("g").agg(
        F.sum(F.expr(f"((2 * ns * g + {slices - 1}L) div {slices}L) div 2L")).alias("start"))

    same = F.col("l.s").eqNullSafe(F.col("r.s")) & (F.col("l.b") == F.col("r.b"))
    ranked = (narrow.withColumn("b", bucket_of(F.col("k"))).alias("l").join(ranks.alias("r"), same)
              .select("l.*", "r.below", "r.ns"))
    in_bucket = Window.partitionBy("s", "b").orderBy("k", "id", "tie", "digest").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("last", F.col("below") + F.sum("n").over(in_bucket))
    ranked = ranked.withColumn("r", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))))
    ranked = ranked.select("digest", "n", "k", "id", "tie", "s", ((F.col("r") - 0.5) / F.col("ns")).alias("fraction"),
                           F.expr(f"((2 * r - 1) * {slices}L) div (2 * ns)").cast("int").alias("g"))
    placed = ranked.join(lower, "g")
    in_slice = Window.partitionBy("g").orderBy("fraction", "k", "id", F.col("s").asc_nulls_last(), "tie", "digest")
    placed = placed.withColumn("p", F.col("start") + F.row_number().over(in_slice) - 1)
    placed = placed.withColumn("shard", F.expr(f"(p * {n_shards}L) div {max(total, 1)}L").cast("int"))
    slot = F.expr(f"p - ((shard * {total}L + {n_shards - 1}L) div {n_shards}L)")
    placed = placed.select("digest", "n", "shard", slot.alias("slot")).checkpoint()
    return unpacked(put_back(df, placed), columns, shard=F.col("shard"), slot=F.col("slot"))
