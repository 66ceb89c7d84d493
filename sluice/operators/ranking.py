"""Exact global ranks and running sums without a single-task window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. Both primitives
here split the order into buckets that are monotone in the sort key, count each bucket in
a tiny table, turn the counts into offsets, and rank inside each bucket in parallel:

* ``hash_rank`` -- for uniformly distributed hex keys (SHA-256 order keys). The bucket is
  a key prefix, so the bucketing is a pure expression: no sampling, no persisted copy.
* ``range_rank`` -- for arbitrary sort keys (scores with hot values). Buckets come from a
  range exchange, which samples the *full* composite key, so a score value shared by a
  third of all rows is still split by its tie-breakers. The sorted rows are written to the
  shared checkpoint folder with their bucket and place, so both stay fixed when later stages
  read them (and survive executor loss); positions and running sums are windows over a bucket.

Offsets tables have one row per bucket (or, with group columns, one row per bucket of a
group that crosses a bucket boundary -- about two per bucket); their size is checked before
they are broadcast. Bucket counts follow the data: hex-prefix length from the row count,
range buckets from the shuffle partitions or a known row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import scratch_path

MAX_BROADCAST_ROWS = 2_000_000
# Target rows per rank bucket: one bucket is sorted by one task.
ROWS_PER_BUCKET = 4_000_000


def hex_digits_for(rows: int, groups: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex prefix length so that each (group, prefix) bucket of a uniform hex key holds about
    ``rows_per_bucket`` rows at most (at least 3 digits = 4096 buckets)."""
    digits = 3
    while rows / max(groups, 1) / (16 ** digits) > rows_per_bucket:
        digits += 1
    return digits


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL groups matching each other."""
    n = offsets.count()
    side = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in keys], *[c for c in offsets.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = df.join(F.broadcast(side) if n <= MAX_BROADCAST_ROWS else side, on, how)
    return joined.drop(*[f"_o_{c}" for c in keys])


def _offsets(stats: DataFrame, group_cols: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running totals of bucket counts/sums within each group, plus group totals."""
    w = Window.partitionBy(*group_cols).orderBy("_b") if group_cols else Window.orderBy("_b")
    wall = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    cols = [(F.sum("_n").over(w) - F.col("_n")).alias("_off_n"), F.sum("_n").over(wall).alias("_group_n")]
    for c, s in sums.items():
        cols.append((F.sum(s).over(w) - F.col(s)).alias(f"_off_{c}"))
        cols.append(F.sum(s).over(wall).alias(f"_group_{c}"))
    return stats.select(*group_cols, "_b", *cols)


def hash_rank(df: DataFrame, key: str, group_cols: list[str] | None = None, tiebreak: list[str] | None = None,
              hex_digits: int = 3) -> DataFrame:
    """1-based rank ``_rank`` of each row within its group by ascending hex ``key`` (then
    ``tiebreak``), and the group size ``_group_n``. Rows with a NULL key rank last; NULL group
    values form a group. At most 15 digits (a bigint) are used for the bucket."""
    group_cols = list(group_cols or [])
    tiebreak = list(tiebreak or [])
    hex_digits = min(hex_digits, 15)
    prefix = F.conv(F.substring(F.col(key), 1, hex_digits), 16, 10).cast("bigint")
    b = df.withColumn("_b", F.coalesce(prefix, F.lit(16 ** hex_digits).cast("bigint")))
    stats = b.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(stats, group_cols, {}).checkpoint()
    w = Window.partitionBy(*group_cols, "_b").orderBy(F.col(key).asc_nulls_last(), *[F.col(c) for c in tiebreak])
    ranked = b.withColumn("_rn", F.row_number().over(w))
    out = _join_offsets(ranked, offsets, group_cols + ["_b"])
    return out.withColumn("_rank", F.col("_off_n") + F.col("_rn")).drop("_b", "_rn", "_off_n")


def range_rank(spark: SparkSession, df: DataFrame, order: list[Column], group_cols: list[str] | None = None,
               running: list[str] | None = None, num_buckets: int | None = None, totals: bool = False,
               name: str = "ranked", rows: int | None = None) -> DataFrame:
    """Exact 1-based rank ``_rank`` within each group by ``order`` (must be a total order:
    include tie-breakers) and inclusive running sums ``cum_<c>`` of ``running`` columns.
    With ``totals`` the group size ``_group_n`` and sums ``_group_<c>`` are added. ``rows``
    (a known input size) raises the bucket count so no bucket exceeds ``ROWS_PER_BUCKET``.

    The ranked rows are persisted under the shared checkpoint folder (``name``). Buckets are
    monotone in (group, order), so only groups that cross a bucket boundary -- at most about
    two per bucket -- need offsets: that table is bounded by the bucket count and broadcast;
    every other row's offset is 0. No data-sized join is needed unless ``totals`` is asked
    for with group columns.
    """
    group_cols = list(group_cols or [])
    running = list(running or [])
    if num_buckets is None:
        # one bucket per shuffle partition (sized to the data by the cluster), more when the
        # caller knows the row count (e.g. of a persisted input) and buckets would be too big
        base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        num_buckets = max(base, -(-rows // ROWS_PER_BUCKET)) if rows else base
    sort_keys = [F.col(c) for c in group_cols] + list(order)
    staged = (df.repartitionByRange(num_buckets, *sort_keys)
                .sortWithinPartitions(*sort_keys)
                .withColumn("_b", F.spark_partition_id())
                .withColumn("_at", F.monotonically_increasing_id()))
    path = scratch_path(spark, name)
    staged.write.parquet(path)
    fixed = spark.read.parquet(path)
    # rows of a bucket in the order in which its task sorted them
    w = Window.partitionBy(*group_cols, "_b").orderBy("_at")
    local = fixed.withColumn("_pos", F.row_number().over(w) - 1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in running:
        local = local.withColumn(f"_cum_{c}", F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(upto))
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in running]
    stats = fixed.groupBy(*group_cols, "_b").agg(*aggs)
    sums = {c: f"_s_{c}" for c in running}
    if group_cols:
        # groups present in more than one bucket (bounded by the bucket count)
        spanning = Window.partitionBy(*group_cols)
        stats_span = stats.withColumn("_k", F.count(F.lit(1)).over(spanning)).filter("_k > 1").drop("_k")
        offsets = _offsets(stats_span, group_cols, sums).checkpoint()
        out = _join_offsets(local, offsets, group_cols + ["_b"], "left")
    else:
        offsets = _offsets(stats, group_cols, sums).checkpoint()
        out = _join_offsets(local, offsets, ["_b"])
    zero = F.lit(0)
    cols = [F.col(c) for c in df.columns]
    cols.append((F.coalesce(F.col("_off_n"), zero) + F.col("_pos") + 1).alias("_rank"))
    for c in running:
        cols.append((F.coalesce(F.col(f"_off_{c}"), F.lit(0.0)) + F.col(f"_cum_{c}")).alias(f"cum_{c}"))
    ranked = out.select(*cols)
    if not totals:
        return ranked
    if not group_cols:
        tot = offsets.select(F.first("_group_n").alias("_group_n"),
                             *[F.first(f"_group_{c}").alias(f"_group_{c}") for c in running]).limit(1)
        return ranked.crossJoin(F.broadcast(tot))  # one row
    per_group = stats.groupBy(*group_cols).agg(F.sum("_n").alias("_group_n"),
                                               *[F.sum(f"_s_{c}").alias(f"_group_{c}") for c in running])
    side = per_group.select(*[F.col(c).alias(f"_o_{c}") for c in group_cols],
                            *[c for c in per_group.columns if c not in group_cols])
    on = F.lit(True)
    for c in group_cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return ranked.join(side, on, "inner").drop(*[f"_o_{c}" for c in group_cols])
