"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target says how many words the mix takes from it. Every document first gets
the whole copies that are certain: the integer part of its expected number of copies
``target / source size``. The fractional part is its inclusion probability ``pi`` for one
more copy. Documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (pi / (1 - pi))`` with ``u`` a hash of seed and key, and the lowest ranks
are taken until the source's remaining words are used up, cutting at the nearest document: a
sample of fixed size (in words) with unequal probabilities. With ``weight`` the expected
copies of a document are in proportion to it.

Scale: ranks are dealt into buckets of about equal size, bucket sums become word offsets, and
running sums are taken inside a bucket, so a hot source is spread over many tasks. Sizes, keys
and a digest of each row are all that is ranked, equal rows as one; whole rows are shuffled
once. Only the table of sources (one row each) meets in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.columns import WORD, hash_bits, put_back, row_digest, unpacked

U_DIGITS = 13  # 52 bits: u is exact in a double


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """One row per source of ``sizes`` (s, size): ``source_size`` and ``target``. Sources in
    code point order (null last) weigh ``cycle`` in turn and share all words by weight; a
    target stops at ``max_copies`` times the source's size and the excess is shared again by
    weight among the others until none is above (the limit of that is found at once: sources
    are capped in ascending order of limit over weight)."""
    by_source = sizes.groupBy("s").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("s").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in cycle]),
                          (F.pmod(F.row_number().over(names) - 1, F.lit(len(cycle))) + 1).cast("int"))
    t = by_source.select("s", "source_size", weight.alias("w"))
    t = t.withColumn("most", max_copies * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("s").asc_nulls_last())
    everyone = Window.partitionBy()
    t = t.select("*", F.sum("source_size").over(everyone).alias("words"),
                 (F.sum("most").over(order) - F.col("most")).alias("most_before"),
                 (F.sum("w").over(everyone) - F.sum("w").over(order) + F.col("w")).alias("w_from"))
    full = F.col("most") / F.col("w") <= (F.col("words") - F.col("most_before")) / F.col("w_from")
    t = t.withColumn("full", full)
    free = ((F.col("words") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everyone))
            / F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everyone))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(free * F.col("w"))
    return t.select("s", "source_size", target.alias("target"))


def pareto_mix(spark: SparkSession, df: DataFrame, source: Column, key: Column, size: Column, seed: int = 23,
               weight: Column | None = None, cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3,
               rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` (of its source) and ``copies`` (0 to
    ``max_copies``). The result is the same on every run.

    Null sources are one source, null keys hash as the empty string. Documents of size 0 take
    no words whatever their copies. Equal ranks (repeated rows) are ordered by a hash of the
    key, size and source; equal rows swap freely. An empty input gives an empty result. Input
    columns with the name of an output column are replaced. With ``weight``, documents at the
    copy limit can leave a source short of its target.
    """
    columns = df.columns
    keyed = df.select(source.cast("string").alias("s"), key.alias("id"), size.alias("size"),
                      (F.lit(1.0) if weight is None else weight.cast("double")).alias("wt"),
                      hash_bits(seed, key, U_DIGITS).alias("k"), row_digest(df).alias("digest"))
    narrow = (keyed.groupBy("s", "id", "size", "wt", "k", "digest").agg(F.count(F.lit(1)).alias("n"))
              .checkpoint())  # the texts are read once for sizes
    targets = source_targets(narrow.select("s", (F.col("size") * F.col("n")).alias("size")), cycle, max_copies)
    heavy = narrow.groupBy("s").agg(F.sum(F.col("wt") * F.col("size") * F.col("n")).alias("weighted"))
    targets = (targets.alias("t").join(heavy.alias("h"), F.col("t.s").eqNullSafe(F.col("h.s")))
               .select("t.*", "h.weighted").checkpoint())

    def expected(rows: DataFrame) -> DataFrame:
        j = (rows.alias("l").join(targets.alias("t"), F.col("l.s").eqNullSafe(F.col("t.s")))
             .select("l.*", "t.source_size", "t.target", "t.weighted"))
        if weight is None:
            share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        else:
            share = F.when(F.col("weighted") > 0, F.col("target") * F.col("wt") / F.col("weighted"))
        j = j.withColumn("e", F.least(F.lit(float(max_copies)), F.coalesce(share, F.lit(0.0))))
        j = j.withColumn("sure", F.floor("e").cast("int")).withColumn("pi", F.col("e") - F.floor("e"))
        u = (F.col("k") + 0.5) / float(2 ** (4 * U_DIGITS))
        q = (u * (1.0 - F.col("pi"))) / ((1.0 - u) * F.col("pi"))
        return j.withColumn("q", F.when(F.col("pi") > 0, q))

    total = narrow.count()
    buckets = max(1, math.ceil(total / rows_per_bucket), min(total, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = expected(narrow)
    # q is u again where pi is the middle of its source: buckets of that are even
    if weight is None:
        rows = rows.withColumn("middle", F.col("pi"))
    else:
        middles = rows.groupBy("s").agg(F.avg(F.when(F.col("pi") > 0, F.col("pi"))).alias("middle")).checkpoint()
        rows = (rows.alias("l").join(middles.alias("m"), F.col("l.s").eqNullSafe(F.col("m.s")))
                .select("l.*", "m.middle"))
    even = F.col("q") * F.col("middle") / (F.col("q") * F.col("middle") + (1.0 - F.col("middle")))
    rows = rows.withColumn("b", F.least(F.lit(buckets - 1), F.floor(even * buckets)).cast("int"))
    words = F.col("size") * F.col("n")
    sums = rows.groupBy("s", "b").agg(F.sum(F.when(F.col("q").isNotNull(), words)).alias("words"),
                                      F.sum(F.col("sure") * words).alias("sure_words"))
    per_source = Window.partitionBy("s")
    before = F.sum("words").over(per_source.orderBy(F.col("b").asc_nulls_first())) - F.col("words")
    offsets = sums.select("s", "b", F.coalesce(before, F.lit(0)).alias("before"),
                          F.sum("sure_words").over(per_source).alias("sure_words")).checkpoint()

    full = (rows.alias("l").join(offsets.alias("o"), F.col("l.s").eqNullSafe(F.col("o.s"))
                                 & F.col("l.b").eqNullSafe(F.col("o.b")))
            .select("l.*", "o.before", "o.sure_words"))
    # rows that cannot get one more copy need no running sum: they are dealt by their key
    running = Window.partitionBy("s", "b", F.when(F.col("q").isNull(), F.pmod("k", F.lit(4096)))).orderBy(
        "q", F.col("id").asc_nulls_first(), "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("upto", F.col("before") + F.sum(words).over(running))
    # a row that occurs n times is one row up to here
    full = full.withColumn("later", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    full = full.withColumn("upto", F.col("upto") - F.col("later") * F.col("size"))
    left = F.col("target") - F.col("sure_words")
    more = F.col("q").isNotNull() & (F.col("upto") - F.col("size") / 2.0 <= left)
    mixed = full.select("digest", "n", "size", "source_size", "target",
                        (F.col("sure") + F.when(more, 1).otherwise(0)).alias("copies")).checkpoint()
    return unpacked(put_back(df, mixed), columns, **{c: F.col(c) for c in ("size", "source_size", "target", "copies")})


def copied(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix, each as often as its ``copies`` say."""
    return mixed.filter(F.col("copies") > 0).withColumn(
        "copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in columns])
