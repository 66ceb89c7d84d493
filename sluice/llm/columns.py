"""Column helpers shared by the operators: carrying whole input rows past internal column
names, and the two word-level SQL patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """``df`` as one struct column ``row`` plus ``extra``: names inside the input can then
    never clash with an operator's own columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame, columns: list[str], **out: Column) -> DataFrame:
    """The input's ``columns`` again, with the output columns ``out``; an input column of the
    same name as an output column is replaced by it."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in out]
    return df.select(*kept, *[c.alias(n) for n, c in out.items()])


def hash_bits(seed: int, key: Column, hex_digits: int) -> Column:
    """A uniform non-negative integer of ``4 * hex_digits`` bits (at most 60) from md5 of
    ``seed:key``; a null key hashes as the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def row_digest(df: DataFrame) -> Column:
    """A digest of a whole row: equal for rows that are equal in every column, nulls included."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def put_back(df: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of ``df`` as ``row`` with the columns of ``results`` (stored; ``digest``, ``n``, ...), which
    has one row for every row of ``df``: ``n`` rows for a row that occurs ``n`` times. Whole rows are
    shuffled once, by digest. Of a repeated row one is kept and joined with its ``n`` results, since
    its copies differ in nothing."""
    wide = packed(df, digest=row_digest(df))
    out = wide.join(results.filter("n = 1"), "digest")
    repeated = results.filter("n > 1")
    if not repeated.isEmpty():
        one = wide.join(repeated.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
        out = out.unionByName(one.join(repeated, "digest"))
    return out
