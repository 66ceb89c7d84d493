"""Column expressions over function source code and its annotations.

All are built-in Spark expressions (whole-stage codegen, no Python in the data path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def code_hash(code="code") -> Column:
    """SHA-256 hex digest of the UTF-8 code."""
    return F.sha2(_c(code), 256)


def code_lines(code="code") -> Column:
    """Lines of a function: split on newline, trailing empty pieces kept."""
    return F.split(_c(code), NEWLINE)


def count_code_lines(code="code") -> Column:
    """Number of lines with length > 0 (whitespace-only lines count)."""
    return F.size(F.filter(code_lines(code), lambda x: F.length(x) > 0))


def count_flaw_lines(flaw_line_index="flaw_line_index") -> Column:
    """Comma fields of the flaw index; NULL -> 0, '' -> 1."""
    c = _c(flaw_line_index)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.split(c, ",")))


def has_text(col) -> Column:
    """Non-NULL and non-empty string."""
    return F.coalesce(_c(col), F.lit("")) != ""


# Separators and trim set of the flaw-line text format.
FLAW_LINE_SEPARATOR = "/~/"
FLAW_LINE_TRIM_CHARS = "/~"


def split_flaw_lines(flaw_line="flaw_line") -> Column:
    """C4: strip the characters '/' and '~' from both ends, split on '/~/', trim each part.

    NULL gives an empty array.
    """
    c = _c(flaw_line)
    parts = F.split(F.btrim(c, F.lit(FLAW_LINE_TRIM_CHARS)), FLAW_LINE_SEPARATOR)
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(trimmed)


def flaw_line_numbers(flaw_line_index="flaw_line_index") -> Column:
    """1-based line numbers listed in the flaw index (empty fields dropped)."""
    c = _c(flaw_line_index)
    return F.when(c.isNull(), F.array().cast("array<int>")).otherwise(
        F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""),
                    lambda x: F.trim(x).cast("int")))


# Fixed value: modulus of the experiment seed derivation.
SEED_MODULUS = 123456


def derive_seed(text) -> Column:
    """C14: decimal character codes concatenated, taken modulo 123456.

    The concatenation is a big integer; the modulus is folded digit by digit so every
    intermediate value stays below 10 * 123456.
    """
    digits = F.array_join(F.transform(F.split(_c(text), ""), lambda ch: F.ascii(ch).cast("string")), "")
    return F.aggregate(F.split(digits, ""), F.lit(0).cast("long"),
                       lambda acc, d: (acc * 10 + d.cast("long")) % SEED_MODULUS)


def model_seed(text, repeat) -> Column:
    """Model seed of repeat r: derive_seed(text) + 20000 * r."""
    return derive_seed(text) + F.lit(20000) * _c(repeat).cast("long")


def data_seed(repeat) -> Column:
    """Data seed of repeat r: 10000 * r."""
    return F.lit(10000) * _c(repeat).cast("long")


def dot(u, v) -> Column:
    """Dot product of two equal-length numeric arrays, in double."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(u) -> Column:
    return F.sqrt(dot(u, u))


def cosine_distance(u, v) -> Column:
    """1 - u.v / (|u| |v|); a zero vector gives NULL (never selected by a comparison)."""
    return F.lit(1.0) - F.try_divide(dot(u, v), l2_norm(u) * l2_norm(v))


def softmax_prob(logit0, logit1) -> Column:
    """Probability of class 1 under a two-class softmax."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(logit0) - _c(logit1)))


def threshold_predict(prob="prob", threshold: float = 0.5) -> Column:
    """strict threshold, as an int 0/1."""
    return (_c(prob) > F.lit(float(threshold))).cast("int")


def report_round(x, digits: int) -> Column:
    """C17: Python's ``round`` of a double to ``digits`` places (0 to 15), applied at the reporting
    edge: the exact binary value is rounded, halves to even. ``x * 10^digits`` is computed as a
    double together with its exact error (products of split halves), which decides when the
    double lands on a half."""
    x = _c(x).cast("double")
    scale = float(10 ** digits)
    split = 134217729.0  # 2^27 + 1 cuts a double into two halves whose products are exact
    scale_hi = split * scale - (split * scale - scale)
    scale_lo = scale - scale_hi
    hi = x * scale
    x_hi = split * x - (split * x - x)
    x_lo = x - x_hi
    error = ((x_hi * scale_hi - hi) + x_hi * scale_lo + x_lo * scale_hi) + x_lo * scale_lo
    whole = F.floor(hi).cast("double")
    part = hi - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(hi) < float(2 ** 52), rounded).otherwise(x)
