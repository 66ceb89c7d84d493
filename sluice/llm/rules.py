"""Quality rules as weak supervision.

Every rule looks at one statistic of a document and votes good, votes bad or abstains. How far
a rule can be trusted is not set by hand: expectation-maximisation over the votes of all
documents estimates, for each rule, how often it is right on good and on bad documents, along
with the share of good ones. A document's verdict is the posterior probability of being good.

Votes are few values per rule, so all the estimation needs is how many documents have each vote
pattern: one aggregation to at most 3^rules rows, whatever the number of documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import text as tx

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals",
          "n_letter_words", "n_stops")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_LETTER = _CAPITAL.copy()
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

# (name, votes good, votes bad) over the counts; otherwise the rule abstains. Words and lines
# count as at least one in the ratios.
RULES = (
    ("length", "n_words >= 100", "n_words < 20"),
    ("word_length", "word_chars >= 3 * n_words and word_chars <= 10 * n_words",
     "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines = 0 and n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
    ("repeated_words", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    ("capitals", "10 * n_capitals <= n_letters", "3 * n_capitals > n_letters"),
    ("letter_words", "10 * n_letter_words >= 9 * n_words", "10 * n_letter_words < 7 * n_words"),
    ("sentences", "100 * n_stops >= n_words and 3 * n_stops <= n_words", "2 * n_stops > n_words"),
)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags of each document are set."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of the entries whose (document, key) occurs twice or more, first included."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.empty(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def document_counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of each document, words and lines compared as they stand."""
    _, start, end, doc, first = tx.words(data, at, lower=False)
    sums = tx.prefix_hash(data)
    n_words = np.diff(first)
    word = tx.span_hash(sums, start, end)
    # words in three-word windows that occur again in the document
    whole = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    window = tx.mix(tx.mix(tx.mix(word[whole]) + word[whole + 1]) + word[whole + 2]) if len(whole) else word[:0]
    again = whole[_repeats(window, doc[whole])]
    covered = np.zeros(len(word), bool)
    for j in range(3):
        covered[again + j] = True
    # lines: between newlines and document edges
    cuts = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([at[:-1], cuts + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    line_end = np.minimum(np.concatenate([cuts, [len(data)]])[np.searchsorted(cuts, line_start)], at[line_doc + 1])
    wordy = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[wordy], line_end[wordy], line_doc[wordy]
    lines = tx.span_hash(sums, line_start, line_end)
    order = np.lexsort((lines, line_doc))
    later = np.zeros(len(lines), bool)
    later[1:] = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    n_docs = len(at) - 1
    letter = _LETTER[data]
    letters = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    lettered = letters[end] > letters[start]
    stop = _STOP[data[end - 1]] if len(end) else np.zeros(0, bool)
    return [n_words, _sums(_LEAD[data] & ~tx.WHITE[data], at), _sums(_SYMBOL[data], at),
            np.bincount(line_doc[order][later], minlength=n_docs), _sums(covered, first),
            np.bincount(line_doc, minlength=n_docs), _sums(letter & _LEAD[data], at), _sums(_CAPITAL[data], at),
            _sums(lettered, first), _sums(stop, first)]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns ``COUNTS`` (long). A null text counts as empty; input columns of
    the same names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c not in COUNTS]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in COUNTS])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text):
                part = batch.slice(lo, hi - lo)
                counts = [pa.array(c.astype(np.int64)) for c in document_counts(data, at)]
                yield pa.RecordBatch.from_arrays([*[tx.column(part, c) for c in kept], *counts], schema=arrow)
    return df.mapInArrow(run, schema)


def votes() -> Column:
    """The pattern of all votes as one number: digit 2 good, 0 bad, 1 abstained, base 3."""
    total = F.lit(0)
    for k, (_, good, bad) in enumerate(RULES):
        vote = F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1)
        total = total + vote * 3 ** k
    return total


def posteriors(patterns: dict[int, int], prior: float = 0.8, right: float = 0.99, caught: float = 0.1,
               strength: float = 0.1, rounds: int = 500, tolerance: float = 1e-9) -> dict[int, float]:
    """Posterior probability of good for every vote pattern, by expectation-maximisation from
    pattern counts. Rules are independent given the truth; abstaining says nothing. A rule is
    ``right`` on good documents and has ``caught`` so many of the bad ones to begin with (bad
    documents are of many kinds, and a rule sees one or two of them); with the weight of
    ``strength`` of all documents the estimates are drawn to these values. No rule may vote bad
    more readily on good documents than on bad ones, so good and bad cannot change places."""
    codes = sorted(patterns)
    if not codes:
        return {}
    n = np.array([patterns[c] for c in codes], float)
    vote = np.array([[c // 3 ** k % 3 - 1 for k in range(len(RULES))] for c in codes])
    good, bad = (vote == 1).astype(float), (vote == -1).astype(float)
    drawn = strength * n.sum() + 1.0
    share, right_good, right_bad = prior, np.full(len(RULES), right), np.full(len(RULES), caught)
    p = np.full(len(codes), prior)
    for _ in range(rounds):
        up = math.log(share) + good @ np.log(right_good) + bad @ np.log(1 - right_good)
        down = math.log(1 - share) + bad @ np.log(right_bad) + good @ np.log(1 - right_bad)
        new = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        moved = float(np.abs(new - p).max())
        p = new
        share = float(np.clip((n @ p + drawn * prior) / (n.sum() + drawn), 1e-6, 1 - 1e-6))
        for truth, weight, start, own in ((good, n * p, right, right_good), (bad, n * (1 - p), caught, right_bad)):
            seen = weight @ (good + bad)
            own[:] = np.clip((weight @ truth + drawn * start) / (seen + drawn), 1e-6, 1 - 1e-6)
        right_good = np.maximum(right_good, 0.5)
        right_bad = np.maximum(right_bad, 1 - right_good)
        if moved < tolerance:
            break
    return dict(zip(codes, p.tolist(), strict=True))


def judged(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """``counted`` (rows with ``COUNTS``) with ``votes``, ``p_good`` and ``good`` (p_good of one half
    or more). ``counted`` is read twice and should be a stored table."""
    rows = counted.withColumn("votes", votes())
    patterns = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = posteriors(patterns)
    # at most 3^8 rows
    model = spark.createDataFrame(list(known.items()) or [(0, 0.0)], "votes int, p_good double")
    rows = rows.drop("p_good", "good").join(F.broadcast(model), "votes")
    return rows.withColumn("good", F.col("p_good") >= 0.5)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
