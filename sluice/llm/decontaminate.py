"""Benchmark decontamination with suffix arrays over the training text.

Every task reads whole documents in shards of a few MB and builds a word-level suffix array of
the shard, ordered by the first ``window`` words of each suffix. Each benchmark suffix of
``window`` words (a shorter item: the whole item) is located by binary search; its range in
the array gives every place where it occurs verbatim. Runs of matches on one diagonal of
(document, item) are joined into the longest verbatim matches.

Words are compared by 64-bit hashes turned into numbers of the benchmark's vocabulary; 0 stands
for any word that no item has. No item matches across such a word, so suffixes that meet one
before the shortest test suffix ends are left out of the array, which therefore stays small on
clean text and is complete for every search.

Scale: one narrow pass over the documents without any shuffle; hot passages cost their own
occurrences only. The benchmark is the stated query set. It is brought to the tasks in blocks of
at most ``block_words`` words; with more than one block the annotated documents are written to
the shared folder between passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import text as tx
from sluice.session import persist_table

MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType()),
                      T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("items", T.ArrayType(T.StringType())),
                      T.StructField("matches", T.ArrayType(MATCH))])
SHARD_BYTES = 4 << 20


class Tests:
    """The test suffixes of one block of items: distinct windows in sorted order, and for each
    the (item, position) pairs it stands at."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        every = np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)])
        self.vocabulary = np.unique(every)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = max(1, 63 // self.bits)
        self.n_keys = -(-window // self.per_key)
        rows, lengths, owner, place = [], [], [], []
        for k, (_, hashes) in enumerate(items):
            ids = self.numbers(hashes)
            size = min(window, len(ids))
            if not size:
                continue
            padded = np.concatenate([ids, np.zeros(window, np.int64)])
            starts = np.arange(len(ids) - size + 1)
            rows.append(np.where(np.arange(window) < size, padded[starts[:, None] + np.arange(window)], 0))
            lengths.append(np.full(len(starts), size))
            owner.append(np.full(len(starts), k))
            place.append(starts)
        if not rows:
            self.lengths = np.zeros(0, np.int64)
            return
        both = np.concatenate([np.concatenate(rows), np.concatenate(lengths)[:, None]], axis=1)
        distinct, group = np.unique(both, axis=0, return_inverse=True)
        self.lengths = distinct[:, -1]
        self.shortest = int(self.lengths.min())
        self.low = self.keys(list(distinct[:, :-1].T))
        top = np.where(np.arange(window) < self.lengths[:, None], distinct[:, :-1], (1 << self.bits) - 1)
        self.high = self.keys(list(top.T))
        order = np.argsort(group.ravel(), kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(group.ravel(), minlength=len(distinct)))])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def keys(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Several words a 63-bit number, first word highest: comparing the numbers in turn
        compares the word sequences."""
        out = []
        for k in range(0, self.window, self.per_key):
            key = np.zeros(len(columns[0]), np.int64)
            for j in range(k, k + self.per_key):
                key <<= self.bits
                if j < self.window:
                    key |= columns[j]
            out.append(key)
        return out


def suffix_array(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions whose suffix can match, in suffix order, with their sort keys. ``numbers`` must
    end with ``window`` zeros."""
    n = len(numbers) - tests.window
    stops = np.flatnonzero(numbers == 0)
    at = np.flatnonzero(numbers[:n])
    at = at[stops[np.searchsorted(stops, at)] - at >= tests.shortest]
    keys = tests.keys([numbers[at + j] for j in range(tests.window)])
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys]


def bound(keys: list[np.ndarray], sought: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of every sought key sequence at once."""
    low = np.zeros(len(sought[0]), np.int64)
    high = np.full(len(sought[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) >> 1, len(keys[0]) - 1)
        less = np.zeros(len(mid), bool)
        same = np.ones(len(mid), bool)
        for k, s in zip(keys, sought, strict=True):
            less |= same & (k[mid] < s)
            same &= k[mid] == s
        if right:
            less |= same
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def _search(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(test window, position) of every occurrence."""
    at, keys = suffix_array(numbers, tests)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = bound(keys, tests.low, False), bound(keys, tests.high, True)
    return np.repeat(np.arange(len(low)), high - low), at[tx.ragged(low, high - low)]


def _documents(data: np.ndarray, at: np.ndarray, tests: Tests, given: list | None) -> list[dict]:
    """The findings for one shard of documents."""
    low, start, end, doc, first = tx.words(data, at, alnum=True)
    n_docs, size = len(at) - 1, tests.window
    hashes = tx.span_hash(tx.prefix_hash(low), start, end)
    counts = np.diff(first)
    # documents stand apart by `window` zeros
    numbers = np.zeros(len(start) + size * n_docs + size, np.int64)
    place = np.arange(len(start)) + size * doc
    if len(tests.lengths):
        numbers[place] = tests.numbers(hashes)
        found, pos = _search(numbers, tests)
    else:
        found = pos = np.zeros(0, np.int64)
    base = first[:-1] + size * np.arange(n_docs)
    cover = np.zeros(len(numbers) + 1, np.int64)
    if given is not None:  # matches of earlier blocks
        for d, old in enumerate(given):
            for m in old or []:
                cover[base[d] + m["start"]] += 1
                cover[base[d] + m["start"] + m["length"]] -= 1
    if len(found):
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + tests.lengths[found], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit = hit[base + counts] - hit[base]
    out = [{"n_words": int(counts[d]), "n_hit": int(n_hit[d]), "items": [], "matches": list((given or {d: None})[d] or [])}
           for d in range(n_docs)]
    if len(found):
        # every (occurrence, item place) pair, joined along diagonals into longest matches
        reps = np.diff(tests.first)[found]
        entry = tx.ragged(tests.first[found], reps)
        item, there = tests.owner[entry], tests.place[entry]
        here, length = np.repeat(pos, reps), np.repeat(tests.lengths[found], reps)
        order = np.lexsort((here, here - there, item))
        item, there, here, length = item[order], there[order], here[order], length[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (here[1:] != here[:-1] + 1) | (there[1:] != there[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(item)]]) - 1
        owner = np.searchsorted(base, here[heads], "right") - 1
        for d, k, i, p, n in zip(owner.tolist(), item[heads].tolist(), there[heads].tolist(),
                                 (here[heads] - base[owner]).tolist(),
                                 (here[tails] - here[heads] + length[tails]).tolist(), strict=True):
            out[d]["matches"].append({"item": tests.names[k], "item_start": i, "start": p, "length": n})
    for row in out:
        row["items"] = sorted({m["item"] for m in row["matches"]})
    return out


def _searcher(shared, window: int, text: str, kept: list[str], schema: pa.Schema, again: bool):
    def run(batches):
        tests = Tests([(name, np.frombuffer(h, np.uint64)) for name, h in shared.value], window)
        for batch in batches:
            before = tx.column(batch, "matches").to_pylist() if again else None
            for lo, hi, data, at in tx.chunks(batch, text, SHARD_BYTES):
                rows = _documents(data, at, tests, before[lo:hi] if again else None)
                part = batch.slice(lo, hi - lo)
                found = pa.array(rows, pa.struct([schema.field(f.name) for f in FOUND]))
                yield pa.RecordBatch.from_arrays([*[tx.column(part, c) for c in kept], *found.flatten()], schema=schema)
    return run


def _item_words(batches):
    for batch in batches:
        for lo, hi, data, at in tx.chunks(batch):
            low, start, end, _, first = tx.words(data, at, alnum=True)
            h = tx.span_hash(tx.prefix_hash(low), start, end)
            yield pa.RecordBatch.from_arrays([
                tx.column(batch, "item").slice(lo, hi - lo),
                pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                pa.array(np.diff(first), pa.int64())], names=["item", "hashes", "n"])


def benchmark_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13,
                      text: str = "text", item: str = "item_id", item_text: str = "text",
                      block_words: int = 4_000_000) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside a match), ``items`` (sorted ids of the
    items with a matching window) and ``matches`` (longest verbatim matches: item, word offset in
    the item, word offset in the document, words).

    Null and empty texts have no words and match nothing; null item ids read as empty strings.
    Repeated documents are each annotated; repeated items count once under their id. An empty
    benchmark leaves every document clean, an empty table gives an empty result. Input columns
    with the name of an output column are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).alias("text"))
    items = persist_table(spark, items.mapInArrow(_item_words, "item string, hashes binary, n long").filter("n > 0"),
                          "benchmark-words")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    kept = [c for c in docs.columns if c not in FOUND.names]
    df = docs
    for block in range(blocks):
        # at most about block_words hashes of 8 bytes: the bounded query set
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "hashes").collect()
        shared = spark.sparkContext.broadcast([(r.item, bytes(r.hashes)) for r in rows])
        df = df.select(*[F.col(f"`{c}`") for c in kept], *(["matches"] if block else []))
        schema = T.StructType([docs.schema[c] for c in kept] + FOUND.fields)
        df = df.mapInArrow(_searcher(shared, window, text, kept, to_arrow_schema(schema), block > 0), schema)
        if block < blocks - 1:
            df = persist_table(spark, df, "benchmark-pass")
    return df


def contaminated():
    """One word in twenty or more lies inside a benchmark window."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = benchmark_matches(spark, docs, benchmark, **options)
    return found.filter(~contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])
