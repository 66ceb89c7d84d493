"""Suffix-array dedup: remove bytes covered by strings of ``length`` bytes that occur elsewhere.

1. Every window of ``length`` bytes has an anchor, the ``gram``-byte string with the smallest hash in it
   (leftmost on ties). Equal windows have equal anchors at the same place, so only windows whose
   anchor's hash occurs again anywhere can repeat. Consecutive windows with the same anchor make
   up one context: the bytes that they cover.
2. Contexts with an anchor that occurs again are dealt into shards by the anchor's hash, equal
   contexts once with their number. All occurrences of a window thus meet in one shard.
3. Each shard's suffix array and common prefixes come from external induced sorting
   (``induced_sort``). Suffixes with a common prefix of ``length`` or more are equal windows; a window
   is repeated if its class has two members or its context occurs twice.
4. The repeated windows go back to the documents, whose covered bytes are removed.

Scale: what is shuffled is one narrow row per anchor (about one in a hundred bytes) and the
contexts of repeated anchors. Exact copies of whole documents are found by digest first and
stand in for each other, so groups of copies add nothing but their ids. Results are joined
to occurrences by context, the context side being unique, so a hot passage can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import text as tx
from sluice.llm.batches import give_back, small_batches
from sluice.llm.induced_sort import suffix_array
from sluice.session import persist_table

SHARD_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` consecutive values, in linear time by blocks."""
    n = len(values)
    blocks = -(-n // width)
    edge = values.max() if pick is np.minimum else values.min()
    padded = np.append(values, np.full(blocks * width - n, edge, values.dtype)).reshape(blocks, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, hash, first window, last window) of every context; windows by their first byte."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    width = length - gram + 1  # anchors to choose from in a window
    place = np.arange(n - gram + 1)
    hashes = tx.span_hash(tx.prefix_hash(data), place, place + gram)
    least = _sliding(hashes, width, np.minimum)
    owner = np.searchsorted(at, np.arange(len(least)), "right") - 1
    valid = np.arange(len(least)) + length <= at[owner + 1]
    if not valid.any():
        return none, none.astype(np.uint64), none, none
    # runs of windows of one document with the same smallest hash
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(opens)
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    last = np.flatnonzero(stops)
    # the anchor: where the smallest hash has just come in, it is the newest one
    entered = np.zeros(len(first), bool)
    inner = first > 0
    inner[inner] = valid[first[inner] - 1]
    entered[inner] = least[first[inner] - 1] > least[first[inner]]
    chosen = first + width - 1
    chosen[~entered] = _leftmost(hashes, first[~entered], width)
    parts = []
    while len(first):
        # windows past an anchor have a later one of equal hash
        here = np.minimum(last, chosen)
        parts.append((hashes[chosen], first, here))
        more = last > chosen
        first, last = chosen[more] + 1, last[more]
        chosen = _leftmost(hashes, first, width)
    found, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
    return owner[first], found, first, last


def _leftmost(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(first), np.int64)
    for k in range(0, len(first), 4096):
        rows = hashes[first[k:k + 4096, None] + np.arange(width)]
        out[k:k + 4096] = first[k:k + 4096] + rows.argmin(axis=1)
    return out


def _anchor_rows(length: int, gram: int):
    def run(batches):
        seen: set[int] = set()  # of this task's documents: copies give their anchors once
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch):
                nodes = tx.column(batch, "node").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                fresh = np.zeros(hi - lo, bool)
                for k, node in enumerate(nodes.tolist()):
                    fresh[k] = node not in seen
                    seen.add(node)
                doc, found, first, last = anchors(data, at, length, gram)
                keep = fresh[doc]
                doc, found, first, last = doc[keep], found[keep], first[keep], last[keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.view(np.int64)), pa.array(nodes[doc]), pa.array((first - at[doc]).astype(np.int32)),
                    pa.array((last - at[doc]).astype(np.int32))], names=["h", "node", "first", "last"])
    return run


CONTEXT = "h long, one long, two long, node long, first int, context binary"


def _context_rows(length: int):
    def run(batches):
        seen: set[int] = set()  # a task sends the bytes of equal contexts once
        done: set[int] = set()  # and those of a text once
        for batch in batches:
            fresh = []
            for node in tx.column(batch, "node").to_pylist():
                fresh.append(node not in done)
                done.add(node)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            nodes = tx.column(batch, "node").to_numpy(zero_copy_only=False)
            for lo, hi, data, at in tx.chunks(batch):
                spans = tx.column(batch, "spans").slice(lo, hi - lo)
                h, first, last = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                doc = np.repeat(np.arange(hi - lo), np.diff(spans.offsets.to_numpy()))
                a, b = at[doc] + first, at[doc] + last + length
                sums = tx.prefix_hash(data)
                one = tx.span_hash(sums, a, b)
                two = tx.mix(one ^ tx.span_hash(sums, a, (a + b) // 2))
                bodies: list[bytes | None] = [None] * len(one)
                raw = data.tobytes()
                keys, where = np.unique(one, return_index=True)
                for key, k in zip(keys.tolist(), where.tolist(), strict=True):
                    if key not in seen:
                        seen.add(key)
                        bodies[k] = raw[a[k]:b[k]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(h, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array(nodes[lo:hi][doc], pa.int64()), pa.array(first, pa.int32()), pa.array(bodies, pa.binary())],
                    names=["h", "one", "two", "node", "first", "context"])
    return run


def repeated_windows(contexts: list[bytes], times: np.ndarray, length: int, memory: int = 16 << 20) -> list[list[tuple[int, int]]]:
    """For each of the distinct contexts, the ranges (first, last) of windows that occur twice or more
    among all of them, a context counting as often as ``times`` says."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    # bytes from 2; contexts end with 1, the string with 0
    string = np.zeros(int(sizes.sum()) + len(contexts) + 1, np.int16)
    string[:-1] = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    string[:-1] += 2
    string[starts + sizes] = 1
    order, prefix = suffix_array(string, memory)
    # suffixes with a whole window form classes: maximal stretches of long common prefixes
    twice = prefix >= length
    del prefix, string
    twice[:-1] |= twice[1:]
    flag = np.sort(order[twice])
    del order, twice
    owner = np.searchsorted(starts, flag, "right") - 1
    fits = (starts + sizes)[owner] - flag >= length
    flag, owner = flag[fits], owner[fits]
    # ranges of consecutive windows of a context; of one that occurs twice, all of them
    out: list[list[tuple[int, int]]] = [[(0, n - length)] if t > 1 and n >= length else [] for n, t in zip(sizes.tolist(), times.tolist(), strict=True)]
    if len(flag):
        cut = np.flatnonzero(np.append(True, (np.diff(flag) > 1) | (owner[1:] != owner[:-1])))
        for a, b, who in zip(flag[cut].tolist(), flag[np.append(cut[1:], len(flag)) - 1].tolist(), owner[cut].tolist(), strict=True):
            if times[who] <= 1:
                out[who].append((a - int(starts[who]), b - int(starts[who])))
    return out


def _shard_rows(length: int, memory: int):
    """Rows of one shard arrive together; a task may get several shards."""
    def solved(shard: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[3] for r in shard], np.array([r[2] for r in shard]), length, memory)
        rows = [(r[0], r[1], a, b) for r, ranges in zip(shard, found, strict=True) for a, b in ranges]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["one", "two", "low", "high"])

    def run(batches):
        shard, number = [], None
        for batch in batches:
            for which, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if which != number:
                    if shard:
                        yield solved(shard)
                    shard, number = [], which
                shard.append(row)
        if shard:
            yield solved(shard)
    return run


def _slices(batches, rows: int = 100):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _removal_rows(length: int):
    def run(batches):
        for batch in _slices(batches):
            ids, texts, spans = (tx.column(batch, c).to_pylist() for c in ("id", "text", "spans"))
            rows = []
            for text, ranges in zip(texts, spans, strict=True):
                data = (text or "").encode()
                kept, at, removed, runs = [], 0, 0, 0
                for low, high in sorted((r["low"], r["high"]) for r in ranges):
                    high += length
                    if low > at or not runs:
                        kept.append(data[at:low])
                        runs += 1
                        removed += high - low
                        at = high
                    elif high > at:
                        removed += high - at
                        at = high
                kept.append(data[at:])
                rows.append((len(data), removed, runs, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]),
                pa.array([r[3] for r in rows], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of keys if it is small; else join by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200,
                    gram: int = 32, memory: int = 16 << 20, kept: bool = True) -> DataFrame:
    """(``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``[, ``kept``]) for every document: the
    bytes left (binary: a cut may fall inside a character) once all bytes covered by a repeated
    string of ``length`` bytes are gone, judged on the input.

    Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows of long texts
    lose everything, like other copies. Texts are told apart by their digest: ids may be null (they come out
    null) or equal. An empty table gives an empty result."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    node = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("node")
    rows = rows.select("id", "sha", node, F.octet_length("text").cast("long").alias("n_bytes"), "text")
    known = persist_table(spark, rows.drop("text"), "texts")
    texts = known.groupBy("sha", "node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("one_id"),
                                             F.min("n_bytes").alias("n_bytes"))
    texts = persist_table(spark, texts.filter(F.col("n_bytes") >= length), "distinct-texts")

    found = rows.filter(F.octet_length("text") >= length).select("node", "text").mapInArrow(
        _anchor_rows(length, gram), "h long, node long, first int, last int")
    # read twice: for the hashes that occur again and for their places
    found = persist_table(spark, found, "anchors")
    again = found.groupBy("h").agg(F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("first").alias("f0"),
                                   F.max("first").alias("f1")).filter("n0 < n1 or f0 < f1").select("h")
    spans = found.join(again, "h", "left_semi").groupBy("node").agg(
        F.collect_set(F.struct("h", "first", "last")).alias("spans"))  # at most a document's anchors
    spans = persist_table(spark, spans.join(texts.select("node", "one_id"), "node"), "spans")

    # the contexts of one row for each distinct text; rows that repeat it under the same id add nothing
    wanted = _few(spans.select(F.col("node").alias("node_"), "one_id"))
    asked = rows.join(wanted, (F.col("node") == F.col("node_")) & F.col("id").eqNullSafe(F.col("one_id")), "left_semi").select("node", "text")
    asked = asked.join(spans.drop("one_id"), "node").select("node", "text", "spans")
    contexts = persist_table(spark, asked.mapInArrow(_context_rows(length), CONTEXT), "contexts")

    size = contexts.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    distinct = contexts.groupBy("h", "one", "two").agg(F.count(F.lit(1)).alias("times"),
                                                       F.first("context", ignorenulls=True).alias("context"))
    distinct = distinct.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "one", "two", "times", "context")
    dealt = distinct.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard")
    ranges = persist_table(spark, dealt.mapInArrow(give_back(_shard_rows(length, memory)), "one long, two long, low int, high int"),
                           "ranges")
    covered = contexts.select("one", "two", "node", "first").join(ranges, ["one", "two"])
    covered = covered.groupBy("node").agg(F.collect_set(F.struct(
        (F.col("low") + F.col("first")).alias("low"), (F.col("high") + F.col("first")).alias("high"))).alias("spans"))

    # copies of a whole text lose all of it, texts with spans (of one row each) are cut, the rest stays
    covered = persist_table(spark, covered.join(texts.filter("copies = 1").select("node"), "node", "left_semi"), "covered")
    cut = rows.join(_few(covered.select("node")), "node", "left_semi").select("node", "id", "text").join(covered, "node").select("id", "text", "spans")
    cut = cut.mapInArrow(_removal_rows(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    state = ((rows if kept else known).join(texts.filter("copies > 1").select("sha", F.lit(True).alias("copied")), "sha", "left")
             .join(covered.select("node", F.lit(True).alias("covered")), "node", "left"))
    gone = F.coalesce("copied", F.lit(False))
    rest = state.filter(gone | F.col("covered").isNull()).select(
        "id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.encode("text", "utf-8")).alias("kept")] if kept else []))
    return rest.unionByName(cut if kept else cut.drop("kept"))
