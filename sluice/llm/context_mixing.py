"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of words and one end. Every word is spelled in binary decisions: the path to
it in a Huffman tree over the most frequent words, the end and an escape; an escaped word is
then spelled byte by byte down a Huffman tree over bytes. A decision is predicted by three
predictors: the branch frequency of the tree node, and the bits that followed the node under two
hashed contexts (one and two words before; in escaped words, three and five bytes before).
Their log-odds are mixed by weights from a set that a gate picks by how much the contexts have
seen, and an adaptive probability map refines the result. The product over all decisions is the
model's probability of the text.

Counts come first, then what is learned from them. After a word count one pass over the training documents
counts the bits under every context; the counts of all tasks are added up on executors. A second
pass predicts every training decision from those counts, the decision's own count taken out,
and gathers a histogram of (gate, log-odds of the three predictors, bit). The weights of each gate and the
map are learned from that histogram, whose size is fixed. All of it is sums of whole numbers, so scores do not depend on
the number of tasks. Scoring is a pass over all documents; in training documents the
decision's own count is taken out again, so they are scored as texts that the model has not seen there.

Word counts are unbounded: the ``HEAD`` most frequent words or fewer are broadcast, rarer words' counts
are joined by a shuffle. Context tables have eight slots a training token, ``MOST_BITS`` bits at most, and are broadcast.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import text as tx
from sluice.llm.batches import give_back
from sluice.session import persist_table

_U = np.uint64
HEAD = 1 << 17  # words in the tree at most
LEAST_BITS, MOST_BITS = 16, 22  # slots of a context table
LETTERS = (3, 5)  # bytes before in the two contexts of an escaped word's bytes
LEAST = 2  # occurrences of a head word
DEPTH = 64  # no path is longer: one of 65 needs more than 2^44 tokens
LEVELS = 3  # of a tree whose nodes share a bucket: 1 + 2 + 4 slots of 8
BLOCK = 1 << 13  # slots summed up together
CHUNK = 1 << 18  # bytes of text whose arrays stay in the processor's cache
EXACT, COUNTS = 32, 194  # counts kept exactly, and all levels of a summed-up count
STATES = COUNTS * COUNTS  # of a slot
SEEN, MODES, STEPS = 4, 3, 33
GATES = SEEN * SEEN * MODES
BINS = 17  # of a predictor's log-odds in the histogram
TREE_STEP = 4  # bins a unit of a tree node's log-odds


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, bits, lengths, odds): for every symbol the inner nodes on its path and the branches it
    takes, padded to the longest path; for every node the log-odds of branch 1."""
    n = len(counts)
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, branch = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    odds = np.zeros(max(n - 1, 1), np.float64)
    for inner in range(n, 2 * n - 1):
        c0, a = heapq.heappop(heap)
        c1, b = heapq.heappop(heap)
        parent[a] = parent[b] = inner
        branch[b] = 1
        odds[inner - n] = np.log((c1 + 0.5) / (c0 + 0.5))
        heapq.heappush(heap, (c0 + c1, inner))
    up, paths = np.arange(n), []
    root = 2 * n - 2
    while (up != root).any():
        paths.append((np.where(up != root, parent[up] - n, -1), np.where(up != root, branch[up], 0)))
        up = np.where(up != root, parent[up], root)
    if not paths:
        return np.zeros((n, 1), np.int32), np.zeros((n, 1), np.int8), np.zeros(n, np.int64), odds
    nodes = np.stack([p[0] for p in paths], 1)
    lengths = (nodes >= 0).sum(axis=1)
    # from the leaf up to from the root down
    take = np.maximum(lengths[:, None] - 1 - np.arange(nodes.shape[1]), 0)
    rows = np.arange(n)[:, None]
    return (nodes[rows, take].astype(np.int32), np.stack([p[1] for p in paths], 1)[rows, take].astype(np.int8), lengths, odds)


class Tree:
    """Paths of a Huffman tree: ``steps[d]`` holds 2 * node + bit of every symbol's decision ``d``, or -1."""

    def __init__(self, counts: np.ndarray):
        nodes, bits, lengths, odds = huffman(counts)
        self.steps = [np.ascontiguousarray(np.where(lengths > d, 2 * nodes[:, d] + bits[:, d], -1).astype(np.int32))
                      for d in range(nodes.shape[1])]
        self.lengths = lengths.astype(np.uint8)
        self.odds = odds.astype(np.float32)
        # what a step adds to the number of a histogram's cell
        self.cells = (np.repeat(_bin(TREE_STEP * self.odds), 2) * BINS ** 2 * 2 + np.tile([0, 1], len(odds))).astype(np.int32)


class Code:
    """The trees and what follows from them. Symbols: the head words by hash, then end, then escape."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, end: int, escaped: int, byte_counts: np.ndarray):
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        self.end, self.escape, self.ends = len(head), len(head) + 1, end
        self.words = Tree(np.concatenate([self.counts, [max(end, 1), max(escaped, 1)]]))
        self.letters = Tree(byte_counts + 1)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.full(len(words), self.escape)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return np.where(self.head[at] == words, at, self.escape)


def slot_bits(tokens: int) -> int:
    """Bits of a context table's slots for so many training tokens."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * max(tokens, 1) - 1).bit_length()))


class Counter:
    """Bits seen under each context."""

    def __init__(self, bits: int):
        self.bits = bits
        self.counts = np.zeros((2, 2 << bits), np.uint32)  # of bit 0 and 1 of each slot in turn

    def decide(self, tree: Tree, step: np.ndarray, slots: list[np.ndarray], own: None, mode: int) -> None:
        bit = step & 1
        for counts, slot in zip(self.counts, slots, strict=True):
            np.add.at(counts, 2 * slot + bit, np.uint32(1))


def _levels(n: np.ndarray) -> np.ndarray:
    """Counts below ``EXACT`` as they are, greater ones in steps of a sixth of a power of two."""
    steps = np.floor(6 * np.log2(np.maximum(n, EXACT) / EXACT))
    return np.where(n < EXACT, n, EXACT + np.minimum(steps, COUNTS - EXACT - 1)).astype(np.int64)


def states(counts: np.ndarray) -> np.ndarray:
    """Counts of bit 0 and 1 in turn as one 16-bit number a slot."""
    level = _levels(counts.reshape(-1, 2))
    return (level[:, 0] * COUNTS + level[:, 1]).astype(np.uint16)


def _state_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds with how much was seen in the last two bits, seen, and bin of the log-odds, of every state: as it is, less one
    bit 0, and less one bit 1."""
    level = np.arange(COUNTS)
    count = np.where(level < EXACT, level, EXACT * 2.0 ** ((level - EXACT + 0.5) / 6))
    n0, n1 = np.repeat(count, COUNTS), np.tile(count, COUNTS)
    n0, n1 = np.concatenate([n0, np.maximum(n0 - 1, 0), n0]), np.concatenate([n1, n1, np.maximum(n1 - 1, 0)])
    odds = np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)
    seen = np.minimum(SEEN - 1, np.ceil(np.log2(np.minimum(n0 + n1, 64) + 1) / 2)).astype(np.int32)
    return ((odds.view(np.uint32) & np.uint32(0xFFFFFFFC)) | seen.astype(np.uint32)).view(np.float32), seen, _bin(odds).astype(np.int32)


def _bin(x: np.ndarray) -> np.ndarray:
    return (np.clip(np.rint(x), -(BINS // 2), BINS // 2) + BINS // 2).astype(np.int64)


_ODDS, _SEEN, _BINNED = _state_tables()
# what a context adds to the number of a histogram's cell
_CELL1 = (_SEEN * SEEN * BINS ** 3 + _BINNED * BINS) * 2
_CELL2 = (_SEEN * BINS ** 3 + _BINNED) * 2


class _Reader:
    """Summed-up tables that decisions are predicted from."""

    def __init__(self, bits: int, tables: np.ndarray):
        self.bits, self.tables = bits, tables

    def look(self, bit: np.ndarray, slots: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
        """States of both contexts, without what the decisions counted themselves (``own`` is 1)."""
        without = (own + own * bit) * STATES
        return [table[slot] + without for table, slot in zip(self.tables, slots, strict=True)]


class Histogram(_Reader):
    """How often each bit came with each gate and log-odds of the predictors."""

    def __init__(self, bits: int, tables: np.ndarray):
        super().__init__(bits, tables)
        self.cells = np.zeros(GATES * BINS ** 3 * 2, np.int64)

    def decide(self, tree: Tree, step: np.ndarray, slots: list[np.ndarray], own: np.ndarray, mode: int) -> None:
        bit = step & 1
        first, second = self.look(bit, slots, own)
        cell = tree.cells[step] + _CELL1[first]
        cell += _CELL2[second]
        cell += mode * SEEN * SEEN * BINS ** 3 * 2
        np.add.at(self.cells, cell, 1)


def learned(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of each gate, map): the weights by Newton's method on the logistic loss of the histogram,
    drawn to where they start by a few decisions' worth; the map counts bits by mixed log-odds."""
    n = cells.reshape(GATES, BINS ** 3, 2).astype(np.float64)
    axis = np.arange(BINS) - BINS // 2
    x = np.stack([g.ravel() for g in np.meshgrid(axis / TREE_STEP, axis, axis, indexing="ij")], 1).astype(np.float64)
    start = np.tile(np.array([1.0, 0.1, 0.1]), (GATES, 1))
    start[2 * SEEN * SEEN:] = 0.4, 0.5, 0.4
    weights, seen = start.copy(), np.zeros((MODES, STEPS, 2))
    for gate in range(GATES):
        at = np.flatnonzero(n[gate].sum(axis=1))
        if not len(at):
            continue
        some, total, ones, w = x[at], n[gate, at].sum(axis=1), n[gate, at, 1], weights[gate]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(some @ w, -12, 12)))
            slope = some.T @ (ones - total * p) - 4 * (w - start[gate])
            step = np.linalg.solve((some * (total * p * (1 - p))[:, None]).T @ some + 4 * np.eye(3), slope)
            w = np.clip(w + np.clip(step, -0.5, 0.5), -0.5, 3)
            if np.abs(step).max() < 1e-6:
                break
        weights[gate] = w
        np.add.at(seen[gate // (SEEN * SEEN)], _step(np.clip(some @ w, -12, 12)), n[gate, at])
    return weights, seen


def _step(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(2 * odds), -(STEPS // 2), STEPS // 2).astype(np.int64) + STEPS // 2


class Model(_Reader):
    """What scores a text."""

    def __init__(self, bits: int, tables: np.ndarray, weights: np.ndarray, seen_map: np.ndarray):
        super().__init__(bits, tables)
        self.weights = np.ascontiguousarray(weights.T.astype(np.float32))
        # log probability by mode, log-odds in steps of 1/64 and bit, the adaptive map included
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
        refined = (seen_map[:, :, 1] + 8 * centre) / (seen_map.sum(axis=2) + 8)
        odds = (np.arange(24 * 64 + 1) - 12 * 64) / 64
        p = 0.5 / (1 + np.exp(-odds)) + 0.5 * np.stack([np.interp(odds, (np.arange(STEPS) - STEPS // 2) / 2, r) for r in refined])
        self.logs = np.stack([np.log(1 - p), np.log(p)], axis=2).astype(np.float32).reshape(MODES, -1)

    def decide(self, tree: Tree, step: np.ndarray, slots: list[np.ndarray], own: np.ndarray, mode: int) -> np.ndarray:
        bit = step & 1
        first, second = (_ODDS[state] for state in self.look(bit, slots, own))
        gate = ((first.view(np.int32) & 3) << 2) + (second.view(np.int32) & 3) + mode * SEEN * SEEN
        w = self.weights
        odds = w[0][gate] * tree.odds[step >> 1]
        odds += w[1][gate] * first
        odds += w[2][gate] * second
        np.clip(odds, -12, 12, out=odds)
        return self.logs[mode][2 * (odds * 64 + np.float32(768.5)).astype(np.int32) + bit]


def _walk(visitor, tree: Tree, symbols: np.ndarray, contexts: list[np.ndarray], own: np.ndarray, letters: bool) -> np.ndarray | None:
    """Take every symbol's decisions in turn; a model gives the log probability of each symbol. Symbols
    go by falling path length, so the ones still under way are always the first."""
    lengths = tree.lengths[symbols]
    order = np.argsort(lengths, kind="stable")[::-1]
    symbols, contexts, own = symbols[order], [c[order] for c in contexts], own[order]
    under_way = len(symbols) - np.cumsum(np.bincount(lengths, minlength=len(tree.steps) + 1))
    scoring = isinstance(visitor, Model)
    gained = np.zeros(len(symbols))
    shift, half = _U(64 - (visitor.bits - 4)), int(letters) << (visitor.bits - 1)
    base, local = [], None
    for d, steps in enumerate(tree.steps):
        n = int(under_way[d])
        if not n:
            break
        step = steps[symbols[:n]]
        if d % LEVELS == 0:
            tag = ((step >> 1).astype(_U) + _U(1 + ((1 + letters) << 24))) * _U(0x9E3779B97F4A7C15)
            base = [((((c[:n] ^ tag) * _U(0xD1342543DE82EF95)) >> shift) << _U(3)).view(np.int64) + half for c in contexts]
            local = np.ones(n, np.int64)
        got = visitor.decide(tree, step, [b[:n] + local[:n] for b in base], own[:n], 2 if letters else int(d > 1))
        local = 2 * local[:n] + (step & 1)
        if scoring:
            gained[:n] += got
    if not scoring:
        return None
    out = np.empty(len(symbols))
    out[order] = gained
    return out


def spell(visitor: Counter | Histogram | Model, code: Code, data: np.ndarray, at: np.ndarray, own: np.ndarray | None = None) -> tuple | None:
    """Go through all decisions of the documents; a model gives (log probability, tokens, symbols,
    word hashes, document of each word). ``own`` tells the documents whose decisions are in the counts."""
    low, start, end, doc, first = tx.words(data, at)
    word = tx.span_hash(tx.prefix_hash(low), start, end)
    n_docs, n = len(at) - 1, len(word)
    own = np.zeros(n_docs, np.int32) if own is None else own.astype(np.int32)
    # tokens with the ends in place
    place = np.arange(n) + doc
    ends = first[1:] + np.arange(n_docs)
    total = n + n_docs
    symbol, value = np.full(total, code.end), np.zeros(total, _U)
    word_symbol = code.symbols(word)
    symbol[place], value[place] = word_symbol, word
    before = np.append(_U(0), value[:-1])  # an end stands before a document's first word, with hash 0
    before2 = np.append(_U(0), before[:-1])
    before2[before == 0] = 0
    begin = np.append(0, ends[:-1] + 1)
    contexts = [tx.mix(before), tx.mix(before ^ tx.mix(before2 + _U(1)))]
    gained = _walk(visitor, code.words, symbol, contexts, np.repeat(own, ends + 1 - begin), False)
    # escaped words, byte by byte, closed by a space
    rare = np.flatnonzero(word_symbol == code.escape)
    if len(rare):
        sizes = end[rare] - start[rare] + 1
        inside = tx.ragged(start[rare], sizes)
        stop = np.cumsum(sizes) - 1
        letters = low[np.minimum(inside, len(low) - 1)]
        letters[stop] = 0x20
        # the bytes before, not beyond the word's start
        behind = np.arange(len(letters)) - np.repeat(stop - sizes + 1, sizes)
        history = np.zeros(len(letters), _U)
        for j in range(LETTERS[1], 0, -1):
            history <<= _U(8)
            ok = np.flatnonzero(behind >= j)
            history[ok] |= letters[ok - j].astype(_U)
        short = history & _U((1 << 8 * LETTERS[0]) - 1)
        contexts = [tx.mix(short + _U(1 << 62)), tx.mix(history + _U(1 << 63))]
        spelled = _walk(visitor, code.letters, letters, contexts, np.repeat(own[doc[rare]], sizes), True)
        if gained is not None:
            gained[place[rare]] += np.add.reduceat(spelled, stop - sizes + 1)
    if gained is None:
        return None
    return np.add.reduceat(gained, begin), ends + 1 - begin, word_symbol, word, doc, first


def _word_counts(batches):
    words, counts, letters, ends = [], [], np.zeros(256, np.int64), 0
    for batch in batches:
        for lo, hi, data, at in tx.chunks(batch, limit=4 << 20):
            low, start, end, _, _ = tx.words(data, at)
            w, n = np.unique(tx.span_hash(tx.prefix_hash(low), start, end), return_counts=True)
            words.append(w)
            counts.append(n)
            letters += np.bincount(low, minlength=256)
            ends += hi - lo
        if len(words) > 16:
            words, counts = _merged(words, counts)
    words, counts = _merged(words, counts)
    key = np.concatenate([words[0].view(np.int64), np.arange(256), [0]])
    kind = np.concatenate([np.zeros(len(words[0]), np.int8), np.ones(256, np.int8), [np.int8(2)]])
    value = np.concatenate([counts[0], letters, [ends]])
    for k in range(0, len(key), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(kind[k:k + 50_000].astype(np.int32)), pa.array(key[k:k + 50_000]),
                                          pa.array(value[k:k + 50_000].astype(np.int64))], names=["kind", "key", "n"])


def _merged(words: list, counts: list) -> tuple[list, list]:
    if not words:
        return [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    w, back = np.unique(np.concatenate(words), return_inverse=True)
    return [w], [np.bincount(back, np.concatenate(counts), len(w)).astype(np.int64)]


TABLES = "block int, body binary"


def _count(code, bits):
    @give_back
    def run(batches):
        counter, any_ = Counter(bits), False
        for batch in batches:
            for _, _, data, at in tx.chunks(batch, limit=CHUNK):
                spell(counter, code.value, data, at)
                any_ = True
        if any_:
            yield from _blobs(counter.counts.ravel(), 2 * BLOCK)
    return run


def _gather(shared):
    @give_back
    def run(batches):
        code, bits, tables = shared.value
        histogram, any_ = Histogram(bits, tables), False
        for batch in batches:
            for _, _, data, at in tx.chunks(batch, limit=CHUNK):
                spell(histogram, code, data, at, np.ones(len(at) - 1))
                any_ = True
        if any_:
            yield from _blobs(histogram.cells, BINS ** 3 * 2)
    return run


def _blobs(flat: np.ndarray, per: int):
    """The parts that hold anything, bytes of equal weight together (most are zero)."""
    for block in range(len(flat) // per):
        part = flat[block * per:(block + 1) * per]
        if part.any():
            planes = part.view(np.uint8).reshape(per, -1).T
            yield _blob(block, np.ascontiguousarray(planes).tobytes())


def _blob(block: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(body, 1)], pa.binary())],
                                      names=["block", "body"])


def _summed(kind: type, pack: bool):
    """Rows sorted by block: one row per block with the sum."""
    def run(batches):
        block, total = None, None
        for batch in batches:
            for b, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                planes = np.frombuffer(zlib.decompress(body.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1)
                values = np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)
                if b != block:
                    if block is not None:
                        yield _blob(block, (states(total) if pack else total).tobytes())
                    block, total = b, values
                else:
                    total += values
        if block is not None:
            yield _blob(block, (states(total) if pack else total).tobytes())
    return run


def _sums(spark: SparkSession, blobs: DataFrame, kind: type, out: np.ndarray, pack: bool) -> np.ndarray:
    """Blocks of all tasks added up on executors, one row a block to the driver: ``out``, of fixed size."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = blobs.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(_summed(kind, pack), TABLES)
    for r in summed.collect():
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.body)), out.dtype)
    return out


def fit(spark: SparkSession, training: DataFrame, text: str = "text") -> tuple[Code, Model, DataFrame, int, int, int]:
    """(code, model, stored word counts, training tokens, distinct tokens, least count of a head word)."""
    texts = training.select(F.col(text).alias("text"))
    counts = texts.mapInArrow(_word_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = persist_table(spark, counts.filter("n > 0"), "word-counts")
    words = counts.filter("kind = 0").select("key", "n")
    # the least count of a head word, from how many words have each count: few rows
    by_count = sorted(((r.n, r.words) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, taken, tokens = 1 << 62, 0, 0
    for n, k in by_count:
        if taken + k > HEAD or n < LEAST:
            break
        least, taken, tokens = n, taken + k, tokens + n * k
    head = words.filter(F.col("n") >= least).collect()  # HEAD rows at most
    others = {(r.kind, r.key): r.n for r in counts.filter("kind > 0").collect()}
    all_words = sum(n * k for n, k in by_count)
    ends = others.get((2, 0), 0)
    code = Code(np.array([r.key for r in head], np.int64).view(_U), np.array([r.n for r in head], np.int64), ends,
                all_words - tokens, np.array([others.get((1, b), 0) for b in range(256)]))
    distinct = sum(k for _, k in by_count) + (1 if ends else 0)

    bits = slot_bits(all_words + ends)
    shared = spark.sparkContext.broadcast(code)
    tables = _sums(spark, texts.mapInArrow(_count(shared, bits), TABLES), np.uint32,
                   np.zeros((2 * (1 << bits) // BLOCK, BLOCK), np.uint16), True).reshape(2, -1)
    counted = spark.sparkContext.broadcast((code, bits, tables))  # of fixed size
    cells = _sums(spark, texts.mapInArrow(_gather(counted), TABLES), np.int64,
                  np.zeros((GATES, BINS ** 3 * 2), np.int64), False)
    return code, Model(bits, tables, *learned(cells)), words, all_words + ends, distinct, least


SCORES = "id long, trained boolean, n_bytes long, n_tokens long, head_known long, head_sum double, log_p double, rare array<long>"


def _score(shared):
    @give_back
    def run(batches):
        code, model = shared.value
        known = np.append(np.log10(code.counts + 0.5), [0.0, 0.0])
        for batch in batches:
            trained = tx.column(batch, "trained").to_numpy(zero_copy_only=False)
            for lo, hi, data, at in tx.chunks(batch, limit=CHUNK):
                log_p, tokens, symbol, word, doc, first = spell(model, code, data, at, trained[lo:hi])
                is_head = symbol < code.end
                rare = word[~is_head].view(np.int64)
                cut = np.append(0, np.cumsum(np.bincount(doc[~is_head], minlength=hi - lo)))
                yield pa.RecordBatch.from_arrays([
                    tx.column(batch, "id").slice(lo, hi - lo), tx.column(batch, "trained").slice(lo, hi - lo),
                    pa.array(np.diff(at)), pa.array(tokens.astype(np.int64)),
                    pa.array(np.bincount(doc[is_head], minlength=hi - lo).astype(np.int64)),
                    pa.array(np.bincount(doc, known[symbol] * is_head, hi - lo)), pa.array(log_p / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rare))],
                    names=["id", "trained", "n_bytes", "n_tokens", "head_known", "head_sum", "log_p", "rare"])
    return run


def text_scores(spark: SparkSession, docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``trained``, ``n_bytes``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``bits_per_byte``) of every document, learning from the rows where ``training`` holds.

    Null texts are empty: their only token is the end. Repeated rows score alike where ``training`` holds for all or
    none of them. Without a
    training row every word is unknown and spelled with even odds. An empty table gives an
    empty result. Words are compared by 64-bit hashes."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("trained"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    code, model, words, tokens, distinct, least = fit(spark, rows.filter("trained"))
    shared = spark.sparkContext.broadcast((code, model))  # tables of fixed size
    scored = persist_table(spark, rows.mapInArrow(_score(shared), SCORES)
                           .withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = scored.select("row", F.explode("rare").alias("key"))
    joined = rare.join(words.filter(F.col("n") < least), "key", "left")
    per_row = joined.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_sum"),
                                        F.count("n").alias("rare_known"))
    out = scored.drop("rare").join(per_row, "row", "left")
    total = tokens + 0.5 * (distinct + 1)
    base = (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + float(np.log10(code.ends + 0.5))
            - F.col("n_tokens") * float(np.log10(total)))
    return out.select("id", "trained", "n_bytes", "n_tokens",
                      (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + (1 if code.ends else 0)).alias("n_known"),
                      F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("log_p").alias("score"),
                      F.when(F.col("n_bytes") > 0, -F.col("log_p") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
