"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles; two documents link when their Jaccard
similarity reaches ``num / den``. The result is the connected components of all links, found
without listing pairs:

1. Blocking, exact. Sets of compatible sizes that link differ in at most H shingles. Shingles are
   dealt by hash into P > H parts, so two linked sets agree on P - H parts at least, and a set
   knows how many keys, one per filled part, it shares with any set it links with: t. Keys are
   ordered by the number of sets that have them, rarest first. Of the keys that two linked sets
   share, the first has t - 1 others behind it in both sets, so each set leaves out its last t - 1
   keys and the two still share one. Common passages are what is left out, so they do not join the
   documents that quote them, and a set with fewer than t keys that others have drops out. Sets that
   share a key that both kept become candidates (an edge to the smallest set of the key, never all
   pairs). Kept keys go out once from a task, however many of its sets have them.
2. Components of the candidate edges form the blocks; every link lies inside a block.
3. In a block the sets are the leaves of a signature tree. A node holds the OR of its
   sets' shingle bitmaps, the range of set sizes and the largest bitmap excess (shingles minus
   bits). Two nodes are traversed against each other from the root; a pair of nodes is dropped
   when sizes or the largest possible overlap rule out any link, or when all sets below are
   connected already. Leaf pairs that remain are compared exactly.

A block of more than ``piece_shingles`` shingles is cut into windows of two neighbouring size classes, and a
window that is larger still by hash into pieces that meet in pairs, so a task never holds more than two pieces;
their links go through the component search once more. Equal sets count as one
node throughout. Shingles are compared by 64-bit hashes.

Rows are told apart by their text, never by their id alone: ids may be null or equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import text as tx
from sluice.llm.batches import give_back, small_batches
from sluice.llm.columns import packed, unpacked
from sluice.llm.components import components
from sluice.session import persist_table

_U = np.uint64
FAN_OUT = 8
BROADCAST_ROWS = 500_000


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, shingle hash) pairs of lower-cased words."""
    low, start, end, doc, first = tx.words(data, at)
    word = tx.span_hash(tx.prefix_hash(low), start, end)
    n = len(word)
    h = np.zeros(max(n - k + 1, 0), _U)
    for j in range(k):
        h = tx.mix(h + word[j:n - k + 1 + j]) if len(h) else h
    whole = doc[k - 1:] == doc[:len(h)] if len(h) else np.zeros(0, bool)
    owner, value = doc[:len(h)][whole], h[whole]
    # documents of fewer words: the sequence as one shingle, told apart by its length
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        s = np.zeros(len(short), _U)
        for j in range(k - 1):
            here = counts[short] > j
            s[here] = tx.mix(s[here] + word[first[short[here]] + j])
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, tx.mix(s + counts[short].astype(_U) * _U(0xD6E8FEB86659FD93))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    np.add.at(out, group, values)
    return out


def digests(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and two independent 64-bit digests of the sets."""
    sizes = np.bincount(owner, minlength=n)
    one = tx.mix(_sums(tx.mix(value), owner, n) + sizes.astype(_U))
    two = tx.mix(_sums(tx.mix(value ^ _U(0x5851F42D4C957F2D)), owner, n) ^ sizes.astype(_U))
    return sizes, one, two


class SizeClasses:
    """Classes of set sizes, the number of parts of each, and which classes a set belongs to. A pair
    meets in the class of its smaller set."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lower, self.parts = [1], []
        self.grow(1 << 10)

    def grow(self, size: int) -> None:
        while self.lower[-1] <= size:
            low = self.lower[-1]
            up = max(low + 1, int(low * (self.den / self.num) ** 1.5))
            most = up - 1
            differ = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            # spare parts: as many common keys can be left out, and agreeing on empty parts alone is rare
            self.parts.append(differ + 1 + (differ // 4 + 2 if differ else 0))
            self.lower.append(up)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last class of each size."""
        if len(sizes):
            self.grow(int(sizes.max()) + 1)
        least = -(-sizes * self.num // self.den)
        lower = np.array(self.lower)
        return np.searchsorted(lower, least, "right") - 1, np.searchsorted(lower, sizes, "right") - 1


MOST_LEFT_OUT = (1 << 14) - 1


def part_keys(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, mark) of every part of every set, in all classes of the set. The mark says how many keys of the
    class the set may leave out, times four, plus the class modulo four (a set is in three classes at most)."""
    out_doc, out_key, out_mark = [], [], []
    low, high = classes.of(np.maximum(sizes, 1))
    spread = tx.mix(value ^ _U(0x2545F4914F6CDD1D)) >> _U(20)
    values = tx.mix(value)
    num, den = classes.num, classes.den
    for step in range(int((high - low).max()) + 1 if len(sizes) else 0):
        c = low + step
        here = (c <= high) & (sizes > 0)
        parts = np.where(here, np.array(classes.parts)[c.clip(max=len(classes.parts) - 1)], 0)
        base = np.cumsum(parts) - parts
        total = int(parts.sum())
        inside = here[owner]
        o = owner[inside]
        slot = base[o] + (spread[inside] % parts[o].astype(_U)).astype(np.int64)
        sums, filled = _sums(values[inside], slot, total), np.bincount(slot, minlength=total)
        doc = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(total) - base[doc]
        key = tx.mix(sums + tx.mix((c[doc].astype(_U) << _U(32)) + number.astype(_U) + _U(1)))
        # the parts that differ are no more than the shingles that do: with a larger set in the set's own class,
        # with a set of the class in a smaller one
        most = np.array(classes.lower)[(c + 1).clip(max=len(classes.lower) - 1)] - 1
        both = sizes + np.where(c == high, sizes * den // num, np.minimum(sizes, most))
        shared = parts - both * (den - num) // (den + num) - np.bincount(doc[filled == 0], minlength=len(sizes))
        # if all agreeing parts may be empty, these count too, and one key is sure to be shared
        emitted = (filled > 0) | (shared < 1)[doc]
        mark = ((shared - 1).clip(0, MOST_LEFT_OUT) << 2 | c & 3).astype(np.uint16)
        out_doc.append(doc[emitted])
        out_key.append(key[emitted])
        out_mark.append(mark[doc[emitted]])
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint16)
    return np.concatenate(out_doc), np.concatenate(out_key), np.concatenate(out_mark)


def _set_rows(k: int, text: str):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text):
                sizes, one, two = digests(*shingles(data, at, k), hi - lo)
                yield pa.RecordBatch.from_arrays([
                    tx.column(batch, "id").slice(lo, hi - lo), tx.column(batch, "told").slice(lo, hi - lo), pa.array(sizes.astype(np.int64)),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["id", "told", "n", "node", "check"])
    return run


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, smallest node of each, u, v): every other node of a key with the smallest, pairs once."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    least = node[first]
    centre = least[np.cumsum(first) - 1] if len(key) else node
    apart = node != centre
    pairs = np.unique(np.stack([node[apart], centre[apart]], 1), axis=0)
    return key[first], least, pairs[:, 0], pairs[:, 1]


HELD_KEYS = 3_000_000


def _dealt(by: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple]:
    """(bucket, columns as bytes) of each bucket of the 64-bit numbers ``by``."""
    which = ((by >> _U(32)) * _U(buckets)) >> _U(32)
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(buckets + 1, dtype=_U))
    columns = [c[order] for c in columns]
    return [(b, *[c[x:y].tobytes() for c in columns]) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if x < y]


def _packed_batches(rows: list[tuple], names: list[str]):
    for x in range(0, len(rows), 64):
        part = list(zip(*rows[x:x + 64], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *[pa.array(c, pa.binary()) for c in part[1:]]], names=["bucket", *names])


def _by_bucket(batches, *kinds):
    """The arrays of each bucket of rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, *columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if b != bucket:
                if held:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]
                bucket, held = b, []
            held.append([np.frombuffer(c, kind) for c, kind in zip(columns, kinds, strict=True)])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


ALL_KEYS = "bucket int, key binary, node binary, mark binary"


def _key_rows(k: int, text: str, num: int, den: int, buckets: int):
    """The part keys of the task's sets with node and mark, as one row of packed arrays per bucket of keys."""
    def run(batches):
        classes = SizeClasses(num, den)
        seen: set[int] = set()  # of this task's documents: copies emit their keys once
        held, n = [], 0
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text):
                owner, value = shingles(data, at, k)
                sizes, one, _ = digests(owner, value, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for d, node in enumerate(one.tolist()):
                    if sizes[d] and node not in seen:
                        seen.add(node)
                        fresh[d] = True
                keep = fresh[owner]
                doc, key, mark = part_keys(owner[keep], value[keep], np.where(fresh, sizes, 0), classes)
                held.append((key, one[doc], mark))
                n += len(key)
                if n >= HELD_KEYS:
                    key, node, mark = map(np.concatenate, zip(*held, strict=True))
                    yield from _packed_batches(_dealt(key, buckets, key, node, mark), ["key", "node", "mark"])
                    held, n = [], 0
        if n:
            key, node, mark = map(np.concatenate, zip(*held, strict=True))
            yield from _packed_batches(_dealt(key, buckets, key, node, mark), ["key", "node", "mark"])
    return run


SHARED_KEYS = "bucket int, node binary, key binary, sets binary, mark binary"


def _shared_rows(buckets: int):
    """Rows sorted by bucket of keys: the keys that several sets have, with the number of sets, per bucket of nodes."""
    def run(batches):
        held, n = [], 0
        for key, node, mark in _by_bucket(batches, _U, _U, np.uint16):
            order = np.lexsort((node, key))
            key, node, mark = key[order], node[order], mark[order]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, mark = key[new], node[new], mark[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            sets = np.repeat(times, times)
            several = sets > 1
            held.append((node[several], key[several], sets[several].astype(np.uint32), mark[several]))
            n += len(held[-1][0])
            if n >= HELD_KEYS:
                yield from packed_rows(held)
                held, n = [], 0
        if n:
            yield from packed_rows(held)

    def packed_rows(held):
        columns = list(map(np.concatenate, zip(*held, strict=True)))
        yield from _packed_batches(_dealt(columns[0], buckets, *columns), ["node", "key", "sets", "mark"])
    return run


def _rarest(node: np.ndarray, key: np.ndarray, sets: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which of their shared keys the sets keep: in each class all but the most common ones that may be left out."""
    order = np.lexsort((key, sets, mark & 3, node))
    node, mark = node[order], mark[order]
    first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (mark[1:] & 3 != mark[:-1] & 3)))
    times = np.diff(np.append(first, len(node)))
    place = np.arange(len(node)) - np.repeat(first, times)
    kept = np.zeros(len(node), bool)
    kept[order] = place < np.repeat(times, times) - (mark >> 2)
    return kept


KEYS = "bucket int, key binary, node binary, u binary, v binary"


def _kept_rows(buckets: int):
    """Rows sorted by bucket of nodes: the keys that the sets keep, each key once with its smallest node, as one row of
    packed arrays per bucket of keys, and the edges that the task has found itself."""
    def packed_rows(held: list):
        key, least, u, v = _stars(*map(np.concatenate, zip(*held, strict=True)))
        rows = [(*row, b"", b"") for row in _dealt(key, buckets, key, least)]
        if len(u):
            rows.append((int(u[0] % buckets), b"", b"", u.tobytes(), v.tobytes()))
        yield from _packed_batches(rows, ["key", "node", "u", "v"])

    def run(batches):
        held, n = [], 0
        for node, key, sets, mark in _by_bucket(batches, _U, _U, np.uint32, np.uint16):
            kept = _rarest(node, key, sets, mark)
            held.append((key[kept], node[kept].view(np.int64)))
            n += int(kept.sum())
            if n >= HELD_KEYS:
                yield from packed_rows(held)
                held, n = [], 0
        if n:
            yield from packed_rows(held)
    return run


def _star_rows(batches):
    """Rows sorted by bucket: the candidate edges of each bucket's keys."""
    def out(u: np.ndarray, v: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    bucket, keys, nodes = None, [], []
    for batch in batches:
        for b, key, node, u, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if u:
                yield out(np.frombuffer(u, np.int64), np.frombuffer(v, np.int64))
            if b != bucket:
                if keys:
                    yield out(*_stars(np.concatenate(keys), np.concatenate(nodes))[2:])
                bucket, keys, nodes = b, [], []
            keys.append(np.frombuffer(key, _U))
            nodes.append(np.frombuffer(node, np.int64))
    if keys:
        yield out(*_stars(np.concatenate(keys), np.concatenate(nodes))[2:])


class Tree:
    """Levels of nodes over one block, leaves first."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets])
        # neighbours in the tree should resemble each other: order by the smallest shingle hash
        self.order = np.lexsort((sizes, np.array([s[0] for s in sets])))
        self.sets = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        words = bits // 64
        leaf = np.zeros((len(sets), words), _U)
        for i, s in enumerate(self.sets):
            bit = tx.mix(s) % _U(bits)
            np.bitwise_or.at(leaf[i], (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
        excess = sizes - np.bitwise_count(leaf).sum(axis=1, dtype=np.int64)
        self.levels = [(leaf, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            bitmap, least, most, over = self.levels[-1]
            cut = np.arange(0, len(bitmap), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, cut, axis=0), np.minimum.reduceat(least, cut),
                                np.maximum.reduceat(most, cut), np.maximum.reduceat(over, cut)))


class Links:
    """Union of sets as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        old = np.unique(self.label[np.append(others, i)])
        self.label[np.isin(self.label, old)] = old[0]


def _linked(sets: list[np.ndarray], i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``others`` whose set links with set ``i``, by exact comparison."""
    own = sets[i]
    sizes = np.array([len(sets[j]) for j in others])
    tokens = np.concatenate([sets[j] for j in others])
    at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
    cut = np.cumsum(sizes) - sizes
    common = np.add.reduceat((own[at] == tokens).astype(np.int64), cut)
    return others[den * common >= num * (sizes + len(own) - common)]


def block_links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of a set of its component (the component's smallest in tree order).
    With ``side`` (0 or 1 for each set) only sets of different sides are compared."""
    n = len(sets)
    if n == 1:
        return np.zeros(1, np.int64)
    if n == 2:  # a tree of two leaves
        found = _linked(sets, 0, np.array([1]), num, den) if side is None or side[0] != side[1] else ()
        return np.zeros(2, np.int64) if len(found) else np.arange(2)
    longest = max(len(s) for s in sets)
    bits = min(1 << 16, max(256, 1 << (16 * longest - 1).bit_length()))
    tree = Tree(sets, bits)
    links = Links(n)
    sides = np.zeros(n, int) if side is None else side[tree.order]

    def possible(level, a, b):
        bitmap, least, most, over = tree.levels[level]
        fits = (den * most[a] >= num * least[b]) & (den * most[b] >= num * least[a])
        a, b = a[fits], b[fits]
        shared = np.zeros(len(a), np.int64)
        step = max(1, (8 << 20) // (bitmap.shape[1] * 8))
        for k in range(0, len(a), step):
            shared[k:k + step] = np.bitwise_count(bitmap[a[k:k + step]] & bitmap[b[k:k + step]]).sum(axis=1, dtype=np.int64)
        shared += np.minimum(over[a], over[b])
        # overlap o of sets of x and y shingles links if (num + den) * o >= num * (x + y)
        able = (num + den) * shared >= num * (least[a] + least[b])
        return a[able], b[able]

    def visit(level, a, b):
        """Node pairs a <= b of a level that may hold links."""
        for k in range(0, len(a), 4096):
            x, y = possible(level, a[k:k + 4096], b[k:k + 4096])
            if not len(x):
                continue
            if level == 0:
                for i in np.unique(x):
                    js = y[x == i]
                    js = js[(links.label[js] != links.label[i]) & ((side is None) | (sides[js] != sides[i]))]
                    while len(js):
                        found = _linked(tree.sets, i, js[:256], num, den)
                        if len(found):
                            links.join(i, found)
                        js = js[256:]
                        js = js[links.label[js] != links.label[i]]
                continue
            below = len(tree.levels[level - 1][0])
            child = np.arange(FAN_OUT)
            left = (x[:, None, None] * FAN_OUT + child[None, :, None]) + np.zeros((1, 1, FAN_OUT), int)
            right = (y[:, None, None] * FAN_OUT + child[None, None, :]) + np.zeros((1, FAN_OUT, 1), int)
            keep = (left < below) & (right < below) & (left <= right)
            if level == 1:
                keep &= left < right
            left, right = left[keep], right[keep]
            width = FAN_OUT ** (level - 1)
            if len(left) > 64:  # both nodes inside one component: nothing to find
                low, high = _ranges(links.label, width)
                same = (low[left] == high[left]) & (low[left] == low[right]) & (low[right] == high[right])
                left, right = left[~same], right[~same]
            visit(level - 1, left, right)

    top = len(tree.levels) - 1
    visit(top, np.zeros(1, int), np.zeros(1, int))
    out = np.empty(n, np.int64)
    out[tree.order] = tree.order[links.label]
    return out


def _ranges(label: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.arange(0, len(label), width)
    return np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)


def _member_rows(k: int, text: str):
    def run(batches):
        seen: set[int] = set()  # of this task's nodes: repeated rows stand for one set
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text):
                owner, value = shingles(data, at, k)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                part = batch.slice(lo, hi - lo)
                nodes = tx.column(part, "node")
                fresh = np.zeros(hi - lo, bool)
                for i, node in enumerate(nodes.to_pylist()):
                    fresh[i] = node not in seen
                    seen.add(node)
                out = pa.RecordBatch.from_arrays([
                    *[tx.column(part, c) for c in ("block", "cls", "whole")], nodes,
                    pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["block", "cls", "whole", "node", "shingles"])
                yield out.filter(pa.array(fresh))
    return run


def _block_rows(num: int, den: int):
    """Rows sorted by (block, window, first, second): the links of each block, or of each pair of pieces
    of its windows."""
    def solved(node, piece, sets, first, second):
        side = None
        if first != second:
            side = (np.array(piece) == second).astype(int)
        root = block_links([np.frombuffer(s, _U) for s in sets], num, den, side)
        node = np.array(node, np.int64)
        return node, node[root]

    def run(batches):
        key, node, piece, sets = None, [], [], []
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            out_u, out_v, out_split = [], [], []
            for block, window, first, second, own, n, s in zip(*rows, strict=True):
                if (block, window, first, second) != key:
                    if node:
                        u, v = solved(node, piece, sets, key[2], key[3])
                        out_u.append(u)
                        out_v.append(v)
                        out_split.append(np.full(len(u), key[2] >= 0))
                    key, node, piece, sets = (block, window, first, second), [], [], []
                if node and node[-1] == n and sets[-1] == s:
                    continue  # a repeated row
                node.append(n)
                piece.append(own)
                sets.append(s)
            if out_u:
                yield _edge_batch(out_u, out_v, out_split)
        if node:
            u, v = solved(node, piece, sets, key[2], key[3])
            yield _edge_batch([u], [v], [np.full(len(u), key[2] >= 0)])
    return run


def _edge_batch(u, v, split) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)),
                                       pa.array(np.concatenate(split))], names=["u", "v", "split"])


PIECE_SHINGLES = 1 << 22  # a task holds two pieces: 64 MB


def _told(text: str):
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


@small_batches
def _labelled(spark: SparkSession, docs: DataFrame, key: str, text: str, k: int, num: int, den: int, piece_shingles: int) -> DataFrame:
    """(id, told, n, node, root) of every row: its set's size and node and the node that stands for its component."""
    rows = docs.select(F.col(key).cast("long").alias("id"), _told(text).alias("told"), F.col(text).alias("text"))
    sets = persist_table(spark, rows.mapInArrow(give_back(_set_rows(k, "text")), "id long, told long, n long, node long, check long"), "sets")

    # about (1 - similarity) * 2.8 keys a shingle; a bucket holds some hundred thousand
    shingled = sets.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, int(2.8 * shingled * (den - num) / den / 500_000) + 1)
    keyed = rows.select("text").mapInArrow(give_back(_key_rows(k, "text", num, den, buckets)), ALL_KEYS)

    def dealt(packed_rows: DataFrame) -> DataFrame:
        return packed_rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    shared = dealt(keyed).mapInArrow(give_back(_shared_rows(buckets)), SHARED_KEYS)
    kept = dealt(shared).mapInArrow(give_back(_kept_rows(buckets)), KEYS)
    edges = dealt(kept).mapInArrow(give_back(_star_rows), "u long, v long")
    blocks = persist_table(spark, components(spark, edges), "blocks")
    roots = persist_table(spark, _roots(spark, rows, sets, blocks, k, num, den, piece_shingles), "roots")
    return sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _roots(spark: SparkSession, rows: DataFrame, sets: DataFrame, blocks: DataFrame, k: int, num: int, den: int,
           piece_shingles: int) -> DataFrame:
    """(node, root) of every node that links with another, but the root itself."""
    nodes = blocks.unionByName(blocks.select(F.col("component").alias("node"), "component").distinct())
    # for each distinct set of a block the row of its smallest id (nulls last) and, among those, one text
    last = F.coalesce("id", F.lit((1 << 63) - 1))
    members = sets.join(nodes, "node").groupBy("component", "node", "check").agg(
        F.min("id").alias("id"), F.min_by("told", last).alias("told"), F.min("n").alias("n"))
    # linked sets are of the same or of neighbouring size classes
    size_class = F.floor(F.log("n") / float(1.5 * np.log(den / num))).cast("int")
    members = persist_table(spark, members.select("id", "told", "node", F.col("component").alias("block"), size_class.alias("cls"), "n"),
                            "block-members")
    classes = members.groupBy("block", "cls").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    sizes = classes.groupBy("block").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("all")).filter("sets > 1")
    sizes = sizes.select("block", (F.col("all") <= piece_shingles).alias("whole"))
    members = persist_table(spark, members.join(sizes, "block").select("id", "told", "node", "block", "cls", "whole"), "members")
    chosen = _few(members.withColumnRenamed("id", "id_").withColumnRenamed("told", "told_"))
    full = rows.join(chosen, (F.col("told") == F.col("told_")) & F.col("id").eqNullSafe(F.col("id_"))).mapInArrow(
        give_back(_member_rows(k, "text")), "block long, cls int, whole boolean, node long, shingles binary")
    # a large block is cut into windows of two neighbouring size classes, a set going to two of them;
    # where a window is large, its pieces by hash meet in pairs; other blocks stay whole
    whole = full.filter("whole").select("block", F.lit(-1).alias("window"), F.lit(-1).alias("first"),
                                        F.lit(-1).alias("second"), F.lit(-1).alias("piece"), "node", "shingles")
    both = F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("window")
    windows = classes.join(sizes.filter("not whole"), "block").select("block", both, "shingles")
    windows = windows.groupBy("block", "window").agg(F.ceil(F.sum("shingles") / piece_shingles).cast("int").alias("pieces"))
    windows = _few(persist_table(spark, windows, "windows"))
    cut = full.filter("not whole").select("block", both, "node", "shingles").join(windows, ["block", "window"])
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    cut = cut.select("block", "window", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"),
                     "piece", "node", "shingles")
    pairs = whole.unionByName(cut)
    dealt = (pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "window", "first", "second")
             .sortWithinPartitions("block", "window", "first", "second", "node"))
    links = persist_table(spark, dealt.mapInArrow(give_back(_block_rows(num, den)), "u long, v long, split boolean"), "links")
    inside = links.filter("not split and u <> v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    across = components(spark, links.filter("split")).select("node", F.col("component").alias("root"))
    return inside.unionByName(across)


def _few(table: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def similar_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3,
                      num: int = 9, den: int = 10, piece_shingles: int = PIECE_SHINGLES) -> DataFrame:
    """(``id``, ``n_shingles``, ``component_id``) for every row of ``docs``: the size of its set and the
    smallest id reachable by links, its own included.

    Null and empty texts, and texts without a word, have no shingles and link with nothing.
    Repeated rows each have their line; so have rows of one id and several texts. Rows with a null id come out with a
    null id; a component of such rows alone has a null ``component_id``. An empty table gives an
    empty result."""
    labelled = _labelled(spark, docs, key, text, k, num, den, piece_shingles)
    least = labelled.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = labelled.join(least, "root", "left")
    return out.select("id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                      num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest id stays (null ids last; of rows
    that share id and text, one). Documents without shingles link with nothing and stay, a repeated id once."""
    found = _labelled(spark, docs, key, text, k, num, den, PIECE_SHINGLES).filter("n > 0")
    last = F.coalesce("id", F.lit((1 << 63) - 1))
    chosen = found.groupBy("root").agg(F.min("id").alias("id"), F.min_by("told", last).alias("told"))
    times = found.groupBy("id", "told").agg(F.count(F.lit(1)).alias("times"))
    chosen = persist_table(spark, chosen.alias("c").join(times.alias("t"), F.col("c.id").eqNullSafe(F.col("t.id")) & (F.col("c.told") == F.col("t.told")))
                           .select(F.col("c.id").alias("id_"), F.col("c.told").alias("told_"), "times"), "kept")
    named = packed(docs, id=F.col(key).cast("long"), told=_told(text), words=F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = named.join(chosen, F.col("id").eqNullSafe(F.col("id_")) & (F.col("told") == F.col("told_"))).filter("words")
    once = kept.filter("times = 1").select("row").unionByName(kept.filter("times > 1").dropDuplicates(["id", "told"]).select("row"))
    silent = named.filter("not words")
    silent = silent.filter("id IS NULL").select("row").unionByName(silent.filter("id IS NOT NULL").dropDuplicates(["id", "told"]).select("row"))
    return unpacked(once.unionByName(silent), docs.columns)
