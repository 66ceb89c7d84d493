"""External induced sorting: suffix array and longest common prefixes of one shard.

The suffixes of a string are sorted by induction from its leftmost S-type suffixes (a suffix is S-type
if it is smaller than the next one, L-type if larger). One sweep over the buckets in ascending
order induces all L-type suffixes, one in descending order all S-type ones. A sweep is driven by
a priority queue keyed by (first symbol, order of arrival): popping a suffix pushes the suffix
that starts one symbol earlier, if it is of the sweep's type. Every entry carries, along with its
position, its common prefix with the entry before it: the common prefix of two pushed suffixes is one
more than that of the two that pushed them, a minimum over the entries popped in between.
Between L- and S-type suffixes of a bucket it is the shorter of the two runs of their first symbol.

The starting order comes from the same sweeps: run over starts of which only the first run of
equal symbols is known, they sort the substrings that reach from a start to the end of the next
start's run, whose carried prefixes tell equal ones; equal substrings get one name,
and if names repeat, the string of names is sorted by recursion. Names are written in two
digits where there are many, so the alphabet, and with it the number of buckets, stays small at
every level. Recursion ends in memory, by doubling ranks, once a string of names has at most
``BASE`` symbols.

Entries move in arrays, and a queue whose arrays pass ``memory`` bytes writes them to an unnamed
file in Spark's local scratch folder, as Spark's own sorts do: nothing outlives the task, and a
repeated task starts anew. Only the string itself (and a few bytes per symbol of types and runs)
must fit into memory, not the tuples.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 16
FEW_NAMES = 1024
BASE = 1 << 21
_BIG = np.int32(1 << 30)


class Queues:
    """First-in-first-out queues of (position, common prefix), one for each symbol; in memory up to a
    limit, beyond it on disk."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts: dict[int, list] = {}
        self.file = None
        self.spilled = 0

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((position, prefix))
        self.held += 8 * len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.file = tempfile.TemporaryFile(dir=folder)
        self.file.seek(0, os.SEEK_END)
        for segments in self.parts.values():
            for k, s in enumerate(segments):
                if isinstance(s[0], np.ndarray):
                    segments[k] = (self.file.tell(), len(s[0]))
                    self.file.write(s[0].astype(np.int32).tobytes())
                    self.file.write(s[1].astype(np.int32).tobytes())
        self.spilled += self.held
        self.held = 0

    def _read(self, segment) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(segment[0], np.ndarray):
            return segment
        self.file.seek(segment[0])
        both = np.frombuffer(self.file.read(8 * segment[1]), np.int32)
        return both[:segment[1]], both[segment[1]:]

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        waiting, size = [], 0
        for segment in self.parts.pop(symbol, []):
            if isinstance(segment[0], np.ndarray):
                self.held -= 8 * len(segment[0])
            waiting.append(self._read(segment))
            size += len(waiting[-1][0])
            if size >= BATCH:
                yield from _batches(waiting)
                waiting, size = [], 0
        yield from _batches(waiting)

    def all(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The whole queue, which stays."""
        found = [self._read(s) for s in self.parts.get(symbol, [])]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _batches(segments: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if segments:
        position, prefix = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*segments, strict=True))
        for k in range(0, len(position), BATCH):
            yield position[k:k + BATCH], prefix[k:k + BATCH]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], ends included, for every pair (low <= high)."""
    if not len(low):
        return np.zeros(0, values.dtype)
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        here = level == k
        if here.any():
            a, b = low[here], high[here] - (1 << k) + 1
            out[here] = np.minimum(table[a], table[b])
        half = 1 << k
        if len(table) <= half:
            break
        table = np.minimum(table[:-half], table[half:])
    return out


class String:
    """A string with its suffix types. The last symbol must be 0 and stand nowhere else."""

    def __init__(self, symbols: np.ndarray, memory: int):
        n = len(symbols)
        self.symbols, self.n, self.memory = symbols, n, memory
        self.size = int(symbols.max()) + 1
        differs = np.ones(n, bool)
        differs[:-1] = symbols[1:] != symbols[:-1]
        ends = np.flatnonzero(differs).astype(np.int32)
        del differs
        lengths = np.diff(ends, prepend=np.int32(-1))
        self.run = np.repeat(ends + np.int32(1), lengths)
        self.run -= np.arange(n, dtype=np.int32)
        rises = symbols[np.minimum(ends + 1, n - 1)] > symbols[ends]
        rises[-1] = True
        self.s_type = np.repeat(rises, lengths)
        self.starts = np.zeros(n, bool)
        self.starts[1:] = self.s_type[1:] & ~self.s_type[:-1]

    def sweep(self, given: Queues, upward: bool) -> Queues:
        """Suffixes of one type in the order of the sweep, bucket by bucket. ``given`` holds, for each
        symbol and in the order of the sweep, the suffixes that follow the induced ones."""
        queues, done = Queues(self.memory), Queues(self.memory)
        wanted = ~self.s_type if upward else self.s_type
        pending = np.full(self.size, -1, np.int32)  # least common prefix since a symbol's last push

        def popped(position: np.ndarray, prefix: np.ndarray, symbol: int) -> list:
            """Push what a batch induces; returns the part that belongs to the same bucket."""
            nonlocal pending
            before = position - 1
            from_ = np.flatnonzero((position > 0) & wanted[before])
            if not len(from_):
                np.minimum(pending, prefix.min(), out=pending)
                return []
            target = self.symbols[before[from_]]
            order = np.argsort(target, kind="stable")
            from_, target = from_[order], target[order]
            head = np.ones(len(target), bool)
            head[1:] = target[1:] != target[:-1]
            low = np.zeros(len(target), np.int64)
            low[1:] = from_[:-1] + 1
            low[head] = 0
            least = range_minima(prefix, low, from_)
            least[head] = np.minimum(least[head], pending[target[head]])
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(target)) - 1
            rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], _BIG)
            np.minimum(pending, rest[0], out=pending)
            pending[target[heads]] = rest[from_[tails] + 1]
            moved, carried = before[from_].astype(np.int32), (least + 1).astype(np.int32)
            same = []
            for t, a, b in zip(target[heads].tolist(), heads.tolist(), (tails + 1).tolist(), strict=True):
                if t == symbol:
                    same.append((moved[a:b], carried[a:b]))
                else:
                    queues.push(t, moved[a:b], carried[a:b])
            return same

        symbols = range(self.size) if upward else range(self.size - 1, -1, -1)
        for c in symbols:
            last = -1
            wave = queues.pop(c)
            while True:
                following = []
                for position, prefix in wave:
                    done.push(c, position, prefix)
                    last = int(position[-1])
                    following += popped(position, prefix, c)
                if not following:
                    break
                wave = _batches(following)
            first = True
            for position, prefix in given.pop(c):
                if first:
                    prefix = prefix.copy()
                    prefix[0] = min(self.run[last], self.run[position[0]]) if last >= 0 else 0
                    first = False
                popped(position, prefix, c)
        queues.close()
        return done

    def _reversed(self, queue: Queues) -> Queues:
        """Buckets turned around: each entry's prefix is the one it had with its new forerunner."""
        out = Queues(self.memory)
        for c in list(queue.parts):
            position, prefix = queue.all(c)
            out.push(c, position[::-1], np.append(prefix[1:], np.int32(0))[::-1])
        return out

    def induced(self, starts: np.ndarray, prefix: np.ndarray) -> tuple[Queues, Queues]:
        """Both sweeps from the starts in the given order; prefixes with the forerunner."""
        given = Queues(self.memory)
        symbol = self.symbols[starts]
        cut = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(starts)).tolist(), strict=True):
            given.push(int(symbol[a]), starts[a:b].astype(np.int32), prefix[a:b].astype(np.int32))
        large = self.sweep(given, True)
        given.close()
        turned = self._reversed(large)
        small = self.sweep(turned, False)
        turned.close()
        return large, small

    def _small_order(self, small: Queues, c: int) -> tuple[np.ndarray, np.ndarray]:
        position, prefix = small.all(c)
        return position[::-1], np.append(prefix[1:], np.int32(0))[::-1]

    def sorted_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The starts in suffix order, and the common prefix of each with the one before."""
        place = np.flatnonzero(self.starts).astype(np.int32)
        if len(place) <= 1:
            return place, np.zeros(len(place), np.int32)
        # what is known of a start at first: its run of equal symbols, which a larger one follows
        known = place[np.lexsort((-self.run[place], self.symbols[place]))]
        run = self.run[known]
        large, small = self.induced(known, np.minimum(run, np.append(run[:1], run[:-1])))
        large.close()
        # the substrings in order: starts among the S-type suffixes, the end of the string first
        positions, prefixes = [np.array([self.n - 1], np.int32)], [np.zeros(1, np.int32)]
        for c in range(self.size):
            position, prefix = self._small_order(small, c)
            if not len(position):
                continue
            is_start = np.flatnonzero(self.starts[position])
            if not len(is_start):
                continue
            positions.append(position[is_start])
            least = np.minimum.reduceat(prefix[:is_start[-1] + 1], np.append(0, is_start[:-1] + 1))
            least[0] = 0  # another first symbol
            prefixes.append(least)
        small.close()
        positions, prefixes = np.concatenate(positions), np.concatenate(prefixes)
        number = np.zeros(self.n, np.int32)
        number[place] = np.arange(len(place))
        length = np.append(np.diff(place) + self.run[place[1:]], 1)[number[positions]]
        new = np.ones(len(positions), bool)
        new[1:] = (prefixes[1:] < length[1:]) | (length[1:] != length[:-1])
        name = np.cumsum(new) - 1
        between = prefixes[new]  # common prefix of a name with the name before
        if int(name[-1]) + 1 == len(place):
            return positions, prefixes
        count = int(name[-1]) + 1
        names = np.zeros(len(place), np.int32)
        names[number[positions]] = name
        del known, run, positions, prefixes, number, length, new, name  # only the names go down
        order, common = _names_order(names, count, self.n, self.memory)
        # symbols covered by the common names, then the common prefix of the first two that differ
        a, b = order[:-1], order[1:]
        k = common[1:]
        whole = place[a + k] - place[a]
        x, y = names[a + k], names[b + k]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        prefix = np.append(0, whole + range_minima(between, low, high))
        return place[order], prefix.astype(np.int32)


def _names_order(names: np.ndarray, count: int, longer: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of the names, and how many names each shares with the one before."""
    if len(names) <= BASE:
        return _doubled(names)
    if count <= FEW_NAMES or 2 * len(names) > 0.9 * longer:
        digits, string = 1, names
    else:
        digits, base = 2, int(np.ceil(np.sqrt(count)))
        string = np.zeros(2 * len(names) - 1, np.int64)  # the end stays a single smallest symbol
        string[0:-1:2], string[1:-1:2] = names[:-1] // base + 1, names[:-1] % base + 1
    order, prefix = suffix_array(string, memory)
    if digits == 1:
        return order, prefix
    at = np.flatnonzero(order % 2 == 0)
    least = np.minimum.reduceat(prefix[:at[-1] + 1], np.append(0, at[:-1] + 1))
    return order[at] // 2, least // 2


def _doubled(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base of the recursion: order and common prefixes from ranks of ever longer prefixes."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    head = np.append(0, np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).astype(np.int32)
    del sorted_
    rank = np.empty(n + 1, np.int32)  # suffixes that are smaller by the symbols seen
    sizes = np.diff(head, append=np.int32(n))
    rank[order] = np.repeat(head, sizes)
    rank[n] = -1
    ranks, width = [rank.copy()], 1
    open_ = order[np.repeat(sizes > 1, sizes)].astype(np.int32)
    open_.sort()
    del order, head, sizes
    while len(open_):
        key = rank[open_].astype(np.int64) * (n + 2) + rank[np.minimum(open_ + width, n)] + 1
        by = np.argsort(key, kind="stable")
        moved, key = open_[by], key[by]
        old = rank[moved]
        at = np.arange(len(moved))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        rank[moved] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        alone = fresh & np.append(fresh[1:], True)
        open_ = moved[~alone]
        width *= 2
        ranks.append(rank.copy())
    order = np.empty(n, np.int32)
    order[rank[:n]] = np.arange(n, dtype=np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int32)
    for k in range(len(ranks) - 1, -1, -1):
        known = ranks.pop()
        same = (known[np.minimum(a, n)] == known[np.minimum(b, n)]) & (a < n) & (b < n)
        for c in (a, b, common):
            c[same] += 1 << k
    return order, np.append(np.int32(0), common)


def suffix_array(symbols: np.ndarray, memory: int = 16 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``symbols`` (whole numbers from 0; the last is 0 and stands nowhere else) and the
    common prefix of each suffix with the one before it. Queues keep ``memory`` bytes each in
    memory at most."""
    size = int(symbols.max()) + 1
    string = String(symbols.astype(np.uint8 if size <= 256 else np.uint16 if size <= 1 << 16 else np.int32), memory)
    if string.n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    starts, prefix = string.sorted_starts()
    large, small = string.induced(starts, prefix)
    order, common = [np.array([string.n - 1], np.int32)], [np.zeros(1, np.int32)]
    for c in range(string.size):
        first, first_prefix = large.all(c)
        second, second_prefix = string._small_order(small, c)
        if len(first):
            order.append(first)
            common.append(first_prefix)
        if len(second):
            second_prefix = second_prefix.copy()
            second_prefix[0] = min(string.run[first[-1]], string.run[second[0]]) if len(first) else 0
            order.append(second)
            common.append(second_prefix)
    large.close()
    small.close()
    return np.concatenate(order), np.concatenate(common)
