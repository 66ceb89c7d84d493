"""Plain versions of the operators' contracts, one document at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def union_find(items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find, join


def jaccard(docs, k, num, den):
    """{id: (set size, component)}"""
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    find, join = union_find(sets)
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    common = Counter((a, b) for ids in having.values() for n, a in enumerate(ids) for b in ids[n + 1:])
    for (a, b), o in common.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            join(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, length):
    """{id: (bytes, removed, spans, sha256 of the rest)}"""
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[k:k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


def rule_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def contamination(docs, items, window=13):
    """{id: (words, hit words, items)}"""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    tests = defaultdict(set)
    for item, t in items:
        w = split(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            tests[tuple(w[k:k + size])].add(str(item))
    sizes = {len(t) for t in tests}
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in tests:
                    hit.update(range(k, k + size))
                    found |= tests[tuple(w[k:k + size])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1
