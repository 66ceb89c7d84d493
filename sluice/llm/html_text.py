"""Main text of web pages: markup says what a block is, suffix arrays of the host say what is template.

A page is read into text blocks. Markup names many of them: what stands in an ``article`` is main
text, and menus, page headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are
not, by element, role or class name. On pages without an ``article`` the rest is open: plain
blocks may be text or template.

Every page gives its host two token streams, the text of its ``article`` and all other text (named or not: a footer
that one page marks is evidence for a page that does not). The distinct streams of a host are concatenated and sorted
as a suffix array; neighbours in it that share ``min_tokens`` tokens or more are repeated substrings. They decide:

* open text goes where a distinct stream outside articles has it too; unique runs stay;
* text of an ``article`` goes where a stream outside articles has it and more than half of the host's
  distinct articles, ``MIN_ARTICLES`` at least. What only articles share, and what few of them take up (a title that
  sidebars list, a quoted notice), is text of theirs and stays.

Equal streams are copies and count once. A covered run of more than half of a page's open text is a copied text, not
boilerplate, and stays.

A host of more than ``shard_tokens`` is dealt by stream digest into slots, and each task sorts shards of whole slots. Of a
host in several slots, the distinct windows of ``min_tokens`` tokens outside articles meet in an aggregate that finds those
with two streams; a window of more than half of the articles has more than half of those of some slot, so only such
windows are counted over all articles.

Null html reads as empty, a null url as the host ''; equal rows and null ids give one row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.llm.text import mix
from sluice.session import persist_table

MIN_TOKENS = 6
MIN_ARTICLES = 4
SHARD_TOKENS = 1 << 20

# elements and names that say what a block is (fixed values)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg math iframe object audio video canvas head title".split())
RAW = set("script style noscript template iframe title textarea".split())
AROUND = set("nav footer aside menu dialog button select textarea label".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr img input label".split())
AROUND_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
AROUND_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav
    navbar navigation topnav subnav breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe
    subscription signup popup modal overlay comment comments disqus respond replies share sharing social related recommended recommendations
    widget widgets toolbar pagination pager login search skip copyright""".split())
WHOLE = {"html", "body", "article", "main"}

SETTLED, MAIN, OPEN, BESIDE = "article", "main", "open", "beside"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _zone(name: str, attributes: dict[str, str], around: str | None) -> str | None:
    """Zone of an element inside ``around``: a zone, None for text that is nobody's."""
    if around is None or name in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" \
            or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return None
    if around == BESIDE:
        return BESIDE
    role = attributes.get("role", "").lower()
    if name == "article":
        return SETTLED
    if name == "main" or role == "main":
        return SETTLED if around == SETTLED else MAIN
    if name in AROUND or role in AROUND_ROLES or name == "header" and around != SETTLED:
        return BESIDE
    if name not in WHOLE:
        names = {m.lower() for m in _NAMES.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
        if names & AROUND_NAMES or "header" in names and around != SETTLED:
            return BESIDE
    return "form" if name == "form" else around


@lru_cache(1 << 12)
def _zone_of_short(name: str, attributes: str, around: str | None) -> str | None:
    return _zone(name, _attributes(attributes), around)


def _zone_of(name: str, attributes: str, around: str | None) -> str | None:
    return _zone_of_short(name, attributes, around) if len(attributes) <= 200 else _zone(name, _attributes(attributes), around)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the text blocks of a page, in order; white space in a block is one space."""
    found: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str | None]] = [("", OPEN)]

    def zone() -> str | None:
        z = stack[-1][1]
        return BESIDE if z == "form" else z

    def flush() -> None:
        if parts:
            if (z := zone()) and (text := " ".join(html.unescape("".join(parts)).split())):
                found.append((z, text))
            parts.clear()

    at, raw = 0, None
    while at < len(page):
        if raw:  # script, style and the like end at their own end tag only
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # end tag: closes the nearest open element of its name
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    flush()
                    del stack[i:]
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        inner = _zone_of(name, m[3], stack[-1][1])
        if name in INLINE and inner == stack[-1][1]:
            continue  # stays in its block
        flush()
        if name not in INLINE:  # a block ends an open paragraph, an item the item before it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
            inner = _zone_of(name, m[3], stack[-1][1])
        stack.append((name, inner))
        if name in RAW and not m[3].rstrip().endswith("/"):
            raw = name
    flush()
    return found


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?U)^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


ARTICLE, BESIDES, JUDGED = range(3)


def _read_page(page: str | None) -> tuple[list[str], list[str], list[int], list[tuple[int, bytes, bytes]]]:
    """(article's blocks, open blocks, their first tokens in the stream, streams as (kind, digest, text))."""
    found = blocks(page or "")
    zones = {z for z, _ in found}
    open_zone = None if SETTLED in zones else MAIN if MAIN in zones else OPEN
    article, opened, at, besides, n = [], [], [], [], 0
    for z, t in found:
        if z == SETTLED:
            article.append(t)
            continue
        if z == open_zone:
            opened.append(t)
            at.append(n)
        besides.append(t)
        n += t.count(" ") + 1
    streams = []
    if article:
        raw = " ".join(article).encode("utf-8", "surrogatepass")
        streams.append((ARTICLE, hashlib.sha256(b"article " + raw).digest(), raw))
    if besides:
        raw = " ".join(besides).encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(raw + b"\n" + np.array(at, np.int64).tobytes()).digest()
        streams.append((JUDGED if opened else BESIDES, digest, raw))
    return article, opened, at, streams


_STREAM = "host string, kind int, digest binary, stream binary"
_STREAM_ARROW = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("digest", pa.binary()), ("stream", pa.binary())])


def page_streams(pages: DataFrame) -> DataFrame:
    """(host, kind, digest, compressed text) of the streams of pages (host, html), those of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        pack = zstandard.ZstdCompressor()
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64)
                rows = []
                for host, page in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    for kind, digest, raw in _read_page(page)[3]:
                        if (host, digest) not in seen:
                            seen.add((host, digest))
                            rows.append((host, kind, digest, pack.compress(raw)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STREAM_ARROW, strict=True)], schema=_STREAM_ARROW)

    return pages.select("host", "html").mapInArrow(run, _STREAM)


def suffix_array(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix positions in order, by prefix doubling of the suffixes not yet told apart, and the ranks by the first 1, 2, 4, ... tokens."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    first = np.concatenate([[True], tokens[order[1:]] != tokens[order[:-1]]])
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, size = [rank], 1
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while size < longest and len(tied):
        rank = levels[-1].copy()
        some = order[tied]
        second = np.zeros(len(some), np.int64)
        inside = some + size < n
        second[inside] = rank[some[inside] + size]
        second[inside] += 1
        key = rank[some].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, some = key[by], some[by]
        order[tied] = some
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = tied[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank)
        tied = tied[~(first & np.append(first[1:], True))]
        size *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order (0 for the first)."""
    n = len(order)
    a, b = order[:-1].astype(levels[0].dtype), order[1:].astype(levels[0].dtype)
    out = np.zeros(n, levels[0].dtype)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        fits = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[fits] = rank[a[fits]] == rank[b[fits]]
        a[same] += size
        b[same] += size
        out[1:][same] += size
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _windows(hosts: np.ndarray, hashes: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the windows of ``least`` tokens at ``at``; ``hosts`` is a hash of the host."""
    out = np.zeros(len(at), np.uint64) ^ hosts
    with np.errstate(over="ignore"):
        for i in range(least):
            out = mix((out ^ hashes[at + i]) * _ODD)
    return out.view(np.int64)


_SHARD = "host string, digest binary, window long, lo long, hi long, pos int, kind int"
_SHARD_ARROW = pa.schema([("host", pa.string()), ("digest", pa.binary()), ("window", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                          ("pos", pa.int32()), ("kind", pa.int32())])
COVERED, PLACE, WINDOW, TEMPLATE, OFTEN, ARTICLES = range(6)


def _shard(streams: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
    """One shard's repeats, from (host, slots, slot, kind, digest, text) in order of host and slot.

    Rows: COVERED (digest, pos) for a window of ``least`` tokens of a judged stream that a distinct stream of the shard outside articles
    has too; TEMPLATE (host, window) for a window that goes from the articles of a host in one slot. For hosts in several: WINDOW (host, window, least and
    greatest digest, cut to a long) for each distinct window outside articles, PLACE (host, window, digest, pos) for windows of judged streams
    still open, OFTEN (host, window) for windows of more than half of the slot's articles, ARTICLES (host, number of them in lo)."""
    vocabulary, known, parts = [], {}, []
    unit, units = [], []
    for host, slots, slot, _, _, text in streams:
        if not units or units[-1][0] != host:  # words of two hosts never meet
            vocabulary.extend(known)
            known = {}
        if not units or units[-1] != (host, slots, slot):
            units.append((host, slots, slot))
        unit.append(len(units) - 1)
        base = len(vocabulary)
        parts.append(np.array([known.setdefault(w, base + len(known)) for w in text.split(" ")], np.int64))
    vocabulary.extend(known)
    unit, kind = np.array(unit), np.array([s[3] for s in streams])
    articles = np.bincount(unit[kind == ARTICLE], minlength=len(units))
    split = np.array([u[1] > 1 for u in units])
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    page_of = np.repeat(np.arange(len(parts)), lengths + 1)
    ends = starts[1:] - 1
    inside = np.ones(starts[-1], bool)
    inside[ends] = False
    tokens = np.empty(starts[-1], np.int64)
    tokens[inside] = np.concatenate(parts)
    tokens[ends] = len(vocabulary) + np.arange(len(parts))  # a separator after each stream, all different

    def rows(row_kind: int, pages: np.ndarray, **columns) -> Iterator[pa.RecordBatch]:
        for part in range(0, len(pages), 1 << 14):
            some = slice(part, part + (1 << 14))
            p = pages[some]
            made = {"host": [streams[i][0] for i in p], "kind": np.full(len(p), row_kind)}
            if row_kind in (COVERED, PLACE):
                made["digest"] = [streams[i][4] for i in p]
            made.update({c: v[some] for c, v in columns.items()})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(p), f.type) for f in _SHARD_ARROW], schema=_SHARD_ARROW)

    heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    yield from rows(ARTICLES, heads[split], lo=articles[split])

    order, levels = suffix_array(tokens, int(lengths.max()))
    shared = common_prefixes(order, levels)
    del levels
    whole = ends[page_of[order]] - order >= least  # a window of tokens, not of a separator
    first = ((shared < least) | ~whole)[whole]
    order = order[whole]
    if not len(order):
        return
    page = page_of[order]
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    besides = kind[page] != ARTICLE
    lo = np.minimum.reduceat(np.where(besides, page, len(parts)), heads)
    hi = np.maximum.reduceat(np.where(besides, page, -1), heads)
    twice = lo < hi
    mine = unit[page[heads]]  # first slot of a group, which may have others of its host
    judged = kind[page] == JUDGED
    seeds = np.array([xxhash.xxh3_64_intdigest(u[0].encode("utf-8", "surrogatepass")) for u in units], np.uint64)
    hashes: list[np.ndarray] = []

    def windows(at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.int64)
        if not hashes:
            hashes.append(_word_hashes(vocabulary + [""] * len(parts))[tokens])
        return _windows(seeds[unit[page[at]]], hashes[0], order[at], least)

    def places(at: np.ndarray) -> np.ndarray:
        return order[at] - starts[page[at]]

    at = np.flatnonzero(twice[group] & judged)
    yield from rows(COVERED, page[at], pos=places(at))
    at = np.flatnonzero(split[unit[page]] & judged & ~twice[group])
    yield from rows(PLACE, page[at], pos=places(at), window=windows(at))
    at = np.flatnonzero(split[mine] & (hi >= 0))
    least_digest = np.array([int.from_bytes(s[4][:8], "big", signed=True) for s in streams])
    a, b = least_digest[lo[at]], least_digest[hi[at]]
    yield from rows(WINDOW, page[heads[at]], window=windows(heads[at]), lo=np.minimum(a, b), hi=np.maximum(a, b))

    # (group, slot, article) once each; then articles of a slot that have the window
    fewest: dict[str, int] = {}  # articles of a slot of the host in this shard
    for (host, _, _), n in zip(units, articles.tolist(), strict=True):
        if n:
            fewest[host] = min(n, fewest.get(host, n))
    often = np.add.reduceat(~besides, heads) * 2 > np.array([fewest.get(u[0], 0) for u in units])[mine]
    at = np.flatnonzero(often[group] & ~besides)
    pair = np.unique(group[at] * len(parts) + page[at])
    by_slot = (pair // len(parts)) * len(units) + unit[pair % len(parts)]
    by_slot, n = np.unique(by_slot, return_counts=True)
    g, u = by_slot // len(units), by_slot % len(units)
    many = n * 2 > articles[u]
    template = many & ~split[u] & (n >= MIN_ARTICLES) & (hi[g] >= 0)
    yield from rows(TEMPLATE, page[heads[g[template]]], window=windows(heads[g[template]]))
    elsewhere = many & split[u]
    yield from rows(OFTEN, page[heads[g[elsewhere]]], window=windows(heads[g[elsewhere]]))


def _shards(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Shards of whole slots, ``size`` tokens or little more."""
    streams, held, last = [], 0, None
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for host, slots, slot, kind, digest, stream in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (host, digest) == last:  # from another task
                continue
            last = host, digest
            if streams and held >= size and (streams[-1][0], streams[-1][2]) != (host, slot):
                yield from _shard(streams, least)
                streams, held = [], 0
            text = unpack.decompress(stream).decode("utf-8", "surrogatepass")
            streams.append((host, slots, slot, kind, digest, text))
            held += text.count(" ") + 1
    if streams:
        yield from _shard(streams, least)


def host_repeats(spark: SparkSession, pages: DataFrame, min_tokens: int, shard_tokens: int) -> DataFrame:
    """Rows of ``_shard`` over all streams of pages (host, html)."""
    size = F.sum(F.octet_length("html")) / (4 * shard_tokens)
    split = pages.groupBy("host").agg(F.ceil(size).cast("int").alias("slots")).where("slots > 1")  # at most one row for 4 * shard_tokens of input
    streams = page_streams(pages).join(F.broadcast(split), "host", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    dealt = streams.withColumn("slot", F.pmod(F.xxhash64("digest"), F.col("slots")).cast("int")).repartition("host", "slot")
    ordered = dealt.sortWithinPartitions("host", "slot", "digest").select("host", "slots", "slot", "kind", "digest", "stream")
    return persist_table(spark, ordered.mapInArrow(lambda it: _shards(it, min_tokens, shard_tokens), _SHARD), "host-repeats")


def open_repeats(found: DataFrame) -> DataFrame:
    """(host, digest, pos) of every window of a judged stream that a distinct stream of its host outside articles has too."""
    places = found.where(F.col("kind") == PLACE).select("host", "window", "digest", "pos")
    windows = found.where(F.col("kind") == WINDOW).groupBy("host", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    elsewhere = places.join(windows.where("lo < hi").select("host", "window"), ["host", "window"]).select("host", "digest", "pos")
    return found.where(F.col("kind") == COVERED).select("host", "digest", "pos").unionByName(elsewhere)


def article_templates(spark: SparkSession, pages: DataFrame, found: DataFrame, min_tokens: int) -> DataFrame:
    """(host, windows): windows that go from the host's articles."""
    known = found.where(F.col("kind") == TEMPLATE).select("host", "window")
    besides = found.where(F.col("kind") == WINDOW).select("host", "window")
    often = found.where(F.col("kind") == OFTEN).select("host", "window").join(besides, ["host", "window"], "left_semi")
    asked = persist_table(spark, often.groupBy("host").agg(F.collect_set("window").alias("windows")), "host-often")
    if not asked.isEmpty():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for host, page, windows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    for kind, digest, raw in _read_page(page)[3]:
                        if kind == ARTICLE:
                            there = np.unique(_article_windows(host, raw, min_tokens))
                            there = there[np.isin(there, windows)]
                            yield pa.RecordBatch.from_arrays([pa.array([host] * len(there), pa.string()), pa.array(there), pa.array([digest] * len(there), pa.binary())],
                                                             names=["host", "window", "digest"])

        having = pages.join(asked, "host").select("host", "html", "windows").mapInArrow(run, "host string, window long, digest binary")
        counts = having.distinct().groupBy("host", "window").agg(F.count(F.lit(1)).alias("n"))
        articles = found.where(F.col("kind") == ARTICLES).groupBy("host").agg(F.sum("lo").alias("articles"))
        most = counts.join(articles, "host").where((F.col("n") * 2 > F.col("articles")) & (F.col("n") >= MIN_ARTICLES))
        known = known.unionByName(most.select("host", "window"))
    return persist_table(spark, known.groupBy("host").agg(F.collect_set("window").alias("windows")), "host-templates")


def _article_windows(host: str, raw: bytes, least: int) -> np.ndarray:
    """Window hashes of an article's stream, in order."""
    hashes = _word_hashes(raw.decode("utf-8", "surrogatepass").split(" "))
    seed = np.uint64(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))
    return _windows(seed, hashes, np.arange(max(0, len(hashes) - least + 1)), least)


def _cut(opened: list[str], at: list[int], starts: list[int], least: int, copies: bool = True) -> str:
    """Blocks without the covered runs of their tokens; with ``copies``, a run of more than half of them stays."""
    words = [b.split(" ") for b in opened]
    n = sum(map(len, words))
    covered = set()
    for s in starts:
        covered.update(range(s, s + least))
    tokens = [(i, w, p + k in covered) for i, (ws, p) in enumerate(zip(words, at, strict=True)) for k, w in enumerate(ws)]
    run = 0
    kept = []
    for j, (i, w, gone) in enumerate([*tokens, (None, None, False)]):
        if gone:
            run += 1
            continue
        if copies and run * 2 > n:  # a copied text
            kept.extend(tokens[j - run:j])
        run = 0
        if i is not None:
            kept.append((i, w, gone))
    out: dict[int, list[str]] = {}
    for i, w, _ in kept:
        out.setdefault(i, []).append(w)
    return "\n".join(" ".join(ws) for ws in out.values())


def main_text(spark: SparkSession, pages: DataFrame, page_id: Column, url: Column, page: Column, min_tokens: int = MIN_TOKENS,
              shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, url, text) of every page."""
    df = pages.select(page_id.alias("id"), url.cast("string").alias("url"), page.cast("string").alias("html"))
    df = df.select("id", "url", host_of(F.col("url")).alias("host"), "html")
    found = host_repeats(spark, df, min_tokens, shard_tokens)
    templates = article_templates(spark, df, found, min_tokens)
    starts = persist_table(spark, open_repeats(found).groupBy("host", "digest").agg(F.collect_set("pos").alias("starts")), "host-starts")
    kind = df.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("url", pa.string()), ("host", pa.string()), ("digest", pa.binary()), ("text", pa.string()),
                        ("blocks", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64)
                rows = []
                for host, page, windows in zip(*[some.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                    article, opened, at, streams = _read_page(page)
                    text = None if opened else "\n".join(article)
                    if article and windows:
                        gone = np.flatnonzero(np.isin(_article_windows(host, streams[0][2], min_tokens), windows)).tolist()
                        lengths = [b.count(" ") + 1 for b in article]
                        text = _cut(article, np.cumsum([0, *lengths[:-1]]).tolist(), gone, min_tokens, copies=False)
                    rows.append((host, streams[0][1] if streams else None, text, opened, at))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]],
                                                 schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
            texts = [t if t is not None else _cut(b, a, s or [], min_tokens) for t, b, a, s in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    id_type = kind.simpleString()
    pages_read = df.join(templates, "host", "left").select("id", "url", "host", "html", "windows").mapInArrow(
        read, f"id {id_type}, url string, host string, digest binary, text string, blocks array<string>, at array<int>")
    judged = pages_read.join(starts, ["host", "digest"], "left")
    return judged.select("id", "url", "text", "blocks", "at", "starts").mapInArrow(cut, f"id {id_type}, url string, text string")
