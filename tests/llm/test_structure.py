"""Conversation repair, page text and whitening against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import queries
from sluice.llm.conversations import Conversation, damaged, ordered_rows, repair_plans, repaired_turns
from sluice.llm.html_text import blocks, common_prefixes, main_text, suffix_array
from sluice.llm.whitening import bidiagonalised, fit_whitening, whiten, whole_numbers

CLASHING = "conv present copy said audit key x pos value n kind rows component id host digest stream window blocks at starts label".split()


# ------------------------------------------------------------------ 11
def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def every_repair(rows):
    """The cheapest repair of at most three rows, by trying all of them."""
    inserts = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    best = None
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r), ("R", "user"), ("R", "assistant")]) for r, _, f in rows]
    for edits in itertools.product(*choices):
        cost = sum({"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and f == "truncated" else 0) for (e, _), (_, _, f) in zip(edits, rows, strict=True))
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            turns, audit = [], ""
            for i, g in enumerate(gaps):
                turns += [(names[c], "") for c in g]
                audit += "I" * len(g)
                if i < len(rows):
                    audit += edits[i][0]
                    turns += [] if edits[i][0] == "D" else [(edits[i][1], rows[i][1])]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                best = min(best or (999,), (total, audit, "\n".join(f"{r}:{t}" for r, t in turns)))
    return best


def test_cheapest_repair_equals_all_repairs():
    rng = random.Random(2)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b", "c!", "", " \t", "d?"])) for _ in range(rng.randrange(4))]
        c = Conversation()
        seen = set()
        for i, (role, text) in enumerate(rows):
            c.read(i, role, text, (role, text) in seen)
            seen.add((role, text))
        cost, audit, whole = every_repair(faults(rows)) or (0, "", "")
        assert c.row()[5:] == (cost, audit, hashlib.sha256(whole.encode()).hexdigest()), rows


def plain_parse(rows):
    """Cheapest (cost, audit), keeping every state of every prefix."""
    shift = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def closed(states):
        out = dict(states)
        for _ in range(3):
            for (s, (c, a)), i in itertools.product(list(out.items()), "ua"):
                if (s, i) in shift:
                    out[shift[s, i]] = min(out.get(shift[s, i], (1 << 40,)), (c + 5, a + "I"))
        return out

    states = {0: (0, "")}
    for role, _, fault in rows:
        new = {}
        for s, (c, a) in closed(states).items():
            new[s] = min(new.get(s, (1 << 40,)), (c + 2, a + "D"))
            for i, edit, price in [(role[:1], "K", 0), ("u", "R", 1), ("a", "R", 1)]:
                if (s, i) in shift and fault not in ("blank", "duplicate"):
                    new[shift[s, i]] = min(new.get(shift[s, i], (1 << 40,)), (c + price + 5 * (fault == "truncated"), a + edit))
        states = new
    return min(v for s, v in closed(states).items() if s in (0, 3))


def test_long_conversation_in_one_pass():
    rng = random.Random(4)
    rows = [(("user", "assistant")[i % 2] if rng.random() > 0.02 else "system", f"t{i}" + rng.choice("....a")) for i in range(3000)]
    c = Conversation()
    for i, (role, text) in enumerate(rows):
        c.read(i, role, text, False)
    assert len(c.stack.agreed) > 5
    assert c.row()[5:7] == plain_parse(faults(rows))


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df


def parts(df, present=None):
    return ordered_rows(df, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), present)


def test_conversation_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 5, "user", "a"), (2, 9, "user", "a"), (None, 3, "assistant", "x."),
            (None, 1, "user", "x."), (None, 1, "user", "x."), (4, 7, "user", "word " * 60_000 + "!"), (4, 8, "assistant", "Fine?"), (5, 0, "system", "Be."),
            (6, 0, "user", "a."), (6, 2, "assistant", "b."), (6, 2, "tool", "c."), (7, None, "user", "q?"), (7, None, "assistant", "r.")]
    df = conversations(spark, rows)
    got = {r.conv: r for r in repair_plans(parts(df)).collect()}
    assert len(got) == 7
    assert (got[1].audit, got[1].cost, got[1].illegal) == ("KK", 0, 0)
    assert (got[2].blank, got[2].duplicate, got[2].truncated, got[2].gaps, got[2].audit) == (1, 1, 1, 3, "DDD")
    assert (got[None].duplicate, got[None].gaps, got[None].audit) == (1, 1, "KDK")
    assert got[4].audit == "KK" and got[5].audit == "D" and got[5].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[6].gaps, got[6].audit, got[6].illegal) == (1, "KKD", 1)
    assert (got[7].gaps, got[7].audit, got[7].illegal) == (0, "RR", 0)  # equal turns go by role: the assistant is first
    assert repair_plans(parts(df.limit(0))).count() == 0
    # a conversation of which nothing is left
    gone = repair_plans(parts(df, F.col("conv_id") != 1)).where("conv = 1").first()
    assert tuple(gone) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_plans(parts(df.union(df.limit(1)))).where("conv = 1").first().audit in ("KDK", "KKD")


def test_repaired_turns_have_the_digest(spark, sf):
    rows = damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    ordered = parts(rows, F.col("present"))
    plans = repair_plans(ordered)
    turns = {}
    for r in repaired_turns(ordered, plans).orderBy("conv", "position").collect():
        turns.setdefault(r.conv, []).append((r.role, r.text, r.edit))
    for p in plans.collect():
        t = turns.get(p.conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in t).encode()).hexdigest() == p.repaired_sha256
        assert "".join(e for _, _, e in t) == p.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _, _ in t))


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = damaged(conversations(spark, rows)).collect()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = [r for r in got if (r.conv_id, r.turn) == (c, t)]
        assert len(mine) == (2 if kind == 3 else 1) and all(r.present == (kind != 0) for r in mine)
        assert {r.text for r in mine} == {"" if kind == 1 else "One Two" if kind == 2 and text else text or " "}
        assert {r.role for r in mine} == {"user" if kind == 4 else role or " "}


# ------------------------------------------------------------------ 12
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) x="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<article><header><h1>Ti&#116;le &amp; more</h1></header><p>One  <b>two</b>
three<p>Four<br>five&nbsp;six<div class="ad">Buy</div><div hidden>h</div><form><input value=">">Mail</form>
<section id="comments"><article>Nice post</article></section><table><tr><td>a<td>b</table></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_blocks():
    found = blocks(PAGE)
    assert [t for z, t in found if z == "article"] == ["Title & more", "One two three", "Four", "five six", "a", "b"]
    assert {t for z, t in found if z == "beside"} == {"Site", "Home", "About", "We use cookies", "Buy", "Mail", "Nice post", "Side", "© me"}
    assert blocks("") == [] and blocks("<") == [("open", "<")] and blocks("<p") == [] and blocks("a < b") == [("open", "a < b")]
    assert blocks("<script>x") == [] and blocks("<p>x" * 3 + "</div></nope>") == [("open", "x")] * 3
    assert blocks("<form><article>in a form</article></form>") == [("article", "in a form")]
    assert blocks('<p title="a>b">x</p><p title=it\'s>y') == [("open", "x"), ("open", "y")]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(400)) for _ in range(n))


def template_site(seed, host, n):
    """Pages without an article: unmarked template lines around a text of their own."""
    rng = random.Random(seed)
    top, bottom, teaser = words(rng, 9), words(rng, 14), words(rng, 8)
    out = []
    for i in range(n):
        own = [words(rng, rng.randrange(15, 60)) for _ in range(3)]
        body = [top, own[0], own[1], *([teaser] if i % 3 == 0 else []), own[2], bottom]
        out.append((f"http://{host}/{i}", "".join(f"<div>{t}</div>" for t in body), "\n".join(own)))
    return out


def covered_by_force(pages, least):
    """Open text left when all windows that another page of the host has are removed."""
    streams = {u: [w for _, t in blocks(h) for w in t.split(" ")] for u, h, _ in pages}
    seen = {}
    for u, s in streams.items():
        for i in range(len(s) - least + 1):
            seen.setdefault((u.split("/")[2], tuple(s[i:i + least])), set()).add(tuple(s))
    out = {}
    for u, s in streams.items():
        gone = [False] * len(s)
        for i in range(len(s) - least + 1):
            if len(seen[u.split("/")[2], tuple(s[i:i + least])]) > 1:
                gone[i:i + least] = [True] * least
        out[u] = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_template_text_goes_by_host(spark, shard):
    pages = template_site(1, "a.example", 40) + template_site(2, "b.example", 7) + template_site(3, "c.example", 1)
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.url: r.text for r in main_text(spark, df, F.col("page_id"), F.col("url"), F.col("html"), shard_tokens=shard).collect()}
    force = covered_by_force(pages, 6)
    assert len(got) == 48
    for u, _, own in pages:
        assert got[u].replace("\n", " ") == force[u]
        if "c.example" not in u:
            assert got[u] == own


def article_site(seed, host, n):
    """Articles with a notice no markup names (in most of them), a passage of all, a quotation of some, and a listed title."""
    rng = random.Random(seed)
    notice, passage, quoted = words(rng, 9), words(rng, 12), words(rng, 10)
    titles = [words(rng, 7) for _ in range(n)]
    out = []
    for i in range(n):
        own = [titles[i], words(rng, rng.randrange(40, 70)), passage, *([quoted] if i % 4 == 0 else []), words(rng, 30)]
        inside = own[:2] + ([notice] if i % 5 else []) + own[2:]
        footer = notice if i % 7 == 0 else quoted if i % 7 == 1 else words(rng, 5)
        page = f"<article>{''.join(f'<p>{t}</p>' for t in inside)}</article><aside>{titles[0]}</aside><footer>{footer}</footer>"
        out.append((f"http://{host}/{i}", page, own if n > 4 else inside))
    if n > 4:  # a short article with a notice longer than itself
        out.append((f"http://{host}/short", f"<article><h1>Short</h1><p>{notice}</p></article><footer>end</footer>", ["Short"]))
    return out + [(f"http://{host}/copy{i}", p, own) for i, (_, p, own) in enumerate(out[:n // 3])]


def articles_by_force(pages, least, fewest=4):
    """Article text left when the windows of most articles that a text outside has too are removed."""
    inside, besides = {}, {}
    for u, h, _ in pages:
        for settled, streams in ((True, inside), (False, besides)):
            streams.setdefault(u.split("/")[2], set()).add(" ".join(t for z, t in blocks(h) if (z == "article") == settled))
    out = {}
    for u, h, _ in pages:
        host = u.split("/")[2]
        s = " ".join(t for z, t in blocks(h) if z == "article").split(" ")
        gone = set()
        for i in range(len(s) - least + 1):
            w = f" {' '.join(s[i:i + least])} "
            n = sum(w in f" {a} " for a in inside[host])
            if n >= fewest and 2 * n > len(inside[host]) and any(w in f" {a} " for a in besides[host]):
                gone.update(range(i, i + least))
        out[u] = " ".join(w for i, w in enumerate(s) if i not in gone)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 2000, 200])
def test_article_text_is_judged_by_host(spark, shard):
    pages = article_site(1, "a.example", 40) + article_site(2, "b.example", 9) + article_site(3, "c.example", 3)
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = {r.url: r.text for r in main_text(spark, df, F.col("page_id"), F.col("url"), F.col("html"), shard_tokens=shard).collect()}
    force = articles_by_force(pages, 6)
    assert len(got) == len(pages) and sum(len(force[u].split()) < len(re.sub("<[^>]*>", " ", h).split()) for u, h, _ in pages) > 0
    for u, _, own in pages:
        assert got[u] == "\n".join(own) and got[u].replace("\n", " ") == force[u]


@pytest.mark.parametrize("symbols", [2, 30, 3000])
def test_suffix_array(symbols):
    tokens = np.random.default_rng(symbols).integers(0, symbols, 700)
    tokens[300:420] = tokens[100:220]
    order, levels = suffix_array(tokens, len(tokens))
    force = sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())
    assert order.tolist() == force
    common = [0] + [next((k for k, (x, y) in enumerate(zip(tokens[a:], tokens[b:], strict=False)) if x != y), len(tokens) - max(a, b)) for a, b in itertools.pairwise(force)]
    assert common_prefixes(order, levels).tolist() == common


def test_copied_pages_and_marked_templates_stay_whole(spark):
    rng = random.Random(5)
    text, other, menu = words(rng, 80), words(rng, 50), words(rng, 7)
    rows = [(1, "http://a/1", f"<p>{text}</p>"), (2, "http://a/2", f"<p>{text}</p>"), (3, "http://a/3", f"<p>{text}</p><p>{words(rng, 9)}</p>"),
            (4, "http://b/1", f"<nav>{menu}</nav><article>{other}</article>"), (5, "http://b/2", f"<div>{menu}</div><p>{words(rng, 30)}</p>"),
            (6, "http://b/3", f"<article><p>{other}</p></article>"), (6, "http://b/3", f"<article><p>{other}</p></article>"),
            (7, None, None), (None, "", ""), (8, "nothing", "<main>" + "long " * 50_000 + "</main>"), (9, "http://d/", "<p>\ud83d</p>".encode("utf-16", "replace").decode("utf-16"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    found = main_text(spark, df, F.col("page_id"), F.col("url"), F.col("html")).collect()
    got = {r.id: r.text for r in found}
    assert len(found) == len(rows) and got[1] == got[2] == text and got[3].startswith(text)
    assert got[4] == got[6] == other and menu not in got[5] and len(got[5].split()) == 30
    assert got[7] == got[None] == "" and got[8] == ("long " * 50_000).strip()
    assert main_text(spark, df.limit(0), F.col("page_id"), F.col("url"), F.col("html")).count() == 0


def test_pages_table(spark, sf):
    got = {r.page_id: r for r in queries.QUERIES["op12_host_suffix_html"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = r.html.split("<article>")[1].split("</article>")[0]
        lines = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", p)) for p in re.split(r"</?(?:p|h1|br)>", inside)]
        text = "\n".join(p.strip() for p in lines if p.strip()).replace("&quot;", '"').replace("&amp;", "&")
        assert got[r.page_id].text.replace("&amp", "&") == text.replace("&amp", "&") and got[r.page_id].n_chars == len(got[r.page_id].text)


# ------------------------------------------------------------------ 13
def by_force(vectors, wanted=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return n, ((n * x - s) ** 2).sum(1), ((x - s / n) @ q) / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_equals_eigenvectors(spark, sf):
    got = queries.QUERIES["op13_lanczos_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, white, explained = by_force(rows.embedding.tolist())
    mine = got.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-9 and set(got.n) == {n}
    assert (got.deviation.to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), explained, rtol=1e-9) and got.identity_error.max() < 1e-9


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (5, 5), (40, 7), (90, 90), (200, 30)])
def test_bidiagonalisation(d, rank):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, rank)) @ rng.standard_normal((rank, d)) * 10
    if d == 90:  # equal singular values and a clear lead
        q = np.linalg.qr(rng.standard_normal((300, d)))[0]
        x = q * np.array([100.0] * 3 + [50.0] * 4 + [1.0] * (d - 7))
    v, s = bidiagonalised(lambda z: (x.T @ (x @ z), float((x @ z) @ (x @ z))), d, 5)
    want = np.linalg.svd(x)[1]
    assert np.allclose(s[:5], want[:5], rtol=1e-9, atol=1e-9 * want[0])
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-10)
    k = min(5, rank)
    assert np.allclose(np.linalg.norm(x @ v[:, :k], axis=0), want[:k], rtol=1e-9)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    fine = [(i, rng.standard_normal(3).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan")] * 3), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = fine + odd + [fine[0], fine[0], (None, [0.5, -0.5, 0.25]), (60, fine[1][1])]
    got = whiten(spark, vectors(spark, rows), F.col("vec_id"), F.col("embedding")).collect()
    kept = [r for r in rows if r not in odd]
    n, deviation, white, _ = by_force([v for _, v in kept], 3)
    assert n == 61 and len(got) == 3 * len(kept) and {r.n for r in got} == {61} and max(r.identity_error for r in got) < 1e-9
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    for c in range(3):
        mine, theirs = sorted(abs(r.whitened) for r in got if r.component == c + 1), sorted(np.abs(white[:, c]))
        assert np.allclose(mine, theirs)
    assert whiten(spark, vectors(spark, rows).limit(0), F.col("vec_id"), F.col("embedding")).count() == 0
    assert whiten(spark, vectors(spark, odd[:5]), F.col("vec_id"), F.col("embedding")).count() == 0
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])
    assert whiten(spark, same, F.col("vec_id"), F.col("embedding")).count() == 0
    flat = whiten(spark, vectors(spark, [(i, [float(i), 7.0, float(-i)]) for i in range(5)]), F.col("vec_id"), F.col("embedding")).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    large = whiten(spark, vectors(spark, [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])]), F.col("vec_id"), F.col("embedding")).collect()
    assert len(large) >= 3 and all(r.deviation is None for r in large if r.component == 1 and r.key < 2)


def test_whole_numbers_floor(spark):
    df = vectors(spark, [(0, [0.01, -0.01, 1.0])]).select(whole_numbers(F.col("embedding")).alias("x"))
    assert df.first().x == [1_000_000, 999_999, 1_000_064]
    assert fit_whitening(spark, df).n == 1
