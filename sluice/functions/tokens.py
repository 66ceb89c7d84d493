"""Token and line expressions (C5-C13): built-in array higher-order functions evaluated per
row in the JVM (Spark interprets these lambdas rather than code-generating them); no Python
in the data path. A lambda must not reference an expression defined outside it -- Spark may
inline and re-evaluate it per element -- so shared values are bound once with ``_let``.

Token arrays are ``array<string>``; scored tokens are ``array<struct<tok string, v double>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Special tokens and markers of the subword vocabulary the reference uses.
BOS, EOS, UNK, PAD = "<s>", "</s>", "<unk>", "<pad>"
SPECIAL_TOKENS = [BOS, EOS, UNK, PAD]
SPACE_MARK = "Ġ"
NEWLINE_MARK = "Ċ"
TAB_MARK = "ĉ"
LINE_SEPARATORS = ["Ċ", " Ċ", "ĊĊ", " ĊĊ"]
FLAW_PREFIX_TOKEN = "@"
BLOCK_SIZE = 512
HIT_RUN = 256

# Word, single punctuation character, newline or tab.
TOKEN_PATTERN = r"\w+|[^\w\s]|\n|\t"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``: the initial value of a one-step
    aggregate is computed once, so ``body`` can read it many times without re-evaluation."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def tokenize(text) -> Column:
    """Regex word-level tokens; newline and tab render as the vocabulary's markers."""
    raw = F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)
    return F.transform(raw, lambda t: F.when(t == "\n", F.lit(NEWLINE_MARK))
                       .when(t == "\t", F.lit(TAB_MARK)).otherwise(t))


def framed_tokens(text) -> Column:
    """All tokens of a text between <s> and </s>."""
    return F.concat(F.array(F.lit(BOS)), tokenize(text), F.array(F.lit(EOS)))


def blocks_of(tokens, block_size: int = BLOCK_SIZE) -> Column:
    """Consecutive runs of block_size - 2 tokens, each wrapped in <s> ... </s> and padded to
    block_size; without tokens, one block of padding."""
    body = block_size - 2

    def cut(t):
        blocks = F.greatest(F.ceil(F.size(t) / body), F.lit(1)).cast("int")

        def block(b):
            part = F.slice(t, b * body + 1, F.lit(body))
            return F.concat(F.array(F.lit(BOS)), part, F.array(F.lit(EOS)), F.array_repeat(F.lit(PAD), F.lit(body) - F.size(part)))
        return F.transform(F.sequence(F.lit(0), blocks - 1), block)
    return _let(_c(tokens), cut)


def token_blocks(df: DataFrame, key: str = "func_id", text: str = "code", block_size: int = BLOCK_SIZE) -> DataFrame:
    """(key, block_idx, tokens). Block 0 is what a model of that block size sees; the later
    blocks hold the rest of the text. Blocks are cut in the row: no token leaves its text's task."""
    return df.select(key, F.posexplode(blocks_of(tokenize(text), block_size)).alias("block_idx", "tokens"))


def normalise_tokens(tokens) -> Column:
    """Drop the space marker, map the tab marker to the newline marker."""
    return F.transform(_c(tokens), lambda t: F.replace(F.replace(t, F.lit(SPACE_MARK), F.lit("")),
                                                       F.lit(TAB_MARK), F.lit(NEWLINE_MARK)))


def encode_flaw_lines(flaw_lines, tokenizer=tokenize) -> Column:
    """Each flaw line tokenised with a '@ ' prefix, '@' tokens dropped, markers removed,
    joined back to one string."""
    return F.transform(_c(flaw_lines), lambda line: F.array_join(
        F.filter(normalise_tokens(tokenizer(F.concat(F.lit(FLAW_PREFIX_TOKEN + " "), line))),
                 lambda t: t != FLAW_PREFIX_TOKEN), ""))


def token_text(all_tokens) -> Column:
    """The concatenated token text (materialise before ``verify_flaw_lines``)."""
    return F.array_join(_c(all_tokens), "")


def verify_flaw_lines(encoded, joined_text) -> Column:
    """Keep encoded flaw lines, in order, up to the first one not contained in the
    concatenated token text ``joined_text`` (see ``token_text``)."""
    joined = _c(joined_text)
    enc = _c(encoded)
    found = F.transform(enc, lambda x: F.instr(joined, x) > 0)
    first_miss = F.array_position(found, F.lit(False))
    return F.when(first_miss == 0, enc).otherwise(F.slice(enc, 1, (first_miss - 1).cast("int")))


def last_special_index(values, padding: bool = True) -> Column:
    """0-based index of the closing special token: the last non-zero value (padding) or
    the last position. Materialise it as a column before ``zero_special_values``."""
    v = _c(values)
    if padding:
        return F.array_max(F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()))
    return F.size(v) - 1


def zero_special_values(values, last_index) -> Column:
    """Value 0 at the first position and at ``last_index`` (see ``last_special_index``).

    Built from slices rather than a lambda, so ``last_index`` is read once per row."""
    v = F.transform(_c(values), lambda x: x.cast("double"))
    last = _c(last_index)
    n = F.size(v)
    zero = F.array(F.lit(0.0))
    middle = F.slice(v, 2, F.greatest(last - 1, F.lit(0)))
    tail = F.slice(v, F.least(last + 2, n + 1), F.greatest(n - last - 1, F.lit(0)))
    return (F.when(n == 0, v)
            .when(last.isNull() | (last == 0), F.concat(zero, F.slice(v, 2, F.greatest(n - 1, F.lit(0)))))
            .otherwise(F.concat(zero, middle, zero, tail)))


def drop_special_tokens(scored) -> Column:
    """C11: remove <s>, </s>, <unk>, <pad> entries from scored tokens."""
    return F.filter(_c(scored), lambda e: ~e["tok"].isin(*SPECIAL_TOKENS))


def zip_token_scores(tokens, scores) -> Column:
    """Pair tokens with scores as ``struct<tok, v>``."""
    return F.transform(F.arrays_zip(_c(tokens).alias("tok"), _c(scores).alias("v")),
                       lambda e: F.struct(e["tok"].alias("tok"), e["v"].cast("double").alias("v")))


def l2_norm(scores) -> Column:
    """Euclidean norm of a numeric array, summed left to right."""
    return F.sqrt(F.aggregate(_c(scores), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise_attributions(scores, norm) -> Column:
    """Scores divided by their L2 norm ``norm`` (a column; see ``l2_norm``); NULL
    entries when the norm is 0."""
    n = _c(norm)
    return F.transform(_c(scores), lambda x: F.try_divide(x.cast("double"), n))


def segment_line_scores_fold(scored, verified_flaw_lines) -> Column:
    """C9 as a token-by-token fold (the specification; O(lines^2) array growth per row).

    Fold scored tokens into per-line scores with a flaw label.

    A line closes at a separator token (or the last token) when its running score is not
    zero: the closing token's score is added, and the line is a flaw line when its text
    equals the next expected verified flaw line (the pointer advances only on a match).
    A separator reached with a zero running score is skipped and the line text is kept;
    the last token's text is never appended. Returns ``array<struct<score double, label int>>``.

    The flaw list, the token count and a step counter travel in the accumulator, so the
    merge lambda refers to nothing outside its own arguments (outer references inside a
    lambda can be re-evaluated per element).
    """
    arr = _c(scored)
    init = F.struct(
        F.array().cast("array<struct<score:double,label:int>>").alias("lines"),
        F.lit(0.0).alias("ss"), F.lit("").alias("line"), F.lit(1).alias("cur"),
        F.lit(0).alias("i"), F.size(arr).alias("n"), _c(verified_flaw_lines).alias("flaws"))

    def step(acc, e):
        is_sep = e["tok"].isin(*LINE_SEPARATORS)
        last = acc["i"] == acc["n"] - 1
        close = (is_sep | last) & (acc["ss"] != 0)
        hit = F.coalesce((acc["cur"] <= F.size(acc["flaws"])) & (F.element_at(acc["flaws"], acc["cur"]) == acc["line"]),
                         F.lit(False))
        nxt = acc["i"] + 1
        closed = F.struct(
            F.concat(acc["lines"], F.array(F.struct((acc["ss"] + e["v"]).alias("score"),
                                                    hit.cast("int").alias("label")))).alias("lines"),
            F.lit(0.0).alias("ss"), F.lit("").alias("line"),
            (acc["cur"] + hit.cast("int")).alias("cur"), nxt.alias("i"), acc["n"].alias("n"),
            acc["flaws"].alias("flaws"))
        grown = F.struct(acc["lines"].alias("lines"), (acc["ss"] + e["v"]).alias("ss"),
                         F.concat(acc["line"], e["tok"]).alias("line"), acc["cur"].alias("cur"),
                         nxt.alias("i"), acc["n"].alias("n"), acc["flaws"].alias("flaws"))
        skipped = F.struct(acc["lines"].alias("lines"), acc["ss"].alias("ss"), acc["line"].alias("line"),
                           acc["cur"].alias("cur"), nxt.alias("i"), acc["n"].alias("n"),
                           acc["flaws"].alias("flaws"))
        return F.when(close, closed).when(~is_sep, grown).otherwise(skipped)

    return F.aggregate(arr, init, step, lambda acc: acc["lines"])


def segment_line_scores(scored, verified_flaw_lines) -> Column:
    """C9 in linear time (same result as ``segment_line_scores_fold``).

    After a skipped separator the running score is exactly zero, so a line closes at a
    separator (or the last token) iff the scores of its own segment -- the tokens since the
    previous separator -- sum to non-zero, summed left to right from 0.0 like the fold. The
    line text is the text of every segment since the previous closing one; the flaw pointer
    then advances over the emitted lines only. Its hits are gathered in runs of ``HIT_RUN``, so a
    step copies at most one run, and the labels are the zeros and ones between the hits: no line searches a list.
    """
    seps = LINE_SEPARATORS

    def body(b):
        a, n = b["a"], b["n"]
        closers = F.filter(F.transform(a, lambda e, i: F.when(e["tok"].isin(*seps) | (i == n - 1), i)
                                       .otherwise(F.lit(-1))), lambda x: x >= 0)

        def segs_of(c):
            k_count = F.size(c["c"])

            def seg(k):
                start = F.when(k == 0, F.lit(0)).otherwise(F.element_at(c["c"], k) + 1)  # element_at is 1-based
                end = F.element_at(c["c"], k + 1)
                toks = F.slice(c["a"], start + 1, end - start)
                total = F.aggregate(toks, F.lit(0.0), lambda s, e: s + e["v"])
                return F.struct(total.alias("sum"),
                                F.array_join(F.transform(toks, lambda e: e["tok"]), "").alias("text"),
                                (total + F.element_at(c["a"], end + 1)["v"]).alias("score"))
            idx = F.when(k_count > 0, F.sequence(F.lit(0), k_count - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(idx, seg)

        def lines_of(s):
            segs = s["s"]
            emit = F.filter(F.transform(segs, lambda g, k: F.when(g["sum"] != 0, k).otherwise(F.lit(-1))),
                            lambda x: x >= 0)

            def lines_body(t):
                e_count = F.size(t["e"])

                def line(m):
                    j0 = F.when(m == 0, F.lit(0)).otherwise(F.element_at(t["e"], m) + 1)
                    jm = F.element_at(t["e"], m + 1)
                    text = F.array_join(F.transform(F.slice(t["g"], j0 + 1, jm - j0 + 1), lambda g: g["text"]), "")
                    return F.struct(text.alias("text"), F.element_at(t["g"], jm + 1)["score"].alias("score"))
                idx = F.when(e_count > 0, F.sequence(F.lit(0), e_count - 1)).otherwise(F.array().cast("array<int>"))
                return F.transform(idx, line)
            return _let(F.struct(segs.alias("g"), emit.alias("e")), lines_body)

        def labelled(ls):
            flaws = ls["f"]
            init = F.struct(F.lit(1).alias("cur"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("part"),
                            F.array().cast("array<array<int>>").alias("parts"))

            def step(acc, l):
                ok = F.coalesce((acc["cur"] <= F.size(flaws)) & (F.element_at(flaws, acc["cur"]) == l["text"]), F.lit(False))
                full = ok & (F.size(acc["part"]) >= HIT_RUN)
                return F.struct((acc["cur"] + ok.cast("int")).alias("cur"), (acc["i"] + 1).alias("i"),
                                F.when(full, F.array(acc["i"])).when(ok, F.concat(acc["part"], F.array(acc["i"]))).otherwise(acc["part"]).alias("part"),
                                F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"))
            hits = F.aggregate(ls["l"], init, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))

            def labels(h, n):
                """Zeros up to each hit, a one, and zeros to the end."""
                before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(h, k - 1))
                runs = F.flatten(F.transform(h, lambda x, k: F.concat(F.array_repeat(F.lit(0), x - before(k) - 1), F.array(F.lit(1)))))
                return F.concat(runs, F.array_repeat(F.lit(0), n - 1 - F.coalesce(F.get(h, F.size(h) - 1), F.lit(-1))))
            return _let(F.struct(ls["l"].alias("l"), hits.alias("h")), lambda z: F.zip_with(
                z["l"], labels(z["h"], F.size(z["l"])), lambda l, x: F.struct(l["score"].alias("score"), x.alias("label"))))

        segs = _let(F.struct(a.alias("a"), closers.alias("c")), segs_of)
        lines = _let(F.struct(segs.alias("s")), lines_of)
        return _let(F.struct(lines.alias("l"), b["f"].alias("f")), labelled)

    return _let(F.struct(_c(scored).alias("a"), F.size(_c(scored)).alias("n"),
                         _c(verified_flaw_lines).alias("f")), body)
