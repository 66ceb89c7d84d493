"""Quality classifier by co-training of two views.

The content view sees which words and punctuation runs a text has; the page view sees the page's
metadata and form (language, source, sizes, shares of symbols, capitals, repeated lines and
words). Each view is a sparse logistic regression over hashed 0/1 features. From a sample of
labelled rows both are fitted; then, for a few rounds, each view labels all documents outside the sample of
which it is sure, and the other view learns from these pseudo-labels: a pass over the table counts its features by
label, the counts are summed in Spark, and each feature's log-odds ratio among the pseudo-labelled documents,
with its precision, enters the other view's next fit. All pseudo-labelled documents together weigh as much as the
labelled rows, and the labelled rows set the scale on which their ratios are believed.
On labelled rows kept apart for it, the two log-odds are calibrated and combined into one
probability, with which all documents are scored. This is done for two questions, good quality
and freedom from toxic language; the score of a document is the lower of its two probabilities.

Scale: at most ``max_labelled`` labelled documents, chosen by a hash of the key, are fitted on the driver; every
other document takes part in each round through counts, at most one row per feature and task. The
model is four weight tables of fixed size. A round and the scoring are one pass each, without a shuffle of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import text as tx
from sluice.llm.batches import give_back, small_batches
from sluice.llm.rules import document_counts
from sluice.session import persist_table

CHUNK = 1 << 19  # bytes of texts whose features are in memory together
BITS = 20  # hashed features of the content view
PAGE_BITS = 12
QUESTIONS = {"good": "quality = 1", "clean": "toxic = 0"}
SCORED = {f"p_{q}": T.DoubleType() for q in QUESTIONS} | {"score": T.DoubleType()}
_PUNCTUATION = ~tx.ALNUM & ~tx.WHITE
_PUNCTUATION[:0x21] = _PUNCTUATION[0x7F] = False


def content_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, possibly repeated: lower-cased words and runs of two or more
    punctuation characters."""
    low, start, end, doc, _ = tx.words(data, at, alnum=True)
    sums = tx.prefix_hash(low)
    word = tx.span_hash(sums, start, end)
    s, e = tx.spans(_PUNCTUATION[low], at)
    s, e = s[e - s > 1], e[e - s > 1]
    run = tx.span_hash(sums, s, np.minimum(e, s + 4))
    mask = np.uint64((1 << BITS) - 1)
    return (np.concatenate([doc, np.searchsorted(at, s, "right") - 1]),
            np.concatenate([word & mask, tx.mix(run) & mask]).astype(np.int64))


def page_features(data: np.ndarray, at: np.ndarray, names: list[list[str | None]]) -> np.ndarray:
    """A row of features for each document: one per metadata column and one per binned figure."""
    counts = dict(zip(("words", "chars", "symbols", "dup_lines", "repeats", "lines", "letters", "capitals",
                       "letter_words", "stops"), (c.astype(float) for c in document_counts(data, at)), strict=True))
    words = np.maximum(counts["words"], 1)
    figures = [np.log2(counts["words"] + 1), np.log2(counts["lines"] + 1), 2 * counts["chars"] / words]
    for a, b in (("symbols", words), ("dup_lines", np.maximum(counts["lines"], 1)), ("repeats", words),
                 ("capitals", np.maximum(counts["letters"], 1)), ("letter_words", words), ("stops", words)):
        figures.append(12 * np.sqrt(np.minimum(counts[a] / b, 1)))
    binned = [tx.mix(np.uint64(97 * (k + 1)) + np.minimum(f, 40).astype(np.uint64)) for k, f in enumerate(figures)]
    for k, values in enumerate(names):
        text = [f"{k}:{'' if v is None else 'v' + v}".encode() for v in values]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        sums = tx.prefix_hash(np.frombuffer(b"".join(text), np.uint8))
        binned.append(tx.span_hash(sums, ends[:-1], ends[1:]))
    return (np.stack(binned, 1) & np.uint64((1 << PAGE_BITS) - 1)).astype(np.int64)


def _sums(keys: np.ndarray, size: int, values=None, step: int = 1 << 20) -> np.ndarray:
    """``np.bincount`` taking ``step`` pairs at a time; ``values`` gives the weights of a slice."""
    total = np.zeros(size)
    for at in range(0, len(keys), step):
        part = slice(at, at + step)
        total += np.bincount(keys[part], None if values is None else values(part), size)
    return total


class Rows:
    """Documents as sorted distinct (document, feature) pairs."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, n: int):
        self.doc, self.feature, self.n = doc, feature, n

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return _sums(self.doc, self.n, lambda part: weights[self.feature[part]])

    def only(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        inside = keep[self.doc]
        return Rows(place[self.doc[inside]], self.feature[inside], int(keep.sum()))

    def of(self, features: np.ndarray, size: int) -> Rows:
        """The pairs of some of the ``size`` features, which are numbered anew."""
        number = np.full(size, -1, np.int32)
        number[features] = np.arange(len(features), dtype=np.int32)
        feature = number[self.feature]
        inside = feature >= 0
        return Rows(self.doc[inside], feature[inside], self.n)


def _evidence(with_1: np.ndarray, with_any: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Likelihood ratio statistic of each feature's dependence on the label."""
    share = positive / n
    total = np.zeros(len(with_1))
    for observed, expected in ((lambda: with_1, lambda: with_any * share), (lambda: with_any - with_1, lambda: with_any * (1 - share)),
                               (lambda: positive - with_1, lambda: (n - with_any) * share),
                               (lambda: n - with_any - positive + with_1, lambda: (n - with_any) * (1 - share))):
        o = observed()  # one cell of the table at a time
        total += 2 * o * np.log(np.maximum(o, 1e-12) / np.maximum(expected(), 1e-12))
    return total


@dataclass
class Counts:
    """Pseudo-labelled documents of a view: how many of each label, and with each feature."""

    total: np.ndarray  # of label 0 and 1
    having: np.ndarray  # label by feature

    def ratios(self, labelled: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds ratio, its precision, evidence) of each feature, the documents together weighing as
        ``labelled`` rows at most."""
        weight = min(1.0, labelled / max(self.total.sum(), 1.0))
        n, (a, b) = self.total * weight, self.having * weight
        cells = [b + 0.5, n[0] - a + 0.5, a + 0.5, n[1] - b + 0.5]
        ratio = np.log(cells[0]) + np.log(cells[1]) - np.log(cells[2]) - np.log(cells[3])
        return ratio, 1 / sum(1 / c for c in cells), _evidence(b, a + b, n[1], max(n.sum(), 1e-9))


def _scale(margin: np.ndarray, y: np.ndarray) -> float:
    """How far margins tell the labels: the factor of a logistic regression on them, none below 0."""
    x = np.column_stack([margin, np.ones(len(y))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * w)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(np.clip(w[0], 0, 1))


def label_evidence(rows: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """Evidence of each feature among labelled rows."""
    positive, n = float(y.sum()), float(len(y))
    if not 0 < positive < n:
        return np.zeros(size)
    return _evidence(_sums(rows.feature, size, lambda part: y[rows.doc[part]]), _sums(rows.feature, size), positive, n)


def fit_view(rows: Rows, y: np.ndarray, size: int, given: Counts | None = None, least: float = 25.0, ridge: float = 0.1,
             steps: int = 300) -> np.ndarray:
    """Weights of ``size`` features and, last, the intercept. Only features whose presence depends
    on the label (likelihood ratio statistic of ``least`` or more, among labelled or pseudo-labelled documents) take part.
    ``given`` draws weights to the scaled ratios of the pseudo-labelled documents."""
    weights = np.zeros(size + 1)
    positive, n = float(y.sum()), float(len(y))
    weights[-1] = np.log((positive + 1) / (n - positive + 1))
    if not 0 < positive < n:
        return weights
    taken = label_evidence(rows, y, size) >= least
    if given is not None and given.total.min() > 0:
        ratio, precision, evidence = given.ratios(n)
        taken |= evidence >= least
    chosen = np.flatnonzero(taken)
    number = np.full(size, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    inside = number[rows.feature] >= 0
    doc, col = rows.doc[inside], number[rows.feature[inside]]
    centre, hold = np.zeros(len(chosen)), np.zeros(len(chosen))
    if given is not None and given.total.min() > 0:
        centre = _scale(np.bincount(doc, ratio[chosen][col], rows.n), y) * ratio[chosen]
        hold = precision[chosen]
    w, b = np.zeros(len(chosen)), weights[-1]
    look_w, look_b, pace = w.copy(), b, 1.0
    # curvature bounds: a document's share counts as often as it has features, the intercept included
    own = np.bincount(doc, minlength=rows.n) + 1.0
    step = 1.0 / (ridge + hold + 0.25 * np.bincount(col, own[doc], len(chosen)))
    step_b = 1.0 / (0.25 * own.sum())
    for _ in range(steps):  # accelerated gradient descent
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, look_w[col], rows.n) + look_b, -30, 30)))
        error = p - y
        new_w = look_w - step * (np.bincount(col, error[doc], len(chosen)) + ridge * look_w + hold * (look_w - centre))
        new_b = look_b - step_b * error.sum()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if np.dot(look_w - new_w, new_w - w) > 0:  # overshot: start again from here
            faster = 1.0
        look_w = new_w + (pace - 1) / faster * (new_w - w)
        look_b = new_b + (pace - 1) / faster * (new_b - b)
        w, b, pace = new_w, new_b, faster
    weights[chosen], weights[-1] = w, b
    return weights


@dataclass
class Model:
    content: np.ndarray
    page: np.ndarray
    combine: np.ndarray  # factors of the two log-odds and the intercept

    def score(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        odds = self.combine[0] * content + self.combine[1] * page + self.combine[2]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def calibrated(odds: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression of the label on the two log-odds, by Newton steps, drawn to (1, 1, 0)."""
    x = np.column_stack([odds, np.ones(len(odds))])
    start = np.array([1.0, 1.0, 0.0])
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * (w - start))
        w = w - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return np.maximum(w, [0, 0, -np.inf])


CONTENT, PAGE = 0, 1
SIZES = (1 << BITS, 1 << PAGE_BITS)


class CoTraining:
    """The labelled rows of one question and the views fitted to them; content features are numbered by
    ``candidates``. Rows kept ``apart`` calibrate."""

    def __init__(self, train: list[Rows], apart: list[Rows], y: np.ndarray, y_apart: np.ndarray, candidates: np.ndarray):
        self.train, self.apart, self.y, self.y_apart, self.candidates = train, apart, y, y_apart, candidates

    def fit(self, given: tuple[Counts | None, Counts | None] = (None, None)) -> Model:
        """Both views, calibrated and combined on the rows kept apart."""
        sizes = (len(self.candidates), SIZES[PAGE])
        weights = [fit_view(rows, self.y, size, counts) for rows, size, counts in zip(self.train, sizes, given, strict=True)]
        combine = np.array([1.0, 0.0, 0.0])
        if len(self.y_apart) and 0 < self.y_apart.sum() < len(self.y_apart):
            odds = [v.margins(w[:-1]) + w[-1] for v, w in zip(self.apart, weights, strict=True)]
            combine = calibrated(np.column_stack(odds), self.y_apart)
        content = np.zeros(SIZES[CONTENT] + 1, np.float32)
        content[self.candidates], content[-1] = weights[CONTENT][:-1], weights[CONTENT][-1]
        return Model(content, weights[PAGE].astype(np.float32), combine)


def co_trainings(content: Rows, page: Rows, labels: list[np.ndarray], least: float = 10.0) -> list[CoTraining]:
    """One for each question. Every fifth row is kept apart; of the content features those take part that have at least a
    weak dependence on a label."""
    apart = np.zeros(content.n, bool)
    apart[::5] = True
    known = content.only(~apart)
    wanted = np.zeros(SIZES[CONTENT], bool)
    for y in labels:
        wanted |= label_evidence(known, y[~apart].astype(float), SIZES[CONTENT]) >= least
    candidates = np.flatnonzero(wanted)
    del known
    content = content.of(candidates, SIZES[CONTENT])
    train, held = ([v.only(~apart) for v in (content, page)], [v.only(apart) for v in (content, page)])
    return [CoTraining(train, held, y[~apart].astype(float), y[apart].astype(float), candidates) for y in labels]


def view_margins(models: list[Model], data: np.ndarray, at: np.ndarray, names: list, relevant: np.ndarray | None = None) -> tuple:
    """(distinct content pairs, page features, which of them are first of their kind, margins by question and view);
    content features outside ``relevant`` (and without weight) are left out."""
    all_doc, all_feature = content_features(data, at)
    used = np.zeros(len(all_feature), bool) if relevant is None else relevant[all_feature] >= 0
    for m in models:
        used |= m.content[all_feature] != 0
    doc, feature = _distinct(all_doc[used], all_feature[used])
    page = np.sort(page_features(data, at, names), axis=1)
    first = np.ones(page.shape, bool)
    first[:, 1:] = page[:, 1:] != page[:, :-1]
    margins = [(np.bincount(doc, m.content[feature], len(at) - 1) + m.content[-1],
                (m.page[page] * first).sum(axis=1, dtype=np.float64) + m.page[-1]) for m in models]
    return doc, feature, page, first, margins


COUNTED = "question int, view int, label int, feature int, n long"


def _pseudo_label_rows(text: str, metadata: list[str], shared, sure: float):
    """What each view is sure of, counted for the other view: (question, view that learns, label, feature, documents);
    content features by their number among the candidates, feature -1 counts the documents themselves."""
    edge = np.log(sure / (1 - sure))

    def run(batches):
        models, numbers = shared.value
        width = int(numbers.max()) + 1
        total = np.zeros((len(models), 2, 2), np.int64)
        having = [[[np.zeros(size, np.int64) for _ in (0, 1)] for size in (width, SIZES[PAGE])] for _ in models]
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text, CHUNK):
                doc, feature, page, first, margins = view_margins(models, data, at, _names(batch.slice(lo, hi - lo), metadata), numbers)
                number = numbers[feature]
                for q, odds in enumerate(margins):
                    for teacher in (CONTENT, PAGE):
                        learner = 1 - teacher
                        for label, chosen in ((0, odds[teacher] <= -edge), (1, odds[teacher] >= edge)):
                            total[q, learner, label] += chosen.sum()
                            found = number[(number >= 0) & chosen[doc]] if learner == CONTENT else page[first & chosen[:, None]]
                            having[q][learner][label] += np.bincount(found, minlength=len(having[q][learner][label]))
        rows = [(q, v, label, -1, int(total[q, v, label])) for q in range(len(models)) for v in (0, 1) for label in (0, 1)]
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        for q in range(len(models)):
            for v in (0, 1):
                for label in (0, 1):
                    some = np.flatnonzero(having[q][v][label])
                    more = [np.full(len(some), x) for x in (q, v, label)] + [some, having[q][v][label][some]]
                    columns = [np.concatenate(c) for c in zip(columns, more, strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns[:4]], pa.array(columns[4])],
                                         names=["question", "view", "label", "feature", "n"])
    return run


def pseudo_label_counts(spark: SparkSession, docs: DataFrame, models: list[Model], candidates: np.ndarray, text: str, metadata: list[str],
                        sure: float = 0.98) -> list[tuple[Counts, Counts]]:
    """For each question the counts from which the content and the page view learn, over all of ``docs``; content features
    are numbered by ``candidates``."""
    numbers = np.full(SIZES[CONTENT], -1, np.int32)
    numbers[candidates] = np.arange(len(candidates))
    shared = spark.sparkContext.broadcast((models, numbers))  # tables of fixed size
    counted = docs.select(text, *metadata).mapInArrow(give_back(_pseudo_label_rows(text, metadata, shared, sure)), COUNTED)
    out = [tuple(Counts(np.zeros(2), np.zeros((2, size))) for size in (len(candidates), SIZES[PAGE])) for _ in models]
    # at most one row per feature, view, question and label
    for r in counted.groupBy("question", "view", "label", "feature").agg(F.sum("n").alias("n")).collect():
        counts = out[r.question][r.view]
        if r.feature < 0:
            counts.total[r.label] = r.n
        else:
            counts.having[r.label, r.feature] = r.n
    return out


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((doc << BITS) | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _names(part: pa.RecordBatch, metadata: list[str]) -> list[list[str | None]]:
    return [tx.column(part, c).cast(pa.string()).to_pylist() for c in metadata]


def _sampler(text: str, metadata: list[str]):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text, CHUNK):
                part = batch.slice(lo, hi - lo)
                doc, feature = _distinct(*content_features(data, at))
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                page = page_features(data, at, _names(part, metadata))
                feature = feature.astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    tx.column(part, "_order"), *[tx.column(part, f"_{q}") for q in QUESTIONS],
                    pa.array([feature[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([r.astype("<i4").tobytes() for r in page], pa.binary())],
                    names=["ordered", *QUESTIONS, "content", "page"])
    return run


def _rows(column: list) -> Rows:
    parts = [np.unique(np.frombuffer(b, "<i4")) for b in column]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    return Rows(doc, np.concatenate(parts) if parts else np.zeros(0, np.int32), len(parts))


@small_batches
def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                metadata: tuple[str, ...] = ("lang", "source"), max_labelled: int = 20_000, rounds: int = 2,
                seed: int = 5) -> dict[str, Model]:
    """A model for each of ``QUESTIONS``: fitted on at most ``max_labelled`` labelled documents, and in each of
    ``rounds`` on the pseudo-labels of all documents outside this sample. Labels with a null in a column and labels of
    documents that are not there are passed over; of several labels of a document the worst counts."""
    known = labels.filter("quality is not null and toxic is not null").groupBy(F.col(key).alias("k")).agg(
        *[F.min(F.expr(rule).cast("int")).alias(f"_{q}") for q, rule in QUESTIONS.items()])
    metadata = [c for c in metadata if c in docs.columns]
    named = docs.select(F.col(key).alias("k"), text, *metadata)
    sample = named.select("k").filter("k is not null").distinct().join(known, "k").withColumn("_order", F.xxhash64("k", F.lit(seed)))
    # bounded: at most max_labelled keys
    sample = persist_table(spark, sample.orderBy("_order", "k").limit(max_labelled), "labelled-sample")
    rows = named.join(F.broadcast(sample), "k").drop("k")
    kinds = ", ".join(f"{q} int" for q in QUESTIONS)
    found = rows.mapInArrow(_sampler(text, metadata), f"ordered long, {kinds}, content binary, page binary")
    found = sorted(found.collect(), key=lambda r: (r.ordered, bytes(r.content)))  # bounded: the sample
    content, page = _rows([r.content for r in found]), _rows([r.page for r in found])
    answers = [np.array([r[q] for r in found], int) for q in QUESTIONS]
    del found
    n = content.n
    asked = dict(zip(QUESTIONS, co_trainings(content, page, answers), strict=True))
    del content, page
    models = {q: c.fit() for q, c in asked.items()}
    others = named.join(F.broadcast(sample.select("k")), "k", "left_anti")
    candidates = next(iter(asked.values())).candidates
    for _ in range(rounds if n else 0):
        counts = pseudo_label_counts(spark, others, list(models.values()), candidates, text, metadata)
        models = {q: c.fit(given) for (q, c), given in zip(asked.items(), counts, strict=True)}
    return models


def scored(spark: SparkSession, docs: DataFrame, models: dict[str, Model], text: str = "text",
           metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` with ``p_good``, ``p_clean`` and ``score``, the lower of the two.

    Null texts count as empty, null metadata are a value of their own, repeated rows score
    alike, an empty table stays empty; input columns of the output names are replaced. Without
    labels, or with labels of one kind, a probability is the share of that kind among the labels
    (half without any), which keeps documents unless most labels speak against them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    metadata = [c for c in metadata if c in docs.columns]
    kept = [c for c in docs.columns if c not in SCORED]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, t) for c, t in SCORED.items()])
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(models)  # tables of fixed size

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tx.chunks(batch, text, CHUNK):
                part = batch.slice(lo, hi - lo)
                models = list(shared.value.values())
                margins = view_margins(models, data, at, _names(part, metadata))[-1]
                p = [m.score(*odds) for m, odds in zip(models, margins, strict=True)]
                yield pa.RecordBatch.from_arrays([*[tx.column(part, c) for c in kept], *map(pa.array, p),
                                                  pa.array(np.minimum(*p))], schema=arrow)
    return docs.mapInArrow(give_back(run), schema)


def acceptable(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with their own columns."""
    models = fit_quality(spark, docs, labels, **options)
    return scored(spark, docs, models).filter(F.col("score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
