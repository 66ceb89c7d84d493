"""Conversation structure repair: a generalised LR parse of role sequences with weighted edits.

The role grammar is ``C -> empty | B | s B``, ``B -> P | B P``, ``P -> u a`` over role initials.
Its LR automaton, with the reductions of a finished pair taken at once, has four stack tops:
nothing read, ``s`` read, ``u`` read (an open pair), and pairs read. The parse keeps one graph-structured
stack per conversation; every row may be kept, reroled or deleted and turns may be inserted,
and stacks with equal tops are merged by the smallest (cost, audit). Two edit sequences that
meet in a top at equal cost never have audits where one is a prefix of the other (the longer one
would hold the same row edits and more inserts), so the merge keeps the audit that is smallest in
the end. Tops that cost over ``SLACK`` more than the best are dropped: from every top the rest of
every other top's plan can be followed for 10 more, so they cannot win.

Rows are dealt by conversation and sorted in each task, and the parse reads them as a stream: a
task holds one batch of rows and at most four tops, each with its audit since the last edit
all tops agree on and a running hash of its repaired text. A conversation of any length is thus
parsed in bounded memory but for its audit, one character a row. Its rows still pass through one task,
since the digest of a whole conversation is sequential.

Nulls in any column read as one space (a null conversation id is a conversation of its own);
rows of a conversation go by (turn, nulls first; role; text), so repeated rows and equal turns
have a defined order; blank rows and copies must be deleted; an empty table gives no rows; other
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
SLACK = 12
SPACES = " \t\n\x0b\x0c\r"

NOTHING, SYSTEM, OPEN, PAIRS = range(4)
# stack top and role initial to the next top; an 'a' closes the pair, which joins the pairs before it
SHIFT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): OPEN, (SYSTEM, "u"): OPEN, (PAIRS, "u"): OPEN, (OPEN, "a"): PAIRS}
ACCEPTING = (NOTHING, PAIRS)
ROLES = {"u": "user", "a": "assistant"}


class Top:
    """One stack top: what it cost, its audit, and the repaired text so far as a running
    digest with the turns not yet hashed."""

    __slots__ = ("audit", "cost", "digest", "turns")

    def __init__(self, cost: int, audit: str, digest, turns: tuple = ()):
        self.cost, self.audit, self.digest, self.turns = cost, audit, digest, turns

    def then(self, cost: int, edit: str, turn: tuple | None = None) -> Top:
        return Top(self.cost + cost, self.audit + edit, self.digest, (*self.turns, turn) if turn else self.turns)

    def settle(self) -> None:
        """Hash the turns; the digest of a parent is shared, so it is copied first."""
        if self.turns:
            digest, first = (self.digest.copy(), False) if self.digest else (hashlib.sha256(), True)
            for role, text in self.turns:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
            self.digest, self.turns = digest, ()


def _offer(tops: dict[int, Top], state: int, new: Top) -> bool:
    old = tops.get(state)
    if old is None or (new.cost, new.audit) < (old.cost, old.audit):
        tops[state] = new
        return True
    return False


class Stack:
    """The graph-structured stack of one conversation."""

    def __init__(self):
        self.tops = {NOTHING: Top(0, "", None)}
        self.agreed: list[str] = []

    def _inserted(self) -> dict[int, Top]:
        """The tops and what inserted turns lead to from them."""
        tops = dict(self.tops)
        todo = list(tops)
        while todo:
            state = todo.pop()
            for initial, role in ROLES.items():
                to = SHIFT.get((state, initial))
                if to is not None and _offer(tops, to, tops[state].then(INSERT, "I", (role, ""))):
                    todo.append(to)
        return tops

    def read(self, role: str, text: str, must_go: bool, unfinished: bool) -> None:
        """One row: every top deletes it, keeps it or reroles it, after any inserts."""
        new: dict[int, Top] = {}
        more = UNFINISHED if unfinished else 0
        for state, top in self._inserted().items():
            _offer(new, state, top.then(DELETE, "D"))
            if must_go:
                continue
            to = SHIFT.get((state, role[:1]))
            if to is not None:
                _offer(new, to, top.then(KEEP + more, "K", (role, text)))
            for initial, other in ROLES.items():
                to = SHIFT.get((state, initial))
                if to is not None:
                    _offer(new, to, top.then(REROLE + more, "R", (other, text)))
        least = min(t.cost for t in new.values())
        self.tops = {s: t for s, t in new.items() if t.cost <= least + SLACK}
        longest = 0
        for t in self.tops.values():
            t.settle()
            longest = max(longest, len(t.audit))
        if longest > 256:
            self._agree()

    def _agree(self) -> None:
        """Set aside the edits all tops have in common."""
        n = len(prefix := commonprefix([t.audit for t in self.tops.values()]))
        if n:
            self.agreed.append(prefix)
            for t in self.tops.values():
                t.audit = t.audit[n:]

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, sha256 of the repaired conversation) of the cheapest accepted stack."""
        tops = self._inserted()
        best = min((tops[s] for s in ACCEPTING if s in tops), key=lambda t: (t.cost, t.audit))
        best.settle()
        digest = best.digest or hashlib.sha256()
        return best.cost, "".join([*self.agreed, best.audit]), digest.hexdigest()


class Conversation:
    """Counts and parse of one conversation, fed row by row in order."""

    def __init__(self):
        self.stack = Stack()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None  # turns
        self.turns = 0
        self.before = None  # role initial of the row before

    def read(self, turn, role: str, text: str, copy: bool) -> None:
        stripped = text.rstrip(SPACES)
        blank = not stripped
        unfinished = not blank and not copy and stripped[-1] not in ".!?"
        if blank:
            self.blank += 1
        elif copy:
            self.duplicate += 1
        elif unfinished:
            self.truncated += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.stack.read(role, text, blank or copy, unfinished)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.stack.end())


PLAN = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def ordered_rows(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, present: Column | None = None) -> DataFrame:
    """Rows dealt by conversation and sorted in their tasks: (conv, present, copy, turn, role,
    text). ``present`` false marks a row that only names its conversation."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    null_as_space = lambda c: F.when(there, F.coalesce(c.cast("string"), F.lit(" ")))
    df = rows.select(conv.alias("conv"), there.alias("present"), F.when(there, turn).alias("turn"), null_as_space(role).alias("role"),
                     null_as_space(text).alias("text"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    earlier = Window.partitionBy("conv", "said").orderBy(F.asc_nulls_first("turn"))
    df = df.withColumn("said", same).repartition("conv")  # the window is satisfied by the same dealing
    df = df.withColumn("copy", F.col("present") & (F.row_number().over(earlier) > 1)).drop("said")
    return df.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select("conv", "present", "copy", "turn", "role", "text")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, as tuples."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _plans(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    conv, state = None, None

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for key, present, copy, turn, role, text in _groups(batches):
        if state is None or key != conv:
            if state is not None:
                out.append((conv, *state.row()))
                size += len(out[-1][-2])
                if len(out) >= 4096 or size > 1 << 22:
                    yield flush()
                    out, size = [], 0
            conv, state = key, Conversation()
        if present:
            state.read(turn, role, text, copy)
    if state is not None:
        out.append((conv, *state.row()))
    if out:
        yield flush()


def repair_plans(ordered: DataFrame) -> DataFrame:
    """Per conversation of ``ordered_rows``: conv, fault counts, cost, audit and the digest of the repaired text."""
    kind = ordered.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in PLAN]])
    return ordered.mapInArrow(lambda it: _plans(it, schema), f"conv {kind.simpleString()}, {_PLAN}")


def _apply(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The turns that the audits leave. Each conversation's first row has its audit."""
    edits, position, system = iter(""), 0, 0
    out = []

    def turns(row: tuple) -> None:
        """The inserted turns up to the edit that spends ``row`` and what this edit makes of it."""
        nonlocal position, system
        conv, turn, role, text = row
        for edit in edits:
            if edit == "D":
                return
            if edit == "K" and position == 0 and role[:1] == "s":
                system = 1
            made = role if edit == "K" else ROLES["ua"[(position - system) % 2]]
            out.append((conv, position, made, "" if edit == "I" else text, edit, None if edit == "I" else turn))
            position += 1
            if edit != "I":
                return

    conv = None
    for batch in batches:
        for conv_, audit, turn, role, text in _groups([batch]):
            if audit is not None:
                turns((conv, None, "", ""))  # inserts at the end of the conversation before
                edits, position, system, conv = iter(audit), 0, 0, conv_
            else:
                turns((conv, turn, role, text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    turns((conv, None, "", ""))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repaired_turns(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, position, role, text, edit, turn); an inserted turn has a
    null ``turn``. Each conversation's plan comes before its rows in one sorted stream."""
    conv, turn = ordered.schema["conv"].dataType, ordered.schema["turn"].dataType
    schema = pa.schema([("conv", to_arrow_type(conv)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
                        ("turn", to_arrow_type(turn))])
    rows = ordered.where("present").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    both = rows.unionByName(plans.select("conv", "audit"), allowMissingColumns=True).repartition("conv")
    stream = both.sortWithinPartitions("conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    return stream.mapInArrow(lambda it: _apply(it, schema), f"conv {conv.simpleString()}, position long, role string, text string, edit string, "
                             f"turn {turn.simpleString()}")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of a ``conversations`` table after the damage that their checksum names; a row that is
    dropped stays as a mark of its conversation with ``present`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"),
                       F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")
