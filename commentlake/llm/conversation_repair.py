"""Conversation structure repair: the cheapest edits that make turns alternate.

Rows of a conversation are edited so that its role initials read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3; the only
choice for blank and duplicate rows) and Insert an empty user or assistant turn
(2); a truncated row that is not deleted adds 1.  Of the cheapest ways that with
the least audit (the initials of the edits in order, compared as ASCII) is taken.

Cost and audit are one big integer.  Its high digits are the cost; below them
stand a fixed number of octal digits, one for each edit in order (D 1, I 2, K 3,
R 4), with zeros behind the last one.  The smaller integer is the cheaper repair,
or at equal cost the one of lesser audit, so plain integer minima over the graph
of (row, state) decide everything, and the least number itself spells the edits.

On Spark: the duplicate test is a window over (conversation, role, digest of the
text), so no conversation is held for it.  Rows without texts are sorted by
conversation and turn and read as a stream: a task keeps one byte a row of the
conversation at hand, from which the graph is solved (conversations of n rows
take n integers of 6n bits).  Texts are shuffled once, beside the audits, and
streamed into the rows or the hash of the repaired conversation.

Defined results: null roles and texts are one space; a role of another initial
(or none) than s, u, a can't be kept, only reroled or deleted; rows of one turn
that differ are taken by role, then by the SHA-256 of the text; rows without turn
come first; rows without conv_id are one conversation; repeated rows are
duplicates; an empty table has no conversations; other columns do not pass
through, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, table

LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads, and the role it has.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEVER = 1 << 62
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _with(value: int, width: int, letter: int, cost: int) -> int:
    """``value`` (of ``width`` digits) with an edit before all others: one digit more."""
    low = value & ((1 << 3 * width) - 1)
    return ((value >> 3 * width) + cost << 3 * width + 3) | letter << 3 * width | low


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation; a code a row: "-" must go, a role's
    initial (x: another), upper case if the row is truncated."""
    width = 1
    value = [0, NEVER << 3, _with(0, 0, INSERT, COST[INSERT]), 0]
    for code in reversed(codes):
        taken = []
        for state in range(4):
            best = _with(value[state], width, DELETE, COST[DELETE])
            if code != "-":
                more = code.isupper()
                best = min(best, _with(value[NEXT[state]], width, REROLE, COST[REROLE] + more))
                to = KEPT.get((state, code.lower()))
                if to is not None:
                    best = min(best, _with(value[to], width, KEEP, COST[KEEP] + more))
            taken.append(best)
        # two inserted turns side by side never pay, as a pair less is legal too
        value = [min(taken[s] << 3, _with(taken[NEXT[s]], width + 1, INSERT, COST[INSERT])) for s in range(4)]
        width += 2
    best = value[EMPTY]
    digits = best & ((1 << 3 * width) - 1)
    return best >> 3 * width, oct(digits | 1 << 3 * width)[3:].rstrip("0").translate(str.maketrans("1234", "DIKR"))


_short = lru_cache(50_000)(cheapest)


def _solved(codes: str) -> tuple[int, str]:
    return _short(codes) if len(codes) <= 32 else cheapest(codes)


def normal(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) with nulls of role and text as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return (rows.select("conv_id", "turn", part("role"), part("text"))
            .withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)))


ORDER = ("turn", "role", "digest")


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    return (df.repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest"))


def _fields(df: DataFrame) -> list[T.StructField]:
    return [T.StructField("conv_id", df.schema["conv_id"].dataType)]


FACTS = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
AUDIT = T.StructField("audit", T.StringType())


class _Conversation:
    """What is kept of the conversation at hand: a byte a row, and counts."""

    def __init__(self):
        self.codes, self.last = bytearray(), ""
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.codes:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        code = initial if initial in ("s", "u", "a") else "x"
        self.codes += b"-" if fault in ("b", "d") else (code.upper() if fault == "t" else code).encode()

    def facts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = _solved(self.codes.decode())
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def audits(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row
    a conversation of ``rows`` (as ``normal`` gives them) and of ``also``
    (conv_id: conversations that may have no rows)."""
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    fault: Column = (F.when(~F.col("visible"), "b").when(F.row_number().over(seen) > 1, "d")
                     .when(~F.col("ended"), "t").otherwise(""))
    facts = (rows.select("conv_id", *ORDER, F.substr("role", F.lit(1), F.lit(1)).alias("initial"),
                         F.col("text").rlike(VISIBLE).alias("visible"), F.col("text").rlike(ENDED).alias("ended"))
             .withColumn("fault", fault).drop("visible", "ended"))
    if also is not None:
        facts = facts.unionByName(also.select("conv_id").distinct(), allowMissingColumns=True)
    schema = T.StructType([*_fields(rows), *FACTS, AUDIT])
    arrow = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []
        for batch in batches:
            for conv, turn, initial, f in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")),
                                              strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.facts()))
                    key, now = conv, _Conversation()
                if f is not None:
                    now.add(turn, initial, f)
            if out:
                yield _batch(out, arrow)
                out = []
        if now is not None:
            yield _batch([(key, *now.facts())], arrow)

    return _in_order(facts).select("conv_id", "turn", "initial", "fault").mapInArrow(solve, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


class _Editor:
    """Applies an audit to the rows of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand for a row and before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, ROLE[self.state], text


def _edited(rows: DataFrame, audits: DataFrame, schema: T.StructType, begin: Callable, add: Callable, end: Callable) -> DataFrame:
    """Streams every conversation's turns after repair: begin() makes the state
    of a conversation, add(state, conv_id, edit, role, text) may return a row,
    end(state, audit row) too."""
    arrow = to_arrow_schema(schema)
    facts = [f.name for f in FACTS] + ["audit"]
    both = (audits.withColumn("audited", F.lit(0))
            .unionByName(rows.withColumn("audited", F.lit(1)), allowMissingColumns=True))
    columns = ["conv_id", "audited", "role", "text", *facts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edit, state, known, out = None, None, None, None, []

        def turns(some) -> None:
            for t in some:
                r = add(state, conv, *t)
                if r is not None:
                    out.append(r)

        def close() -> None:
            if edit is not None:
                turns(edit.inserted())
                r = end(state, conv, known)
                if r is not None:
                    out.append(r)

        for batch in batches:
            for conv_id, kind, role, text, *found in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if kind == 0:
                    close()
                    conv, edit, state, known = conv_id, _Editor(found[-1]), begin(), found
                else:
                    turns(edit.row(role, text))
            if out:
                yield _batch(out, arrow)
                out.clear()
        close()
        if out:
            yield _batch(out, arrow)

    return _in_order(both, "audited").select(*columns).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, nth, edit, role, text): the repaired conversations turn by turn."""
    rows = normal(rows)
    schema = T.StructType([*_fields(rows), T.StructField("nth", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def add(state: list[int], conv, edit: str, role: str, text: str) -> tuple:
        state[0] += 1
        return conv, state[0] - 1, edit, role, text

    return _edited(rows, stored(audits(rows), "conv-audits"), schema, lambda: [0], add, lambda *_: None)


def digests(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """The audits, each with the SHA-256 of the repaired conversation: its
    ``role:text`` joined by newlines."""
    rows = normal(rows)
    schema = T.StructType([*_fields(rows), *FACTS, AUDIT, T.StructField("repaired_sha256", T.StringType())])

    def begin() -> list:
        return [hashlib.sha256(), False]

    def add(state: list, conv, edit: str, role: str, text: str) -> None:
        if state[1]:
            state[0].update(b"\n")
        state[1] = True
        state[0].update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def end(state: list, conv, known: list) -> tuple:
        return conv, *known, state[0].hexdigest()

    return _edited(rows, stored(audits(rows, also), "conv-audits"), schema, begin, add, end)


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows after the damage that crc32(``conv_id:turn``) mod 20 says (nulls:
    one space), and the conv_id of those dropped: 0 drops a row, 1 empties its
    text, 2 removes its [.!?], 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    left = (marked.filter("kind != 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))
    return left, marked.filter("kind = 0").select("conv_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, dropped = damaged(table(spark, sf_dir, "conversations"))
    return digests(left, dropped)
