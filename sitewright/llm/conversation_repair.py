"""Conversation structure repair: the cheapest edits that give a well-formed conversation.

A conversation is well-formed if its roles' initials are ``(s?(ua)+)?``. Rows may be kept (0),
rerole to user or assistant (1) or deleted (2), and empty rows of either role inserted (5);
blank rows and duplicates must go, a truncated row that stays costs 5. Of the cheapest edit
sequences the one whose initials (K, R, D, I) are least in ASCII order is taken; it is unique.

Secondary-sorted streaming: rows are repartitioned by conversation and sorted by turn, and
``mapInPandas`` carries the state of a dynamic program (cost and order of the best edits to
each of four states) across Arrow batches. The state moves on by a table that fills as it is
used, since costs count from the least and few differences occur. A row leaves four bytes of
backpointers. Above a few MB, rows and backpointers of one conversation go to unnamed files
of the task and are read back in blocks, so memory stays bounded for a conversation of any
length; a lost executor costs its tasks. Whether a row repeats an earlier one is a window in
the same partitions. A conversation is one task's work by its nature: its repaired text is
one digest, its edits one string.

Results by case: null roles and texts are one space; rows with equal turns stand by role and
text, null turns first; null ids are one conversation; an empty role has no initial and is
never kept; repeated rows are duplicates; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system's row, after a user's and an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: the role that may be inserted or given to a row, with the state after it.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: What a row may become, as initials of edits, by their number in a backpointer.
TOKENS = ("D", "K", "R", "IK", "IR")
#: Edits at the end, by the state they start in.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: A state this much dearer than the cheapest can't win: 12 cover any difference (two inserts, one deletion).
HOPELESS = 32
#: Faults of rows, in the order in which they count.
FAULTS = ("", "blank", "duplicate", "truncated")
#: Bytes of backpointers, and characters of rows, that a conversation holds in memory.
POINTERS, CHARS = 1 << 20, 1 << 23


def ordered(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by conversation and turn: ``id``, ``turn``, ``role``, ``text`` and ``fault``, its number in FAULTS."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    met = rows.repartition("id").withColumn("said", said)
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("id", "said").orderBy("turn")))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", 1).when(F.col("nth") > 1, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return met.select("id", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions("id", "turn", "role", "text")


@lru_cache(maxsize=1 << 16)
def step(state: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
    """The state after a row, what the least cost rose by, and the row's backpointers.

    A state holds, for each of the four, the cost over the least and the rank of its edits
    in ASCII order, or None.
    """
    best: dict[int, tuple] = {}
    extra = TRUNCATED * (fault == 3)

    def offer(to: int, cost: int, rank: int, token: str, came: int) -> None:
        if to not in best or (cost, rank, token) < best[to][:3]:
            best[to] = (cost, rank, token, came)

    def lands(at: int) -> int | None:
        """The state after the row as it stands."""
        if initial == "s":
            return SYSTEM if at == START else None
        return GIVEN[at][1] if initial and GIVEN[at][0].startswith(initial) else None

    for at, known in enumerate(state):
        if known is None:
            continue
        cost, rank = known
        offer(at, cost + DELETE, rank, "D", at)
        if fault in (1, 2):
            continue
        for before, fee in (("", 0), ("I", INSERT)):
            here = GIVEN[at][1] if before else at
            offer(GIVEN[here][1], cost + fee + REROLE + extra, rank, before + "R", at)
            if (to := lands(here)) is not None:
                offer(to, cost + fee + KEEP + extra, rank, before + "K", at)
    least = min(v[0] for v in best.values())
    order = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    after = tuple((best[to][0] - least, order[to]) if to in best and best[to][0] - least <= HOPELESS else None for to in range(4))
    return after, least, bytes(best[to][3] | TOKENS.index(best[to][2]) << 2 if to in best else 255 for to in range(4))


class Tape:
    """Bytes that are appended, then read in blocks; above a size they lie in an unnamed file."""

    def __init__(self, limit: int = POINTERS) -> None:
        self.limit, self.held, self.file, self.stored = limit, bytearray(), None, 0

    def append(self, data: bytes) -> None:
        self.held += data
        if len(self.held) > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.stored, self.held = self.stored + len(self.held), bytearray()

    def backward(self, width: int) -> Iterator[bytes]:
        """Its entries of ``width`` bytes, the last first."""
        for k in range(len(self.held) - width, -1, -width):
            yield bytes(self.held[k : k + width])
        size, at = self.limit // width * width or width, self.stored
        while at:
            size = min(size, at)
            at -= size
            self.file.seek(at)
            block = self.file.read(size)
            yield from (block[k : k + width] for k in range(size - width, -1, -width))


class Rows:
    """A conversation's rows in order; above CHARS characters they lie in an unnamed file."""

    def __init__(self, limit: int = CHARS) -> None:
        self.limit, self.held, self.file, self.chars = limit, [], None, 0

    def append(self, row: tuple) -> None:
        self.held.append(row)
        self.chars += len(row[2]) + 64
        if self.chars > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.held


class Conversation:
    """One conversation: rows go in by turn, edits come out."""

    def __init__(self, id_: str | None, pointers: int = POINTERS, chars: int = CHARS) -> None:
        self.id, self.state, self.cost = id_, ((0, 0), None, None, None), 0
        self.rows, self.pointers = Rows(chars), Tape(pointers)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.state, rose, back = step(self.state, role[:1], fault)
        self.cost += rose
        self.pointers.append(back)
        self.rows.append((turn, role, text, fault))

    def edits(self) -> Iterator[tuple]:
        """``(edit, role, text, turn, found role, fault)``, the last three None for inserted rows."""
        ends = {at: (known[0] + INSERT * len(TAILS[at]), known[1]) for at, known in enumerate(self.state) if known}
        at = last = min(ends, key=ends.get)
        self.cost += ends[at][0]
        tokens = Tape(self.pointers.limit)  # the last row's first
        for back in self.pointers.backward(4):
            tokens.append(bytes([back[at] >> 2]))
            at = back[at] & 3
        now = START
        for (token,), (turn, role, text, fault) in zip(tokens.backward(1), self.rows, strict=True):
            for edit in TOKENS[token]:
                if edit == "D":
                    yield "D", role, text, turn, role, fault
                    continue
                given, after = GIVEN[now]
                if edit == "I":
                    yield "I", given, "", None, None, None
                elif edit == "R":
                    yield "R", given, text, turn, role, fault
                else:
                    after = SYSTEM if role[:1] == "s" else after
                    yield "K", role, text, turn, role, fault
                now = after
        for edit in TAILS[last]:
            given, now = GIVEN[now]
            yield edit, given, "", None, None, None


def conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Conversations of sorted rows, each complete."""
    open_ = None
    for batch in batches:
        turns = (None if none else turn for none, turn in zip(batch["none"], batch["turn"].tolist(), strict=True))
        rows = zip(batch["id"], turns, batch["role"], batch["text"], batch["fault"].tolist(), strict=True)
        for id_, run in groupby(rows, key=lambda r: r[0]):
            if open_ is None or open_.id != id_:
                if open_ is not None:
                    yield open_
                open_ = Conversation(id_)
            for _, turn, role, text, fault in run:
                open_.add(turn, role, text, fault)
    if open_ is not None:
        yield open_


def _streamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Ordered rows as Python takes them: a null turn as 0 beside ``none``, so numbers stay exact."""
    return ordered(df, **names).select("id", F.col("turn").isNull().alias("none"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "fault")


def repair(df: DataFrame, **names: str) -> DataFrame:
    """Every edit in order: ``conv_id``, ``place``, ``edit``, ``role`` and ``text`` after it, the row's ``turn`` and ``fault``.

    The repaired conversation is its rows but those whose edit is D.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chars = [], 0
        for conv in conversations(batches):
            for place, (edit, role, text, turn, _, fault) in enumerate(conv.edits()):
                rows.append((conv.id, place, edit, role, text, turn, fault and FAULTS[fault] or None))
                chars += len(text) + 64
                if chars > CHARS:
                    yield _frame(rows)
                    rows, chars = [], 0
        yield _frame(rows)

    out = _streamed(df, names).mapInPandas(run, "id string, place long, edit string, role string, text string, turn long, fault string")
    return out.select(_id(df, names), *out.columns[1:])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "place", "edit", "role", "text", "turn", "fault"]).astype({"turn": "Int64", "place": "int64"})


def _id(df: DataFrame, names: dict[str, str]) -> Column:
    return F.col("id").cast(df.schema[names.get("id_col", "conv_id")].dataType).alias("conv_id")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(df: DataFrame, **names: str) -> DataFrame:
    """What each conversation's repair did: faults, cost, edits and the digest of its repaired rows.

    ``gaps`` counts numbers that no turn has between the first and the last, ``illegal``
    neighbouring rows, as found, whose initials are none of su, ua and au.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for conv in conversations(batches):
            found.append((conv.id, *_told(conv)))
            if len(found) >= 1024:
                yield pd.DataFrame(found, columns=["id", *REPORT])
                found = []
        yield pd.DataFrame(found, columns=["id", *REPORT])

    out = _streamed(df, names).mapInPandas(run, "id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(_id(df, names), *REPORT)


def _told(conv: Conversation) -> tuple:
    faults, illegal, distinct = [0, 0, 0, 0], 0, 0
    first = last = before = None
    audit, digest, sep = bytearray(), hashlib.sha256(), b""
    for edit, role, text, turn, as_found, fault in conv.edits():
        audit += edit.encode()
        if as_found is not None:
            faults[fault] += 1
            if before is not None and before[:1] + as_found[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = as_found
            if turn is not None:
                first = turn if first is None else first
                distinct += turn != last
                last = turn
        if edit != "D":
            digest.update(sep + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            sep = b"\n"
    gaps = 0 if first is None else last - first + 1 - distinct
    return gaps, *faults[1:], illegal, conv.cost, audit.decode(), digest.hexdigest()
