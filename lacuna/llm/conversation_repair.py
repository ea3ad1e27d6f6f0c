"""Repair of conversation structure: signatures are solved once and edits replayed.

A conversation's role initials should read ``(s?(ua)+)?``: a system turn at most,
then user and assistant in turn.  Rows can also be blank (no character but
space and U+0009 to U+000D), duplicate (role and text seen earlier in the
conversation) or truncated (the last such character is not one of ``.!?``); the
first of these counts.  Repair takes the cheapest edits: Keep 0, Rerole to user
or assistant 2, Delete 3 (required for blank and duplicate rows), Insert an
empty user or assistant turn 2; a truncated row that is not deleted adds 1.  Of
equally cheap edits the one whose initials are least in ASCII wins.

1. Rows without their texts (role, a digest of the text, faults) are dealt by
   conversation and read in order; each conversation becomes a signature, a
   letter a row: its role's initial, in upper case if truncated, or x if the row
   must go.
2. Each distinct signature is solved once, by halves: a table holds the best
   edits of a piece between any two of the four states of the grammar, and
   tables of short pieces are memoised.
3. Audits are joined back by signature, and meet the rows again in a sorted
   stream, each conversation's audit before its rows, where they are replayed.

A conversation's rows pass through one task, as its digest is one SHA-256 over
all of them, but as a stream: what is held of a conversation is a few bytes a
row, never its texts.

Defined results: nulls in role and text are one space, so such a role has no
legal initial; an empty role has none either; rows of one turn are taken by role
and then by the digest of their text; turns that are null come first; a null
conversation id is a conversation of its own; repeated rows are duplicates; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import batches_of, runs, written

BLANKS = " \t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.  Where each initial leads.
STEP: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where an inserted or reroled turn leads; the one role that fits.
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
#: Pieces up to this length are remembered.
MEMO = 64

Table = tuple[tuple[tuple[int, str] | None, ...], ...]


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) after no, one, two or three insertions; more only repeat states."""
    out = [(state, 0, "")]
    for _ in range(3):
        state, cost, edits = out[-1]
        out.append((NEXT[state], cost + 2, edits + "I"))
    return out


def _one(sign: str) -> Table:
    """The best edits of one row, insertions before it included, between any two states."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STEP]
    cut, initial = int(sign.isupper()), sign.lower()
    for begin in range(4):
        for state, cost, edits in _inserted(begin):
            ends = [(state, cost + 3, edits + "D")]
            if sign != "x":
                ends.append((NEXT[state], cost + 2 + cut, edits + "R"))
                if initial in STEP[state]:
                    ends.append((STEP[state][initial], cost + cut, edits + "K"))
            for end, *best in ends:
                old = table[begin][end]
                table[begin][end] = min(old, tuple(best)) if old else tuple(best)
    return tuple(map(tuple, table))


def _joined(left: Table, right: Table) -> Table:
    # Edits of one piece end in its last row, so none is the beginning of another and the least of joined ones joins least ones.
    return tuple(tuple(min((((a[0] + b[0]), a[1] + b[1]) for mid in range(4) if (a := left[begin][mid]) and (b := right[mid][end])), default=None) for end in range(4)) for begin in range(4))


def _solve(signs: str) -> Table:
    if len(signs) == 1:
        return _one(signs)
    half = 1 << (len(signs) - 1).bit_length() - 1
    return _joined(solve(signs[:half]), solve(signs[half:]))


_remembered = lru_cache(maxsize=1 << 14)(_solve)


def solve(signs: str) -> Table:
    """The best edits of a piece between any two states; pieces are halved at powers of two, so that signatures share them."""
    return _remembered(signs) if len(signs) <= MEMO else _solve(signs)


def cheapest(signs: str) -> tuple[int, str]:
    """(cost, audit) of a signature."""
    starts = [(state, *best) for state, best in enumerate(solve(signs)[0]) if best] if signs else [(0, 0, "")]
    return min((cost + more, edits + ins) for state, cost, edits in starts for end, more, ins in _inserted(state) if end in ENDS)


def _order(kind: bool = False) -> list[Column | str]:
    return ["conv_id", *(["kind"] if kind else []), F.asc_nulls_first("turn"), "role", "digest"]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of rows (conv_id, turn, role, digest, blank, cut, copies)."""
    gone = F.col("copies") == 0
    earlier = Window.partitionBy("conv_id", "role", "digest", gone).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("blank"), "b").when(F.row_number().over(earlier) > 1, "d").when(F.col("cut"), "t").otherwise("-")
    initial = F.substring(F.concat("role", F.lit("\0")), 1, 1)  # a role without an initial has one that fits nowhere
    rows = rows.repartition("conv_id").select("*", fault.alias("fault"), initial.alias("initial"))
    sign = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(sign)).otherwise(sign)
    again = F.when(F.col("fault") == "b", "b").otherwise("d")  # a copy beside its row
    here, more = F.col("copies") > 0, F.greatest(F.col("copies") - 1, F.lit(0)).cast("int")
    rows = rows.select(
        "conv_id", "turn", "role", "digest", here.alias("here"),
        F.when(here, F.concat(sign, F.repeat(F.lit("x"), more))).otherwise("").alias("signs"),
        F.when(here, F.concat("fault", F.repeat(again, more))).otherwise("").alias("faults"),
        F.when(here, F.repeat("initial", more + 1)).otherwise("").alias("initials"),
    ).sortWithinPartitions(*_order()).drop("role", "digest")

    def row(key, parts: list[list[str]], turns: list[int]) -> tuple:
        signs, faults, initials = map("".join, parts)
        illegal = max(0, len(initials) - 1) - sum(initials.count(x) for x in ("su", "ua", "au"))
        first, last, n = turns
        return key, signs, last - first + 1 - n if n else 0, *map(faults.count, "bdt"), illegal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key = parts = turns = None
        for value, batch, new in runs(batches, "conv_id"):
            if new:
                if parts is not None:
                    yield row(key, parts, turns)
                key, parts, turns = value, [[], [], []], [0, 0, 0]
            for k, c in enumerate(("signs", "faults", "initials")):
                parts[k].append("".join(batch.column(c).to_pylist()))
            for turn, here in zip(batch.column("turn").to_pylist(), batch.column("here").to_pylist(), strict=True):
                if here and turn is not None:
                    if not turns[2]:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns = [turns[0], turn, turns[2] + 1]
        if parts is not None:
            yield row(key, parts, turns)

    schema = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    return rows.mapInArrow(batches_of(run, schema), schema)


def solved(signs: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for s in batch.column("signature").to_pylist():
                yield s, *cheapest(s)

    schema = "signature string, cost long, audit string"
    return signs.select("signature").distinct().mapInArrow(batches_of(run, schema), schema)


class Replay:
    """The repaired turns of one conversation, hashed as its rows go by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.digest, self.first = hashlib.sha256(), True

    def _turn(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else '\n'}{role}:{text}".encode("utf-8", "replace"))
        self.first = False

    def _fit(self, text: str) -> None:
        """A turn of the one role that fits."""
        self.state = NEXT[self.state]
        self._turn("user" if self.state == 2 else "assistant", text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._fit("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state][role[0]]
            self._turn(role, text)
        elif edit == "R":
            self._fit(text)

    def hexdigest(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of the cheapest edits, the digest of what they leave.

    `copies` says how often a row stands in its place (default: once); a row
    that stands nowhere only names its conversation.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    bare = F.rtrim("text", F.lit(BLANKS))
    small = rows.select("conv_id", "turn", "role", "digest", "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    signed = written(signatures(small), "signatures")
    audits = signed.join(solved(signed).hint("merge"), "signature").drop("signature")
    heads = audits.withColumn("kind", F.lit(0))
    both = heads.unionByName(rows.filter("copies > 0").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    counts = [c.split()[0] for c in RESULT.split(", ")[1:-1]]
    both = both.select("conv_id", "kind", "turn", "role", "digest", "text", "copies", *counts).repartition("conv_id").sortWithinPartitions(*_order(kind=True)).drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head = replay = None
        for key, batch, new in runs(batches, "conv_id"):
            texts = batch.column("text")  # one at a time becomes a Python object
            part = batch.drop_columns(["text"]).to_pydict()
            for k in range(batch.num_rows):
                if new and not k:  # a conversation's first row is its audit
                    if replay is not None:
                        yield *head, replay.hexdigest()
                    head, replay = (key, *(part[c][0] for c in counts)), Replay(part["audit"][0])
                    continue
                for _ in range(part["copies"][k]):
                    replay.row(part["role"][k], texts[k].as_py())
        if replay is not None:
            yield *head, replay.hexdigest()

    return both.mapInArrow(batches_of(run, RESULT), RESULT)
