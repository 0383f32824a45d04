"""Conversation structure repair: the cheapest edits that make a conversation read ``system? (user assistant)+`` or nothing.

Edits are written as letters: K keeps a turn, R gives it the role the place wants (cost 2), D deletes it (3; a must for blank
and duplicate turns), I inserts an empty turn (2); a truncated turn that stays costs 1. Of all cheapest edits the one whose
letters are least in ASCII order is taken.

The dynamic programme runs over turns. A layer has a place for each state of the wanted order (nothing yet, after the system
turn, after a user turn, after an assistant turn). One step is a macro edit, a run of up to two insertions and the edit of one
turn, whose code ``I* (D|K|R)`` is prefix-free: letters so far compare as their sequences of codes, and two places of one layer never
hold the same letters or a prefix of each other. So no letters are kept: a layer holds costs, less their minimum, and ranks, a candidate
compares by (cost, rank of its parent, order of its code), and each place remembers parent and code. Longer runs only come
back to a place at a higher cost, and a place that costs over 7 more than the best can't win (two insertions and one deletion
imitate whatever another place can do), so few layers exist, and each (layer, kind of turn) is worked out once a worker. The letters are
read off the pointers backwards.

Spark deals turns by conversation and sorts each twice over: first all turns without their texts (kind and digest), then all turns
with them. A task therefore knows a conversation's edits before its texts arrive, and hashes or emits them as they
stream by. It holds some 150 bytes for each turn of one conversation and no text. A digest over a whole conversation is a
chain, so one conversation is one task's work, however long; conversations share nothing.

Defined edge cases: null roles and texts are one blank, in the key of the damage null ids and turns too; a null conv_id is a conversation;
turns without number come first; turns of equal number are ordered by digest; wholly equal turns are duplicates; an empty role has no initial
and can't be kept; a conversation that loses all turns has zeros and empty edits; an empty table gives no rows; very long texts
pass by once; other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftmill.llm.common import scratch_root

NONE, SYSTEM, USER, ASSISTANT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
LONG_MAX = 2**63 - 1
_SLACK = 7
#: The state after 0, 1, ... insertions.
_RUNS = {NONE: (NONE, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
_TRAILING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
_ORDER = {code: i for i, code in enumerate(_CODES)}
#: A kind of turn: its initial's number among these (3: none of them), 4 if truncated, 8 if it must go.
INITIALS = "sua"
_TRUNCATED, _GOES = 4, 8
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def follows(state: int) -> int:
    """The state after a user or assistant turn, whichever ``state`` wants."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state after a turn that keeps its role, or None where it doesn't fit."""
    if initial == 0:
        return SYSTEM if state == NONE else None
    return follows(state) if initial == (2 if state == USER else 1) else None


def _edits(state: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, next state, cost)`` of what can be done with a turn."""
    yield "D", state, 3
    if not kind & _GOES:
        extra = bool(kind & _TRUNCATED)
        yield "R", follows(state), 2 + extra
        if (after := kept(state, kind & 3)) is not None:
            yield "K", after, extra


Layer = tuple  # a (cost, rank) for each state, or None
FIRST: Layer = ((0, 0), None, None, None)
_STEPS: dict[tuple[Layer, int], tuple[Layer, int, tuple]] = {}


def step(layer: Layer, kind: int) -> tuple[Layer, int, tuple]:
    """The next layer, what all its costs were lowered by, and a (parent, code) for each state."""
    found = _STEPS.get((layer, kind))
    if found is None:
        best: dict[int, tuple] = {}
        for parent, place in enumerate(layer):
            if place:
                for run, state in enumerate(_RUNS[parent]):
                    for letter, after, cost in _edits(state, kind):
                        code = "I" * run + letter
                        candidate = (place[0] + 2 * run + cost, place[1], _ORDER[code], parent)
                        best[after] = min(best.get(after, candidate), candidate)
        least = min(b[0] for b in best.values())
        best = {state: b for state, b in best.items() if b[0] <= least + _SLACK}
        ranks = {state: rank for rank, (_, state) in enumerate(sorted((b[1:3], state) for state, b in best.items()))}
        found = tuple((best[s][0] - least, ranks[s]) if s in best else None for s in range(4)), least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
        _STEPS[layer, kind] = found
    return found


def cheapest(kinds: Iterator[int]) -> tuple[int, str]:
    """Cost and letters of the least edits of turns of these kinds."""
    layer, cost, pointers = FIRST, 0, []
    for kind in kinds:
        layer, more, back = step(layer, kind)
        cost += more
        pointers.append(back)
    end, _, state = min((place[0] + 2 * len(_TRAILING[s]), place[1], s) for s, place in enumerate(layer) if place)
    codes, at = [_TRAILING[state]], state
    for back in reversed(pointers):
        at, code = back[at]
        codes.append(_CODES[code])
    return cost + end, "".join(reversed(codes))


class Repair:
    """Applies letters to turns in order; ``turn`` and ``end`` give the ``(role, text)`` that come out."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, NONE

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._wanted(), ""

    def _wanted(self) -> str:
        self.state = follows(self.state)
        return "user" if self.state == USER else "assistant"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            yield self._wanted(), text
        elif letter == "K":
            self.state = kept(self.state, INITIALS.find(role[0]))
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insertions()


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there`` after the stated faults; a dropped turn stays with ``there`` false to name its conversation."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    plain = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    hit = plain.withColumn("fault", F.crc32(key) % 20)
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def _kind() -> Column:
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return number + F.when(rest == "", _GOES).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(0)


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Outline:
    """What the turns without texts say of one conversation."""

    def __init__(self):
        self.kinds, self.seen, self.counts = bytearray(), set(), [0, 0, 0]
        self.least = self.most = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, kind: int, digest: bytes) -> None:
        fault = 0 if kind & _GOES else 1 if digest in self.seen else 2 if kind & _TRUNCATED else None
        self.seen.add(digest)
        if fault is not None:
            self.counts[fault] += 1
        self.kinds.append(kind | _GOES if fault == 1 else kind)
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn
            self.distinct += 1

    def close(self) -> tuple:
        """``gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        self.seen = set()
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(self.kinds, self.kinds[1:], strict=False))
        return (min(gaps, LONG_MAX), *self.counts, illegal, *cheapest(self.kinds))


def _dealt(turns: DataFrame) -> DataFrame:
    """Each turn twice, without and with its text, by conversation and in order."""
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    passes = F.when(F.col("there"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = turns.select("conv_id", "turn", "role", "text", "there", _kind().alias("kind"), digest.alias("digest"), F.explode(passes).alias("pass"))
    light = twice.select("conv_id", "pass", "turn", "there", "kind", "digest", *(F.when(F.col("pass") == 1, F.col(c)).alias(c) for c in ("role", "text")))
    return light.repartition("conv_id").sortWithinPartitions("conv_id", "pass", F.col("turn").asc_nulls_first(), "digest")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pass", "turn", "there", "kind", "digest", "role", "text")), strict=True)


def _repaired(rows: Iterator[tuple]) -> tuple[tuple, Iterator[tuple[str, str]]]:
    """The report of one conversation and then, as they stream by, its turns."""
    outline, heavy = Outline(), None
    for row in rows:
        if row[1]:
            heavy = row
            break
        if row[3]:
            outline.add(row[2], row[4], row[5])
    report = outline.close()

    def turns() -> Iterator[tuple[str, str]]:
        repair = Repair(report[-1])
        if heavy:
            yield from repair.turn(heavy[6], heavy[7])
        for row in rows:
            yield from repair.turn(row[6], row[7])
        yield from repair.end()

    return report, turns()


def _run(turns: DataFrame, ddl: str, emit, most: int = 4096) -> DataFrame:
    scratch_root(turns.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for conv_id, rows in groupby(_stream(batches), key=lambda r: r[0]):
            for row, size in emit(conv_id, *_repaired(rows)):
                out.append(row)
                held += size
                if len(out) >= most or held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _dealt(turns).mapInArrow(run, ddl)


def report(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cost and letters of its repair, and a digest of the repaired turns."""

    def emit(conv_id, found, repaired):
        sha, first = hashlib.sha256(), True
        for role, text in repaired:
            sha.update(("" if first else "\n").encode() + role.encode() + b":")
            sha.update(text.encode())
            first = False
        yield (conv_id, *found, sha.hexdigest()), len(found[-1])

    return _run(turns, f"conv_id long, {_REPORT}, repaired_sha256 string", emit)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns themselves, numbered from 0: ``conv_id, turn, role, text``."""

    def emit(conv_id, _, made):
        for i, (role, text) in enumerate(made):
            yield (conv_id, i, role, text), len(text)

    return _run(turns, "conv_id long, turn long, role string, text string", emit)
