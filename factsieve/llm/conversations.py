"""Repair of damaged conversations by the cheapest edits, with square-root checkpoints.

A conversation's rows in order are kept, given another role, deleted or preceded by inserted empty turns so that the
roles left read ``(s?(ua)+)?`` (s, u, a: initials of system, user, assistant). Four states: at the start, and after
s, u or a. What is left to pay from a row on is a vector of four costs, computed backwards; edits are then chosen
forwards, of the cheapest the one whose letter comes first (D, I, K, R), which gives the ASCII-least audit. Only every
``sqrt(n)``-th vector is kept on the way back; the walk forward recomputes the block it is in.

No conversation has to fit in a task:

* Rows are sorted by conversation and turn into ranges, so a long conversation lies in several partitions. A
  *segment* is what one partition holds of a conversation. Rows of one turn are ordered by a hash of role and text.
* A row's part in the costs is one of 16 codes; the codes of a segment are a string of a byte a row.
* A segment of several is first summed up as a 4 x 4 matrix (cheapest way from each state to each other). The matrices
  of a conversation, at most one for each partition, give the vectors behind its segments.
* Each segment is walked from all four states; the conversation's start then picks one of the four for each.
* Texts join the edits in one more pass by segment, as a stream; the hash of a conversation in one segment is done
  there, of one in several by a stream over its segments' repaired rows.

Defined results: null conversations are one conversation; null turns come first; null roles and texts are one space;
repeated rows are duplicates; other columns are ignored; a conversation without rows after damage has zeros, an empty
audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.llm.common import col, slices, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: States: start, after s, after u, after a. Where each initial leads (None: not allowed), and what may be inserted or reroled to.
START, S, U, A = range(4)
NEXT = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None), "-": (None,) * 4}
FILL = (U, U, A, U)
FILL_ROLE = ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)  # ``u`` and ``a``, or ``a``, inserted at the end

Vector = tuple[int, ...]


def _steps(code: str) -> list[list[tuple[str, int, int]]]:
    """The edits of a row in each state as ``(letter, next state, cost)``, inserts aside. Codes: initial (s, u, a, -) in upper case if truncated, x for rows to delete, . for none."""
    if code == ".":
        return [[] for _ in range(4)]
    out = []
    for state in range(4):
        own = [("D", state, DELETE)]
        if code != "x":
            more = TRUNCATED if code in "SUA+" else 0
            stay = NEXT[code.lower() if code != "+" else "-"][state]
            if stay is not None:
                own.append(("K", stay, KEEP + more))
            own.append(("R", FILL[state], REROLE + more))
        out.append(own)
    return out


STEPS = {c: _steps(c) for c in "suaSUAx-+."}


def back(code: str, ahead: Vector) -> Vector:
    """What is to pay before a row, given what is to pay behind it. Inserts before a row: at most two in a row pay."""
    if code == ".":
        return ahead
    own = [min(cost + ahead[to] for _, to, cost in STEPS[code][state]) for state in range(4)]
    for _ in range(2):
        own = [min(own[s], INSERT + own[FILL[s]]) for s in range(4)]
    return tuple(own)


def walk(codes: str, behind: Vector, state: int) -> tuple[list[str], int]:
    """Each row's letters (inserts before it, then its own) of the cheapest and ASCII-least way, and the state at the end."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks = {n: behind}
    ahead = behind
    for i in range(n - 1, -1, -1):
        ahead = back(codes[i], ahead)
        if i % step == 0:
            marks[i] = ahead
    out = []
    for first in range(0, n, step):
        last = min(n, first + step)
        block = [marks[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(back(codes[i], block[-1]))
        block.reverse()  # block[j]: to pay before row first + j
        for i in range(first, last):
            here, then, letters = block[i - first], block[i - first + 1], ""
            while codes[i] != ".":
                options = [(letter, to) for letter, to, cost in STEPS[codes[i]][state] if cost + then[to] == here[state]]
                if here[FILL[state]] + INSERT == here[state]:
                    options.append(("I", FILL[state]))
                letter, state = min(options)
                letters += letter
                if letter != "I":
                    break
            out.append(letters)
    return out, state


def matrix(codes: str) -> list[int]:
    """Row by row the cheapest cost from each state to each other over a segment."""
    columns = []
    for goal in range(4):
        ahead: Vector = tuple(0 if s == goal else NEVER for s in range(4))
        for code in reversed(codes):
            ahead = tuple(min(NEVER, x) for x in back(code, ahead))
        columns.append(ahead)
    return [columns[t][s] for s in range(4) for t in range(4)]


def _damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, gone``: the rows as the damage leaves them; dropped ones stay, marked and empty."""
    one = lambda c: F.coalesce(c, F.lit(" "))
    fault = F.crc32(F.concat(one(col("conv_id").cast("string")), F.lit(":"), one(col("turn").cast("string"))).cast("binary")) % 20
    rows = conversations.select(col("conv_id").alias("conv"), col("turn").cast("long").alias("turn"), one(col("role")).alias("role"), one(col("text")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _undamaged(conversations: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(c, F.lit(" "))
    return conversations.select(col("conv_id").alias("conv"), col("turn").cast("long").alias("turn"), one(col("role")).alias("role"), one(col("text")).alias("text"), F.lit(False).alias("gone"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows with their place: ``part`` and ``pos``, ascending by conversation, turn and hash; written once."""
    sha = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.col("gone"), "gone").when(F.length(tail) == 0, "blank").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("*", sha.alias("h"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("h")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ranged.select("conv", "turn", "h", "initial", "fault", "role", "text", F.monotonically_increasing_id().alias("pos")).withColumn("part", F.shiftright("pos", 33)), "conversation-rows")


def _segments(rows: DataFrame) -> DataFrame:
    """``conv, part, codes, faults``: a segment's codes, and the same rows' faults and initials for the report."""
    slim = rows.select("conv", "part", "pos", "turn", "h", "initial", "fault")
    seen = slim.where("fault <> 'gone'").groupBy("conv", "h").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("conv").alias("c"), F.col("h").alias("g"), "first")
    flagged = slim.join(seen, _same("conv", "c") & (F.col("h") == F.col("g")), "left")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    repeated = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    code = F.when(F.col("fault") == "gone", ".").when((F.col("fault") == "blank") | repeated, "x").when(F.col("fault") == "truncated", F.when(initial == "-", "+").otherwise(F.upper(initial))).otherwise(initial)
    fault = F.when(F.col("fault") == "gone", ".").when(F.col("fault") == "blank", "b").when(repeated, "d").when(F.col("fault") == "truncated", "t").otherwise("o")
    listed = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"), fault.alias("fault"), initial.alias("initial"))))
    joined = lambda name: F.array_join(F.transform(F.col("l"), lambda x: x[name]), "").alias(name)
    turns = F.when(F.col("fault") != "gone", F.col("turn"))
    return flagged.groupBy("conv", "part").agg(listed.alias("l"), F.min(turns).alias("low"), F.max(turns).alias("high"), F.count_distinct(turns).alias("turns")).select("conv", "part", joined("code"), joined("fault"), joined("initial"), "low", "high", "turns")


def _behind(segments: DataFrame) -> DataFrame:
    """``c, g, behind, single``: of every segment of a conversation that has several, the costs behind it."""
    several = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv").alias("c"))
    own = segments.select("conv", "part", "code").join(several, _same("conv", "c"), "left_semi")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([matrix(c) for c in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["conv", "part", "m"])

    conv = segments.schema["conv"].dataType.simpleString()
    chains = own.mapInArrow(sums, f"conv {conv}, part long, m array<long>").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("chain"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, parts, found = [], [], []
            for i, chain in enumerate(batch.column(1).to_pylist()):
                ahead = END
                for link in reversed(chain):
                    of.append(i)
                    parts.append(link["part"])
                    found.append(list(ahead))
                    m = link["m"]
                    ahead = tuple(min(m[4 * s + t] + ahead[t] for t in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(parts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["c", "g", "behind"])

    return chains.mapInArrow(vectors, f"c {conv}, g long, behind array<long>")


def _edits(segments: DataFrame) -> DataFrame:
    """``segments`` with ``single``, ``start`` and each row's letters (``letters``, comma-joined) by their way through the conversation."""
    known = stage(_behind(segments), "conversation-behind")
    placed = segments.join(known, _same("conv", "c") & (F.col("part") == F.col("g")), "left").select(*segments.columns, "behind")
    names = placed.columns

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ways, ends = [], []
            for codes, behind in zip(batch.column(names.index("code")).to_pylist(), batch.column(names.index("behind")).to_pylist(), strict=True):
                own = [walk(codes, tuple(behind or END), state) for state in (range(4) if behind else (START,))]
                ways.append([",".join(letters) for letters, _ in own])
                ends.append([end for _, end in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=[*names, "ways", "ends"])

    schema = T.StructType([*placed.schema.fields, T.StructField("ways", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    walked = stage(placed.mapInArrow(walks, schema), "conversation-walks")
    chains = walked.where("behind is not null").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("chain"))
    # the state before each segment: the ends of those before it, one after the other
    starts = chains.select("conv", F.explode(F.expr("""
        aggregate(chain, named_struct('state', 0, 'all', cast(array() as array<struct<part: bigint, start: int, last: boolean>>)),
            (acc, x) -> named_struct('state', x.ends[acc.state], 'all', concat(acc.all, array(named_struct('part', x.part, 'start', acc.state, 'last', x.part = element_at(chain, -1).part)))),
            acc -> acc.all)""")).alias("s")).select(F.col("conv").alias("c"), F.col("s.part").alias("g"), F.col("s.start").alias("start"), F.col("s.last").alias("last"))
    found = walked.join(starts, _same("conv", "c") & (F.col("part") == F.col("g")), "left")
    start = F.coalesce("start", F.lit(START))
    return found.select("conv", "part", "fault", "initial", "low", "high", "turns", F.col("behind").isNull().alias("single"), start.alias("start"), F.coalesce("last", F.lit(True)).alias("last"), F.col("ways")[start].alias("letters"))


class _Fold:
    """What is reported of one conversation, gathered segment by segment."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.turns = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.before, self.begun, self.sha = "", False, hashlib.sha256()

    def segment(self, s: dict) -> None:
        if s["low"] is not None:
            self.turns += s["turns"] - (self.high is not None and self.high == s["low"])
            self.low = s["low"] if self.low is None else self.low
            self.high = s["high"]
        self.blank += s["fault"].count("b")
        self.duplicate += s["fault"].count("d")
        self.truncated += s["fault"].count("t")
        for initial, fault in zip(s["initial"], s["fault"], strict=True):
            if fault != ".":
                self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
                self.before = initial
        self.audit.append(s["audit"])
        self.cost += s["cost"]

    def rows(self, payload: bytes) -> None:
        if payload:
            self.sha.update(payload if self.begun else payload[1:])
            self.begun = True

    def result(self, conv: object) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


class _Segment:
    """The rows of one segment as they stream by."""

    def __init__(self, head: dict):
        self.head, self.state, self.at = head, head["start"], 0
        self.letters = head["letters"].split(",")
        self.cost, self.audit = 0, []

    def _put(self, role: str, text: str) -> str:
        return f"\n{role}:{text}"

    def _insert(self) -> str:
        role, self.state = FILL_ROLE[self.state], FILL[self.state]
        self.cost += INSERT
        return self._put(role, "")

    def row(self, role: str, text: str) -> str:
        """The repaired rows for the next row, each after a line break."""
        letters, fault, out = self.letters[self.at], self.head["fault"][self.at], ""
        self.at += 1
        self.audit.append(letters)
        for letter in letters:
            if letter == "I":
                out += self._insert()
                continue
            if letter == "D":
                self.cost += DELETE
                continue
            if letter == "R":
                self.cost += REROLE
                role, self.state = FILL_ROLE[self.state], FILL[self.state]
            else:
                self.state = NEXT[role[:1]][self.state]
            self.cost += TRUNCATED * (fault == "t")
            out += self._put(role, text)
        return out

    def close(self) -> str:
        """Turns inserted at the conversation's end."""
        out = ""
        while self.head["last"] and self.state in (S, U):
            out += self._insert()
            self.audit.append("I")
        return out

    def summary(self) -> dict:
        return {**self.head, "audit": "".join(self.audit), "cost": self.cost}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_HEAD = ("fault", "initial", "low", "high", "turns", "single", "start", "last", "letters")
_CARRIED = ("fault", "initial", "low", "high", "turns", "audit", "cost")
#: Characters of repaired rows passed on at a time.
CHUNK = 1 << 18


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    With ``damage`` the rows are first damaged by the rule of the query; without it they are repaired as they are.
    """
    rows = _sorted_rows(_damaged(conversations) if damage else _undamaged(conversations))
    edits = _edits(stage(_segments(rows), "conversation-segments"))
    conv = rows.schema["conv"].dataType.simpleString()
    head = F.struct(*_HEAD)
    both = rows.select("conv", "part", "pos", "role", "text", F.lit(None).cast(edits.select(head.alias("h")).schema["h"].dataType).alias("head")).unionByName(
        edits.select("conv", "part", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), head.alias("head")))
    stream = both.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")
    carried = "struct<fault: string, initial: string, low: bigint, high: bigint, turns: bigint, audit: string, cost: bigint>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments one after the other: results of conversations in one segment, parts of the others."""
        made: list[tuple] = []
        segment, fold, key, waiting, size, at = None, None, None, [], 0, 0
        types, names = None, ["conv", "part", "at", "more", "payload", *(p.split()[0] for p in _RESULT.split(", "))]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2

        def pass_on() -> None:
            nonlocal waiting, size, at
            payload = "".join(waiting).encode()
            if segment.head["single"]:
                fold.rows(payload)
            elif payload:
                made.append((*key, at, None, payload, *(None,) * 8))
                at += 1
            waiting, size = [], 0

        def close() -> None:
            waiting.append(segment.close())
            pass_on()
            if segment.head["single"]:
                fold.segment(segment.summary())
                made.append((*key, 0, None, None, *fold.result(None)[1:]))
            else:
                made.append((*key, at, {n: segment.summary()[n] for n in _CARRIED}, None, *(None,) * 8))

        more = pa.struct([(n, pa.string() if n in ("fault", "initial", "audit") else pa.int64()) for n in _CARRIED])
        for batch in slices(batches):
            types = types or [batch.column(0).type, pa.int64(), pa.int64(), more, pa.binary(), *kinds]
            heads = batch.column(5)
            for i, (c, part, role, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if heads[i].is_valid:
                    if segment is not None:
                        close()
                    segment, fold, key, at = _Segment(heads[i].as_py()), _Fold(), (c, part), 0
                    continue
                waiting.append(segment.row(role, text))
                size += len(waiting[-1])
                if size > CHUNK:
                    pass_on()
            if len(made) >= 1000 or sum(len(r[4] or b"") for r in made) > 8 * CHUNK:
                yield _columns(made, types, names)
                made = []
        if segment is not None:
            close()
        if made:
            yield _columns(made, types, names)

    done = stage(stream.mapInArrow(apply, f"conv {conv}, part long, at long, more {carried}, payload binary, {_RESULT}"), "conversation-repairs")
    outputs = [p.split()[0] for p in _RESULT.split(", ")]
    whole = done.where("repaired_sha256 is not null").select(F.col("conv").alias("conv_id"), *outputs)
    parts = done.where("repaired_sha256 is null").select("conv", "part", "at", "more", "payload").repartition("conv").sortWithinPartitions("conv", "part", "at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key, types, made = None, None, None, []
        for batch in slices(batches, 64):
            types = types or [batch.column(0).type, *[pa.int64()] * 6, *[pa.string()] * 2]
            for c, more, payload in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if fold is None or c != key:
                    made += [fold.result(key)] if fold else []
                    fold, key = _Fold(), c
                fold.rows(payload or b"")
                if more is not None:
                    fold.segment(more)
            if len(made) > 1000:
                yield _columns(made, types, ["conv_id", *outputs])
                made = []
        if fold is not None:
            yield _columns([*made, fold.result(key)], types, ["conv_id", *outputs])

    return whole.unionByName(parts.mapInArrow(join, f"conv_id {conv}, {_RESULT}"))
