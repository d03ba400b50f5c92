"""Conversation structure repair by a min-plus matrix scan.

A conversation's roles should read `(s?(ua)+)?` by their initials: nothing, or user and assistant in
turn after at most one system turn. Four states tell where in that pattern one is (at the start, after
system, after user, after assistant). Each turn is a 4x4 matrix from state to state, whose elements are
(cost, audit): the cheapest edits and their initials, the smaller audit first among equal costs.

    Keep 0, Rerole 2 (to user or assistant), Delete 3, Insert 2 (an empty user or assistant turn)

Blank and repeated turns must be deleted; a truncated turn that stays adds 1. Any number of inserts may
come before a turn: its matrix is the insert closure times the turn's own edits, and one more closure
ends the conversation. Products of such matrices are associative (two audits between the same states
over the same turns have the same number of letters besides I, so of equal cost neither begins with the
other, and the order survives what is appended). Turns are sorted by range over all conversations; each
task folds the stretches that it holds by a balanced tree, and conversations that lie in several tasks
are reduced by a tree over their stretches, ARITY at a time. The repaired text of such a conversation
is hashed in order by one stream that holds no more than a batch, as SHA-256 has no other way.

Defined cases: rows with one turn are in the order of role and text; null roles and texts are one
space; a null turn comes first; a null conversation is one of its own; an empty or unknown role has no
place in the pattern, so it is reroled or deleted; equal rows of one turn are duplicates from the second
on; a gap beyond the longs is the largest long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to, and its role.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: From which states a kept turn with this initial leads where.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
ARITY = 8
LONGEST = 2**63 - 1

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product over (cost, audit)."""
    return tuple(tuple(min(((x[0] + y[0], x[1] + y[1]) for x, row in zip(own, b, strict=True) if x and (y := row[j])), default=None) for j in range(4)) for own in a)


def _closure() -> Matrix:
    step: Matrix = tuple(tuple((INSERT, "I") if NEXT[i][0] == j else None for j in range(4)) for i in range(4))
    none: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))
    out = none
    for _ in range(3):  # beyond three inserts a state repeats
        more = multiply(out, step)
        out = tuple(tuple(min((x for x in (none[i][j], more[i][j]) if x), default=None) for j in range(4)) for i in range(4))
    return out


CLOSURE = _closure()


@lru_cache
def turn_matrix(kind: str) -> Matrix:
    """kind: the initial (x: none of the pattern's), a capital if truncated, or d if it must go."""
    own: list[list[tuple[int, str] | None]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if kind != "d":
        more = int(kind.isupper())
        for state, (to, _) in NEXT.items():
            own[state][to] = (REROLE + more, "R")
        for state, to in KEPT[kind.lower()].items():
            own[state][to] = (KEEP + more, "K")
    return multiply(CLOSURE, tuple(map(tuple, own)))


@lru_cache(16_384)
def _few(kinds: str) -> Matrix:
    return turn_matrix(kinds) if len(kinds) == 1 else multiply(_few(kinds[:-1]), turn_matrix(kinds[-1]))


def fold(kinds: str) -> Matrix:
    """The product of all turns' matrices, as a balanced tree: an audit is copied once a level."""
    if len(kinds) <= 4:
        return _few(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return multiply(fold(kinds[:half]), fold(kinds[half:]))


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest way from the start to a whole pattern."""
    end = multiply(m, CLOSURE)[START]
    return min(x for x in (end[START], end[ASSISTANT]) if x)


def kind_of(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """(the turn's kind, its first fault)."""
    bare = text.strip(SPACE)
    if not bare:
        return "d", "blank"
    if repeated:
        return "d", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial, "") if bare[-1] in ".!?" else (initial.upper(), "truncated")


def replay(turns: Iterator[tuple[str, str, str]], audit: str, state: int = START) -> Iterator[str | int]:
    """The repaired turns, and at the end the state reached; turns are (kind, role, text)."""
    for letter in audit:
        if letter == "I":
            state, role = NEXT[state]
            yield f"{role}:"
            continue
        kind, role, text = next(turns)
        if letter == "K":
            state = KEPT[kind.lower()][state]
            yield f"{role}:{text}"
        elif letter == "R":
            state, role = NEXT[state]
            yield f"{role}:{text}"
    yield state


class Stretch:
    """Consecutive turns of one conversation: what a product of matrices and sums over turns need."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> str:
        kind, fault = kind_of(role, text, repeated)
        self.kinds.append(kind)
        if fault:
            self.faults[fault] += 1
        if self.first is None:
            self.first = role[:1]
        else:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        return kind

    def row(self) -> dict:
        return self.faults | {"illegal": self.illegal, "distinct": self.distinct, "low": self.low, "high": self.high, "first": self.first, "last": self.last}


def joined(a: dict, b: dict) -> dict:
    """The sums of two stretches, one after the other."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"]}


def gaps(sums: dict) -> int:
    return 0 if sums["low"] is None else min(LONGEST, sums["high"] - sums["low"] + 1 - sums["distinct"])


_SUMS = "blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string"
_MATRIX = "costs array<long>, audits array<string>"
_FOLDED = f"what string, conv string, part int, nth long, role string, text string, kinds string, {_SUMS}, {_MATRIX}, gaps long, cost long, audit string, repaired_sha256 string"
_RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _schema(of: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in of.split(", "))])


def _flat(m: Matrix) -> dict:
    """-1: no way."""
    cells = [x or (-1, "") for row in m for x in row]
    return {"costs": [c for c, _ in cells], "audits": [a for _, a in cells]}


def _matrix(row: dict) -> Matrix:
    cells = [None if c < 0 else (int(c), a) for c, a in zip(row["costs"], row["audits"], strict=True)]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


def _fold_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (part, conv, turn, role, text, earlier). Conversations inside the task come out
    finished; the first and the last may go on in other tasks, so they come out as a stretch and its rows."""
    schema, out, room = _schema(_FOLDED), [], 0
    conv = own = before = None
    turns: list[tuple[str, str, str]] = []
    first, part, nth = True, 0, 0

    def finish(edge: bool) -> None:
        kinds = "".join(own.kinds)
        if edge:
            out.append({"what": "stretch", "conv": conv, "part": part, "kinds": kinds} | own.row() | _flat(fold(kinds)))
            return
        cost, audit = best(fold(kinds))
        text = "\n".join([x for x in replay(iter(turns), audit)][:-1])
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        out.append({"what": "done", "conv": conv, "cost": cost, "audit": audit, "repaired_sha256": digest, "gaps": gaps(own.row())} | own.faults | {"illegal": own.illegal})

    def turn_row(at: int, kind: str, role: str, text: str) -> dict:
        return {"what": "turn", "conv": conv, "part": part, "nth": at, "kinds": kind, "role": role, "text": text}

    for batch in batches:
        for part, name, turn, role, text, earlier in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if name != conv:
                if conv is not None:
                    finish(first)
                    first = False
                conv, own, before, turns, nth = name, Stretch(), None, [], 0
            now = (turn, role, text)
            kind = own.add(turn, role, text, earlier or now == before)
            before = now
            if first:
                out.append(turn_row(nth, kind, role, text))
                room += len(text)
            else:
                turns.append((kind, role, text))
            nth += 1
            if len(out) >= 2_000 or room >= 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, room = [], 0
    if conv is not None:
        finish(True)
        out += [turn_row(i, *x) for i, x in enumerate(turns)]
        for at in range(0, len(out), 2_000):
            yield pa.RecordBatch.from_pylist(out[at : at + 2_000], schema)


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring stretches of a conversation as one."""
    parts = rows.sort_values("part").to_dict("records")
    names = [n.split()[0] for n in _SUMS.split(", ")]
    parts = [{k: None if v is None or v is pd.NA or v != v else int(v) if k in names[:7] else v for k, v in p.items() if k in names} | {"m": _matrix(p)} for p in parts]
    while len(parts) > 1:
        parts = [joined(*p) | {"m": multiply(p[0]["m"], p[1]["m"])} if len(p) == 2 else p[0] for p in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    sums = {k: parts[0][k] for k in names}
    out = pd.DataFrame([{"conv": rows["conv"].iloc[0], "part": rows["part"].min() // ARITY, "stretches": len(rows)} | sums | _flat(parts[0]["m"])])
    return out.astype({n: "Int64" for n in names[:7]})


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    sums = rows.iloc[0].to_dict()
    whole = {k: None if pd.isna(sums[k]) else int(sums[k]) for k in ("low", "high", "distinct")}
    cost, audit = best(_matrix(sums))
    return pd.DataFrame([{k: sums[k] for k in ("conv", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps(whole), "cost": cost, "audit": audit}])


def _pieces(stretches: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
    """Each stretch's part of the audit, and the state that it begins in."""
    out, audit, at, state = [], solved["audit"].iloc[0], 0, START
    stretches = stretches.sort_values("part")
    for conv, part, kinds in zip(stretches["conv"], stretches["part"], stretches["kinds"], strict=True):
        end, left = at, len(kinds)
        while left:
            left -= audit[end] != "I"
            end += 1
        out.append((conv, part, audit[at:end], state))
        *_, state = replay(((k, "", "") for k in kinds), audit[at:end], state)
        at = end
    if out:
        conv, part, piece, begun = out[-1]
        out[-1] = (conv, part, piece + audit[at:], begun)
    return pd.DataFrame(out, columns=["conv", "part", "piece", "state"])


def _repaired(turns: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
    turns = turns.sort_values("nth")
    lines = list(replay(zip(turns["kinds"], turns["role"], turns["text"], strict=True), piece["piece"].iloc[0], int(piece["state"].iloc[0])))[:-1]
    conv, part = piece["conv"].iloc[0], piece["part"].iloc[0]
    return pd.DataFrame([(conv, part, at, "\n".join(lines[at : at + 1_000])) for at in range(0, len(lines), 1_000)], columns=["conv", "part", "nth", "lines"])


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (conv, part, nth, lines): each conversation's hash, a batch in memory at a time."""
    schema, conv, state = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]), None, None
    for batch in batches:
        out = []
        for name, lines in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if name != conv:
                if conv is not None:
                    out.append({"conv": conv, "repaired_sha256": state.hexdigest()})
                conv, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(lines.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pylist(out, schema)
    if conv is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": state.hexdigest()}], schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each
    conversation with a row."""
    space = F.lit(" ")
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    turns = rows.select(key.alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    # Where each role and text first stands. The join below has the turn in its key: no text is hot in it.
    firsts = turns.groupBy("conv", "role", digest.alias("digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("at"))
    firsts = firsts.select("conv", "role", "digest", F.col("at.turn").alias("turn"), F.lit(True).alias("here"))
    l, r = turns.withColumn("digest", digest).alias("l"), firsts.alias("r")
    on = (F.col("l.conv") == F.col("r.conv")) & F.col("l.turn").eqNullSafe(F.col("r.turn")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.digest") == F.col("r.digest"))
    marked = written(l.join(r, on, "left").select("l.conv", "l.turn", "l.role", "l.text", F.col("r.here").isNull().alias("earlier")), "turns")
    order = ["conv", "turn", "role", "text"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order, "earlier")
    folded = written(dealt.mapInArrow(_fold_tasks, _FOLDED), "folded")

    stretches = folded.filter("what = 'stretch'")
    level = stretches.select("conv", "part", *[x.split()[0] for x in f"{_SUMS}, {_MATRIX}".split(", ")])
    while True:
        level = written(level.groupBy("conv", F.floor(F.col("part") / ARITY).alias("_up")).applyInPandas(_reduce, f"conv string, part int, stretches int, {_SUMS}, {_MATRIX}"), "stretches")
        if level.agg(F.max("part")).first()[0] in (None, 0):  # all of a conversation is in one
            break
        level = level.drop("stretches")
    solved = written(level.groupBy("conv").applyInPandas(_solve, "conv string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"), "solved")
    pieces = stretches.select("conv", "part", "kinds").groupBy("conv").cogroup(solved.select("conv", "audit").groupBy("conv")).applyInPandas(_pieces, "conv string, part int, piece string, state int")
    edges = folded.filter("what = 'turn'").select("conv", "part", "nth", "kinds", "role", "text")
    lines = edges.groupBy("conv", "part").cogroup(pieces.groupBy("conv", "part")).applyInPandas(_repaired, "conv string, part int, nth long, lines string")
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "part", "nth").mapInArrow(_hash_stream, "conv string, repaired_sha256 string")
    late = solved.join(hashes, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    out = folded.filter("what = 'done'").select(*_RESULT).unionByName(late.select(*_RESULT))
    kind = rows.schema[conv].dataType
    return out.select(F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind).alias(conv), *_RESULT[1:])


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults that follow from the CRC of `conv_id:turn` (nulls: a
    space): of 20 remainders 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it,
    4 makes its role user."""
    space = F.lit(" ")

    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
