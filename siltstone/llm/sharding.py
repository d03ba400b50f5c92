"""Jump consistent hashing: stable keys to shards without a ring table, DataFrame functions only.

The generator is the published one (Lamping and Veach): state = state * 2862933555777941757 + 1
modulo 2^64, next = floor((b + 1) * 2^31 / ((state >> 33) + 1)). Spark has no unsigned or wrapping
product under ANSI rules, so the state is kept as two 32-bit halves in bigints and multiplied in
16-bit steps that never leave 63 bits. The start state is the first half of the key's MD5, which
makes the mapping the same in any engine and for any key type.

Defined cases: a null key counts as the empty string; equal keys share a shard; an empty table
gives no rows; a column of the input with the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

MULTIPLIER = 2862933555777941757
_CH, _CL = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M32 = 0xFFFFFFFF
#: Steps taken for every key. A key needs about ln(shards) steps; the few that need more take
#: the exact long way, so no shard count is out of reach.
QUICK_STEPS = 64


def _mul32(a: Column, b: int) -> Column:
    """(a * b) modulo 2^32 for 32-bit halves."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    high = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_M32))


def _advance(s: Column) -> tuple[Column, Column]:
    hi, lo = s["h"], s["l"]
    t0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(_CL) + F.lit(1)
    t1 = F.shiftright(lo, 16) * F.lit(_CL)
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
    high = (_mul32(hi, _CL) + _mul32(lo, _CH) + carry).bitwiseAND(F.lit(_M32))
    return high, low.bitwiseAND(F.lit(_M32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of each key as an int column."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    start = F.struct(
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("h"),
        F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint").alias("l"),
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
    )
    n = F.lit(shards).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        high, low = _advance(s)
        jump = F.floor((s["j"] + F.lit(1)) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double")))
        moved = F.struct(high.alias("h"), low.alias("l"), s["j"].alias("b"), jump.cast("bigint").alias("j"))
        return F.when(s["j"] < n, moved).otherwise(s)

    def run(first: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)

    quick = run(start, min(shards, QUICK_STEPS))
    if shards > QUICK_STEPS:
        quick = F.when(quick["j"] < n, run(quick, shards)).otherwise(quick)
    return quick["b"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, order: list[str] | None = None, blocks: int = 1024) -> DataFrame:
    """df with `shard` and `slot`, the row's gapless place in its shard.

    Slots are dealt in two levels so that no shard is numbered by one task: rows fall into
    `blocks` hash blocks within each shard, block sizes (shards x blocks numbers, a bound set by
    the parameters alone) give each block's first slot, and rows are numbered inside blocks.
    Rows are ordered by block, then by `order` (the key first). Input columns named shard and slot are
    replaced, all others stay.
    """
    own_block, rows, before_block, nth = (fresh(df, c) for c in ("_block", "_rows", "_first", "_nth"))
    block = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 17, 8), 16, 10).cast("bigint"), F.lit(blocks)).cast("int")
    placed = df.drop("shard", "slot").withColumns({"shard": jump_shard(F.col(key), shards), own_block: block})
    sizes = placed.groupBy("shard", own_block).agg(F.count("*").alias(rows))
    before = Window.partitionBy("shard").orderBy(own_block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", own_block, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(before_block))
    inside = Window.partitionBy("shard", own_block).orderBy(key, *(order or []))
    numbered = placed.withColumn(nth, F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(firsts), ["shard", own_block])
        .withColumn("slot", (F.col(before_block) + F.col(nth) - 1).cast("bigint"))
        .drop(own_block, before_block, nth)
    )


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """One folder per shard, rows of a shard spread over as many files as writing tasks."""
    df.drop("shard").withColumn("shard", jump_shard(F.col(key), shards)).write.partitionBy("shard").parquet(path)
