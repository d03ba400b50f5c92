"""Fingerprints of 64 bits and the grid range-join that finds those within a few bits of each other.

The bits are a majority over shingle hashes. A fingerprint's cell are the bit counts of equal segments; `simhash`
tells why cells within half the distance on both sides meet. op9 and the pipeline's near-duplicate stage share it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bit i is set where over half of them have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def embedding(fp: Column, segments: int) -> Column:
    """The segments' bit counts, packed into a bigint: one field of 64 / segments bits each."""
    if segments == 64:
        return fp
    low = F.lit(0x5555555555555555).cast("long")
    x, y = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    bits, out = 2, x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))  # x + y without a carry into the sign
    for mask in (0x3333333333333333, 0x0F0F0F0F0F0F0F0F):
        if 64 // bits == segments:
            return out
        m = F.lit(mask).cast("long")
        out, bits = out.bitwiseAND(m) + F.shiftrightunsigned(out, bits).bitwiseAND(m), 2 * bits
    if 64 // bits != segments:
        raise ValueError("segments must be 64, 32, 16 or 8")
    return out


def ball(cell: str, segments: int, radius: int) -> str:
    """SQL for the cells within Manhattan distance `radius` of a cell: one count up or down a step."""
    if not radius:
        return f"array({cell})"
    bits = 64 // segments
    v = f"(shiftrightunsigned(c, {bits} * i) & {(1 << bits) - 1})"
    step = f"array(if({v} < {bits}, c ^ shiftleft({v} ^ ({v} + 1), {bits} * i), null), if({v} > 0, c ^ shiftleft({v} ^ ({v} - 1), {bits} * i), null))"
    near = f"concat(array(c), filter(flatten(transform(sequence(0, {segments - 1}), i -> {step})), x -> x is not null))"
    around = f"flatten(transform({ball(cell, segments, radius - 1)}, c -> {near}))"
    return around if radius == 1 else f"array_distinct({around})"


def links(nodes: DataFrame, distance: int = 2, segments: int = 32) -> DataFrame:
    """(a, b) for every pair of different fingerprints in `nodes` (fp, unique) within `distance`.

    Two cells within Manhattan distance d have a cell between them that is within d / 2 of both, so
    each side goes to the cells of a ball of half the radius and the join is on equal cells. With 32
    segments a chance pair shares a cell about once in 10^11 pairs.
    """
    at = nodes.select("fp", embedding(F.col("fp"), segments).alias("cell"))
    left = at.select(F.col("fp").alias("a"), F.explode(F.expr(ball("cell", segments, (distance + 1) // 2))).alias("cell"))
    right = at.select(F.col("fp").alias("b"), F.explode(F.expr(ball("cell", segments, distance // 2))).alias("cell"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    if distance % 2:
        near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Spark sizes an exploded side as its child, 65 times too low for a ball of one, and would broadcast it.
    met = left.alias("l").hint("merge").join(right.alias("r"), (F.col("l.cell") == F.col("r.cell")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
