"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut once more after sentence marks; each is a 64-bit digest, a
repeated one counted with its number so that a sketch holds a set. A sketch has three tables of
cells; a digest goes into one cell of each, adding 1 to its count, itself to its sum and a checksum
to its check (all modulo 2^64). Two sketches of one size subtract cell by cell; what both texts
hold is gone, and the rest is recovered by peeling: a cell with count +1 or -1 whose check fits its
sum holds exactly one digest, which is then taken out of its other cells. Where cells are left over,
the pair is tried again with sketches `growth` times as large, until peeling ends with empty cells.

Likeness of two sketches is 1 - d / (|A| + |B|), d being the digests recovered: 1 for equal texts,
0 for texts with no paragraph in common.

Defined cases: a null text is the empty text, whose sketch is empty; two empty texts are alike (1);
null ids come first in the order of ids and rows with one id are ordered by text; a table of one
row is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 24
GROWTH = 4
#: The cut: line ends, and white space after a sentence mark.
PARAGRAPH_END = re.compile(r"\n+|(?<=[.!?])\s+")
_TABLES = 3
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_DIGEST = xxhash.xxh64_intdigest


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def digests(text: str) -> np.ndarray:
    """The set of the text's paragraph digests."""
    parts = [p for p in PARAGRAPH_END.split(text) if p]
    found = np.fromiter((_DIGEST(p.encode("utf-8", "surrogatepass")) for p in parts), np.uint64, len(parts))
    if len(found) > 1:
        order = np.argsort(found, kind="stable")
        ranked = found[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        if not first.all():
            at = np.arange(len(ranked))
            nth = at - np.maximum.accumulate(np.where(first, at, 0))
            found = np.where(nth > 0, _mixed(ranked + nth.astype(np.uint64), 77), ranked)
    return found


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """(tables, keys): the cell of each key in each table; sizes hash apart."""
    each = cells // _TABLES
    return np.stack([_mixed(keys, cells * 8 + t) % np.uint64(each) + np.uint64(t * each) for t in range(_TABLES)]).astype(np.int64)


class Sketches:
    """Many sketches of one size, as rows: count, sum and check of each cell."""

    def __init__(self, sets: list[np.ndarray], cells: int):
        self.cells, self.rows = cells, len(sets)
        total = len(sets) * cells
        self.count = np.zeros(total, np.int64)
        self.sum, self.check = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.put(np.repeat(np.arange(len(sets)), sizes), keys, np.ones(len(keys), np.int64))

    def put(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        """Add sign x key to the key's cell in each table."""
        check = _mixed(keys, 3)
        times = sign.astype(np.uint64)  # -1 is 2^64 - 1
        for place in _places(keys, self.cells):
            at = row * self.cells + place
            self.count += np.bincount(at, sign, len(self.count)).astype(np.int64)
            np.add.at(self.sum, at, keys * times)
            np.add.at(self.check, at, check * times)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches([], self.cells)
        out.rows, out.count = self.rows, self.count - other.count
        out.sum, out.check = self.sum - other.sum, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, digests, signs, ended): what is recovered of each row, and whether nothing is left."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            keys = self.sum[at] * sign.astype(np.uint64)
            pure = self.check[at] * sign.astype(np.uint64) == _mixed(keys, 3)
            at, sign, keys = at[pure], sign[pure], keys[pure]
            if not len(at):
                break
            row = at // self.cells
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], sign[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])]
            row, keys, sign = row[new], keys[new], sign[new]
            found.append((row, keys, sign))
            self.put(row, keys, -sign)
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        ended = ~left.reshape(-1, self.cells).any(axis=1) if self.rows else np.zeros(0, bool)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), ended
        return *(np.concatenate(x) for x in zip(*found, strict=True)), ended

    def text(self, row: int) -> str:
        own = slice(row * self.cells, (row + 1) * self.cells)
        return base64.b64encode(self.count[own].astype("<i4").tobytes() + self.sum[own].astype("<u8").tobytes() + self.check[own].astype("<u4").tobytes()).decode()


def differing(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS, growth: int = GROWTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(only in left, only in right) of each pair, by subtraction and peeling, larger on failure.

    Sketch memory of a round follows the digests of the pairs that are still open: a pair is tried
    with at most a few times as many cells as it has digests before it must come out.
    """
    none = np.zeros(0, np.uint64)
    out: list = [(none, none)] * len(left)
    open_pairs = list(range(len(left)))
    while open_pairs:
        a, b = Sketches([left[i] for i in open_pairs], cells), Sketches([right[i] for i in open_pairs], cells)
        rows, keys, signs, ended = a.minus(b).peel()
        order = np.argsort(rows, kind="stable")
        rows, keys, signs = rows[order], keys[order], signs[order]
        ends = np.searchsorted(rows, np.arange(len(open_pairs) + 1))
        for at, i in enumerate(open_pairs):
            if ended[at]:
                own = slice(ends[at], ends[at + 1])
                out[i] = keys[own][signs[own] > 0], keys[own][signs[own] < 0]
        open_pairs = [i for at, i in enumerate(open_pairs) if not ended[at]]
        cells *= growth
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS, growth: int = GROWTH) -> np.ndarray:
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.float64)
    differ = np.array([len(a) + len(b) for a, b in differing(left, right, cells, growth)], np.float64)
    return np.where(both > 0, 1 - differ / np.maximum(both, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order_blocks(docs: DataFrame, text: str, id_col: str, blocks: int) -> DataFrame:
    """(block, id, text, borrowed): blocks of rising ids; each block also holds, as borrowed, the
    first document of the next block (the last: of the first), so that each row's successor is in
    its own block. One shuffle moves the texts. `blocks` quantiles of the ids bound what is
    broadcast: one id per block."""
    spark = docs.sparkSession
    low = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("order"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("order", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks)).first()[0] or []
    shared = spark.sparkContext.broadcast(np.array(sorted(set(cuts)) if blocks > 1 else [], np.int64))

    @F.pandas_udf("int")
    def block_of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, order.to_numpy(np.int64), side="left"))

    placed = rows.withColumn("block", block_of("order"))
    heads = sorted((r["block"], r["first"]) for r in placed.groupBy("block").agg(F.min("order").alias("first")).collect())  # one row per block
    lending = spark.createDataFrame([(first, heads[at - 1][0]) for at, (_, first) in enumerate(heads)], "order long, lend int")
    both = placed.join(F.broadcast(lending), "order", "left")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("lend").alias("block"), F.lit(True).alias("borrowed"))
    spread = both.withColumn("_at", F.explode(F.filter(F.array(own, lent), lambda s: s["block"].isNotNull())))
    return spread.select(F.col("_at.block").alias("block"), "order", "id", "text", F.col("_at.borrowed").alias("borrowed"))


def fingerprint_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", cells: int = CELLS, growth: int = GROWTH, chunk_digests: int = 60_000) -> DataFrame:
    """Each text's sketch, its edited version's sketch, and the likenesses to that and to the next
    document in order of ids. A task holds one chunk of documents at a time."""
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = in_order_blocks(docs, text, id_col, blocks)
    dealt = spread.repartition("block").sortWithinPartitions("block", "borrowed", "order", "text")

    def finish(chunk: list[tuple]) -> pd.DataFrame:
        """chunk: (id, text, next text)."""
        own = [digests(t) for _, t, _ in chunk]
        after = [digests(n) if i + 1 == len(chunk) or n is not chunk[i + 1][1] else own[i + 1] for i, (_, _, n) in enumerate(chunk)]
        versions = [edited(t, n) for _, t, n in chunk]
        changed = [digests(v) for v in versions]
        a, b = Sketches(own, cells), Sketches(changed, cells)
        return pd.DataFrame(
            {
                "id": pd.array([i for i, _, _ in chunk], dtype="Int64"),
                "n_chars": [len(t) for _, t, _ in chunk],
                "edited_sha256": [hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest() for v in versions],
                "fingerprint": [a.text(i) for i in range(len(chunk))],
                "edited_fingerprint": [b.text(i) for i in range(len(chunk))],
                "near_edited": likeness(own, changed, cells, growth),
                "near_next": likeness(own, after, cells, growth),
                "n_paragraphs": [len(o) for o in own],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, waiting, chunk, size, lent = None, None, [], 0, False
        for batch in batches:
            for block, doc_id, t, borrowed in zip(batch["block"], batch["id"], batch["text"], batch["borrowed"], strict=True):
                if block != at:
                    at, waiting, lent = block, None, False
                if borrowed and lent:
                    continue  # only the first of the borrowed rows is the successor
                lent = borrowed
                if waiting is not None:
                    chunk.append((*waiting, t))
                    size += 1 + len(waiting[1]) // 40
                waiting = None if borrowed else (None if pd.isna(doc_id) else int(doc_id), t)
                if size >= chunk_digests:
                    yield finish(chunk)
                    chunk, size = [], 0
        if chunk:
            yield finish(chunk)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"
    return dealt.mapInPandas(run, schema).withColumnRenamed("id", id_col)
