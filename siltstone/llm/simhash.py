"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact check.

A 64-bit fingerprint is embedded as the bit counts of `segments` equal segments. Flipping one bit
moves one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance. Fingerprints within d bits therefore lie in grid cells (one per embedding) within
Manhattan distance d, and the range join meets them half-way: both sides visit the cells within d / 2
of their own, cells are joined by equality, and candidates are checked bit by bit. Nothing is capped.

Copies share a fingerprint and are joined as one row, so a pair of rows is a pair of different
fingerprints. A fingerprint has a bounded number of neighbours within d bits (2,080 for d = 2),
which bounds every group in the join's result. Components come from alternating large and small
stars over the links between fingerprints; each round is written to the scratch folder.

Defined cases: a null, empty or blank text has no words and fingerprint zero, linked like any other;
equal texts are always linked; repeated rows give repeated results; a null id never names a
component unless all ids in it are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import likeness
from .common import clean_worker, hot_split_join, keep_first, written
from .components import components
from .grid import links, majority

_HASH = xxhash.xxh64_intdigest


def simhash(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: bit i is set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = [_HASH(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a bigint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        for batch in batches:
            fps = np.fromiter((simhash(t, words_per_shingle, seed) for t in batch["t"]), np.uint64, len(batch))
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"id {kind}, fp long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words_per_shingle: int = 3, distance: int = 2, segments: int = 32, seed: int = 42) -> DataFrame:
    """(id, fp, component): component is the least id that links reach."""
    fps = written(fingerprints(docs, text, id_col, words_per_shingle, seed), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "nodes")
    member = components(links(nodes.select("fp"), distance, segments))
    grouped = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = written(grouped.join(named, "root").select("fp", "rows", "component"), "components")
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    return hot_split_join(fps, of_fp, "fp", "rows", total).select(F.col("id").alias(id_col), "fp", "component")


def _fingerprint(text: Column, words_per_shingle: int, seed: int) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([format(simhash(t, words_per_shingle, seed), "016x") for t in texts], dtype=object)

    return run(text.cast("string"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float | None = None, words_per_shingle: int | None = None, distance: int = 2, segments: int = 32, seed: int = 42) -> DataFrame:
    """docs with one row of each component, that with the least id; rows without an id come last.

    Fingerprints within `distance` bits are linked, or, where `least` is given, texts whose shingles
    have a Jaccard of that much: then `likeness` checks what the grid joins, and adds bands for what it cannot
    reach (at 0.8 texts differ in 4 to 14 of 64 bits, and a bound of 14 lets 0.45 % of all pairs
    through at 32 segments, 20 % at 16). Rows with null or repeated ids take part
    like any other; rows equal in id and fingerprint (or text) count as one.
    """
    if least is not None:
        return likeness.deduplicate(docs, text, id_col, least, words_per_shingle or 5)
    key = _fingerprint(F.col(text), words_per_shingle or 3, seed)
    keyed = written(docs.select(key.alias("key"), F.col(id_col).alias("id")), "keyed")
    nodes = keyed.select(F.conv("key", 16, -10).cast("long").alias("fp")).distinct()
    roots = components(links(nodes, distance, segments))
    named = roots.select(*[F.lower(F.lpad(F.hex(c), 16, "0")).alias(c) for c in ("node", "root")])
    return keep_first(docs, key, keyed, named, id_col)
