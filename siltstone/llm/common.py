"""Helpers that the corpus operators share: scratch tables, table readers, skew-safe lookups."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.joins import HOT_SHARE, hot_split_join  # noqa: F401  operators take them from here
from siltstone.sources import scratch

#: What a Python worker keeps from one task to the next: loaded tokenizers and their caches.
WORKER: dict = {}


def clean_worker() -> None:
    """Drop what other operators' tasks kept in this Python worker, which Spark uses for many stages."""
    if WORKER:
        WORKER.clear()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch.root(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


#: Write a table to the shared scratch folder and read it back.
written = scratch.kept


def fresh(df: DataFrame, base: str) -> str:
    """A column name like `base` that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_first(docs: DataFrame, key: Column, keyed: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """docs with one row of each component, that with the least id; rows without an id come last.

    `key` tells which of docs' rows have one content, keyed (key, id) holds the same keys, and roots
    (node, root) their components; a key without a root stands alone.
    """
    ids = keyed.groupBy("key", "id").agg(F.count("*").alias("rows"))
    best = ids.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("key").alias("of"), "rows")).alias("best"))
    named = best.join(roots.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    own, of, id_of, rows = (fresh(docs, c) for c in ("_own", "_of", "_id", "_rows"))
    kept = written(named.select(F.col("best.of").alias(of), F.col("best.id").alias(id_of), F.col("best.rows").alias(rows)), "kept")
    met = docs.withColumn(own, key).join(kept, (F.col(own) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(id_of)))
    single = met.filter(F.col(rows) == 1).select(*docs.columns)
    return single.unionByName(met.filter(F.col(rows) > 1).dropDuplicates([of]).select(*docs.columns))
