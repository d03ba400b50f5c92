"""Digests remembered between runs in a bucketed table: what is known is not read again.

A row a path, in buckets of the path: files meet it by path without an exchange on its side, and size and
time decide whether what is remembered still holds. Only files without such a row are read. A renewal
rewrites the slices (of the path's hash) in which something is new, by dynamic partition overwrite.

Defined cases: files are unique by path; a null path is read each time and never remembered; a file that
changed takes the place of what it was; an empty table of files changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import kept

SLICES, BUCKETS = 16, 8
COLUMNS = "path string, size bigint, mtime_ns bigint, hash string"


def create(spark: SparkSession, name: str, location: str) -> None:
    """An empty memo table at a location, if there is none of that name."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}, slice int) USING parquet PARTITIONED BY (slice) CLUSTERED BY (path) SORTED BY (path) INTO {BUCKETS} BUCKETS LOCATION '{location}'")


def recall(files: DataFrame, name: str) -> DataFrame:
    """files (path, size, mtime_ns, ..) with `hash` as remembered, null where it has to be read."""
    memo = files.sparkSession.table(name).select("path", F.struct("size", "mtime_ns", "hash").alias("_memo"))
    met = files.join(memo, "path", "left")
    same = F.col("_memo.size").eqNullSafe(F.col("size")) & F.col("_memo.mtime_ns").eqNullSafe(F.col("mtime_ns"))
    return met.withColumn("hash", F.when(same, F.col("_memo.hash"))).drop("_memo")


def digests(files: DataFrame, name: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """files with `hash`, and `fresh`, whether it was read now. `read` turns files without a hash into
    (path, hash); what it finds is remembered."""
    spark = files.sparkSession
    known = kept(recall(files, name), "recalled")
    new = kept(known.filter("hash is null").drop("hash").join(read(known.filter("hash is null").drop("hash")), "path").withColumn("fresh", F.lit(True)), "read")
    rows = new.filter("path is not null and hash is not null").select("path", "size", "mtime_ns", "hash", F.pmod(F.xxhash64("path"), F.lit(SLICES)).cast("int").alias("slice"))
    slices = [r.slice for r in rows.select("slice").distinct().collect()]  # SLICES at most
    if slices:
        old = spark.table(name).filter(F.col("slice").isin(slices)).join(rows.select("path"), "path", "left_anti")
        whole = kept(old.unionByName(rows), "memo")
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            whole.select("path", "size", "mtime_ns", "hash", "slice").write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    unread = known.filter("hash is null").join(new.select("path"), "path", "left_anti").withColumn("fresh", F.lit(False))
    return known.filter("hash is not null").withColumn("fresh", F.lit(False)).unionByName(new.select(*known.columns, "fresh")).unionByName(unread)
