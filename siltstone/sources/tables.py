"""Engine inputs from the shared tables, and journals, manifests and parallel corpora from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import csv_safe, csv_unsafe

MANIFEST = "stored_as string, original_relpath string, keeper_relpath string, sha256 string, size_bytes bigint, identity_source string, scope string, moved_at string"
JOURNAL = "src string, dst string, size bigint, status string, plan_id string, ts bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_entries(documents: DataFrame) -> DataFrame:
    """(id, rel, dir_rel, name, size, hash): a document is a file in the folder of its source."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", name).alias("rel"), F.col("source").alias("dir_rel"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def named_entries(part: DataFrame) -> DataFrame:
    """Parts as files with copy-marked names: the same stripped name with several contents."""
    base = F.concat(F.lit("part_"), (F.col("p_partkey") % 97).cast("string"))
    mark = F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" ("), (F.col("p_partkey") % 7).cast("string"), F.lit(")"))).when(F.col("p_partkey") % 5 == 2, F.lit(" copy")).otherwise(F.lit(""))
    name = F.concat(base, mark, F.when(F.col("p_partkey") % 3 == 0, F.lit(".tar.gz")).otherwise(F.lit(".pdf")))
    return part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.col("p_brand"), name).alias("rel"), F.col("p_brand").alias("dir_rel"), name.alias("name"), F.col("p_size").cast("long").alias("size"), F.sha2(F.concat("p_type", "p_brand").cast("binary"), 256).alias("hash"))


def page_files(pages: DataFrame) -> DataFrame:
    """(id, path, name, size): a page is a file at host and path; fragment and query go."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), "/+$", "")
    return pages.select(F.col("page_id").alias("id"), bare.alias("path"), F.regexp_extract(bare, "([^/]*)$", 1).alias("name"), F.octet_length("html").cast("long").alias("size"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').schema(MANIFEST).csv(path)
    return rows.withColumns({c: csv_unsafe(F.col(c)) for c in ("stored_as", "original_relpath", "keeper_relpath")})


def write_manifest(rows: DataFrame, path: str) -> None:
    safe = rows.withColumns({c: csv_safe(F.col(c)) for c in ("stored_as", "original_relpath", "keeper_relpath")})
    safe.write.option("header", True).option("escape", '"').mode("append").csv(path)


def parse_journal(lines: DataFrame, line: str = "value") -> DataFrame:
    """Journal lines as rows; a line that is no JSON object has status 'corrupt-line'."""
    parsed = F.from_json(line, JOURNAL + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim(line) != "").withColumn("_row", parsed)
    bad = F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull()
    return rows.select(*[F.when(~bad, F.col(f"_row.{c.split()[0]}")).alias(c.split()[0]) for c in JOURNAL.split(", ") if not c.startswith("status")], F.when(bad, F.lit("corrupt-line")).otherwise(F.col("_row.status")).alias("status"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_journal(spark.read.text(path))


def recorded_scope(manifests: DataFrame) -> DataFrame:
    """One row: the scope if all manifests name the same, else null."""
    return manifests.agg(F.when(F.countDistinct("scope") == 1, F.max("scope")).alias("scope"))


def newest_manifest(found: DataFrame) -> DataFrame:
    """Of the copies (plan_id, in_tree, mtime, path), one in the tree first, then the newest."""
    order = Window.partitionBy("plan_id").orderBy(F.desc("in_tree"), F.desc("mtime"), "path")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def manifests_below(found: DataFrame, rows: DataFrame, root: str) -> DataFrame:
    """found (plan_id, in_tree, mtime, path) without mirrors that are not of this root: a copy outside the
    tree counts only if the first row (by `line`) of it (rows: path, line, src) that has a source lies
    below the root."""
    first = rows.filter("src <> ''").groupBy("path").agg(F.min_by("src", "line").alias("_src"))
    met = found.join(first, "path", "left")
    return met.filter(F.col("in_tree") | F.coalesce(F.col("_src").startswith(root.rstrip("/") + "/"), F.lit(False))).select(*found.columns)


def overlay(*tiers: DataFrame, key: str) -> DataFrame:
    """Rows of the first tier that has their key."""
    both = None
    for n, t in enumerate(tiers):
        t = t.withColumn("_tier", F.lit(n))
        both = t if both is None else both.unionByName(t)
    best = Window.partitionBy(key)
    return both.withColumn("_best", F.min("_tier").over(best)).filter("_tier = _best").drop("_tier", "_best")


def parallel_sentences(left: DataFrame, links: DataFrame, right: DataFrame) -> DataFrame:
    """left (id, text) with the text of its first linked, non-empty right sentence."""
    met = links.join(right.filter(F.col("text") != "").select(F.col("id").alias("id_b"), F.col("text").alias("other")), "id_b")
    first = met.groupBy("id_a").agg(F.min_by("other", F.struct("pos", "id_b")).alias("other"))
    return left.join(first.withColumnRenamed("id_a", "id"), "id")


def hardlink_first(files: DataFrame) -> DataFrame:
    """hl_first = 1 for the first path of each (dev, ino) that has several links, and for plain files and
    those whose inode is not known."""
    several = F.coalesce((F.col("nlink") > 1) & F.col("ino").isNotNull(), F.lit(False))  # only these meet by inode
    nth = F.row_number().over(Window.partitionBy("dev", "ino").orderBy("path"))
    linked = files.filter(several).withColumn("hl_first", F.when(nth == 1, 1).otherwise(0))
    return linked.unionByName(files.filter(~several).withColumn("hl_first", F.lit(1)))


def local_state(flags: Column, blocks: Column, size: Column) -> Column:
    """Placeholder where the dataless flag is set, whatever else is; local where anything is stored, where
    nothing need be, or where the file is compressed into its attributes."""
    has = lambda flag: F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(flag)) != 0
    return F.when(has(0x40000000), "placeholder").when((size > 0) & (blocks == 0) & ~has(0x20), "placeholder").otherwise("local")


def identify(files: DataFrame, now: Column, guard_seconds: int = 120) -> DataFrame:
    """Adds `reason`, why a file has no identity (null: it has one): empty, still changing, not here, unread."""
    reason = F.when(F.col("size") == 0, "empty").when(now - F.col("mtime") < guard_seconds, "recently-modified").when(~F.col("is_local") & F.col("hash").isNull(), "not-local").when(F.col("hash").isNull(), "read-error")
    return files.withColumn("reason", reason)


def memo_hash(files: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose digest is remembered, files still to be read), by path, size and time."""
    key = ["path", "size", "mtime_ns"]
    return files.join(memo, key), files.join(memo, key, "left_anti")
