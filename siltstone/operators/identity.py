"""Content identity: poisoned digests, duplicate plans with a chosen keeper, name families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import hot_split_join
from siltstone.functions.text import copy_number, strip_copy
from siltstone.sources.scratch import kept


def poisoned_hashes(entries: DataFrame) -> DataFrame:
    """Digests seen with more than one size (a null size is a size): they identify nothing."""
    sized = F.struct(F.col("size").isNull(), F.coalesce("size", F.lit(-1)))
    return entries.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(sized).alias("a"), F.max(sized).alias("b")).filter("a <> b").select("hash")


#: A bitmap of positions has no more than 2 ** MOST_BITS bits (32 MB); with more digests than that it would tell nothing.
MOST_BITS = 28


def seen_again(entries: DataFrame, hash: str = "hash") -> DataFrame:
    """entries without those whose digest is seen once: nearly all of them, and no other.

    Only positions, digests hashed to a number of eight bytes, are counted; those counted more than once
    are bits of a bitmap, in buckets that rows meet by broadcast, at eight bits a row. A row whose
    position is another's too stays, so nothing that is repeated is lost. Null digests go. Beyond
    2 ** (MOST_BITS - 3) rows every row with a digest stays.
    """
    rows = entries.filter(F.col(hash).isNotNull())
    bits = max(16, (8 * rows.count()).bit_length())
    if bits > MOST_BITS:
        return rows
    place = F.pmod(F.xxhash64(hash), F.lit(1 << bits))
    often = rows.select(place.alias("_at")).groupBy("_at").agg(F.count("*").alias("_n")).filter("_n > 1")
    maps = often.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    met = rows.withColumn("_at", place).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket")
    spot = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (spot % 8).cast("int")) == 1).select(*entries.columns)


def keeper_key() -> list[Column]:
    """Originals before copies, low copy numbers, shallow, short, then by path and id."""
    n = copy_number(F.col("name"))
    depth = F.length("rel") - F.length(F.replace(F.col("rel"), F.lit("/"), F.lit("")))
    return [n > 0, n, depth, F.length("name"), F.col("rel"), F.col("id")]


def duplicate_plan(entries: DataFrame, per_folder: bool = False) -> DataFrame:
    """(id, rel, dir_rel, hash, size, keeper): every redundant entry with the entry that stays.

    Digests are made once, and only rows whose digest is seen again go on. A digest's keeper is a least struct, combined on the map side, so no task sorts or gathers the
    copies of one digest; digests that hold a large share of all rows meet them by broadcast. Rows
    without a digest take no part; of rows equal in id and path one may stay.
    """
    key = ["dir_rel", "hash"] if per_folder else ["hash"]
    order = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(keeper_key())])
    good = kept(seen_again(kept(entries.select("id", "rel", "dir_rel", "name", "size", "hash"), "entries")), "repeated")
    sized = F.struct(F.col("size").isNull(), F.coalesce("size", F.lit(-1)))
    groups = good.groupBy(*key).agg(F.min(order).alias("_best"), F.count("*").alias("_rows"), F.min(sized).alias("_a"), F.max(sized).alias("_b"))
    if per_folder:
        pure = good.groupBy("hash").agg(F.min(sized).alias("_a"), F.max(sized).alias("_b")).filter("_a = _b").select("hash")
        groups = groups.join(pure, "hash", "left_semi")
    shared = groups.filter("_rows > 1 and _a = _b").withColumn("_key", F.concat_ws("\0", *key)).select("_key", "_best", "_rows")
    keyed = good.withColumns({"_key": F.concat_ws("\0", *key), "_own": order})
    met = hot_split_join(keyed, shared, "_key", "_rows", good.count())
    return met.filter(F.col("_best").isNotNull() & (F.col("_own") != F.col("_best"))).select("id", "rel", "dir_rel", "hash", "size", F.col("_best.o4").alias("keeper"))


def duplicate_summary(entries: DataFrame) -> DataFrame:
    """One row: entries, bytes, unique contents (poisoned digests too), groups, redundant rows and bytes."""
    by_hash = entries.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("low"), F.max("size").alias("high"))
    good = (F.col("n") > 1) & (F.col("low") == F.col("high"))
    return by_hash.agg(
        F.sum("n").alias("entries"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("unique_contents"),
        F.count_if(good).alias("dup_groups"),
        F.coalesce(F.sum(F.when(good, F.col("n") - 1)), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum(F.when(good, (F.col("n") - 1) * F.col("low"))), F.lit(0)).alias("redundant_bytes"),
        F.count_if(F.col("low") != F.col("high")).alias("poisoned"),
    )


def same_name_families(entries: DataFrame) -> DataFrame:
    """(dir_rel, base, files, contents): one name, apart from copy marks, with several contents."""
    return entries.groupBy("dir_rel", strip_copy(F.col("name")).alias("base")).agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents")).filter("contents > 1")


NAME_PARTS = r"(?s)^(.+?)(\.[^.]*)?$"
NUMBERED = r"(?s)^(.+) \[dup(\d{1,9})\](\.[^.]*)?$"


def free_names(moves: DataFrame, taken: DataFrame, mark: str = "dup", lowest: int = 2) -> DataFrame:
    """moves (dup_dir, name, rel) with `stored_as`: the name, or with " [<mark>N]", N from `lowest` on, where it
    is taken. Upper and lower case are one name. Names given or taken are reserved first, so a number
    that such a name already has is passed over; rows are served in order of rel.

    The j-th free number is j + `lowest` - 1 and one more for each reserved number that has fewer than j free
    ones below it: a running count over a group's needs and reserved numbers, without a loop.
    """
    stem, ext = F.regexp_extract("name", NAME_PARTS, 1), F.regexp_extract("name", NAME_PARTS, 2)
    low, numbered = F.lower("name"), NUMBERED.replace("dup", mark)
    fixed = taken.select("dup_dir", F.lower("name").alias("_low")).distinct().withColumn("_taken", F.lit(1))
    served = Window.partitionBy("dup_dir", "_low").orderBy("rel")
    rows = moves.withColumn("_low", low).join(fixed, ["dup_dir", "_low"], "left").withColumn("_j", F.row_number().over(served) - 1 + F.coalesce("_taken", F.lit(0)))
    known = moves.select("dup_dir", low.alias("_n")).unionByName(taken.select("dup_dir", low.alias("_n"))).distinct()
    n = F.regexp_extract("_n", numbered, 2).cast("int")
    held = known.filter(F.col("_n").rlike(numbered)).select("dup_dir", F.concat(F.regexp_extract("_n", numbered, 1), F.regexp_extract("_n", numbered, 3)).alias("_low"), n.alias("_held"), F.col("_n").endswith(F.concat(F.lit(f" [{mark}"), n.cast("string"), F.lit("]"), F.regexp_extract("_n", numbered, 3))).alias("_plain")).filter(f"_plain and _held >= {lowest}").drop("_plain")
    below = F.col("_held") - (lowest - 1) - F.row_number().over(Window.partitionBy("dup_dir", "_low").orderBy("_held"))
    marks = held.select("dup_dir", "_low", below.alias("_at"), F.lit(1).alias("_mark"))
    needs = rows.withColumns({"_at": F.col("_j"), "_mark": F.lit(0)})
    seen = Window.partitionBy("dup_dir", "_low").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    counted = needs.unionByName(marks, allowMissingColumns=True).withColumn("_over", F.sum("_mark").over(seen)).filter("_mark = 0")
    number = F.col("_j") + (lowest - 1) + F.col("_over")
    stored = F.when(F.col("_j") == 0, F.col("name")).otherwise(F.concat(stem, F.lit(f" [{mark}"), number.cast("string"), F.lit("]"), ext))
    return counted.withColumn("stored_as", stored).drop("_low", "_taken", "_j", "_at", "_mark", "_over")


def drain(entries: DataFrame, per_folder: bool = False, max_passes: int = 10) -> tuple[DataFrame, int, bool]:
    """Plan and remove until nothing is redundant: (what stays, passes, converged).

    Each pass writes what stays to the shared checkpoint folder, so the plan does not grow.
    """
    left = entries
    for n in range(1, max_passes + 1):
        plan = duplicate_plan(left, per_folder)
        if plan.isEmpty():
            return left, n, True
        left = kept(left.join(plan.select("id"), "id", "left_anti"), "left")
    return left, max_passes, False
