"""Hierarchy operators over paths, by exploding each path's ancestors: no recursion, no driver loop.

Every roll-up is one explode and one map-side-combined aggregation; a path adds as many rows as it
is deep, and rows of one folder are combined before they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import kept


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, shallowest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def folders(files: DataFrame) -> DataFrame:
    """Every folder that holds a file at any depth."""
    return files.select(parent(F.col("path")).alias("dir")).filter("dir is not null").distinct().select(F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("dir")).distinct()


def rollup(files: DataFrame, *extra: str) -> DataFrame:
    """(dir, extra.., files, bytes) of whole subtrees by path; see report.folder_rollup for all sums of a report by id."""
    direct = files.groupBy(parent(F.col("path")).alias("_own"), *extra).agg(F.count("*").alias("_n"), F.sum("size").alias("_b")).filter("_own is not null")
    up = direct.select(*extra, "_n", "_b", F.explode(F.concat(ancestors(F.col("_own")), F.array("_own"))).alias("dir"))
    return up.groupBy("dir", *extra).agg(F.sum("_n").alias("files"), F.sum("_b").alias("bytes"))


def subtree_values(files: DataFrame, *aggregates: Column) -> DataFrame:
    """Any aggregates over whole subtrees: max of times, exists of flags, weighted means."""
    return files.withColumn("dir", F.explode(ancestors(F.col("path")))).groupBy("dir").agg(*aggregates)


def zones(dirs: DataFrame, kind: Column) -> DataFrame:
    """(dir, kind, zone_root, zone): the shallowest ancestor-or-self with a kind is inherited.

    `kind` is a folder's own kind. Own kinds are joined to the exploded ancestors, so a folder
    meets its few ancestors and no more.
    """
    own = dirs.select("dir", kind.alias("kind"))
    marked = own.filter("kind is not null").select(F.col("dir").alias("_anc"), F.col("kind").alias("_kind"))
    up = own.select("dir", F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("_anc")).join(marked, "_anc")
    top = up.groupBy("dir").agg(F.min_by(F.struct("_anc", "_kind"), F.length("_anc")).alias("_top"))
    return own.join(top, "dir", "left").select("dir", "kind", F.col("_top._anc").alias("zone_root"), F.col("_top._kind").alias("zone"))


def empty_folders(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Folders without a file in the whole subtree, out of `dirs` (dir)."""
    full = folders(files)
    return dirs.join(full, "dir", "left_anti")


def longest_existing(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, found): the deepest ancestor-or-self of each path that is a known folder."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("dir"))
    hit = up.join(dirs.select("dir").distinct(), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("found"))
    return paths.select("path").distinct().join(hit, "path", "left")


def top_children(files: DataFrame, keep: int) -> DataFrame:
    """The largest files of each folder, and the rest of it as one rolled-up row (null name)."""
    rows = files.withColumn("dir", parent(F.col("path"))).filter("dir is not null")
    nth = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("size"), "path"))
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= keep)
    total = rows.groupBy("dir").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    kept = first.groupBy("dir").agg(F.count("*").alias("kn"), F.sum("size").alias("kb"))
    rest = total.join(kept, "dir").filter("n > kn").select("dir", F.lit(None).cast("string").alias("path"), (F.col("b") - F.col("kb")).alias("size"), (F.col("n") - F.col("kn")).alias("files"))
    return first.select("dir", "path", "size", F.lit(1).cast("long").alias("files")).unionByName(rest)


# Limits of the pruned tree map.
MAP_LEAST, MAP_MOST, MAP_FILES, MAP_DEPTH, MAP_SHARE, MAP_FLOOR = 8, 50, 50, 12, 0.005, 4096


def treemap(files: DataFrame, root: str, budget: int) -> DataFrame:
    """(dir, depth, kind, path, size, files, categories): what a tree map of `root` shows, a row a box.

    files (path, size, category). Of each shown folder its largest entries stay (at most 50, fewer as
    the budget of its level shrinks, always those of half a percent of the folder or more), if they
    reach the floor and are less than 12 deep; kinds are `dir` and `file`. All else of a folder is one
    `rest` row, with the bytes of each category, so that rows of a folder add up to it exactly. Ties go
    to folders first, then to the smaller path.

    The budget of a folder follows from its parent's, so levels are settled one after another, at most
    12 times. The floor is a millionth of all bytes, and folders of one level share no file: a level
    holds at most 10^6 folders, however many files there are. A folder's files are ranked by partial
    top lists, not sorted whole. Null sizes count as 0; a root that holds no file gives no rows.
    """
    inside = files.filter(F.col("path").startswith(root + "/")).select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "category")
    by_category = kept(rollup(inside, "category").select("dir", "category", "files", "bytes"), "map-categories")
    whole = by_category.groupBy("dir").agg(F.sum("files").alias("files"), F.sum("bytes").alias("size"))
    total = whole.filter(F.col("dir") == root).first()
    empty = files.sparkSession.createDataFrame([], "dir string, depth int, kind string, path string, size long, files long, categories map<string,bigint>")
    if total is None:
        return empty
    floor = max(MAP_FLOOR, total["size"] // 1_000_000)
    order = [F.desc("size"), "kind", "path"]
    own = inside.withColumn("dir", parent(F.col("path"))).withColumn("kind", F.lit("file"))
    largest = own.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy(*order))).filter(F.col("_n") <= MAP_FILES).select("dir", "kind", "path", "size", F.lit(1).cast("long").alias("files"), "category")
    folders_ = whole.filter(F.col("dir") != root).select(parent(F.col("dir")).alias("dir"), F.lit("dir").alias("kind"), F.col("dir").alias("path"), "size", "files", F.lit(None).cast("string").alias("category"))
    entries = folders_.unionByName(largest)
    # An entry of half a percent is among the first 200, so no more need to be ranked.
    first = kept(entries.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy(*order))).filter(F.col("_n") <= int(1 / MAP_SHARE) + MAP_MOST), "map-first")
    counts = entries.groupBy("dir").agg(F.count("*").alias("_entries"))
    frontier = files.sparkSession.createDataFrame([(root, budget)], "dir string, budget long")
    shown = empty.drop("categories").withColumn("category", F.lit(None).cast("string"))
    for depth in range(MAP_DEPTH + 1):
        level = frontier.join(whole.withColumnsRenamed({"size": "_total", "files": "_files"}), "dir").join(counts, "dir", "left")
        keep = F.least(F.coalesce("_entries", F.lit(0)), F.greatest(F.lit(MAP_LEAST), F.floor(F.col("budget") / 4)), F.lit(MAP_MOST))
        met = level.withColumn("_keep", keep).join(first, "dir")
        kept_bytes = F.greatest(F.sum(F.when(F.col("_n") <= F.col("_keep"), F.col("size"))).over(Window.partitionBy("dir")), F.lit(1))
        large = (F.col("_n") <= F.col("_keep")) | (F.col("size") >= MAP_SHARE * F.greatest(F.col("_total"), F.lit(1)))
        pool = F.greatest(F.col("budget") - F.col("_keep"), F.lit(0))
        chosen = kept(met.withColumn("_kept", kept_bytes).filter(large & (F.col("size") >= floor) & F.lit(depth < MAP_DEPTH)).withColumn("_budget", F.floor(pool * (F.col("size") / F.col("_kept"))).cast("long")), "map-level")
        shown = shown.unionByName(frontier.select("dir", F.lit(depth).alias("depth"), F.lit("folder").alias("kind"), F.col("dir").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("files"), F.lit(None).cast("string").alias("category")))
        shown = shown.unionByName(chosen.select("dir", F.lit(depth).alias("depth"), "kind", "path", "size", "files", "category"))
        frontier = chosen.filter("kind = 'dir'").select(F.col("path").alias("dir"), F.col("_budget").alias("budget"))
        if frontier.isEmpty():
            break
    shown = kept(shown, "map-shown")
    boxes = shown.filter("kind <> 'folder'")
    # What a folder's boxes hold of each category: a shown file its own, a shown folder its whole subtree.
    held = boxes.filter("kind = 'file'").select("dir", "category", "size", "files").unionByName(boxes.filter("kind = 'dir'").select("dir", "path").join(by_category.select(F.col("dir").alias("path"), "category", F.col("bytes").alias("size"), "files"), "path").select("dir", "category", "size", "files"))
    level_of = shown.filter("kind = 'folder'").select("dir", "depth")
    all_ = level_of.join(by_category, "dir").select("dir", "depth", "category", F.col("bytes").alias("size"), "files")
    left = all_.unionByName(held.join(level_of, "dir").select("dir", "depth", "category", (-F.col("size")).alias("size"), (-F.col("files")).alias("files")))
    rest = left.groupBy("dir", "depth", "category").agg(F.sum("size").alias("size"), F.sum("files").alias("files")).groupBy("dir", "depth").agg(F.sum("size").alias("size"), F.sum("files").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("size") > 0, F.struct(F.coalesce("category", F.lit("other")), "size"))))).alias("categories")).filter("files > 0")
    none = F.lit(None).cast("map<string,bigint>")
    return boxes.select("dir", "depth", "kind", "path", "size", "files", none.alias("categories")).unionByName(rest.select("dir", "depth", F.lit("rest").alias("kind"), F.lit(None).cast("string").alias("path"), "size", "files", "categories"))
