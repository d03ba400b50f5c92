"""A walk over a tree of entries that stops at folders which are not to be looked into.

The walk is a recursive common table expression over folders alone: its frontier goes down one level a
step, and a folder that is closed is reported but not entered, so what lies below it is never read.
Files meet the folders that were reached in one join.

Defined cases: a null name is empty; a folder that lies on a cycle is never reached; entries whose folder
is unknown or was not reached give no row; ids are unique; an empty table, or one without the root, gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import kept

# The folder of what was set aside, and endings of folders that are one thing to their user.
QUARANTINE = "Duplicates"
BUNDLES = [".photoslibrary", ".musiclibrary", ".tvlibrary", ".aplibrary", ".pkpass", ".app", ".bundle", ".framework", ".plugin", ".rtfd", ".fcpbundle", ".imovielibrary", ".logicx", ".band"]
#: The deepest folder that is entered.
DEPTH_CAP = 64


def closed(name: Column, is_link: Column) -> Column:
    """Why a folder is not entered, null where it is."""
    low = F.lower(name)
    bundle = F.lit(False)
    for ending in BUNDLES:
        bundle = bundle | low.endswith(ending)
    return F.when(name.startswith("."), "hidden").when(low == QUARANTINE.lower(), "quarantine").when(bundle, "bundle").when(F.coalesce(is_link, F.lit(False)), "link")


def reached(folders: DataFrame, root, cap: int = DEPTH_CAP) -> DataFrame:
    """(id, rel, depth) of the folders (id, parent, name, why) that are entered from the folder `root`, whose
    own `why` does not matter."""
    spark = folders.sparkSession
    open_folders = kept(folders.filter(F.col("why").isNull() & F.col("parent").isNotNull() & (F.col("id") != root)).select("id", "parent", "name"), "open-folders")
    tops = folders.filter(F.col("id") == root).select("id").limit(1)
    names = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = [spark.conf.get(n, None) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "-1")  # the depth is bounded by the cap, the rows by the folders
        found = spark.sql(
            f"""WITH RECURSIVE reach(id, rel, depth) AS (
  SELECT id, '' AS rel, 0 AS depth FROM {{tops}}
  UNION ALL
  SELECT f.id, CASE WHEN r.rel = '' THEN f.name ELSE concat(r.rel, '/', f.name) END, r.depth + 1 FROM reach r JOIN {{open}} f ON f.parent = r.id WHERE r.depth < {cap}
) SELECT id, rel, depth FROM reach""",
            tops=tops,
            open=open_folders,
        )
        return kept(found, "reached")
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def walk(entries: DataFrame, root, cap: int = DEPTH_CAP) -> DataFrame:
    """(id, rel, dir_rel, is_dir, reason) of what a walk from the folder `root` meets.

    entries (id, parent, name, is_dir, is_link, reason): `reason` says why a file has no identity, null
    where it has one. Rows of files without a reason are the entries; folders come out only where they are
    not entered (hidden, quarantine, bundle, link, too-deep). Hidden files are passed over without a word.
    """
    rows = entries.withColumn("name", F.coalesce("name", F.lit("")))
    shut = closed(F.col("name"), F.col("is_link"))
    met = reached(rows.filter("is_dir").select("id", "parent", "name", shut.alias("why")), root, cap)
    up = met.select(F.col("id").alias("parent"), F.col("rel").alias("dir_rel"), F.col("depth").alias("_depth"))
    inside = rows.filter((F.col("id") != root) & (F.col("is_dir") | ~F.col("name").startswith("."))).join(up, "parent")
    why = F.when(F.col("is_dir"), F.coalesce(shut, F.when(F.col("_depth") >= cap, "too-deep"))).when(F.col("is_link"), "symlink").otherwise(F.col("reason"))
    rel = F.when(F.col("dir_rel") == "", F.col("name")).otherwise(F.concat_ws("/", "dir_rel", "name"))
    return inside.select("id", rel.alias("rel"), "dir_rel", "is_dir", why.alias("reason")).filter("not is_dir or reason is not null")


def skips(met: DataFrame) -> DataFrame:
    """(reason, entries): how often the walk passed something over, and why."""
    return met.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("entries"))
