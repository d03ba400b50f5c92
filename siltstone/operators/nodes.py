"""Trees given as (id, parent, name), and the records of a sync store that know what was never downloaded.

Paths come by doubling: each round a node's known piece of path takes on its upper end's piece, so a
tree of depth d needs about log2(d) joins. Only folders go through the rounds; files meet their
folder's path in one join.

Whether a folder is in another's subtree is a matter of ids (see `intervals`); a wanted path is followed
down from the roots (see `resolve`).

Defined cases: a null or missing parent is a root; an empty name adds nothing to a path; a node on a
cycle, or below one, has no path and is left out; ids are unique; equal paths go to the smallest id;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from siltstone.functions.text import nfc
from siltstone.operators import intervals
from siltstone.operators.tree import ancestors, parent
from siltstone.sources.scratch import kept

# The deepest folder that is walked, the error of a folder that would have to be downloaded,
# and the flag of a folder that only links to another volume.
DEPTH_CAP, WOULD_DOWNLOAD, FIRMLINK = 64, 11, 0x00800000
#: States of folders whose contents are not walked.
CLOSED = ["excluded", "too-deep", "foreign", "dataless", "error"]
RECORD = StructType([StructField("is_file", BooleanType()), StructField("size", LongType()), StructField("hash", StringType()), StructField("mtime", LongType())])


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, path, depth) of folders (id, parent, name) that are in a tree; roots have the path of their
    name. Each round doubles the known piece of a path; rounds go on while the number of open folders
    falls, whatever the depth: what then remains is on a cycle or below one."""
    rows = folders.select("id", F.col("parent").alias("up"), F.coalesce("name", F.lit("")).alias("path"))
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("_there"))
    joined = rows.join(known, "up", "left").select("id", F.when(F.col("_there"), F.col("up")).alias("up"), "path", F.when(F.col("_there"), 1).otherwise(0).alias("depth"))
    state = kept(joined, "paths")
    open_folders = state.filter("up is not null").count()
    while open_folders:
        done, todo = state.filter("up is null"), state.filter("up is not null")
        upper = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        longer = todo.join(upper, "up").select("id", F.col("_up").alias("up"), F.concat_ws("/", F.nullif("_path", F.lit("")), F.nullif("path", F.lit(""))).alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = kept(done.unionByName(longer), "paths")
        left = state.filter("up is not null").count()
        if left == open_folders:
            break
        open_folders = left
    return state.filter("up is null").select("id", "path", "depth")


def members(folders: DataFrame) -> DataFrame:
    """(ancestor, id, depth): every folder (id, parent) of every folder's subtree, itself included, and how
    far down, by the intervals of their ids."""
    return intervals.members(intervals.intervals(folders))


def resolve(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, id): the folder (id, parent, name) at each wanted path; null where there is none.

    Folders with a name that no wanted path has are dropped first. From the roots down, a folder is then
    followed only if its path so far begins a wanted path, so the paths of all folders are never made:
    the work is that of the wanted paths' own prefixes. A folder without a name adds nothing to a path;
    equal paths go to the smallest id; empty and null paths have no folder.
    """
    parts = F.filter(F.split(nfc(F.col("path")), "/"), lambda p: p != "")
    asked = kept(wanted.select("path", parts.alias("_parts")).distinct(), "wanted")
    begun = asked.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_parts"), F.lit(1))), lambda i: F.slice("_parts", 1, i))).alias("_parts")).filter("size(_parts) > 0")
    prefixes = kept(begun.select(F.array_join("_parts", "/").alias("at"), F.element_at("_parts", -1).alias("_name")).distinct(), "prefixes")
    known = folders.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    named = folders.select("id", "parent", nfc(F.coalesce("name", F.lit(""))).alias("_name"))
    some = named.join(prefixes.select("_name").distinct().unionByName(folders.sparkSession.createDataFrame([("",)], "_name string")), "_name", "left_semi")
    some = kept(some.join(known, "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"), "_name"), "candidates")

    def follow(front: DataFrame) -> DataFrame:
        """front (id, _at, _name): what still begins a wanted path, with its own path."""
        own = front.withColumn("at", F.concat_ws("/", F.nullif("_at", F.lit("")), F.nullif("_name", F.lit(""))))
        empty = own.filter("at = ''")
        return kept(empty.unionByName(own.filter("at <> ''").join(prefixes.select("at"), "at", "left_semi").select(*own.columns)).select("id", "at"), "front")

    front = follow(some.filter("parent is null").select("id", F.lit("").alias("_at"), "_name"))
    found = front
    while not front.isEmpty():
        front = follow(some.join(front.select(F.col("id").alias("parent"), F.col("at").alias("_at")), "parent").select("id", "_at", "_name"))
        found = found.unionByName(front)
    at = found.filter("at <> ''").groupBy("at").agg(F.min("id").alias("id"))
    return asked.withColumn("at", F.array_join("_parts", "/")).join(at, "at", "left").select("path", "id")


def _numbers(data: bytes) -> dict[int, list]:
    """Fields of a wire message: number -> values, up to where it is cut off or makes no sense."""
    out: dict[int, list] = {}
    at, end = 0, len(data)

    def varint() -> int | None:
        nonlocal at
        value = shift = 0
        while at < end:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7
        return None

    while at < end:
        tag = varint()
        if tag is None:
            break
        kind = tag & 7
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if kind == 0:
            value = varint()
        elif size is None:
            break
        else:
            value, at = data[at : at + size], at + size
            if kind == 2 and len(value) != size:
                break
        if value is None:
            break
        out.setdefault(tag >> 3, []).append(value)
    return out


def _record(data: bytes | None) -> tuple[bool, int, str | None, int | None]:
    top = _numbers(data or b"")
    file = top.get(4, [None])[0]
    time = top.get(13, top.get(3, [None]))[0]
    mtime = time if isinstance(time, int) and 0 < time < 2**63 else None
    if not isinstance(file, bytes):
        return False, 0, None, mtime
    inner = _numbers(file)
    size = inner.get(2, [0])[0]
    content = inner.get(6, [None])[0]
    digest = _numbers(content).get(1, [None])[0] if isinstance(content, bytes) else None
    return True, size if isinstance(size, int) and size < 2**63 else 0, digest.hex() if isinstance(digest, bytes) and len(digest) == 32 else None, mtime


@F.pandas_udf(RECORD)
def sync_record(data: pd.Series) -> pd.DataFrame:
    """What a sync record says: whether it is a file, its size, its SHA-256, its time. Fields that are
    absent, cut off or of another kind give no value; nothing raises."""
    return pd.DataFrame([_record(d) for d in data], columns=["is_file", "size", "hash", "mtime"]).astype({"mtime": "Int64"})


def sync_entries(rows: DataFrame) -> DataFrame:
    """(id, parent, name, is_file, size, hash, mtime, poisoned) of the store's latest, named rows
    (id, parent, name, metadata, latest). A hash of several sizes is no content's: poisoned."""
    read = rows.filter("latest and name is not null").select("id", "parent", nfc(F.col("name")).alias("name"), sync_record("metadata").alias("r")).select("id", "parent", "name", "r.*")
    bad = read.filter("hash is not null").groupBy("hash").agg(F.min("size").alias("_lo"), F.max("size").alias("_hi")).filter("_lo <> _hi").select("hash", F.lit(True).alias("poisoned"))
    return read.join(bad, "hash", "left").select("id", "parent", "name", "is_file", "size", "hash", "mtime", F.coalesce("poisoned", F.lit(False)).alias("poisoned"))


def child_hashes(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (parent, name) with the hash of the file of that name there, and whether it is poisoned."""
    files = entries.filter("is_file and hash is not null").groupBy("parent", F.col("name").alias("_name")).agg(F.min_by(F.struct("hash", "poisoned"), "id").alias("_at"))
    met = wanted.withColumn("_name", nfc(F.col("name"))).join(files, ["parent", "_name"], "left")
    return met.select(*wanted.columns, F.col("_at.hash").alias("hash"), F.coalesce("_at.poisoned", F.lit(False)).alias("poisoned"))


def walk_states(listing: DataFrame, root_device: int, excluded: list[str], cap: int = DEPTH_CAP) -> DataFrame:
    """(path, state) of the folders that a walk reaches: done, or why their contents are not walked.

    listing (path, device, flags, depth, errno), errno null where a folder could be read. What lies
    below a folder that is not walked is not reached.
    """
    other = (F.col("depth") > 0) & (~F.coalesce(F.col("device") == root_device, F.lit(False)) | (F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(FIRMLINK)) != 0))
    failed = F.when(F.col("errno") == WOULD_DOWNLOAD, "dataless").when(F.col("errno").isNotNull(), "error")
    state = F.when(other, "foreign").when(F.col("path").isin(*excluded), "excluded").when(F.col("depth") >= cap, "too-deep").otherwise(F.coalesce(failed, F.lit("done")))
    rows = listing.select("path", state.alias("state"))
    shut = rows.filter(F.col("state").isin(*CLOSED)).select(F.col("path").alias("_above"))
    below = rows.select("path", F.explode(ancestors(F.col("path"))).alias("_above")).join(shut, "_above", "left_semi").select("path").distinct()
    return rows.join(below, "path", "left_anti")


def resumed(recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """Folders (path) that a walk which was broken off still has to read: listed, but not recorded as
    settled in `recorded` (path, state)."""
    return listing.select("path").distinct().join(recorded.filter("state <> 'pending'").select("path"), "path", "left_anti")


def backfill(states: DataFrame, entries: DataFrame, paths: DataFrame, cap: int = DEPTH_CAP) -> DataFrame:
    """Rows that the store knows below folders that were not read (state dataless): (path, is_file, size,
    mtime, hash, poisoned, state), folders as backfilled, files without poisoned hashes.

    `paths` (id, path) of the store's folders. Each entry meets its folder's path once, then the unread
    folders among its ancestors, so the work follows the entries and their depth.
    """
    placed = entries.alias("e").join(paths.select(F.col("id").alias("parent"), F.col("path").alias("_dir")), "parent").withColumn("path", F.concat_ws("/", F.nullif("_dir", F.lit("")), "name"))
    unread = states.filter("state = 'dataless'").select(F.col("path").alias("_above"))
    spread = placed.select("path", "is_file", "size", "mtime", "hash", "poisoned", F.explode(ancestors(F.col("path"))).alias("_above")).join(unread, "_above")
    near = spread.groupBy("path").agg(F.min_by(F.struct("is_file", "size", "mtime", "hash", "poisoned"), F.length("_above")).alias("e"), F.min(F.length("_above")).alias("_at"))
    deep = F.size(F.split(F.substr("path", F.col("_at") + 2), "/"))
    kept = near.filter(deep <= cap)
    return kept.select("path", "e.is_file", F.when(F.col("e.is_file"), F.col("e.size")).alias("size"), "e.mtime", F.when(~F.col("e.poisoned"), F.col("e.hash")).alias("hash"), "e.poisoned", F.when(~F.col("e.is_file"), "backfilled").alias("state"))


def filled_hashes(files: DataFrame, entries: DataFrame, paths: DataFrame) -> DataFrame:
    """files (path, dataless, hash) with hashes of the store for those that are not here and have none;
    a file that is here keeps what it has, for the store may know an older content."""
    dirs = paths.groupBy("path").agg(F.min("id").alias("parent"))
    asked = files.filter("dataless and hash is null").select("path", parent(F.col("path")).alias("_dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    found = child_hashes(asked.join(dirs.withColumnRenamed("path", "_dir"), "_dir").select("path", "parent", "name"), entries)
    right = found.filter("hash is not null").select("path", F.when(~F.col("poisoned"), F.col("hash")).alias("_hash"), F.col("poisoned").alias("_poisoned"))
    return files.join(right, "path", "left").withColumns({"hash": F.coalesce("hash", "_hash"), "poisoned": F.coalesce("_poisoned", F.lit(False))}).drop("_hash", "_poisoned")
