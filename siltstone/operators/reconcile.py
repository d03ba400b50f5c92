"""Quarantine reconciliation: classes, residual duplicates, heal plans, twins, undo accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import hot_split_join
from siltstone.functions.text import csv_unsafe, nfc
from siltstone.sources.scratch import kept

from .identity import free_names, poisoned_hashes


def quarantine_classes(quarantined: DataFrame, outside: DataFrame) -> DataFrame:
    """quarantined with `klass`: unreadable, poisoned, ok, inconclusive or orphan, in that order.

    The poison set spans both sides. A row is ok if its content is outside; one without is
    inconclusive if a poisoned outside row has its size, since that row's content is unknown.
    """
    inside = kept(quarantined, "quarantined")
    poison = poisoned_hashes(outside.select("hash", "size").unionByName(inside.select("hash", "size")))
    there = outside.filter("hash is not null").select("hash").distinct().withColumn("_there", F.lit(True))
    unsure = outside.join(poison, "hash", "left_semi").filter("size is not null").select("size").distinct().withColumn("_unsure", F.lit(True))
    total = inside.count()
    # A row a digest, and a row a size, with the number of rows that will meet it: hot ones meet them by broadcast.
    of_hash = inside.filter("hash is not null").groupBy("hash").agg(F.count("*").alias("_rows")).join(poison.withColumn("_poison", F.lit(True)), "hash", "left").join(there, "hash", "left")
    of_size = inside.filter("size is not null").groupBy("size").agg(F.count("*").alias("_rows")).join(unsure, "size")
    met = hot_split_join(hot_split_join(inside.filter("hash is not null"), of_hash, "hash", "_rows", total), of_size, "size", "_rows", total)
    klass = F.when(F.col("_poison"), "poisoned").when(F.col("_there"), "ok").when(F.col("_unsure"), "inconclusive").otherwise("orphan")
    unread = inside.filter("hash is null").withColumn("klass", F.lit("unreadable"))
    return met.withColumn("klass", klass).select(*quarantined.columns, "klass").unionByName(unread)


def residual_groups(outside: DataFrame, per_folder: bool = False) -> DataFrame:
    """Groups still redundant outside; poisoned digests are counted apart."""
    key = ["dir_rel", "hash"] if per_folder else ["hash"]
    groups = outside.filter(F.col("hash").isNotNull()).groupBy(*key).agg(F.count("*").alias("files"), F.min("size").alias("low"), F.max("size").alias("high")).filter("files > 1")
    return groups.select(*key, "files", (F.col("low") != F.col("high")).alias("poisoned"))


def heal_plan(classified: DataFrame) -> DataFrame:
    """One orphan of each content and folder goes back: fewest " [dupN]" tags, then short, then first."""
    tags = (F.length("name") - F.length(F.regexp_replace("name", r"\[dup\d+\]", ""))).asc()
    nth = F.row_number().over(Window.partitionBy("dir_rel", "hash").orderBy(tags, F.length("name").asc(), F.col("name").asc(), F.col("id").asc()))
    rows = classified.filter("klass = 'orphan'").withColumn("_n", nth)
    return rows.withColumns({"restore": F.col("_n") == 1, "restore_name": F.regexp_replace("name", r" \[dup\d+\](?=(\.[^.]*)?$)", "")}).drop("_n")


def restored_names(healed: DataFrame, there: DataFrame) -> DataFrame:
    """Rows of heal_plan that go back, with `final`: the clean name, or with " [recoveredN]", N from 2
    on, where the folder has it (`there`: dir_rel, name) or another row takes it."""
    back = healed.filter("restore").withColumns({"dup_dir": F.col("dir_rel"), "_was": F.col("name"), "name": F.col("restore_name")})
    given = free_names(back, there.select(F.col("dir_rel").alias("dup_dir"), "name"), "recovered", 2)
    return given.withColumns({"final": F.col("stored_as"), "name": F.col("_was")}).drop("dup_dir", "_was", "stored_as")


def twins(quarantined: DataFrame, outside: DataFrame, most: int = 5, salts: int = 64) -> DataFrame:
    """Each quarantined row with the number of outside twins and the first `most` of their paths.

    Twins are reduced to a count and `most` paths, first within `salts` parts of a digest's rows and
    then per digest, before the join: a digest with many copies is never sorted or collected whole.
    """
    part = F.pmod(F.xxhash64("rel"), F.lit(salts))
    inner = F.row_number().over(Window.partitionBy("hash", "_part").orderBy("rel"))
    few = outside.filter("hash is not null").select("hash", "rel", part.alias("_part")).withColumn("_n", inner).filter(F.col("_n") <= most)
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("rel"))
    first = few.drop("_n").withColumn("_n", nth).filter(F.col("_n") <= most).groupBy("hash").agg(F.array_sort(F.collect_list("rel")).alias("copies"))
    count = outside.filter("hash is not null").groupBy("hash").agg(F.count("*").alias("total"))
    asked = kept(quarantined, "asked")
    of_hash = first.join(count, "hash").join(asked.groupBy("hash").agg(F.count("*").alias("_rows")), "hash")
    met = hot_split_join(asked.filter("hash is not null"), of_hash, "hash", "_rows", asked.count()).unionByName(asked.filter("hash is null"), allowMissingColumns=True)
    return met.select("id", "rel", "hash", F.coalesce("total", F.lit(0)).alias("total"), F.concat_ws("|", "copies").alias("copies"))


def contained(path: Column, root: Column) -> Column:
    """Lexically inside root; a step up anywhere is outside."""
    return path.startswith(F.concat(root, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


# Verdicts of set-aside files from worst to best.
VERDICTS = ["orphan", "poisoned", "unreadable", "inconclusive", "syncing", "ok"]


def where(quarantined: DataFrame, outside: DataFrame, manifest: DataFrame, existing: DataFrame, names: DataFrame | None = None, per_folder: bool = False, most: int = 5) -> DataFrame:
    """(severity, file, verdict, size, total, copies, keeper, keeper_status): where the content of set-aside
    files lives outside, and whether what the manifest names as kept is there.

    quarantined (id, dup_dir, name, rel, size, hash, klass), manifest (dup_dir, stored_as, keeper), existing
    (rel) all paths below the root, names (name) the files asked for; without it all are. A keeper lies
    below the root, or with `per_folder` below its quarantine's folder: unsafe-path if it is absolute or
    leads up, else present or missing, null without a row. A name asked for that no set-aside file has is
    a row of its own, not-found. Rows are in order of severity, then file; of several manifest rows of one
    file the greatest keeper counts; names are compared in composed form.
    """
    rows = quarantined.withColumn("_name", nfc(F.col("name")))
    if names is not None:
        asked = names.select(nfc(F.col("name")).alias("_name")).distinct()
        rows = rows.join(asked, "_name", "left_semi")
    claimed = manifest.filter("stored_as <> ''").groupBy("dup_dir", nfc(csv_unsafe(F.col("stored_as"))).alias("_name")).agg(F.max(csv_unsafe(F.col("keeper"))).alias("keeper"))
    met = rows.join(claimed, ["dup_dir", "_name"], "left").withColumn("keeper", F.nullif("keeper", F.lit("")))
    above = F.when(F.lit(per_folder) & (F.instr("dup_dir", "/") > 0), F.regexp_replace("dup_dir", "/[^/]*$", "")).otherwise("")
    place = F.when(above == "", F.col("keeper")).otherwise(F.concat_ws("/", above, "keeper"))
    unsafe = F.col("keeper").startswith("/") | F.col("keeper").rlike(r"(^|/)\.\.(/|$)")
    there = existing.select(F.col("rel").alias("_place")).distinct().withColumn("_there", F.lit(True))
    met = met.withColumn("_place", F.when(F.col("keeper").isNotNull() & ~unsafe, place)).join(there, "_place", "left")
    status = F.when(F.col("keeper").isNull(), None).when(unsafe, "unsafe-path").when(F.col("_there"), "present").otherwise("missing")
    copies = twins(quarantined, outside, most).select("id", "total", "copies")
    out = met.withColumn("keeper_status", status).join(copies, "id")
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("klass")) - 1, F.lit(-1)), F.lit(9)).cast("int")
    out = out.select(order.alias("severity"), F.col("rel").alias("file"), F.col("klass").alias("verdict"), "size", "total", "copies", "keeper", "keeper_status")
    if names is None:
        return out
    none = asked.join(quarantined.select(nfc(F.col("name")).alias("_name")), "_name", "left_anti")
    return out.unionByName(none.select(F.lit(10).alias("severity"), F.col("_name").alias("file"), F.lit("not-found").alias("verdict")), allowMissingColumns=True)


def undo_accounting(manifest: DataFrame, stored: DataFrame, existing: DataFrame, root: Column) -> DataFrame:
    """manifest with `outcome`: refused (outside root), unaccounted (not stored), skipped (target there), restored."""
    rows = manifest.join(stored.select("stored_as").distinct().withColumn("_stored", F.lit(True)), "stored_as", "left").join(existing.select(F.col("rel").alias("original_relpath")).distinct().withColumn("_there", F.lit(True)), "original_relpath", "left")
    outcome = F.when(~contained(F.concat(root, F.lit("/"), F.col("original_relpath")), root), "refused").when(F.col("_stored").isNull(), "unaccounted").when(F.col("_there"), "skipped").otherwise("restored")
    return rows.withColumn("outcome", outcome).drop("_stored", "_there")


def retire(accounted: DataFrame, manifest_col: str) -> DataFrame:
    """Per manifest the outcomes' counts and whether it may go: only if every row is accounted for."""
    return accounted.groupBy(manifest_col).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("restored", "skipped", "refused", "unaccounted")], F.bool_and(F.col("outcome").isin("restored", "skipped")).alias("retire"))


def reconcile_journal(journal: DataFrame) -> DataFrame:
    """Moved rows (plan_id, dst, ..) whose target no failed row of the plan names: a failed row says
    that the file never came, whichever of the two was written first."""
    failed = journal.filter("status = 'failed'").select("plan_id", "dst").distinct()
    return journal.filter("status = 'moved'").join(failed, ["plan_id", "dst"], "left_anti")


def verify_journal(journal: DataFrame, inventory: DataFrame) -> DataFrame:
    """journal rows with `state`: corrupt (an unreadable line), moved_ok (its target is there),
    already_undone (back at its source) or dst_missing; failed rows and those they void are left out."""
    there = inventory.select("path").distinct().withColumn("_there", F.lit(True))
    failed = journal.filter("status = 'failed'").select("plan_id", "dst").distinct().withColumn("_void", F.lit(True))
    rows = journal.filter("status <> 'failed'").join(failed, ["plan_id", "dst"], "left").filter("_void is null or status = 'corrupt-line'").drop("_void")
    rows = rows.join(there.withColumnsRenamed({"path": "dst", "_there": "_at"}), "dst", "left").join(there.withColumnsRenamed({"path": "src", "_there": "_back"}), "src", "left")
    state = F.when(F.col("status") == "corrupt-line", "corrupt").when(F.col("_at"), "moved_ok").when(F.col("_back"), "already_undone").otherwise("dst_missing")
    return rows.withColumn("state", state).drop("_at", "_back")


def verify_plans(journal: DataFrame, inventory: DataFrame, quarantine: Column) -> DataFrame:
    """Per plan: rows, the states' counts, quarantined files that no row names, and whether all is well.

    `quarantine` gives the plan in whose quarantine a path of the inventory lies (null: none).
    """
    states = verify_journal(journal, inventory)
    counted = states.groupBy("plan_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("moved_ok", "already_undone", "dst_missing", "corrupt")])
    live = states.filter("state <> 'corrupt'").select("plan_id", F.col("dst").alias("path")).distinct()
    strays = inventory.select(quarantine.alias("plan_id"), "path").filter("plan_id is not null").distinct().join(live, ["plan_id", "path"], "left_anti").groupBy("plan_id").agg(F.count("*").alias("unmanifested"))
    rows = journal.groupBy("plan_id").agg(F.count("*").alias("rows"))
    out = rows.join(counted, "plan_id", "left").join(strays, "plan_id", "left").na.fill(0)
    return out.withColumn("ok", F.col("dst_missing") + F.col("corrupt") + F.col("unmanifested") == 0)


def undo_journal(journal: DataFrame, inventory: DataFrame, root: str) -> DataFrame:
    """journal rows with `outcome` of taking them back: corrupt, escaping (a path outside root),
    already_home, missing, as_restored (something new lies at the source) or restored."""
    states = verify_journal(journal.filter("status in ('moved', 'corrupt-line')").unionByName(journal.filter("status = 'failed'")), inventory)
    taken = inventory.select(F.col("path").alias("src"), F.lit(True).alias("_back")).distinct()
    inside = contained(F.col("src"), F.lit(root)) & contained(F.col("dst"), F.lit(root))
    outcome = F.when(F.col("state") == "corrupt", "corrupt").when(~inside, "escaping").when(F.col("state") == "already_undone", "already_home").when(F.col("state") == "dst_missing", "missing").when(F.col("_back"), "as_restored").otherwise("restored")
    return states.join(taken, "src", "left").withColumn("outcome", outcome).drop("_back", "state")


def undo_plans(undone: DataFrame) -> DataFrame:
    """Per plan the outcomes' counts, and whether its journal may go: nothing missing, corrupt or escaping.
    A file that comes back beside a new one counts as restored too."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    out = undone.groupBy("plan_id").agg(count("restored", "as_restored").alias("restored"), *[count(n).alias(n) for n in ("already_home", "missing", "as_restored", "corrupt", "escaping")])
    return out.withColumn("retire", F.col("missing") + F.col("corrupt") + F.col("escaping") == 0)


def verdict(classified: DataFrame, residual: DataFrame) -> DataFrame:
    """One row over quarantine_classes and residual_groups: counts, whether all is well, whether it
    must be looked at again."""
    counts = classified.agg(F.count("*").alias("checked"), *[F.count_if(F.col("klass") == k).alias(k) for k in ("orphan", "poisoned", "unreadable", "inconclusive", "ok")])
    groups = residual.agg(F.count_if(~F.col("poisoned")).alias("residual"), F.count_if("poisoned").alias("residual_poisoned"))
    both = counts.crossJoin(F.broadcast(groups))  # a row each
    return both.withColumns({"passed": (F.col("orphan") + F.col("poisoned") + F.col("unreadable") + F.col("residual")) == 0, "needs_reverify": F.col("inconclusive") > 0})


def stored_names(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """manifest (dup_dir, stored_as) with `found`, the file that a row points at: its name without the
    guard of formulas first, the name as written only where that is not there; null if neither is."""
    plain = csv_unsafe(F.col("stored_as"))
    at = stored.select("dup_dir", F.col("name").alias("_name")).distinct()
    first = manifest.withColumn("_name", plain).join(at.withColumn("_a", F.lit(True)), ["dup_dir", "_name"], "left").withColumnRenamed("_name", "_plain")
    both = first.withColumn("_name", F.col("stored_as")).join(at.withColumn("_b", F.lit(True)), ["dup_dir", "_name"], "left").drop("_name")
    return both.withColumn("found", F.when(F.col("_a"), F.col("_plain")).when(F.col("_b"), F.col("stored_as"))).drop("_plain", "_a", "_b")


def managed_folders(folders: DataFrame, manifests: DataFrame) -> DataFrame:
    """folders (dir) named like a quarantine with `managed`: whether a manifest of ours lies in them."""
    ours = manifests.select("dir").distinct().withColumn("_ours", F.lit(True))
    return folders.filter(F.lower(F.element_at(F.split("dir", "/"), -1)) == "duplicates").join(ours, "dir", "left").select("dir", F.coalesce("_ours", F.lit(False)).alias("managed"))
