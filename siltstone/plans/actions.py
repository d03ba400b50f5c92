"""Action plans: capture dates, destinations, consent, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import CLOCK_YEARS, extension
from siltstone.operators.identity import free_names
from siltstone.operators.photos import SIDECARS
from siltstone.sources.scratch import kept

# File names that carry a date, and the limits of consent.
DATED_NAMES = [
    r"^(?:IMG|VID|PXL)[-_](\d{4})(\d{2})(\d{2})[-_]",
    r"^(\d{4})-(\d{2})-(\d{2}) \d{2}\.\d{2}\.\d{2}",
    r"^(\d{4})(\d{2})(\d{2})_\d{6}",
    r"^(?:IMG|VID|AUD|PTT)-(\d{4})(\d{2})(\d{2})-WA",
    r"(?i)^Screen ?Shot (\d{4})-(\d{2})-(\d{2})",
    r"(?i)^Screenshot[_ ](\d{4})-?(\d{2})-?(\d{2})",
]
FIRST_YEAR = 1990
TYPED_FILES, TYPED_BYTES, EXPLICIT_FILES, EXPLICIT_BYTES = 10_000, 50 << 30, 1_000, 5 << 30
CHURN_FILES = 2_000


def capture_month(name: Column, mtime: Column, last_year: int) -> Column:
    """struct(year, month, origin) from the name, else the time, else unknown (0, 0)."""
    good = lambda y, m: y.between(FIRST_YEAR, last_year + 1) & m.between(1, 12)
    named = []
    for p in DATED_NAMES:
        y, m = F.regexp_extract(name, p, 1).try_cast("int"), F.regexp_extract(name, p, 2).try_cast("int")
        named.append(F.when(name.rlike(p) & good(y, m), F.struct(y.alias("year"), m.alias("month"), F.lit("filename").alias("origin"))))
    t = F.timestamp_seconds(mtime)
    timed = F.when((mtime > 0) & good(F.year(t), F.month(t)) & ~F.year(t).isin(*CLOCK_YEARS), F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.lit("mtime").alias("origin")))
    return F.coalesce(*named, timed, F.struct(F.lit(0).alias("year"), F.lit(0).alias("month"), F.lit("unknown").alias("origin")))


def consent_level(files: Column, size: Column) -> Column:
    return F.when((files > TYPED_FILES) | (size > TYPED_BYTES), "typed").when((files >= EXPLICIT_FILES) | (size >= EXPLICIT_BYTES), "explicit").otherwise("simple")


def finalise(operations: DataFrame) -> DataFrame:
    """Per plan: operations, bytes, consent, whether it churns; empty plans do not exist."""
    out = operations.groupBy("plan_id").agg(F.count("*").alias("op_count"), F.sum("size").alias("total_bytes"))
    return out.withColumns({"consent": consent_level(F.col("op_count"), F.col("total_bytes")), "churn": F.col("op_count") > CHURN_FILES})


def junk_plan(classified: DataFrame) -> DataFrame:
    """Junk of tiers A and B to the quarantine of its plan; tier C is never planned."""
    plan = F.concat(F.lit("junk-"), F.lower("tier"))
    return classified.filter(F.col("tier").isin("A", "B")).select(plan.alias("plan_id"), F.lit("move").alias("op"), F.col("path").alias("src"), F.concat(F.lit("_Quarantine/"), plan, F.lit("/"), F.col("path")).alias("dst"), "size", F.col("family").alias("evidence"))


def reject_reason(op: Column, src: Column, dst: Column) -> Column:
    """Why an operation may not run; null if it may."""
    bad = lambda p: p.rlike(r"(^|/)\.\.?(/|$)") | p.contains("//") | p.startswith("/") | (p == "")
    return F.when(op != "move", "not a move").when(bad(src), "source path").when(bad(dst), "target path").when(src == dst, "same path")


def operations_checksum(operations: DataFrame) -> DataFrame:
    """(plan_id, checksum): SHA-256 over each plan's operations in a canonical form of our own.

    Each operation's fields become one JSON text; plans add up their operations' digests as numbers, so
    a plan of any size is combined on the map side and its order does not matter.
    """
    line = F.to_json(F.struct("dst", "op", "size", "src"))
    digest = F.sha2(line.cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)"))
    sums = operations.groupBy("plan_id").agg(F.count("*").alias("_n"), *[part(1 + 8 * i).alias(f"_s{i}") for i in range(8)])
    return sums.select("plan_id", F.sha2(F.concat_ws("|", "_n", *[F.col(f"_s{i}").cast("string") for i in range(8)]).cast("binary"), 256).alias("checksum"))


def linked_sources(operations: DataFrame, links: DataFrame) -> DataFrame:
    """Operations that move what some link (path, target) points at, with the number of such links."""
    to = links.groupBy(F.col("target").alias("src")).agg(F.count("*").alias("links"))
    return operations.join(to, "src")


def dry_run(operations: DataFrame, inventory: DataFrame) -> DataFrame:
    """What each operation would meet now: missing, changed, collision or ready."""
    at = inventory.select(F.col("path").alias("src"), F.col("size").alias("_now"), F.lit(True).alias("_here"))
    there = inventory.select(F.col("path").alias("dst"), F.lit(True).alias("_taken"))
    met = operations.join(at, "src", "left").join(there, "dst", "left")
    return met.withColumn("outcome", F.when(F.col("_here").isNull(), "missing").when(~F.col("_now").eqNullSafe(F.col("size")), "changed").when(F.col("_taken"), "collision").otherwise("ready")).drop("_now", "_here", "_taken")


def final_targets(operations: DataFrame, inventory: DataFrame) -> DataFrame:
    """operations (src, dst) that can run, with `final`: dst, or dst with " [tN]", N from 1 on, before the
    extension where dst exists or an operation with a smaller src takes it. No file is overwritten."""
    folder, name = (F.regexp_extract(F.col(c), r"(?s)^(.*?)([^/]*)$", n) for c, n in (("dst", 1), ("dst", 2)))
    moves = operations.withColumns({"dup_dir": folder, "name": name, "rel": F.col("src")})
    taken = inventory.select(F.regexp_extract("path", r"(?s)^(.*?)([^/]*)$", 1).alias("dup_dir"), F.regexp_extract("path", r"(?s)^(.*?)([^/]*)$", 2).alias("name"))
    given = free_names(moves, taken, "t", 1)
    return given.withColumn("final", F.concat("dup_dir", "stored_as")).drop("dup_dir", "name", "rel", "stored_as")


LINK_ROUNDS = 40


def leaking_folders(folders: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """(folder): those of folders below root that lead out of it through a link (path, target; both absolute
    and normalised).

    In each round a folder's first link on its path is replaced by its target, for folders that still have
    one. A folder with more than LINK_ROUNDS links in turn, as in a circle, counts as leading out. Of
    several targets of one path the least counts; links without a path or target are none.
    """
    of = kept(links.filter("path is not null and target is not null").groupBy("path").agg(F.min("target").alias("target")), "links")
    now = folders.filter("folder is not null").select("folder", F.col("folder").alias("at")).distinct()
    out = None
    for _ in range(LINK_ROUNDS):
        names = F.split("at", "/")
        upper = now.select("folder", "at", F.explode(F.sequence(F.lit(2), F.greatest(F.size(names), F.lit(2)))).alias("n"), names.alias("names"))
        met = upper.withColumn("path", F.array_join(F.slice("names", 1, F.col("n")), "/")).join(of, "path")
        first = met.groupBy("folder", "at").agg(F.min(F.struct("n", "path", "target")).alias("link"))
        led = first.select("folder", F.concat("link.target", F.substr("at", F.length("link.path") + 1)).alias("at"))
        now = kept(led, "led")
        inside = (F.col("at") == root) | F.startswith("at", F.lit(root + "/"))
        gone = now.filter(~inside).select("folder")
        out, now = gone if out is None else out.unionByName(gone), now.filter(inside)
        if now.isEmpty():
            return out
    return out.unionByName(now.select("folder"))


def plan_refusal(plans: DataFrame, operations: DataFrame, root: str, token: str, links: DataFrame | None = None) -> DataFrame:
    """(plan_id, reason): why a plan (plan_id, root, checksum) may not run, null if it may: another token,
    another root, changed operations, or an operation that reject_reason or the root refuses. With links
    (path, target), operations whose source's or target's folder leads out of the root through one are
    refused too; the moved name itself may be a link."""
    sums = operations_checksum(operations).withColumnRenamed("checksum", "_now")
    inside = lambda c: F.col(c).startswith(root + "/")
    below = lambda c: F.substr(F.col(c), F.lit(len(root) + 2))
    bad = F.when(~(inside("src") & inside("dst")), "outside the folder").otherwise(reject_reason(F.col("op"), below("src"), below("dst")))
    found = operations.select("plan_id", bad.alias("_bad"))
    if links is not None:
        sides = operations.select("plan_id", F.explode(F.array("src", "dst")).alias("_side"))
        of = sides.select("plan_id", F.regexp_extract("_side", r"(?s)^(.*)/", 1).alias("folder")).filter(F.startswith("folder", F.lit(root))).distinct()
        led = of.join(leaking_folders(of.select("folder"), links, root), "folder").select("plan_id", F.lit("through a link").alias("_bad"))
        found = found.unionByName(led)
    worst = found.groupBy("plan_id").agg(F.min("_bad").alias("_bad"))
    met = plans.join(sums, "plan_id", "left").join(worst, "plan_id", "left")
    return met.select("plan_id", F.when(F.col("plan_id") != token, "approval token").when(F.col("root") != root, "another folder").when(~F.col("_now").eqNullSafe(F.col("checksum")), "changed since").otherwise(F.col("_bad")).alias("reason"))


# Idle time before an archive, and top folders that plans leave alone.
ARCHIVE_IDLE = 3 * 365 * 86_400
RESERVED = ["Archive", "Photos", "Screenshots", "_Quarantine"]


def photo_plan(files: DataFrame, last_year: int) -> DataFrame:
    """Sure and likely captures outside Photos to Photos/YYYY/MM, undated ones by their folder's name.

    files (id, dir, name, size, mtime, photo), dir below the root. What shares a capture's folder and
    stem (sidecars, pairs) travels with the one of least id; equal rows each have their operation.
    """
    name, folder = F.col("name"), F.coalesce("dir", F.lit(""))
    ext, taken = extension(name), F.col("photo").isin("ph:cert", "ph:likely")
    members = files.filter(F.col("photo").isNotNull() & (taken | (F.col("photo") == "ph:side") | ext.isin(*SIDECARS)))
    members = members.select("id", folder.alias("dir"), "name", "size", "mtime", "photo", F.lower(F.substring(name, F.lit(1), F.length(name) - F.length(ext))).alias("stem"))
    date = capture_month(name, F.col("mtime"), last_year)
    undated = F.concat(F.lit("Photos/_Unknown-Date/"), F.coalesce(F.nullif(F.element_at(F.split("dir", "/"), -1), F.lit("")), F.lit("root")))
    target = F.when(F.col("date.year") > 0, F.format_string("Photos/%04d/%02d", "date.year", "date.month")).otherwise(undated)
    away = (F.col("dir") != "Photos") & ~F.col("dir").startswith("Photos/")
    leads = members.filter(taken & away).withColumn("date", date).groupBy("dir", "stem").agg(F.min(F.struct("id", target.alias("target"), F.col("date.origin").alias("origin"))).alias("lead"))
    source = F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(""), name)
    why = F.when(F.col("id") == F.col("lead.id"), F.concat("photo", F.lit(" · date from "), "lead.origin")).otherwise("travels with its photo (sidecar/pair)")
    return members.join(leads, ["dir", "stem"]).select("id", F.lit("photo-consolidation").alias("plan_id"), F.lit("move").alias("op"), source.alias("src"), F.concat_ws("/", "lead.target", name).alias("dst"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), why.alias("evidence"))


def screenshot_plan(files: DataFrame, last_year: int) -> DataFrame:
    """Screenshots to Screenshots/YYYY, or _Undated."""
    folder, year = F.coalesce("dir", F.lit("")), capture_month(F.col("name"), F.col("mtime"), last_year)["year"]
    target = F.when(year > 0, F.format_string("%04d", year)).otherwise("_Undated")
    source = F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), "name")
    return files.filter("photo = 'ph:screen'").select("id", F.lit("screenshots").alias("plan_id"), F.lit("move").alias("op"), source.alias("src"), F.concat_ws("/", F.lit("Screenshots"), target, "name").alias("dst"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.lit("screenshot pattern").alias("evidence"))


def archive_plan(files: DataFrame, now: int, protected: DataFrame | None = None, manifests: str = "_Manifests") -> DataFrame:
    """Top-level items idle for three years to Archive/<year>, whole; none that holds a sensitive file.

    files (dir, name, size, mtime, sensitive), dir below the root; `protected` (top) lists top folders
    to leave, `manifests` names the engine's own. One pass with partial sums per top-level item, however large a folder is.
    """
    folder = F.coalesce("dir", F.lit(""))
    is_file = folder == ""
    items = files.groupBy(F.when(is_file, F.col("name")).otherwise(F.split(folder, "/")[0]).alias("src"), is_file.alias("is_file")).agg(
        F.max("mtime").alias("newest"), F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("size"), F.coalesce(F.bool_or(F.col("sensitive").isNotNull()), F.lit(False)).alias("secret")
    )
    if protected is not None:
        items = items.join(protected.select(F.col("top").alias("src"), F.lit(False).alias("is_file")).distinct(), ["src", "is_file"], "left_anti")
    year = F.year(F.timestamp_seconds("newest"))
    idle = ~F.col("secret") & (F.lit(now) - F.col("newest") >= ARCHIVE_IDLE) & year.between(FIRST_YEAR, F.year(F.timestamp_seconds(F.lit(now))))
    kept = items.filter(idle & (F.col("is_file") | ~F.col("src").isin(*RESERVED, manifests)))
    why = F.concat(F.when(F.col("is_file"), "idle since ").otherwise("whole folder idle since "), year.cast("string"))
    return kept.select(F.lit("cold-archive").alias("plan_id"), F.lit("move").alias("op"), "src", F.concat_ws("/", F.lit("Archive"), F.format_string("%04d", year), "src").alias("dst"), "size", why.alias("evidence"))
