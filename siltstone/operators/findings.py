"""Finding identity and run-over-run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import asof_join

# Severities from worst to least.
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def finding_hash(cat: Column, path: Column, line: Column, extra: Column | None = None) -> Column:
    """The first eight digits of a finding's SHA-1; null where a part of it is."""
    text = F.concat(cat, F.lit("|"), path, F.lit("|"), F.trim(F.regexp_replace(line, r"[ \t\r\n]+", " ")))
    text = text if extra is None else F.concat(text, F.lit("|"), extra)
    return F.left(F.sha1(text.cast("binary")), F.lit(8))


def finding_ids(findings: DataFrame) -> DataFrame:
    """findings (cat, path, line) with `hash8`; of different findings with one hash, those after the
    first in order are hashed again with their number."""
    rows = findings.withColumn("hash8", finding_hash(F.col("cat"), F.col("path"), F.col("line")))
    nth = F.dense_rank().over(Window.partitionBy("cat", "hash8").orderBy("path", "line"))
    again = finding_hash(F.col("cat"), F.col("path"), F.col("line"), F.col("_n").cast("string"))
    return rows.withColumn("_n", nth).withColumn("hash8", F.when(F.col("_n") == 1, F.col("hash8")).otherwise(again)).drop("_n")


def severity_rank(s: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for n, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(s == name, n).otherwise(out)
    return out


def merge_sinks(findings: DataFrame) -> DataFrame:
    """One row per (path, line) at its worst severity."""
    return findings.groupBy("path", "line").agg(F.min_by("severity", F.struct(severity_rank(F.col("severity")), "severity")).alias("severity"), F.count("*").alias("merged"))


def compare_runs(now: DataFrame, last: DataFrame, accepted: DataFrame, run_date: Column) -> DataFrame:
    """(key, state) over everything seen: ACCEPTED while its expiry is not past, REGRESSION after,
    STILL-OPEN if last seen, NEW if not, FIXED if only last seen."""
    a = accepted.groupBy("key").agg(F.max(F.coalesce("expires", F.lit("9999-12-31").cast("date"))).alias("_until"))
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    both = flag(now, "_now").join(flag(last, "_last"), "key", "full").join(a, "key", "left")
    state = F.when(F.col("_now").isNull(), "FIXED").when(F.col("_until") >= run_date, "ACCEPTED").when(F.col("_until").isNotNull(), "REGRESSION").when(F.col("_last"), "STILL-OPEN").otherwise("NEW")
    return both.select("key", state.alias("state"))


def states_of_runs(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(run, key, state) over all runs: compare_runs of each run with the one before it, under the acceptances
    of its own date.

    found (run, key), run a date; accepted (key, run, expires): an acceptance holds from the date `run` until
    a later one of its key takes its place, and lapses after `expires` (null: never). A key of one run that
    the next lacks is FIXED there. Repeated rows count once; null runs and keys take no part.
    """
    rows = found.select("run", "key").filter("run is not null and key is not null").distinct()
    runs = rows.select("run").distinct()  # a row a run
    near = runs.select("run", F.lag("run").over(Window.orderBy("run")).alias("_last"), F.lead("run").over(Window.orderBy("run")).alias("_next"))
    dated = rows.join(F.broadcast(near), "run")
    seen = rows.select(F.col("run").alias("_last"), "key", F.lit(True).alias("_seen"))
    valid = accepted.filter("key is not null").select("key", "run", F.struct("expires").alias("accepted"))
    met = asof_join(dated.join(seen, ["_last", "key"], "left").select("run", "key", "_seen"), valid, "key", "run", ["accepted"])
    holds = F.col("accepted.expires").isNull() | (F.col("accepted.expires") >= F.col("run"))
    state = F.when(F.col("accepted").isNotNull(), F.when(holds, "ACCEPTED").otherwise("REGRESSION")).when(F.col("_seen"), "STILL-OPEN").otherwise("NEW")
    gone = dated.filter("_next is not null").select(F.col("_next").alias("run"), "key").join(rows, ["run", "key"], "left_anti")
    return met.select("run", "key", state.alias("state")).unionByName(gone.select("run", "key", F.lit("FIXED").alias("state")))


# Categories by the kind of sink, first match first.
CATEGORIES = [("command", "CMD"), ("filesystem", "FS"), ("network", "NET"), ("dependency", "DEP"), ("lifecycle", "LIF"), ("error-handling", "ERR"), ("data-safety", "DAT"), ("security", "SEC"), ("quality", "QUA"), ("hardening", "QOL")]


def category(sinks: Column) -> Column:
    """The category of a finding with several kinds of sink: the first in the table."""
    out = F.lit(None).cast("string")
    for kind, code in reversed(CATEGORIES):
        out = F.when(F.array_contains(sinks, kind), code).otherwise(out)
    return out


def gate(severity: Column, answer: Column) -> Column:
    """Where a finding goes after its check: only Critical and High ones are checked; a refuted one is
    dropped, one that could not be settled needs investigation, an unchecked one waits."""
    checked = severity.isin("Critical", "High")
    return F.when(~checked, "report").when(answer == "yes", "report").when(answer == "no", "drop").when(answer == "unsettled", "investigate").otherwise("check")


def coverage(inventory: DataFrame, read: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: files known, read, skipped, and unaccounted."""
    flag = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    met = inventory.select("path").distinct().join(flag(read, "r"), "path", "left").join(flag(skipped, "s"), "path", "left")
    return met.agg(F.count("*").alias("known"), F.count_if(F.col("r")).alias("read"), F.count_if(F.col("r").isNull() & F.col("s")).alias("skipped"), F.count_if(F.col("r").isNull() & F.col("s").isNull()).alias("unaccounted"))


def slug(title: Column) -> Column:
    """The first three words of a title in lower case, joined by hyphens; for readers, not for matching."""
    words = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 3), "-")


def finding_key(cat: Column, title: Column, hash8: Column) -> Column:
    return F.concat_ws("-", cat, F.nullif(slug(title), F.lit("")), hash8)
