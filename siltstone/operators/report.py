"""Report aggregates over a classified inventory: each is one map-side-combined aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.identity import seen_again
from siltstone.operators.intervals import subtree_sums
from siltstone.operators.tree import ancestors
from siltstone.sources.scratch import kept


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.countDistinct("dir").alias("dirs"), F.sum("size").alias("bytes"), F.count_if(F.col("size") == 0).alias("empty"), F.count_if(F.col("size").isNull()).alias("errors"))


def counted(size: str = "size", first: str = "hl_first") -> Column:
    """The bytes that a file adds: none where it is a further link to bytes counted already."""
    return F.when(F.col(first) == 1, F.coalesce(F.col(size), F.lit(0))).otherwise(F.lit(0)).cast("long")


def inventory_totals(files: DataFrame) -> DataFrame:
    """One row over files (size, blocks, dataless, hl_first): files, bytes of first links, bytes on disk,
    placeholders and their bytes, files without a size."""
    at_rest = F.coalesce("dataless", F.lit(False))
    none = F.lit(0).cast("long")
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(counted()), none).alias("bytes"),
        F.coalesce(F.sum(F.coalesce("blocks", none) * 512), none).alias("physical"),
        F.count_if(at_rest).alias("dataless_files"),
        F.coalesce(F.sum(F.when(at_rest, counted())), none).alias("dataless_bytes"),
        F.count_if(F.col("size").isNull()).alias("errors"),
    )


def junk_families(files: DataFrame) -> DataFrame:
    """(tier, family, files, bytes, samples) of junk among files (name, size, hl_first, cls): bytes of first
    links, and the first three names."""
    code = F.split("cls", ":")
    rows = files.filter(F.col("cls").rlike("^j[ABC]:")).select(F.substring(code[0], 2, 1).alias("tier"), code[1].alias("family"), "name", counted().alias("size"))
    return samples(rows, ["tier", "family"])


def folder_rollup(labels: DataFrame, files: DataFrame, categories: list[str]) -> DataFrame:
    """(id, files, bytes, junk_bytes, year, categories): whole subtrees of folders by their interval labels.

    files (folder, size, hl_first, cls, year, category), bytes are those of first links: junk_bytes of
    tiers A and B, categories the bytes of each category (of the list) that has any, year the mean
    weighted by bytes over files with a year, rounded half to even, null without such bytes.
    """
    b, dated = counted(), F.col("year").isNotNull()
    sums = {"files": F.lit(1).cast("long"), "bytes": b, "junk_bytes": F.when(F.col("cls").rlike("^j[AB]:"), b), "_years": F.when(dated, b.cast("decimal(38,0)") * F.col("year")), "_dated": F.when(dated, b)}
    sums |= {f"_c{n}": F.when(F.col("category") == c, b) for n, c in enumerate(categories)}
    direct = files.groupBy(F.col("folder").alias("id")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    whole = subtree_sums(labels, direct, *sums)
    each = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_c{n}").alias("value")) for n, c in enumerate(categories)])
    year = F.when(F.col("_dated") > 0, F.bround(F.col("_years").cast("double") / F.col("_dated"))).cast("int")
    return whole.select("id", "files", "bytes", "junk_bytes", year.alias("year"), F.map_from_entries(F.filter(each, lambda e: e["value"] > 0)).alias("categories"))


def by_group(files: DataFrame, key: Column, name: str) -> DataFrame:
    return files.groupBy(key.alias(name)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def top_groups(groups: DataFrame, name: str, most: int) -> DataFrame:
    return groups.orderBy(F.desc("bytes"), name).limit(most)


def samples(files: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Counts and bytes per keys with the first `most` names in order. Names are ranked per group and
    only the first are collected, so a large group is never gathered."""
    first = files.select(*keys, "name").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))).filter(F.col("_n") <= most)
    names = first.groupBy(*keys).agg(F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("samples"))
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).join(names, keys)


def overlap(files: DataFrame) -> DataFrame:
    """One row: digest groups with several files, and the bytes that copies take. Where files have a column
    hl_first, further links are no copies. Digests seen once are dropped before they are grouped."""
    rows = files.filter("hl_first = 1") if "hl_first" in files.columns else files
    groups = seen_again(kept(rows.select("hash", "size"), "digests")).filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted"))


def largest(files: DataFrame, most: int = 100) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(most)


def by_severity(files: DataFrame, most_dirs: int = 8) -> DataFrame:
    """(severity, category, files, bytes, dirs) of sensitive files (dir, size, cls), with the first
    `most_dirs` folders in order."""
    parts = F.split("cls", ":")
    rows = files.filter(F.col("cls").startswith("sn:")).select(parts[1].alias("severity"), parts[2].alias("category"), "size", "dir")
    nth = F.row_number().over(Window.partitionBy("severity", "category").orderBy("dir"))
    first = rows.select("severity", "category", "dir").distinct().withColumn("_n", nth).filter(F.col("_n") <= most_dirs)
    dirs = first.groupBy("severity", "category").agg(F.concat_ws("|", F.array_sort(F.collect_list("dir"))).alias("dirs"))
    return rows.groupBy("severity", "category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).join(dirs, ["severity", "category"])


def photo_tiers(files: DataFrame) -> DataFrame:
    rows = files.filter(F.col("cls").startswith("ph:"))
    return rows.groupBy(F.split("cls", ":")[1].alias("tier")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def junk_and_secrets(files: DataFrame) -> DataFrame:
    """One row: bytes of junk that plans may move (tiers A and B) and of files by severity."""
    at = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0))
    return files.agg(at(F.col("cls").rlike("^j[AB]:")).alias("junk_ab"), at(F.col("cls").rlike("^jC:")).alias("junk_c"), at(F.col("cls").startswith("sn:S1:")).alias("sure"), at(F.col("cls").startswith("sn:S2:")).alias("likely"))


def reclaim(files: DataFrame, most: int = 20) -> DataFrame:
    """(dir, junk_bytes): the folders with the most bytes of junk in their subtrees. A folder's bytes
    count for every folder above it too."""
    direct = files.filter(F.col("cls").rlike("^j[AB]:")).groupBy("dir").agg(F.sum("size").alias("b"))
    up = direct.select("b", F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("dir"))
    return up.groupBy("dir").agg(F.sum("b").alias("junk_bytes")).filter("junk_bytes > 0").orderBy(F.desc("junk_bytes"), "dir").limit(most)


def age_lens(years: DataFrame) -> DataFrame:
    """years (.., year) with `age`: 1 for the oldest, 0 for the newest, 0 where there is one year."""
    span = years.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    age = F.when(F.col("_b") > F.col("_a"), 1 - (F.col("year") - F.col("_a")) / (F.col("_b") - F.col("_a"))).when(F.col("year").isNotNull(), 0.0)
    return years.crossJoin(F.broadcast(span)).withColumn("age", F.round(age, 6)).drop("_a", "_b")  # one row


def resorted(rows: DataFrame, column: str, descending: bool) -> DataFrame:
    """The rows of a bounded list in the order of one of its columns; ties by path."""
    return rows.orderBy(F.desc(column) if descending else F.asc(column), "path")


def histogram(issues: DataFrame, advisory: list[str]) -> DataFrame:
    """(rule, issues, hard) per rule; advisory rules are not hard."""
    return issues.groupBy("rule").agg(F.count("*").alias("issues")).withColumn("hard", ~F.col("rule").isin(*advisory))


def fields_touched(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field").agg(F.count("*").alias("records"))


def preflight(checks: DataFrame) -> DataFrame:
    """One row over checks (state: PASS, FAIL, WARN, INFO): passed of all that decide (a warning counts as not passed), and whether none failed."""
    decided = F.col("state").isin("PASS", "WARN", "FAIL")
    return checks.agg(F.count_if(F.col("state") == "PASS").alias("passed"), F.count_if(decided).alias("total"), (F.count_if(F.col("state") == "FAIL") == 0).alias("ready"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row a run: findings by severity, and how many are accepted or fixed."""
    is_open = ~F.col("state").isin("ACCEPTED", "FIXED")
    return findings.groupBy("run").agg(*[F.count_if((F.col("severity") == s) & is_open).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")], F.count_if(F.col("state") == "ACCEPTED").alias("accepted"), F.count_if(F.col("state") == "FIXED").alias("fixed"))


def mean_score(*scores: Column) -> Column:
    """The mean of scores from 1 to 10, to one decimal."""
    return F.round(sum(scores[1:], scores[0]) / len(scores), 1)


def year_series(by_year: DataFrame) -> DataFrame:
    """by_year (year, files, bytes) with the years between the first and the last filled with 0."""
    span = by_year.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(by_year, "year", "left").na.fill(0, ["files", "bytes"])


def shares(groups: DataFrame, total: str = "bytes") -> DataFrame:
    """groups with their share; the total is one row, joined back, not a window over all rows."""
    whole = groups.agg(F.sum(total).alias("_all"))
    return groups.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col(total) / F.col("_all"), 6)).drop("_all")


def missing_ranks(items: DataFrame, rank: str = "rank", width: int = 1 << 16) -> DataFrame:
    """The ranks from 1 to the largest that no item has. Ranks are compared within ranges of `width`
    numbers, so no row holds them all; ranges without an item are made from their numbers alone."""
    have = items.select(F.col(rank).cast("long").alias(rank)).filter(F.col(rank) >= 1).distinct()
    top = have.agg(F.max(rank)).first()[0] or 0
    ranges = items.sparkSession.range(0, -(-top // width)).withColumnRenamed("id", "_range")
    every = ranges.select(F.explode(F.sequence(F.col("_range") * width + 1, F.least((F.col("_range") + 1) * width, F.lit(top)))).alias(rank))
    return every.join(have, rank, "left_anti")
