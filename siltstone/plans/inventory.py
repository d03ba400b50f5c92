"""Queries of zones, whole classification and reports over an inventory dealt from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import plausible_year
from siltstone.operators import intervals, report, tree, zones
from siltstone.plans.media import NOW, quoted
from siltstone.sources import tables as S
from siltstone.sources.scratch import kept

#: Folders below a top folder, and names of files; each meets each.
PLACES = ["", "/src", "/node_modules/x", "/.git", "/Lib.photoslibrary/a", "/tool/__pycache__", "/venv/bin", "/data", "/mirror.git", "/logs/old", "/work", "/work/.cache/deep", "/disk.utm"]
NAMES = ["package.json", "Makefile", "a.py", "readme.md", "IMG_1234.jpg", "passport.pdf", "x.tmp", "CURRENT", "MANIFEST-1", "collection.anki2", "b.log", "pyvenv.cfg", "requirements.txt", "photo (2).jpg", "empty.bin", "id_rsa", "app.sln", "c.swift", "IMG_0001 (2).jpg"]

#: Two of three top folders hold no project or repository.
CALM_PLACES = ["", "/data", "/logs/old", "/work", "/work/.cache/deep", "/tool/__pycache__", "/disk.utm"]
CALM_NAMES = ["readme.md", "sunset.jpg", "IMG_1234.jpg", "passport.pdf", "x.tmp", "b.log", "photo (2).jpg", "photo.jpg", "empty.bin", "id_rsa", "a.py", "IMG_0001 (2).jpg"]

_DEALT = f"""SELECT *, CASE WHEN dataless THEN 0 ELSE (size + 511) // 512 END AS blocks, CASE WHEN id % 3 <> 0 OR row_number() OVER (PARTITION BY CASE WHEN id % 3 = 0 THEN id % 2000 ELSE id + 1000000 END ORDER BY dir || '/' || name || '#' || id) = 1 THEN 1 ELSE 0 END AS hl_first FROM (
SELECT event_id AS id, event_id % 37 = 0 AS dataless, 'r' || (user_id % 60) || CASE WHEN user_id % 3 = 0 THEN ([{", ".join(map(quoted, PLACES))}])[1 + event_id % {len(PLACES)}] ELSE ([{", ".join(map(quoted, CALM_PLACES))}])[1 + event_id % {len(CALM_PLACES)}] END AS dir,
  CASE WHEN user_id % 3 = 0 THEN ([{", ".join(map(quoted, NAMES))}])[1 + (event_id * event_id + user_id) % {len(NAMES)}] ELSE ([{", ".join(map(quoted, CALM_NAMES))}])[1 + (event_id * event_id + user_id) % {len(CALM_NAMES)}] END AS name,
  CASE WHEN event_id % 23 = 0 THEN 0 ELSE (event_id * 131) % 40000 END::BIGINT AS size, {NOW} - (user_id % 40) * 40 * 86400 - event_id % 500 * 3600 AS mtime FROM events)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    i, u = F.col("event_id"), F.col("user_id")
    wild = u % 3 == 0
    folder = F.concat(F.lit("r"), (u % 60).cast("string"), F.when(wild, pick(PLACES, i)).otherwise(pick(CALM_PLACES, i)))
    name = F.when(wild, pick(NAMES, i * i + u)).otherwise(pick(CALM_NAMES, i * i + u))
    size = F.when(i % 23 == 0, 0).otherwise(i * 131 % 40_000).cast("long")
    mtime = F.lit(NOW) - u % 40 * 40 * 86_400 - i % 500 * 3_600
    rows = S.table(spark, sf, "events").select(i.alias("id"), folder.alias("dir"), name.alias("name"), size.alias("size"), mtime.alias("mtime"), F.lit(None).cast("string").alias("hash"), (i % 37 == 0).alias("dataless"))
    linked = F.col("id") % 3 == 0
    rows = rows.withColumns({"blocks": F.when(F.col("dataless"), 0).otherwise(F.expr("(size + 511) div 512")).cast("long"), "dev": F.lit(1), "ino": F.when(linked, F.col("id") % 2_000).otherwise(F.col("id") + 1_000_000), "nlink": F.when(linked, 2).otherwise(1), "path": F.concat("dir", F.lit("/"), "name", F.lit("#"), F.col("id").cast("string"))})
    return kept(S.hardlink_first(rows).drop("dev", "ino", "nlink", "path"), "inventory")  # dealt once, read many times


def dirs(rows: DataFrame) -> DataFrame:
    return tree.folders(rows.select(F.concat_ws("/", "dir", "name").alias("path")))


_ZONES = f"""f AS ({_DEALT}), p AS (SELECT DISTINCT dir FROM f),
d AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS dir FROM (SELECT string_split(dir, '/') AS parts, unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM p)),
x AS (SELECT dir, lower(name) AS n FROM f),
k0 AS (SELECT d.dir, lower(regexp_extract(d.dir, '([^/]*)$', 1)) AS low, bool_or(n IN ('package.json') OR ends_with(n, '.sln')) AS strong, count(*) FILTER (n IN ('makefile', 'requirements.txt')) AS weak,
  bool_or(ends_with(n, '.py') OR ends_with(n, '.swift')) AS code, bool_or(n = 'current') AND bool_or(n = 'manifest-1') AS leveldb, bool_or(n = 'collection.anki2') AS app, bool_or(n = 'pyvenv.cfg') AS venv FROM d LEFT JOIN x ON x.dir = d.dir GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN ends_with(low, '.photoslibrary') THEN 'library' WHEN ends_with(low, '.utm') THEN 'vm' WHEN dir || '/.git' IN (SELECT dir FROM d) OR ends_with(low, '.git') THEN 'git'
  WHEN strong OR weak >= 2 OR (weak >= 1 AND code) THEN 'project' WHEN leveldb THEN 'db' WHEN app THEN 'appdata' END AS kind FROM k0),
z0 AS (SELECT k.*, (SELECT a.dir FROM k a WHERE a.kind IS NOT NULL AND (k.dir = a.dir OR starts_with(k.dir, a.dir || '/')) ORDER BY length(a.dir) LIMIT 1) AS root FROM k),
z1 AS (SELECT *, CASE WHEN low IN ('__pycache__', '.cache') THEN 'cache' WHEN low = 'node_modules' THEN CASE WHEN (SELECT u.strong FROM k0 u WHERE u.dir = regexp_replace(z0.dir, '/[^/]*$', '')) THEN 'rebuildable' END WHEN low = 'venv' AND venv THEN 'rebuildable' END AS cache FROM z0),
z AS (SELECT dir, CASE WHEN root = dir THEN kind ELSE cache END AS zone, coalesce(root, CASE WHEN cache IS NOT NULL THEN dir END) AS prot FROM z1)"""
_CLASSES = f"""{_ZONES}, q AS (SELECT f.*, z.prot, r.zone AS kind, lower(f.name) AS low FROM f LEFT JOIN z ON z.dir = f.dir LEFT JOIN z r ON r.dir = z.prot),
h AS (SELECT dir, name, min(size) AS bsize FROM f GROUP BY ALL), s AS (SELECT dir, regexp_replace(lower(name), '[.][^.]*$', '') AS stem, count(*) AS same FROM f GROUP BY ALL),
c AS (SELECT q.id, q.dir, q.size, q.prot, q.kind AS zone, CASE WHEN low = 'id_rsa' THEN 'sn:S1:cred' WHEN low = 'passport.pdf' AND coalesce(kind NOT IN ('git', 'project'), true) THEN 'sn:S2:id' WHEN prot IS NOT NULL THEN NULL
  WHEN low = 'x.tmp' THEN CASE WHEN q.size > 0 AND s.same = 1 THEN 'jA:J3' ELSE 'jB:J3' END
  WHEN low IN ('photo (2).jpg', 'img_0001 (2).jpg') THEN CASE WHEN h.bsize = q.size THEN 'jB:J8' WHEN low = 'img_0001 (2).jpg' AND q.size >= 2048 THEN 'ph:poss' ELSE 'jC:J8' END
  WHEN q.size = 0 AND NOT q.dataless THEN 'jA:J9' WHEN low = 'sunset.jpg' THEN CASE WHEN q.size < 10240 THEN 'ph:asset' WHEN q.dataless THEN 'ph:unk' END WHEN low = 'photo.jpg' THEN 'ph:asset' WHEN low = 'b.log' THEN 'jB:J13' WHEN low = 'img_1234.jpg' THEN CASE WHEN q.size < 10240 THEN 'ph:asset' ELSE 'ph:likely' END END AS cls
  FROM q LEFT JOIN h ON h.dir = q.dir AND h.name = regexp_replace(q.name, ' [(]2[)]', '') AND h.name <> q.name LEFT JOIN s ON s.dir = q.dir AND s.stem = regexp_replace(q.low, '[.][^.]*$', ''))"""


def folder_zones(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    return zones.folder_zones(dirs(rows), rows)


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    return zones.file_classes(rows, dirs(rows), NOW)


def file_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(spark, sf).select("id", "cls", "zone", "prot")


def empty_zone_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders in which only rows of every fourth top folder count as files."""
    rows = files(spark, sf)
    some = rows.filter(F.regexp_extract("dir", "^r([0-9]+)", 1).cast("int") % 4 == 0)
    status = F.when(F.length("dir") % 7 == 0, "error").otherwise("done")
    return zones.empty_folders(dirs(rows).withColumn("status", status), some)


def dormant_caches(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    return zones.dormant_caches(zones.folder_zones(dirs(rows), rows), rows, NOW)


def protected_zones(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    return zones.zone_sizes(zones.folder_zones(dirs(rows), rows), rows, ["git", "project", "library", "vm", "db", "appdata"], 100)


def photo_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return report.photo_tiers(_classes(spark, sf))


def sensitive_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_severity(_classes(spark, sf))


def junk_and_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return report.junk_and_secrets(_classes(spark, sf))


def reclaim_folders(spark: SparkSession, sf: str) -> DataFrame:
    return report.reclaim(_classes(spark, sf))


def inventory_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.inventory_totals(files(spark, sf))


def junk_families(spark: SparkSession, sf: str) -> DataFrame:
    return report.junk_families(_classes(spark, sf))


#: What folder_rollup tells apart: the kind of a file's class.
KINDS = ["sn", "jA", "jB", "jC", "ph", "plain"]


def folder_report(spark: SparkSession, sf: str) -> DataFrame:
    """Subtree sums of every folder by intervals, the categories as text."""
    rows = files(spark, sf)
    places = dirs(rows).select(F.col("dir").alias("id"), tree.parent(F.col("dir")).alias("parent"))
    kind = F.coalesce(F.split("cls", ":")[0], F.lit("plain"))
    year = plausible_year(F.col("mtime"), F.lit(NOW))
    classed = zones.file_classes(rows, dirs(rows), NOW).select(F.col("dir").alias("folder"), "size", "hl_first", "cls", year.alias("year"), kind.alias("category"))
    out = report.folder_rollup(intervals.intervals(places), classed, KINDS)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select(F.col("id").alias("dir"), "files", "bytes", "junk_bytes", "year", text.alias("categories"))


def linked_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Files are one content where their name and size are, further links are no copies."""
    return report.overlap(files(spark, sf).withColumn("hash", F.concat_ws("/", "name", F.col("size").cast("string"))))


def age_lens(spark: SparkSession, sf: str) -> DataFrame:
    years = S.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return report.age_lens(years)


QUERIES = {f.__name__: f for f in (folder_zones, file_classes, empty_zone_folders, dormant_caches, protected_zones, photo_tiers, sensitive_rollup, junk_and_secrets, reclaim_folders, age_lens, inventory_totals, junk_families, folder_report, linked_overlap)}
_UP = "SELECT array_to_string(parts[1:i], '/') AS dir, v FROM (SELECT string_split(dir, '/') AS parts, v, unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM {})"
ORACLE_SQL = {
    "folder_zones": f"WITH {_ZONES} SELECT dir, zone, prot FROM z",
    "file_classes": f"WITH {_CLASSES} SELECT id, cls, zone, prot FROM c",
    "empty_zone_folders": f"""WITH {_ZONES.replace("x AS (SELECT dir, lower(name) AS n FROM f)", "x AS (SELECT dir, lower(name) AS n FROM f WHERE regexp_extract(dir, '^r([0-9]+)', 1)::INTEGER % 4 = 0)")},
b AS (SELECT DISTINCT dir FROM x UNION SELECT dir FROM z0 WHERE root IS NOT NULL UNION SELECT dir FROM d WHERE length(dir) % 7 = 0)
SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dir = d.dir OR starts_with(b.dir, d.dir || '/'))""",
    "dormant_caches": f"""WITH {_ZONES}, m AS (SELECT z.dir, z.zone, z.prot, (SELECT max(f.mtime) FROM f JOIN z y ON y.dir = f.dir WHERE (y.prot = z.prot OR f.dir = regexp_replace(z.dir, '/[^/]*$', '')) AND f.dir <> z.dir AND NOT starts_with(f.dir, z.dir || '/')) AS newest
  FROM z WHERE z.zone IN ('cache', 'rebuildable') AND contains(z.dir, '/'))
SELECT m.dir, m.zone AS kind, coalesce((SELECT sum(size) FROM f WHERE hl_first = 1 AND (f.dir = m.dir OR starts_with(f.dir, m.dir || '/'))), 0)::BIGINT AS size, newest FROM m WHERE {NOW} - newest >= {zones.DORMANT}""",
    "protected_zones": f"""WITH {_ZONES} SELECT dir AS path, zone AS kind, coalesce((SELECT sum(size) FROM f WHERE f.dir = z.dir OR starts_with(f.dir, z.dir || '/')), 0)::BIGINT AS bytes, (SELECT count(*) FROM f WHERE f.dir = z.dir) AS files
FROM z WHERE zone IN ('git', 'project', 'library', 'vm', 'db', 'appdata') ORDER BY bytes DESC, path LIMIT 100""",
    "photo_tiers": f"WITH {_CLASSES} SELECT split_part(cls, ':', 2) AS tier, count(*) AS files, sum(size)::BIGINT AS bytes FROM c WHERE starts_with(cls, 'ph:') GROUP BY 1",
    "sensitive_rollup": f"""WITH {_CLASSES}, t AS (SELECT split_part(cls, ':', 2) AS severity, split_part(cls, ':', 3) AS category, size, dir FROM c WHERE starts_with(cls, 'sn:'))
SELECT severity, category, count(*) AS files, sum(size)::BIGINT AS bytes, array_to_string(list_sort(list(DISTINCT dir))[1:8], '|') AS dirs FROM t GROUP BY 1, 2""",
    "junk_and_secrets": f"""WITH {_CLASSES} SELECT coalesce(sum(size) FILTER (regexp_matches(cls, '^j[AB]')), 0)::BIGINT AS junk_ab, coalesce(sum(size) FILTER (starts_with(cls, 'jC')), 0)::BIGINT AS junk_c,
coalesce(sum(size) FILTER (starts_with(cls, 'sn:S1')), 0)::BIGINT AS sure, coalesce(sum(size) FILTER (starts_with(cls, 'sn:S2')), 0)::BIGINT AS likely FROM c""",
    "reclaim_folders": f"WITH {_CLASSES}, j AS (SELECT dir, size AS v FROM c WHERE regexp_matches(cls, '^j[AB]')) SELECT dir, sum(v)::BIGINT AS junk_bytes FROM ({_UP.format('j')}) GROUP BY 1 HAVING sum(v) > 0 ORDER BY junk_bytes DESC, dir LIMIT 20",
    "inventory_totals": f"""SELECT count(*) AS files, sum(CASE WHEN hl_first = 1 THEN size ELSE 0 END)::BIGINT AS bytes, sum(blocks * 512)::BIGINT AS physical, count(*) FILTER (dataless) AS dataless_files,
  sum(CASE WHEN dataless AND hl_first = 1 THEN size ELSE 0 END)::BIGINT AS dataless_bytes, count(*) FILTER (size IS NULL) AS errors FROM ({_DEALT})""",
    "junk_families": f"""WITH {_CLASSES}, j AS (SELECT cls[2] AS tier, split_part(cls, ':', 2) AS family, f.name, CASE WHEN f.hl_first = 1 THEN f.size ELSE 0 END AS b FROM c JOIN f USING (id) WHERE regexp_matches(cls, '^j[ABC]:'))
SELECT tier, family, count(*) AS files, sum(b)::BIGINT AS bytes, array_to_string(list_sort(list(DISTINCT name))[1:3], '|') AS samples FROM j GROUP BY 1, 2""",
    "folder_report": f"""WITH {_CLASSES}, r AS (SELECT c.dir, cls, CASE WHEN hl_first = 1 THEN f.size ELSE 0 END AS b, year(make_timestamp(f.mtime * 1000000)) AS y, coalesce(nullif(split_part(cls, ':', 1), ''), 'plain') AS k FROM c JOIN f USING (id)),
u AS (SELECT array_to_string(parts[1:i], '/') AS dir, cls, b, y, k FROM (SELECT *, string_split(dir, '/') AS parts, unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM r)),
g AS (SELECT dir, k, sum(b)::BIGINT AS b FROM u GROUP BY 1, 2 HAVING sum(b) > 0), t AS (SELECT dir, string_agg(k || '=' || b, ';' ORDER BY k) AS categories FROM g GROUP BY 1)
SELECT u.dir, count(*) AS files, sum(b)::BIGINT AS bytes, sum(CASE WHEN regexp_matches(cls, '^j[AB]:') THEN b ELSE 0 END)::BIGINT AS junk_bytes, CASE WHEN sum(b) > 0 THEN round_even(sum(b * y)::DOUBLE / sum(b), 0)::INTEGER END AS year, coalesce(any_value(t.categories), '') AS categories FROM u LEFT JOIN t ON t.dir = u.dir GROUP BY 1""",
    "linked_overlap": f"WITH g AS (SELECT name, size, count(*) AS n FROM ({_DEALT}) WHERE hl_first = 1 GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum((n - 1) * size), 0)::BIGINT AS wasted FROM g",
    "age_lens": "WITH y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders) SELECT year, round(CASE WHEN (SELECT max(year) > min(year) FROM y) THEN 1 - (year - (SELECT min(year) FROM y)) / ((SELECT max(year) FROM y) - (SELECT min(year) FROM y)) ELSE 0 END, 6) AS age FROM y",
}
