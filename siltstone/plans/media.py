"""Queries of sensitive files and photos over an inventory dealt from the events, with their SQL.

Names are made by rule: sensitive ones from every entry of the word tables in several spellings,
photos from the shapes that cameras, phones and browsers give. The SQL computes classes from names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import photos, sensitive
from siltstone.plans import actions
from siltstone.sources import tables as S

NOW, LAST_YEAR = 1_735_689_600, 2025


def quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(n), *map(quoted, row)]) + ")" for n, row in enumerate(rows))


def phrases() -> list[tuple[str, str]]:
    """Every word and pair of words of the tables, and what a document's name with it is."""
    words = {w: f"sn:S2:{c}" for w, c in sensitive.LIKELY_WORDS.items()}
    words |= {w: f"sn:S1:{c}" for w, c in sensitive.SURE_WORDS.items()}
    return sorted((words | {w: f"sn:S1:{c}" for w, c in (sensitive.FOREIGN_WORDS | sensitive.PAIRS).items()}).items())


#: Names that hold no word of the tables, though some hold parts of them.
PLAIN = ["report", "goodwill letter", "holiday plan", "compassport", "visage", "the tale", "contraction"]
PHRASES = phrases()
ENDINGS = [".pdf", ".exe", ".DOCX", ".jpg", ".mp3"]

_PICKED = f"""SELECT event_id AS id, event_id // 2 AS n, 'n' || (event_id // 60) || '/docs' AS dir, (event_id * 37) % 90000 AS size, (event_id * 7919) % 20000 * 86400 AS mtime,
  CASE WHEN event_id % 2 = 0 THEN (event_id // 2) % {len(PHRASES)} ELSE {len(PHRASES)} + (event_id // 2) % {len(PLAIN)} END AS nr, ([{", ".join(map(quoted, ENDINGS))}])[1 + event_id // 7 % {len(ENDINGS)}] AS ending FROM events"""
#: A file an event: every second name holds a phrase of the tables.
SENSITIVE_FILES = f"""SELECT id, dir, CASE WHEN n % 3 = 1 THEN upper(phrase) WHEN n % 3 = 2 THEN replace(phrase, ' ', '_') || ' 2019' ELSE phrase END || ending AS name, size::BIGINT AS size, mtime,
  CASE WHEN ending IN ('.pdf', '.DOCX', '.jpg') THEN label END AS sensitive
FROM ({_PICKED}) JOIN (VALUES {values([*PHRASES, *[(p, None) for p in PLAIN]])}) AS w(nr, phrase, label) USING (nr)"""


def sensitive_files(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    i, n = F.col("event_id"), F.expr("event_id div 2")
    phrase = F.when(i % 2 == 0, pick([p for p, _ in PHRASES], n)).otherwise(pick(PLAIN, n))
    spelled = F.when(n % 3 == 1, F.upper("phrase")).when(n % 3 == 2, F.concat(F.replace("phrase", F.lit(" "), F.lit("_")), F.lit(" 2019"))).otherwise(F.col("phrase"))
    rows = S.table(spark, sf, "events").select("event_id", phrase.alias("phrase"))
    folder = F.concat(F.lit("n"), F.expr("event_id div 60").cast("string"), F.lit("/docs"))
    return rows.select(i.alias("id"), folder.alias("dir"), F.concat(spelled, pick(ENDINGS, F.expr("event_id div 7"))).alias("name"), (i * 37 % 90_000).alias("size"), (i * 7919 % 20_000 * 86_400).alias("mtime"))


#: Shapes of names; @ is four digits, # a day.
SHAPES = ["IMG_@.JPG", "DSC0@.jpg", "Screenshot_#-010203.png", "IMG-#-WA@.jpg", "holiday @.jpg", "logo_@.png", "raw@.NEF", "clip@.mp4", "~_@.AAE", "favicon.ico", "Photo 2021-01-02.jpg", "%-06-01 12.00.00.jpg", "notes@.txt", "image.png", "x@.heic"]
FOLDERS = ["trip", "DCIM", "site/assets", "misc"]
PHOTO_FILES = f"""SELECT event_id AS id, 'n' || (event_id // {len(SHAPES) * len(FOLDERS)}) || '/' || ([{", ".join(map(quoted, FOLDERS))}])[1 + event_id // {len(SHAPES)} % {len(FOLDERS)}] AS dir,
  replace(replace(replace(replace(([{", ".join(map(quoted, SHAPES))}])[1 + event_id % {len(SHAPES)}], '@', lpad((event_id // {len(SHAPES)} % 10000)::VARCHAR, 4, '0')), '#', '20230105'), '%', CASE WHEN event_id % 2 = 0 THEN '2019' ELSE '1980' END),
    '~', CASE WHEN event_id // {len(SHAPES)} % 3 = 0 THEN 'Z' ELSE 'IMG' END) AS name, ((event_id * 37) % 20000)::BIGINT AS size, (event_id * 7919) % 20000 * 86400 AS mtime FROM events"""


def photo_files(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    i, turn = F.col("event_id"), F.expr(f"event_id div {len(SHAPES)}")
    name = pick(SHAPES, i)
    for mark, text in (("@", F.lpad((turn % 10_000).cast("string"), 4, "0")), ("#", F.lit("20230105")), ("%", F.when(i % 2 == 0, "2019").otherwise("1980")), ("~", F.when(turn % 3 == 0, "Z").otherwise("IMG"))):
        name = F.replace(name, F.lit(mark), text)
    folder = F.concat_ws("/", F.concat(F.lit("n"), F.expr(f"event_id div {len(SHAPES) * len(FOLDERS)}").cast("string")), pick(FOLDERS, turn))
    return S.table(spark, sf, "events").select(i.alias("id"), folder.alias("dir"), name.alias("name"), (i * 37 % 20_000).alias("size"), (i * 7919 % 20_000 * 86_400).alias("mtime"))


def sensitive_classes(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.classify_sensitive(sensitive_files(spark, sf)).select("id", "sensitive")


def photo_classes(spark: SparkSession, sf: str) -> DataFrame:
    return photos.classify_photos(photo_files(spark, sf), F.lit(NOW)).select("id", "photo")


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    return photos.classify_photos(photo_files(spark, sf), F.lit(NOW))


def photo_plan(spark: SparkSession, sf: str) -> DataFrame:
    return actions.photo_plan(_classed(spark, sf), LAST_YEAR)


def screenshot_plan(spark: SparkSession, sf: str) -> DataFrame:
    return actions.screenshot_plan(_classed(spark, sf), LAST_YEAR)


def archive_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The files dealt to top folders in threes, so that some hold no secret and lie idle."""
    files = sensitive_files(spark, sf).withColumn("dir", F.concat(F.lit("t"), F.expr("id div 3").cast("string")))
    return actions.archive_plan(sensitive.classify_sensitive(files), NOW)


QUERIES = {f.__name__: f for f in (sensitive_classes, photo_classes, photo_plan, screenshot_plan, archive_plan)}
_CLASSED = f"""f AS (SELECT *, lower(regexp_extract(name, '([.][^.]*)$', 1)) AS ext, regexp_replace(name, '[.][^.]*$', '') AS base, ends_with(dir, '/assets') AS asset, ends_with(dir, '/DCIM') AS card FROM ({PHOTO_FILES})),
g AS (SELECT *, ext IN ('.jpg', '.png', '.heic') AS image, ext IN ('.jpg', '.png', '.heic') AND size < 10240 AS tiny, regexp_full_match(base, '(?i)IMG_[0-9]{{4}}|DSC[0-9]{{5}}') AS camera FROM f),
c AS (SELECT *, CASE WHEN ext = '.ico' THEN 'ph:asset'
  WHEN ext = '.aae' THEN CASE WHEN EXISTS (SELECT 1 FROM g o WHERE o.dir = g.dir AND lower(o.base) = lower(g.base) AND o.ext IN ('.jpg', '.png', '.heic', '.nef', '.mp4')) THEN 'ph:side' ELSE 'jB:SC' END
  WHEN ext = '.txt' THEN NULL WHEN asset THEN 'ph:asset' WHEN ext = '.nef' THEN 'ph:cert' WHEN regexp_matches(base, '(?i)^Screenshot_[0-9]{{8}}[-_][0-9]{{6}}') THEN 'ph:screen'
  WHEN regexp_matches(base, '(?i)^(IMG|VID|AUD|PTT)-[0-9]{{8}}-WA[0-9]{{4}}') THEN 'ph:recv' WHEN base = 'image' OR base ILIKE 'logo%' THEN 'ph:asset' WHEN image AND size < 2048 THEN 'ph:asset'
  WHEN regexp_full_match(base, '(19[0-9][0-9]|20[0-9][0-9])-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{2}}') AND left(base, 4) BETWEEN '1995' AND '2026' THEN 'ph:cert' WHEN camera AND card THEN 'ph:cert'
  WHEN ext = '.heic' THEN CASE WHEN card THEN 'ph:cert' ELSE 'ph:likely' END WHEN camera THEN CASE WHEN tiny THEN 'ph:asset' ELSE 'ph:likely' END
  WHEN regexp_matches(base, '(?i)^Photo [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'ph:poss' WHEN card AND NOT tiny THEN 'ph:poss' WHEN tiny THEN 'ph:asset' END AS photo FROM g)"""
ORACLE_SQL = {
    "sensitive_classes": f"SELECT id, sensitive FROM ({SENSITIVE_FILES})",
    "photo_classes": f"WITH {_CLASSED} SELECT id, photo FROM c",
}
ORACLE_SQL["photo_plan"] = f"""WITH {_CLASSED},
d AS (SELECT *, regexp_matches(base, '^2019-06-01 ') AS named, year(make_timestamp(mtime * 1000000)) AS y, month(make_timestamp(mtime * 1000000)) AS m FROM c),
t AS (SELECT *, CASE WHEN named THEN 'Photos/2019/06' WHEN mtime > 0 AND y BETWEEN 1990 AND 2026 THEN printf('Photos/%04d/%02d', y, m) ELSE 'Photos/_Unknown-Date/' || regexp_extract(dir, '([^/]*)$', 1) END AS target,
  CASE WHEN named THEN 'filename' WHEN mtime > 0 AND y BETWEEN 1990 AND 2026 THEN 'mtime' ELSE 'unknown' END AS origin FROM d),
l AS (SELECT dir, lower(base) AS b, min(id) AS lead FROM t WHERE photo IN ('ph:cert', 'ph:likely') GROUP BY ALL)
SELECT x.id, 'photo-consolidation' AS plan_id, 'move' AS op, x.dir || '/' || x.name AS src, t.target || '/' || x.name AS dst, x.size, CASE WHEN x.id = l.lead THEN x.photo || ' · date from ' || t.origin ELSE 'travels with its photo (sidecar/pair)' END AS evidence
FROM t x JOIN l ON l.dir = x.dir AND l.b = lower(x.base) JOIN t ON t.id = l.lead WHERE x.photo IN ('ph:cert', 'ph:likely', 'ph:side')"""
ORACLE_SQL["screenshot_plan"] = f"WITH {_CLASSED} SELECT id, 'screenshots' AS plan_id, 'move' AS op, dir || '/' || name AS src, 'Screenshots/2023/' || name AS dst, size, 'screenshot pattern' AS evidence FROM c WHERE photo = 'ph:screen'"
ORACLE_SQL["archive_plan"] = f"""WITH t AS (SELECT 't' || (id // 3) AS src, max(mtime) AS newest, sum(size)::BIGINT AS size, count(sensitive) AS secrets FROM ({SENSITIVE_FILES}) GROUP BY 1),
y AS (SELECT *, year(make_timestamp(newest * 1000000)) AS y FROM t WHERE secrets = 0 AND {NOW} - newest >= 3 * 365 * 86400)
SELECT 'cold-archive' AS plan_id, 'move' AS op, src, 'Archive/' || y || '/' || src AS dst, size, 'whole folder idle since ' || y AS evidence FROM y WHERE y BETWEEN 1990 AND 2025"""
