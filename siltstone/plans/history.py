"""Queries of runs over time, closed sessions and settings of unknown shape, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import findings, reconcile, records, rules
from siltstone.sources import memo, scratch
from siltstone.sources import tables as S
from siltstone.streaming import incremental


def finding_states(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are quarters, findings the customers (in 97 groups) with an order, acceptances come from customers."""
    orders, k = S.table(spark, sf, "orders"), F.col("c_custkey")
    found = orders.select(F.trunc("o_orderdate", "quarter").alias("run"), (F.col("o_custkey") % 97).alias("key")).filter("key % 5 <> month(run) % 4")
    since = F.date_add(F.lit("1992-01-01").cast("date"), (k * 37 % 2_400).cast("int"))
    accepted = S.table(spark, sf, "customer").filter(k % 3 == 0).select((k % 97).alias("key"), since.alias("run"), F.when(k % 4 != 0, F.date_add(since, (k * 11 % 900).cast("int"))).alias("expires"))
    return findings.states_of_runs(found, accepted).withColumn("run", F.col("run").cast("string"))


def settled_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of ten files: the sessions of changes that have closed."""
    path = f"{sf}/events.parque[t]"  # a pattern: the table may be a file or a folder
    stream = spark.readStream.schema(S.table(spark, sf, "events").schema).parquet(path).select((F.col("user_id") % 10).alias("file"), "ts")
    closed = incremental.run_available(incremental.settled_sessions(stream, "file", "ts"), f"{scratch.root(spark)}/siltstone/settled-{uuid.uuid4().hex}")
    return closed.select("file", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "changes")


MARKER = "/old-loop/"
_OURS, _OTHER = '{"command":"run /old-loop/a","n":1}', '{"command":"say hi"}'
#: Settings of several shapes around an event's properties P: what goes in, and what must come out.
SHAPES = [
    (f'{{"hooks":{{"Stop":[{{"hooks":[{_OURS},{_OTHER}],"matcher":P}}]}},"other":P}}', f'{{"hooks":{{"Stop":[{{"hooks":[{_OTHER}],"matcher":P}}]}},"other":P}}'),
    (f'{{"hooks":{{"Stop":[{{"hooks":[{_OURS}]}}],"Start":P}},"other":[P,1]}}', '{"hooks":{"Start":P},"other":[P,1]}'),
    (f'{{"hooks":{{"Stop":[{{"hooks":[{_OURS}]}}]}},"other":{{"a":P}}}}', '{"other":{"a":P}}'),
    (f'{{"hooks":{{"Stop":[P,"text",{{"hooks":"no list"}},{{"hooks":[P,3,{_OURS}]}}]}}}}', '{"hooks":{"Stop":[P,"text",{"hooks":"no list"},{"hooks":[P,3]}]}}'),
    (f'{{"hooks":[{_OURS}],"x":P}}', None),
    ('[P]', None),
    ('{"hooks": {"Stop": [ ]}, "z": P}', None),
    ('no json P', None),
]


def kept_settings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    text = F.replace(F.element_at(F.array(*[F.lit(a) for a, _ in SHAPES]), (i % len(SHAPES) + 1).cast("int")), F.lit("P"), F.replace("props", F.lit(" "), F.lit("")))
    return S.table(spark, sf, "events").select(i.alias("id"), rules.kept_settings(text, MARKER).alias("settings"))


def _where(spark: SparkSession, sf: str) -> tuple:
    from siltstone.plans.queries import _quarantine  # its inputs are those of the other quarantine queries

    inside, outside = _quarantine(spark, sf)
    i = F.col("id")
    classed = reconcile.quarantine_classes(inside, outside).withColumn("dup_dir", F.concat("dir_rel", F.lit("/Duplicates")))
    keeper = F.when(i % 5 == 0, "../x").when(i % 5 == 1, "/abs").when(i % 5 < 4, F.concat("dir_rel", F.lit("/doc_"), (i + 1).cast("string"), F.lit(".txt")))
    manifest = classed.filter("id % 2 = 0").select("dup_dir", F.col("name").alias("stored_as"), keeper.alias("keeper"))
    asked = S.table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 0, ".gone").otherwise(".txt")).alias("name"))
    return classed, outside, manifest, asked


def where_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document's name is asked for; most are not set aside."""
    classed, outside, manifest, asked = _where(spark, sf)
    return reconcile.where(classed, outside, manifest, outside, asked)


def field_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as records whose fields are in turn plain, marked up, accented, native or blank."""
    k = F.col("p_partkey")
    odd = F.array(*[F.lit(x) for x in ODD_FIELDS])
    field = lambda n: F.coalesce(F.nullif(F.element_at(odd, ((k * (2 * n + 1) + n) % (len(ODD_FIELDS) * 2) + 1).cast("int")), F.lit("-")), F.col("p_name"))
    names = ["term", "headword", "gloss", "pos", "sent_display", "sent_native", "sent_en"]
    odd = F.concat(odd, F.array(*[F.lit("-")] * len(ODD_FIELDS)))
    rank = F.when(k % 9 == 0, "x").otherwise((k % 300).cast("string"))
    return records.field_lint(S.table(spark, sf, "part").select(k.alias("id"), rank.alias("rank"), *[field(n).alias(c) for n, c in enumerate(names)]))


ODD_FIELDS = ["<b>word</b>", "a &amp; b", "wørd", "राम", " ", "plain – dash", "fine", "ok &#39; so"]


def delivery_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Decks are sources; what the labels know is delivered, and sources with an odd number only up to the middle."""
    docs = S.table(spark, sf, "documents").select(F.col("source").alias("deck"), F.col("doc_id").alias("rank"))
    there = docs.join(S.table(spark, sf, "labels").select(F.col("doc_id").alias("rank")).distinct(), "rank", "left_semi")
    late = F.col("deck").rlike("[13579]$")
    return records.order_guard(docs.filter(~late | (F.col("rank") > docs.count())).unionByName(docs.filter(late).withColumn("rank", F.col("rank") + 10**6)), there, "deck")


def memo_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over all documents, of which every seventh changed between them: which digests the second run read."""
    name = f"memo_{uuid.uuid4().hex}"
    memo.create(spark, name, f"{scratch.root(spark)}/siltstone/{name}")
    texts = S.table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_id")
    read = lambda files: files.select("path").join(texts.select("path", F.col("digest").alias("hash")), "path")
    first = texts.select("path", "size", F.lit(1).cast("long").alias("mtime_ns"))
    memo.digests(first, name, read)
    second = texts.select("path", "size", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long").alias("mtime_ns"))
    out = scratch.kept(memo.digests(second, name, read), "memo-second")
    third = memo.digests(second, name, read).filter("fresh").count()
    spark.sql(f"DROP TABLE {name}")
    return out.select("path", "hash", "fresh", F.lit(third).alias("read_again"))


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


QUERIES = {f.__name__: f for f in (finding_states, settled_files, kept_settings, where_report, field_lint, delivery_guards, memo_runs)}
ORACLE_SQL = {
    "finding_states": """
WITH f AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS run, o_custkey % 97 AS key FROM orders WHERE (o_custkey % 97) % 5 <> month(date_trunc('quarter', o_orderdate)) % 4),
a AS (SELECT c_custkey % 97 AS key, DATE '1992-01-01' + (c_custkey * 37 % 2400)::INTEGER AS since, CASE WHEN c_custkey % 4 <> 0 THEN DATE '1992-01-01' + (c_custkey * 37 % 2400)::INTEGER + (c_custkey * 11 % 900)::INTEGER END AS expires FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT run, lag(run) OVER (ORDER BY run) AS last, lead(run) OVER (ORDER BY run) AS next FROM (SELECT DISTINCT run FROM f)),
v AS (SELECT f.run, f.key, a.since, a.expires FROM f LEFT JOIN a ON a.key = f.key AND a.since <= f.run QUALIFY row_number() OVER (PARTITION BY f.run, f.key ORDER BY a.since DESC, a.expires DESC NULLS LAST) = 1)
SELECT v.run::VARCHAR AS run, key, CASE WHEN since IS NOT NULL THEN CASE WHEN expires IS NULL OR expires >= v.run THEN 'ACCEPTED' ELSE 'REGRESSION' END WHEN EXISTS (SELECT 1 FROM f p WHERE p.run = r.last AND p.key = v.key) THEN 'STILL-OPEN' ELSE 'NEW' END AS state FROM v JOIN r USING (run)
UNION ALL SELECT r.next::VARCHAR, f.key, 'FIXED' FROM f JOIN r USING (run) WHERE r.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f n WHERE n.run = r.next AND n.key = f.key)""",
    "settled_files": """
WITH e AS (SELECT user_id % 10 AS file, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 120 SECONDS THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT file, ts, sum(starts) OVER (PARTITION BY file ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT file, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS changes FROM s GROUP BY file, n
HAVING max(ts) + INTERVAL 120 SECONDS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
    "where_report": """
WITH e AS (SELECT doc_id AS id, source || '/doc_' || doc_id || '.txt' AS rel, source AS dir_rel, 'doc_' || doc_id || '.txt' AS name, octet_length(encode(text))::BIGINT AS size, CASE WHEN doc_id % 11 = 0 THEN left(sha256(text), 2) ELSE sha256(text) END AS hash FROM documents),
q AS (SELECT * FROM e WHERE id % 7 = 0), o AS (SELECT * FROM e WHERE id % 7 <> 0), poison AS (SELECT hash FROM e GROUP BY hash HAVING count(DISTINCT size) > 1),
k AS (SELECT q.*, CASE WHEN hash IN (SELECT hash FROM poison) THEN 'poisoned' WHEN hash IN (SELECT hash FROM o) THEN 'ok' WHEN size IN (SELECT size FROM o WHERE hash IN (SELECT hash FROM poison)) THEN 'inconclusive' ELSE 'orphan' END AS verdict,
  CASE WHEN id % 2 = 0 THEN CASE WHEN id % 5 = 0 THEN '../x' WHEN id % 5 = 1 THEN '/abs' WHEN id % 5 < 4 THEN dir_rel || '/doc_' || (id + 1) || '.txt' END END AS keeper FROM q),
a AS (SELECT DISTINCT 'doc_' || doc_id || CASE WHEN doc_id % 50 = 0 THEN '.gone' ELSE '.txt' END AS name FROM documents WHERE doc_id % 3 = 0),
t AS (SELECT hash, count(*) AS total, array_to_string((list(rel ORDER BY rel))[1:5], '|') AS copies FROM o GROUP BY hash)
SELECT CASE verdict WHEN 'orphan' THEN 0 WHEN 'poisoned' THEN 1 WHEN 'inconclusive' THEN 3 ELSE 5 END AS severity, rel AS file, verdict, size, coalesce(total, 0) AS total, coalesce(copies, '') AS copies, keeper,
  CASE WHEN keeper IS NULL THEN NULL WHEN keeper LIKE '/%' OR keeper LIKE '../%' THEN 'unsafe-path' WHEN keeper IN (SELECT rel FROM o) THEN 'present' ELSE 'missing' END AS keeper_status
FROM k LEFT JOIN t USING (hash) WHERE name IN (SELECT name FROM a)
UNION ALL SELECT 10, name, 'not-found', NULL, NULL, NULL, NULL, NULL FROM a WHERE name NOT IN (SELECT name FROM q)""",
    "field_lint": f"""
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '1' END AS rank, {", ".join(f"coalesce(({_strings(ODD_FIELDS)})[1 + (p_partkey * {2 * n + 1} + {n}) % {2 * len(ODD_FIELDS)}], p_name) AS {c}" for n, c in enumerate(["term", "headword", "gloss", "pos", "sent_display", "sent_native", "sent_en"]))} FROM part),
f AS (UNPIVOT r ON term, headword, gloss, pos, sent_display, sent_native, sent_en INTO NAME field VALUE v)
SELECT id, 'rank' AS field, 'empty_field' AS rule FROM r WHERE rank = 'x'
UNION ALL SELECT id, field, 'empty_field' FROM f WHERE trim(v) = '' AND field IN ('term', 'headword', 'gloss', 'pos')
UNION ALL SELECT id, field, 'raw_html' FROM f WHERE field <> 'pos' AND regexp_matches(v, '[<>]|&[a-z]{{2,8}};|&#[0-9]+;')
UNION ALL SELECT id, field, 'native_leak' FROM f WHERE field IN ('headword', 'sent_display', 'gloss', 'sent_en') AND regexp_matches(v, '[ऀ-ॣ॰-ॿ]')
UNION ALL SELECT id, field, 'non_ascii' FROM f WHERE field IN ('headword', 'sent_display', 'gloss', 'sent_en') AND regexp_matches(v, '[^\\x00-\\x7F’–—]')""",
    "delivery_guards": """
WITH d AS (SELECT source AS deck, doc_id AS rank FROM documents), t AS (SELECT * FROM d WHERE rank IN (SELECT doc_id FROM labels)),
i AS (SELECT deck, CASE WHEN regexp_matches(deck, '[13579]$') THEN rank + 1000000 ELSE rank END AS rank FROM d),
l AS (SELECT deck, min(rank) AS lowest FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.deck = i.deck AND t.rank = i.rank) GROUP BY 1), h AS (SELECT deck, max(rank) AS highest FROM t GROUP BY 1)
SELECT l.deck, lowest, highest, coalesce(lowest < highest, false) AS refused FROM l LEFT JOIN h USING (deck)""",
    "memo_runs": "SELECT 'doc_' || doc_id AS path, sha256(text) AS hash, doc_id % 7 = 0 AS fresh, 0::BIGINT AS read_again FROM documents",
    "kept_settings": f"SELECT event_id AS id, replace(({_strings([b or a for a, b in SHAPES])})[1 + event_id % {len(SHAPES)}], 'P', replace(props, ' ', '')) AS settings FROM events",
}
