"""Queries of romanised text, trees by id and sync records over the shared tables, with their DuckDB SQL.

Native words are the letters of part names put through one table of letters, so every letter class
that the rules know occurs in many places of many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import markup, nodes
from siltstone.sources import tables as S

#: Letters of the part types and what they become in the native script.
LETTERS, SIGNS = "ABCDEGHIKLMNOPRSTU", "ाबटडेजहिकलमनोपरसढु"
_NATIVE = f"translate(upper(p_type), '{LETTERS}', '{SIGNS}')"
#: The same names as roman text, with capitals where the type has letters of a few kinds.
_ROMAN = "translate(lower(p_type), 'tdrl', 'TdRl')"


def _native(c: str = "p_type") -> Column:
    return F.translate(F.upper(c), LETTERS, SIGNS)


def _roman(c: str = "p_type") -> Column:
    return F.translate(F.lower(c), "tdrl", "TdRl")


_WORDS = f"""w AS (SELECT p_partkey AS id, {_NATIVE} AS native, {_ROMAN} AS shown FROM part),
t AS (SELECT *, list_filter(regexp_split_to_array(native, '\\s+'), lambda x: regexp_matches(x, '[ऀ-ॣ॰-ॿ]')) AS own, regexp_extract_all(shown, '[A-Za-z]+') AS roman FROM w)"""


def retroflex_counts(spark: SparkSession, sf: str) -> DataFrame:
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), _native().alias("native"), _roman().alias("shown"))
    return part.select("id", markup.retroflex_native(F.col("native")).cast("long").alias("native"), markup.retroflex_marks(F.col("shown")).cast("long").alias("marks"))


def accent_lint(spark: SparkSession, sf: str) -> DataFrame:
    part = S.table(spark, sf, "part")
    items = part.select(F.col("p_partkey").alias("id"), F.lit(True).alias("keep"), F.lower("p_brand").alias("headword"), _native("p_brand").alias("term"), _roman().alias("sent_display"), _native().alias("sent_native"))
    return markup.accent_lint(items).filter("rule <> 'target_not_marked'")


def sentence_caps(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), markup.sentence_caps(_roman(), _native()).alias("shown"))


def target_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.regexp_extract(F.lower("text"), "([a-z]+)[^a-z]*$", 1), F.lit("aa")).alias("head"))
    return rows.select("id", markup.target_word(F.col("text"), F.col("head")).cast("long").alias("place")).filter("place is not null")


def deck_spellings(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.translate(F.lower("p_type"), "adeghiou", "āṭēgśiōṁ")
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(F.split(iso, " "), markup.deck_spelling), " ").alias("spelled"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return S.table(spark, sf, "part").select(k.alias("id"), F.when(k > 1, F.expr("(p_partkey + 4) div 6")).alias("parent"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), k.cast("string")).alias("name"))


_TREE = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN (p_partkey + 4) // 6 END AS parent, replace(p_brand, '#', '') || '_' || p_partkey AS name FROM part),
p AS (SELECT id, name AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || '/' || n.name, p.depth + 1 FROM p JOIN n ON n.parent = p.id)"""


def node_paths(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.folder_paths(_tree(spark, sf)).select("id", "path", F.col("depth").cast("long").alias("depth"))


def node_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    reach = nodes.members(_tree(spark, sf))
    return reach.groupBy("ancestor").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"))


def _varint(n: Column, size: int = 5) -> Column:
    """The number as bytes in hex, in a form of fixed length that readers of varints take too."""
    sevens = [F.shiftright(n.cast("long"), 7 * i).bitwiseAND(F.lit(127)) for i in range(size)]
    return F.concat(*[F.lpad(F.hex(b + (128 if i < size - 1 else 0)), 2, "0") for i, b in enumerate(sevens)])


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records of a store: file, size, digest of the language and source, time."""
    size, digest = F.coalesce(F.octet_length("text"), F.lit(0)), F.sha2(F.concat_ws("/", "lang", "source").cast("binary"), 256)
    content = F.concat(F.lit("0a20"), digest)
    file = F.concat(F.lit("10"), _varint(size), F.lit("3222"), content)
    whole = F.concat(F.lit("22"), _varint(F.length(file) / 2), file, F.lit("68"), _varint(F.col("doc_id") + 1))
    return S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("parent"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.unhex(whole).alias("metadata"), F.lit(True).alias("latest"))


def sync_entries(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.sync_entries(_store(spark, sf)).select("id", "is_file", "size", "hash", "mtime", "poisoned")


_STARTS = "len(list_filter(range(1, least(length(h), length(w)) + 1), lambda i: left(h, i) = left(w, i)))"
_LOW, _MEDIAL = "aāiīuūeēoō", "kgcjṭḍtdnpbmyrlvśṣshṅñṇzfqxṛ"


def _spelled_sql(word: str) -> str:
    out = f"replace(replace(regexp_replace({word}, 'ṁ([pbm])', 'm\\1', 'g'), 'ṁ', 'n'), 'jñ', 'gy')"
    out = f"regexp_replace({out}, '^(.+[{_MEDIAL}h])a$', '\\1')"
    for _ in range(4):
        out = f"regexp_replace({out}, '^(.*[{_LOW}][{_MEDIAL}]h?)a([{_MEDIAL}]h?[{_LOW}])', '\\1\\2')"
    for a, b in (("ṭh", "Th"), ("ṭ", "T"), ("c", "ch"), ("ś", "sh"), ("ā", "aa"), ("ē", "e"), ("ō", "o")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


QUERIES = {f.__name__: f for f in (retroflex_counts, accent_lint, sentence_caps, target_words, deck_spellings, node_paths, node_subtrees, sync_entries)}
ORACLE_SQL = {
    "retroflex_counts": f"WITH {_WORDS} SELECT id, length(regexp_replace(native, '[^टठडढ]', '', 'g')) AS native, len(regexp_extract_all(shown, '[TDR]')) AS marks FROM t",
    "accent_lint": f"""
WITH {_WORDS}, b AS (SELECT t.*, translate(upper(p_brand), '{LETTERS}', '{SIGNS}') AS term FROM t JOIN part ON p_partkey = id),
d AS (SELECT id, -length(regexp_replace(term, '[^टठडढ]', '', 'g')) AS x FROM b UNION ALL
  SELECT id, unnest(list_transform(range(1, len(own) + 1), lambda i: len(regexp_extract_all(roman[i], '[TDR]')) - length(regexp_replace(own[i], '[^टठडढ]', '', 'g')))) FROM b WHERE len(own) = len(roman))
SELECT DISTINCT id, CASE WHEN x > 0 THEN 'retroflex_over' ELSE 'retroflex_under' END AS rule FROM d WHERE x <> 0""",
    "sentence_caps": f"""
WITH {_WORDS}, e AS (SELECT id, unnest(range(1, len(roman) + 1)) AS i, own, roman FROM t),
j AS (SELECT id, i, roman[i] AS r, CASE WHEN len(own) = len(roman) OR i = 1 THEN own[i] END AS n FROM e),
f AS (SELECT id, i, CASE WHEN n IS NULL THEN r ELSE (CASE WHEN left(r, 1) IN ('T', 'D', 'R') AND regexp_extract(n, '[क-ह]') IN ('ट', 'ठ', 'ड', 'ढ', 'ण') THEN left(r, 1) ELSE lower(left(r, 1)) END)
  || CASE WHEN regexp_matches(n, '[टठडढ]') THEN substr(r, 2) ELSE translate(substr(r, 2), 'TDR', 'tdr') END END AS w FROM j)
SELECT id, string_agg(w, ' ' ORDER BY i) AS shown FROM f GROUP BY id""",
    "target_words": f"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Za-z]+') AS ws, [regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1) || 'aa'] AS hs FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, hs, unnest(ws) AS raw, unnest(range(0, len(ws))) AS place FROM d), x AS (SELECT id, place, lower(raw) AS w, unnest(hs) AS h FROM e),
s AS (SELECT *, {_STARTS} AS n FROM x), g AS (SELECT id, place, max(CASE WHEN h = w THEN 1000 WHEN n >= CASE WHEN length(h) <= 5 THEN 3 ELSE 4 END AND n >= length(h) - 4 OR n >= 2 AND n >= least(length(h), length(w)) - 1 THEN n ELSE 0 END) AS score FROM s GROUP BY ALL)
SELECT id, place FROM g WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, place) = 1""",
    "deck_spellings": f"""
WITH e AS (SELECT p_partkey AS id, unnest(string_split(translate(lower(p_type), 'adeghiou', 'āṭēgśiōṁ'), ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part)
SELECT id, string_agg({_spelled_sql("w")}, ' ' ORDER BY i) AS spelled FROM e GROUP BY id""",
    "node_paths": f"WITH RECURSIVE {_TREE} SELECT id, path, depth::BIGINT AS depth FROM p",
    "node_subtrees": """
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN (p_partkey + 4) // 6 END AS parent FROM part),
c AS (SELECT id AS ancestor, id, 0 AS down FROM n UNION ALL SELECT c.ancestor, n.id, c.down + 1 FROM c JOIN n ON n.parent = c.id)
SELECT ancestor, count(*) AS nodes, max(down)::BIGINT AS deepest FROM c GROUP BY 1""",
    "sync_entries": """
WITH d AS (SELECT doc_id AS id, coalesce(octet_length(encode(text)), 0)::BIGINT AS size, sha256(concat_ws('/', lang, source)) AS hash FROM documents)
SELECT id, true AS is_file, size, hash, id + 1 AS mtime, min(size) OVER (PARTITION BY hash) <> max(size) OVER (PARTITION BY hash) AS poisoned FROM d""",
}
