"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, dialogue, divergence, iblt, langid, mixing, mtree, packing, sharding, simhash, tokens, urls, warc
from .common import scratch_path, table, written

SHARDS = 8
RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]
#: Target weights of the mixing query's tree: domain, then language, then source within each.
MIX_WEIGHTS = {
    "domain": {"crawl": 4.0, "reference": 3.0, "forum": 3.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {"src0": 2.0},
}
MIX_SEED = 20
#: The mixing query asks for this share of the corpus's tokens, at most so many epochs of a source.
MIX_SHARE, MIX_EPOCHS = 0.8, 3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def source_domain(source: Column) -> Column:
    """src0 is the crawl; other sources alternate between reference and forum by their number."""
    number = F.try_element_at(F.regexp_extract_all(F.coalesce(source.cast("string"), F.lit("")), F.lit(r"([0-9])$")), F.lit(1)).cast("int")
    return F.when(source == "src0", "crawl").when(number % 2 == 1, "reference").otherwise("forum")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), path)
    records = written(warc.digest_payloads(warc.read_archives(spark, path)), "warc-records")
    captures = written(warc.assemble(records), "captures")
    met = warc.resolve_revisits(captures)
    revisit = F.col("response.type") == "revisit"
    return met.select(
        warc.source_key(F.col("metadata.payload")).cast("long").alias("page_id"),
        F.when(revisit, F.col("origin.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("origin.payload_sha256")).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("origin.key").cast("long")).alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").isNotNull().alias("has_request"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, url, octet_length(body)::BIGINT AS n, sha256(body) AS digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
  replace(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS target_uri,
  true AS has_request
FROM g
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.assign_shards(docs, "doc_id", SHARDS, order=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.jump_shard(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


def _jump_sql(source: str, shards: int, out: str) -> str:
    """CTEs jump_0 .. jump_n: one step of the generator each, over (k, b, j) of every distinct key."""
    ctes = [f"{out}_0 AS (SELECT key, ('0x' || substr(md5(key), 1, 16))::UBIGINT::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM {source})"]
    for i in range(shards):
        moved = f"((k * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT)"
        ctes.append(
            f"{out}_{i + 1} AS (SELECT key, {moved} AS k, CASE WHEN j < {shards} THEN j ELSE b END AS b, "
            f"CASE WHEN j < {shards} THEN floor((j + 1) * (2147483648.0::DOUBLE / (({moved} // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT ELSE j END AS j FROM {out}_{i})"
        )
    return ",\n".join(ctes)


OP2_SQL = f"""
WITH crc_start AS (
  SELECT list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v::UINTEGER, [i::UINTEGER for i in range(0, 8)]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UINTEGER) ELSE c // 2 END)) AS t
), keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc AS (
  SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UINTEGER)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::UINTEGER)::BIGINT AS text_crc32
  FROM keyed, crc_start
), keys AS (SELECT DISTINCT key FROM keyed),
{_jump_sql("keys", SHARDS, "jump")},
{_jump_sql("keys", SHARDS + 1, "grown")},
placed AS (
  SELECT c.*, a.b::INTEGER AS shard, g.b::INTEGER AS grown_shard, ('0x' || substr(md5(c.key), 17, 8))::UBIGINT % 1024 AS block
  FROM crc c JOIN jump_{SHARDS} a USING (key) JOIN grown_{SHARDS + 1} g USING (key)
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM placed
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


TOKEN_LIMIT = 512


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, source_domain(F.col("source")), MIX_WEIGHTS, MIX_SEED, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return mixed.select("doc_id", "lang", "source", F.col("mix_domain").alias("domain"), F.col("mix_epoch").alias("epoch"), F.col("mix_budget").alias("budget"))


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS[level].items()) + " ELSE 1.0 END::DOUBLE"


def _share_sql(name: str, source: str, parent: str, level: str) -> str:
    """Water-filling of one level; every weight in MIX_WEIGHTS and the default are above zero."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY supply / weight, {level}"
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM {source}
), {name}_b AS (
  SELECT *, before + supply / weight * onward <= parent_budget AS full_up FROM {name}_a
), {name} AS (
  SELECT *, CASE WHEN full_up THEN supply ELSE least(supply,
    greatest(0, parent_budget - coalesce(sum(CASE WHEN full_up THEN supply END) OVER ({part}), 0)) * weight / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({part})) END AS own
  FROM {name}_b
)"""


OP7_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, lang AS lang0, source AS source0,
    CASE WHEN source = 'src0' THEN 'crawl' WHEN try_cast(right(source, 1) AS INTEGER) % 2 = 1 THEN 'reference' ELSE 'forum' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {MIX_EPOCHS} AS supply FROM docs GROUP BY ALL
), top AS (
  SELECT domain, sum(supply) AS supply, {_weight_sql("domain")} AS weight, least((SELECT sum(supply) FROM leaves), floor((SELECT sum(tokens) FROM leaves) * {MIX_SHARE}::DOUBLE)) AS parent_budget
  FROM leaves GROUP BY domain
), {_share_sql("d", "top", "", "domain")},
mid AS (
  SELECT l.domain, l.lang, sum(l.supply) AS supply, {_weight_sql("lang").replace("CASE lang", "CASE l.lang")} AS weight, d.own AS parent_budget
  FROM leaves l JOIN d USING (domain) GROUP BY l.domain, l.lang, d.own
), {_share_sql("m", "mid", "domain", "lang")},
low AS (
  SELECT l.domain, l.lang, l.source, l.tokens, l.supply, {_weight_sql("source").replace("CASE source", "CASE l.source")} AS weight, m.own AS parent_budget
  FROM leaves l JOIN m ON l.domain = m.domain AND l.lang = m.lang
), {_share_sql("s", "low", "domain, lang", "source")},
plan AS (
  SELECT domain, lang, source, tokens AS leaf_tokens, floor(own + 1e-6)::BIGINT AS budget, floor(own + 1e-6)::BIGINT // tokens AS epochs FROM s
), keyed AS (
  SELECT docs.*, budget, epochs, budget - epochs * leaf_tokens AS rest, md5('{MIX_SEED}:' || epochs || ':' || id) AS k FROM docs JOIN plan USING (domain, lang, source)
), ranked AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, k), 0) AS place FROM keyed
), chosen AS (
  SELECT *, epochs + CASE WHEN place < rest THEN 1 ELSE 0 END AS times FROM ranked
)
SELECT doc_id, lang0 AS lang, source0 AS source, domain, unnest(range(0, times))::INTEGER AS epoch, budget FROM chosen
"""


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = langid.fit(docs.filter(~test).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", test.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op11_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


OP11_SQL = """
WITH usual AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), vectors AS (
  SELECT * FROM usual WHERE len(v) = (SELECT len(v) FROM usual GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    fixed = dialogue.repair(dialogue.damage(rows))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    met = every.join(fixed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    sums = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("id").alias("conv_id"), *sums, F.coalesce("audit", empty).alias("audit"), F.coalesce("repaired_sha256", F.sha2(empty, 256)).alias("repaired_sha256"))


def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    """A state after one more edit; null where the state was not reached."""
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def _op12_sql() -> str:
    """Dynamic programming over a conversation's rows, one state struct (cost, audit, lines) for each place in the pattern."""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    user = "list_min([" + ", ".join(["s2", *(_edit(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3"))]) + "])"
    go = {s: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edit(s, '2 + cut', 'R', chr(39) + 'user:' + chr(39) + ' || text')} END" for s in ("x0", "x1", "x3")}
    say = {s: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = '{i}' THEN {_edit(s, 'cut', 'K', 'role || ' + chr(39) + ':' + chr(39) + ' || text')} END" for s, i in (("x0", "u"), ("x1", "u"), ("x3", "u"), ("x2", "a"))}
    system = f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = 's' THEN {_edit('x0', 'cut', 'K', 'role || ' + chr(39) + ':' + chr(39) + ' || text')} END"
    answer = f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edit('x2', '2 + cut', 'R', chr(39) + 'assistant:' + chr(39) + ' || text')} END"
    cut = {i: _edit(f"x{i}", "3", "D") for i in range(4)}
    return f"""
WITH RECURSIVE crc_start AS (
  SELECT list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v::UINTEGER, [i::UINTEGER for i in range(0, 8)]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UINTEGER) ELSE c // 2 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), crc AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UINTEGER)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::UINTEGER) % 20 AS k FROM keyed, crc_start
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, (SELECT unnest([0, 1]) AS copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1, 's') AS final FROM damaged
), judged AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM ordered
), turns AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM judged),
dp AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {cut[0]} AS s0, list_min([{cut[1]}, {system}]) AS s1,
    list_min([{cut[2]}, {", ".join(say[s] for s in ("x0", "x1", "x3"))}, {", ".join(go.values())}]) AS s2,
    list_min([{cut[3]}, {say["x2"]}, {answer}]) AS s3
  FROM (SELECT *, list_min([s3, {_edit("x2", "2", "I", "'assistant:'")}]) AS x3 FROM (
    SELECT o.*, s0 AS x0, s1 AS x1, {user} AS x2, s3 FROM dp d JOIN turns o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.n = d.n + 1))
), ended AS (
  SELECT conv_id, list_min([s0, s3, {_edit("x2", "2", "I", "'assistant:'")}]) AS e
  FROM (SELECT *, {user} AS x2 FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(array_to_string(e.e.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP12_SQL = _op12_sql()


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _share_of(n: str, total: str) -> str:
    return f"1 + 1000000000::HUGEINT * ({n} + 1) // ({total} + v)"


OP13_SQL = f"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
said AS (SELECT lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
of_group AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
of_lang AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share_of("coalesce(c.n, 0)", "coalesce(t.total, 0)")} AS p, {_share_of("l.n", "l.total")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang) JOIN of_lang l ON l.lang = g.lang AND l.term = k.term
  LEFT JOIN of_group t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_sharding, op3_fingerprints, op4_urls, op5_tokens, op6_packing, op7_mixing, op8_langid, op9_simhash, op10_ann, op11_mtree, op12_dialogue, op13_divergence)}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_sharding": OP2_SQL, "op7_mixing": OP7_SQL, "op11_mtree": OP11_SQL, "op12_dialogue": OP12_SQL, "op13_divergence": OP13_SQL}
