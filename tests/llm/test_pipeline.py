"""The pipeline against a brute-force reading of each stage's own input."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import mixing
from siltstone.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    start, known, single, mixed, packed = ([r.asDict() for r in d.collect()] for d in seen)
    assert all(d.columns == columns for d in seen[:-1])
    # clean documents stay, those without a letter go
    assert {r["doc_id"] for r in known} == {r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or "")}
    # one document of each component of five-word likeness 0.8 stays, that with the least id
    runs = {}
    for r in known:
        w = (r["text"] or "").lower().split()
        runs[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in runs}
    changed = True
    while changed:
        changed = False
        for a in runs:
            for b in runs:
                if root[a] != root[b] and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert sorted(r["doc_id"] for r in single) == sorted(i for i in root if root[i] == i)
    # the mixture takes each document once, no more than its leaf's budget and one document over
    assert len({r["doc_id"] for r in mixed}) == len(mixed) and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single}
    tokens = seen[3].agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    whole = seen[2].agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    assert tokens >= 0.9 * whole - len(single)
    # packing holds every token of what is left
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed}
    held = {}
    for r in packed:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == expected


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"empty-{name}")
    assert docs.count() == 0


def test_odd_documents_pass_through_the_stages(spark):
    """Null ids and texts, repeated rows, a very long text and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(None, "no id here at all", "en", "src1"), (5_000, None, "en", None), (5_001, "", None, "src2"), (5_002, "word " * 60_000, "en", "src3"), (5_003, "a plain text of some words", "en", "src3"), (5_003, "a plain text of some words", "en", "src3")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for name in ("_own", "_of", "_id", "_rows", "key", "score", "_lang_pred", "id", "tokens"):
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = written(stages["language"](spark, docs, SF), "odd-language")
    assert known.columns == columns
    assert {r.doc_id for r in known.filter("doc_id >= 5000").collect()} == {5_002, 5_003}
    single = written(stages["near_duplicates"](spark, known, SF), "odd-single")
    assert single.columns == columns and single.filter("doc_id = 5003").count() == 1 and single.filter("doc_id = 5002").count() == 1
    mixed = written(stages["mixture"](spark, single, SF), "odd-mixture")
    assert mixed.columns == columns
    packed = stages["packing"](spark, mixed, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("doc_id is not null").collect()
    assert all(r.n == r.m for r in packed) and len(packed) == mixed.filter("doc_id is not null").select("doc_id").distinct().count()
