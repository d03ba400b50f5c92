"""The corpus pipeline: language ID, near-duplicates, mixing, packing, each over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, mixing, packing, simhash
from siltstone.llm.common import fresh, written
from siltstone.llm.queries import MIX_SEED, MIX_WEIGHTS, source_domain, tokenizer_path

#: A document whose predicted language is less sure than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3
#: The mixture takes up to this share of the tokens that reach it, each document at most once.
MIX_SHARE = 0.9
#: Near copies share this much of their runs of so many words (op9 has a contract of its own).
NEAR_LIKENESS, NEAR_WORDS = 0.8, 5
#: Bytes of ids that a worker keeps while it packs: executors are fuller here than where packing runs alone.
PACK_CACHE_BYTES = 40 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language. Fitted on labelled rows of its own input; a document
    without a label is judged by its text like any other. If nothing is labelled, nothing can be
    told apart and only documents without a letter go."""
    model = langid.fit(docs)
    names = (fresh(docs, "_lang_pred"), fresh(docs, "_lang_score"))
    judged = langid.predict(docs, model, names=names)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return judged.filter((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates. Rows with null or
    repeated ids take part; documents without a word are alike; of rows equal in id and text one stays."""
    return simhash.deduplicate(docs, least=NEAR_LIKENESS, words_per_shingle=NEAR_WORDS).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once. Null languages and sources are leaves of
    their own; a null or empty text counts one token; rows of one id are taken or left together."""
    names = tuple(fresh(docs, n) for n in ("mix_domain", "mix_epoch", "mix_budget"))
    mixed = mixing.mix(docs, source_domain(F.col("source")), MIX_WEIGHTS, MIX_SEED, names=names, budget_share=MIX_SHARE, max_epochs=1)
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document that is left, in sequences of 2,048. A null or empty text is its end
    token alone; repeated rows are packed each."""
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), cache_bytes=PACK_CACHE_BYTES)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", pack),
]

#: SQL expresses neither the fitted language model nor the tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
