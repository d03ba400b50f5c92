"""Token counts by a two-tier lookup on the map side.

A text falls into pieces at each lone space or newline between two other characters. A byte-level
tokenizer's own pre-token pattern always starts a new pre-token there, so the pieces' counts add up
to the whole text's count, whatever a piece holds (special strings hold no space). Where white space
comes in runs, the text is cut only at its lone spaces. Piece lengths come from

1. a broadcast table of frequent pieces (`tier_size` strings and one small integer each: the bound
   is the parameter). All pieces of all texts are counted for it, by an aggregation that shuffles a
   piece and a number for each different piece of a task;
2. a worker's own cache, filled by the tokenizer library for what the table lacks, emptied when it
   reaches `cache_size` entries.

The library is asked for many pieces at once, as one text: its tokens that begin with a space tell where
a piece begins.

A piece of more than LONGEST characters (a text in a script without spaces is one piece) goes straight
to the library: neither tier holds it, so both are bounded in characters too.

Both tiers hold lengths from the library itself, so counts never depend on what they contain.

Defined cases: a null or empty text has 0 tokens; repeated rows give repeated results; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORKER as _WORKER
from .common import written

_RUN = re.compile(r"\s\s")
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: What Python's \s matches, as a class of Java's patterns.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A piece or word with more characters is never kept.
LONGEST = 128


def pieces(text: str) -> list[str]:
    """The text's pieces, each with its leading space or newline."""
    if not text:
        return []
    if _RUN.search(text):
        first, *rest = _LONE.split(text)
        return [first, *[" " + x for x in rest]]
    first, *rest = text.replace("\n", " \n").split(" ")
    out = [x if x[:1] == "\n" else " " + x for x in rest]
    return [first, *out] if first else out


def load_tokenizer(path: str):
    """A worker loads each tokenizer file once."""
    key = ("tokenizer", path)
    if key not in _WORKER:
        if path.endswith(".model"):
            import sentencepiece

            _WORKER[key] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _WORKER[key] = t
    return _WORKER[key]


def library_ids(tokenizer, texts: list[str]) -> list[list[int]]:
    if hasattr(tokenizer, "encode_batch"):
        return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [list(x) for x in tokenizer.encode(texts)]


def piece_lengths(path: str, own: list[str]) -> list[int]:
    """The library's count of each piece. Pieces whose one white space is a leading space are one text to it;
    where its tokens do not tell them apart, and for all others, it is asked for each piece."""
    tokenizer, key = load_tokenizer(path), ("starts", path)
    if not hasattr(tokenizer, "encode_batch_fast"):
        return [len(x) for x in library_ids(tokenizer, own)]
    if key not in _WORKER:
        vocab = tokenizer.get_vocab()
        _WORKER[key] = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        _WORKER[key][[i for token, i in vocab.items() if token.startswith("\u0120")]] = True  # a byte-level space
    out, plain = np.zeros(len(own), np.int64), np.array([p[:1] == " " and p[1:].split() == [p[1:]] for p in own], bool)
    for at in range(0, len(own), 10_000):
        part, joins = own[at : at + 10_000], plain[at : at + 10_000]
        together = [p for p, yes in zip(part, joins, strict=True) if yes]
        ids = np.array(tokenizer.encode_batch_fast(["".join(together)], add_special_tokens=False)[0].ids, np.int64)
        starts = np.flatnonzero(_WORKER[key][ids])
        if len(starts) == len(together) and (not len(ids) or (len(starts) and starts[0] == 0)):
            out[at : at + 10_000][joins] = np.diff(np.append(starts, len(ids)))
        else:
            joins[:] = False
        each = [p for p, yes in zip(part, joins, strict=True) if not yes]
        out[at : at + 10_000][~joins] = [len(e.ids) for e in tokenizer.encode_batch_fast(each, add_special_tokens=False)]
    return out.tolist()


def piece_rows(docs: DataFrame, text: str) -> DataFrame:
    """(piece): a row for each of `pieces` of each text."""
    t: Column = F.col(text).cast("string")
    runs = F.split(t, f"(?<=[^{_SPACES}]) (?=[^{_SPACES}])")
    cut = F.when(t.rlike(f"[{_SPACES}][{_SPACES}]"), runs).otherwise(F.split(F.replace(t, F.lit("\n"), F.lit(" \n")), " "))
    piece = F.when((F.col("at") == 0) | F.col("x").startswith("\n"), F.col("x")).otherwise(F.concat(F.lit(" "), F.col("x")))
    return docs.select(F.posexplode(cut).alias("at", "x")).select(piece.alias("piece")).filter("piece <> ''")


def frequent_pieces(docs: DataFrame, text: str, tier_size: int = 65_536) -> list[str]:
    """The most frequent pieces of all texts, `tier_size` at most: all that occur at least so many times,
    twice or more. They steer only speed, and a table does not help a piece that occurs once."""
    rows = piece_rows(docs, text).filter(F.length("piece") <= LONGEST)
    sums = written(rows.groupBy("piece").agg(F.count("*").alias("n")).filter("n > 1"), "piece-counts")
    held, least = 0, None
    for r in sums.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).limit(tier_size).collect():
        held += r.pieces
        if held > tier_size:
            break
        least = r.n
    if least is None:
        return []
    return [r.piece for r in sums.filter(F.col("n") >= least).select("piece").collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", tier_size: int = 65_536, cache_size: int = 500_000) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, the library's count of the whole text."""
    spark = docs.sparkSession
    whole = tokenizer_path.endswith(".model")  # its pieces cross spaces: whole texts go to the library
    tier: dict[str, int] = {}
    if not whole:
        words = frequent_pieces(docs, text, tier_size)
        tier.update(zip(words, piece_lengths(tokenizer_path, words), strict=True))
    shared = spark.sparkContext.broadcast(tier)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(tokenizer_path)
        known = shared.value
        cache = _WORKER.setdefault(("lengths", tokenizer_path), {})  # with the table's lengths, for one lookup a piece
        cache.update(known)
        for batch in batches:
            counts = []
            for at in range(0, len(batch), 256):
                texts = list(batch["t"].iloc[at : at + 256])
                if whole:
                    counts += [len(x) for x in library_ids(tokenizer, texts)]
                    continue
                cut = [pieces(t) for t in texts]
                absent = list(set().union(*cut).difference(cache))
                if len(cache) + len(absent) > cache_size + len(known):
                    cache.clear()
                    cache.update(known)
                    absent = list(set().union(*cut).difference(cache))
                cache.update(zip(absent, piece_lengths(tokenizer_path, absent), strict=True))
                counts += [sum(map(cache.__getitem__, own)) for own in cut]
                for p in absent:
                    if len(p) > LONGEST:
                        del cache[p]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("n_bytes", F.octet_length("t").cast("long"))
    return rows.mapInPandas(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
