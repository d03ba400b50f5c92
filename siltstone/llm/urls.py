"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models of bytes, one of accepted and one of rejected URLs, are smoothed
from order 0 up to `order`: at each order a count pulls the lower order's estimate with the weight of
`pull` observations, so a context seen often speaks for itself and one never seen leaves the lower
order as it is. A URL's score is the difference of its log-likelihoods divided by its length, and
is accepted at or above a threshold.

Training URLs are those that a rule decides. Counts are exact and kept in a Spark table with a row
for every gram (a byte with the `order` bytes before it, as a bigint) of any URL; it grows with the
URLs, and the counts of all lower orders and contexts are sums over it. Estimates go up the orders
by joins in which no key has more than 256 rows (the bytes that may follow a context); tables of up
to two bytes, 65,536 rows, are broadcast. URLs are scored once each, however many rows have them: the
`tier_size` most frequent grams are looked up in a broadcast table, those it lacks (each a small
share of all, by its choice) are joined. Log-ratios are whole numbers of 2^-32, so a sum does not
depend on its order.

The threshold is calibrated on out-of-fold scores: URLs fall into two folds by their hash, each fold
is scored by the counts of the other, and the threshold with the best mean of the two classes'
accuracies over all of them is taken from a histogram of `bins` scores.

Defined cases: a null url is the empty string, whose score is 0; without a trained class (no URL
that a rule accepts, or none that it rejects) the method accepts everything; repeated rows count as
often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_split_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one. Of two rules of one name
    the one listed first decides."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


#: A unit of a log-ratio.
UNIT = 1 << 32
_CHUNK = 1 << 22
#: Counts of accepted and rejected URLs in folds 0 and 1.
CELLS = ["a0", "r0", "a1", "r1"]
#: Which cells a model adds up: all, and those that score fold 0 and fold 1.
MODELS = {"all": ("0", "1"), "for0": ("1",), "for1": ("0",)}


def grams(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bytes of each url): a code's lowest byte is a byte of a url, above it are the `order`
    bytes before, the nearest lowest; before a url's start are bytes of value 2."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    head = b"\x02" * order
    data = np.frombuffer(head + head.join(raw), np.uint8).astype(np.int64)
    code = np.zeros(len(data), np.int64)
    for k in range(order + 1):
        code[k:] |= data[: len(data) - k] << (8 * k)
    own = np.ones(len(data), bool)
    starts = np.cumsum(np.r_[0, sizes[:-1] + order]) if len(raw) else np.zeros(0, np.int64)
    for k in range(order):
        own[starts + k] = False
    return code[own], sizes


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """batch in parts of some megabytes of urls."""
    part = batch["url"].str.len().cumsum() // _CHUNK
    for _, rows in batch.groupby(part, sort=True):
        yield rows


def count_grams(urls: DataFrame, order: int = 4) -> DataFrame:
    """(code, a0, r0, a1, r1, uses) over urls (url, uses, a, r, fold), one row a code; a and r
    are the numbers of accepted and of rejected rows among a url's uses."""
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7: a gram is a bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _chunks(batch):
                codes, sizes = grams(rows["url"].tolist(), order)
                values, at = np.unique(codes, return_inverse=True)
                uses = rows["uses"].to_numpy()
                fold = rows["fold"].to_numpy()
                out = {"code": values}
                for cell in CELLS:
                    weight = rows[cell[0]].to_numpy() * (fold == int(cell[1]))
                    out[cell] = np.bincount(at, np.repeat(weight, sizes), len(values)).astype(np.int64)
                out["uses"] = np.bincount(at, np.repeat(uses, sizes), len(values)).astype(np.int64)
                yield pd.DataFrame(out)

    counted = urls.select("url", "uses", "a", "r", "fold").mapInPandas(run, "code long, " + ", ".join(f"{c} long" for c in [*CELLS, "uses"]))
    return counted.groupBy("code").agg(*[F.sum(c).alias(c) for c in [*CELLS, "uses"]])


def estimates(counts: DataFrame, order: int = 4, pull: float = 2.0) -> DataFrame:
    """(code, <model>_a, <model>_r for each of MODELS): the smoothed probability of each gram's byte
    after its context, by each model and class."""
    low = lambda n: F.lit((1 << (8 * n)) - 1).cast("long")
    sums = [F.sum(c).alias(c) for c in CELLS]
    by_order = {order: counts.select("code", *CELLS)}
    for k in range(order - 1, -1, -1):
        by_order[k] = by_order[k + 1].groupBy(F.col("code").bitwiseAND(low(k + 1)).alias("code")).agg(*sums)
        if k >= 2:
            by_order[k] = written(by_order[k], f"grams-{k}")
    lower = None
    for k in range(order + 1):
        own = by_order[k].withColumns({"context": F.shiftrightunsigned("code", 8), "shorter": F.col("code").bitwiseAND(low(k))})
        seen = by_order[k].groupBy(F.shiftrightunsigned("code", 8).alias("context")).agg(*[F.sum(c).alias(f"c_{c}") for c in CELLS])
        rows = own.join(F.broadcast(seen) if k <= 2 else seen, "context")
        if lower is not None:
            before = lower.withColumnRenamed("code", "shorter")
            rows = rows.join(F.broadcast(before) if k <= 2 else before, "shorter")
        p = []
        for model, folds in MODELS.items():
            for cls in "ar":
                n = reduce(Column.__add__, [F.col(cls + f) for f in folds])
                c = reduce(Column.__add__, [F.col(f"c_{cls}{f}") for f in folds])
                below = F.col(f"p_{model}_{cls}") if lower is not None else F.lit(1 / 256)
                p.append(((n + F.lit(pull) * below) / (c + F.lit(pull))).alias(f"{model}_{cls}"))
        level = rows.select("code", *p)
        if 2 <= k < order:
            level = written(level, f"estimates-{k}")
        lower = level.select("code", *[F.col(f"{m}_{c}").alias(f"p_{m}_{c}") for m in MODELS for c in "ar"])
    return level


def gram_values(counts: DataFrame, order: int, pull: float) -> DataFrame:
    """(code, all, for0, for1, uses): log-ratios of accepted to rejected in UNITs."""
    ratios = [F.round(F.log(F.col(f"{m}_a") / F.col(f"{m}_r")) * UNIT).cast("long").alias(m) for m in MODELS]
    return estimates(counts, order, pull).select("code", *ratios).join(counts.select("code", "uses"), "code")


def url_sums(urls: DataFrame, values: DataFrame, order: int, tier_size: int) -> DataFrame:
    """(key, uses, a, r, bytes, whole, other): each url's log-ratios summed, by all counts and by
    those of the other fold."""
    tier = values.orderBy(F.desc("uses"), "code").limit(tier_size).toPandas().sort_values("code")
    shared = urls.sparkSession.sparkContext.broadcast((tier["code"].to_numpy(), tier[list(MODELS)].to_numpy()))
    columns = ["key", "fold", "code", "n", "uses", "a", "r", "bytes", "whole", "other"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, worth = shared.value
        for batch in batches:
            for rows in _chunks(batch):
                codes, sizes = grams(rows["url"].tolist(), order)
                owner = np.repeat(np.arange(len(rows)), sizes)
                at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
                hit = known[at] == codes
                fold = rows["fold"].to_numpy()
                ends = np.cumsum(sizes)
                both = []
                for model in (np.zeros(len(codes), np.int64), 1 + fold[owner]):
                    total = np.r_[0, np.cumsum(np.where(hit, worth[at, model], 0))]
                    both.append(total[ends] - total[ends - sizes])
                key = rows["key"].to_numpy()
                yield pd.DataFrame({"key": key, "fold": fold, "code": None, "n": 0, "uses": rows["uses"], "a": rows["a"], "r": rows["r"], "bytes": sizes, "whole": both[0], "other": both[1]})[columns]
                if not hit.all():
                    lost = np.unique(np.stack([owner[~hit], codes[~hit]]), axis=1, return_counts=True)
                    (who, code), n = lost
                    yield pd.DataFrame({"key": key[who], "fold": fold[who], "code": code, "n": n, "uses": None, "a": None, "r": None, "bytes": None, "whole": None, "other": None})[columns]

    schema = "key string, fold int, code long, n long, uses long, a long, r long, bytes long, whole long, other long"
    parts = written(urls.select("key", "url", "fold", "uses", "a", "r").mapInPandas(run, schema), "url-parts")
    missed = parts.filter("code is not null").join(values, "code").select("key", (F.col("n") * F.col("all")).alias("whole"), (F.col("n") * F.when(F.col("fold") == 0, F.col("for0")).otherwise(F.col("for1"))).alias("other"))
    sums = parts.filter("code is null").select("key", "uses", "a", "r", "bytes", "whole", "other").unionByName(missed, allowMissingColumns=True)
    return sums.groupBy("key").agg(*[F.max(c).alias(c) for c in ("uses", "a", "r", "bytes")], *[F.sum(c).alias(c) for c in ("whole", "other")])


def calibrate(scored: DataFrame, bins: int = 4_096, span: float = 8.0) -> float:
    """The threshold of scored (score, a, r) with the best mean of both classes' accuracies."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("score") + F.lit(span)) / F.lit(2 * span / bins)))).cast("int")
    hist = np.zeros((2, bins))
    for row in scored.groupBy(bin_of.alias("bin")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).collect():  # a row a bin
        hist[:, row["bin"]] = row["a"], row["r"]
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    # accuracy when everything from bin i on is accepted
    quality = 1 - np.r_[0, np.cumsum(share[0])] + np.r_[0, np.cumsum(share[1])]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float((best.min() + best.max()) / 2 * (2 * span / bins) - span)


def score_urls(labelled: DataFrame, order: int = 4, pull: float = 2.0, bins: int = 4_096, tier_size: int = 1 << 17) -> tuple[DataFrame, float] | None:
    """((key, uses, a, r, score, other_score) of every different url, threshold) for labelled (url,
    rejected; null: to be judged). key is the url's MD5. None if a class has no url."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rejected = F.col("rejected")
    once = labelled.select(url.alias("url"), "rejected").groupBy("url").agg(F.count("*").alias("uses"), F.count_if(~rejected).alias("a"), F.count_if(rejected).alias("r"))
    once = written(once.withColumns({"key": F.md5(F.col("url").cast("binary")), "fold": F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")}), "urls")
    accepted, refused = once.agg(F.sum("a"), F.sum("r")).first()
    if not accepted or not refused:
        return None
    counts = written(count_grams(once, order), "grams")
    values = written(gram_values(counts, order, pull), "gram-values")
    per_byte = lambda c: F.when(F.col("bytes") > 0, F.col(c) / F.lit(float(UNIT)) / F.col("bytes")).otherwise(F.lit(0.0))
    sums = url_sums(once, values, order, tier_size)
    scores = written(sums.select("key", "uses", "a", "r", per_byte("whole").alias("score"), per_byte("other").alias("other_score")), "url-scores")
    return scores, calibrate(scores.select(F.col("other_score").alias("score"), "a", "r"), bins)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", id_col: str = "page_id", **options) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    u = F.col(url)
    own_id = "_id"
    rows = pages.select(F.col(id_col).alias(own_id), F.coalesce(u.cast("string"), F.lit("")).alias("url"), url_host(u).alias("host"), url_path(u).alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    out = [F.col(own_id).alias(id_col), "host", "path", "rule"]
    scored = score_urls(rows.select("url", (F.col("by_rule") == "block").alias("rejected")), **options)
    if scored is None:
        return rows.select(*out, F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scores, threshold = scored
    total = scores.agg(F.sum("uses")).first()[0]
    keyed = rows.withColumn("key", F.md5(F.col("url").cast("binary"))).drop("url")
    met = hot_split_join(keyed, scores.select("key", "uses", "score"), "key", "uses", total)
    own = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return met.select(*out, F.coalesce("by_rule", own).alias("verdict"), "score")
