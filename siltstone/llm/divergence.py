"""Source divergence audit: how far the term shares of a language's sources lie from each other.

Each language keeps the terms of at least `least_docs` of its documents. A (language, source) group, and
each language as a whole, gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), N being
its occurrences of kept terms and V their number; one group's share diverges from another's by
floor((p - q)^2 / q). The audit gives that sum over all kept terms for each two sources of a language,
and the terms in which a group stands out most against its language.

The sums split by how many groups hold a term. A heavy term (held by a quarter of a language's sources or
more) is a column of a dense tile, terms by groups, on which all pairs of groups are summed at once. A
light term is a posting list of the few groups that hold it. If no group held it, it would add a constant
to a pair; against that constant

- a group that holds it changes all its pairs by an amount that depends on its count alone, so the light
  terms of a group are counted by share and each share is set against the other sources once;
- two groups that both hold it need a correction to that, which comes from the pairs of its postings.

All parts are whole numbers, and their sum is exact. Tiles, postings and shares are dealt by hashes of
terms, sources in blocks of BLOCK, so no group of rows grows with the corpus; what goes by source or by
language meets rows of hot ones by a broadcast of a bounded number of rows.

Defined cases: null text, language and source are ''; texts without a term count as documents and keep
their group; a language whose V is 0 has pairs of value 0 and no terms; a language of one source has no
pairs; repeated rows count as documents of their own; equal values are ranked by UTF-8 order; an empty
table gives no rows; other columns are not read. Exact while a group holds fewer than 9 x 10^15 terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import hot_split_join

from .common import clean_worker, written

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A task hands its counts on when it holds so many, or terms of so many bytes together.
HELD, HELD_BYTES = 400_000, 1 << 25
#: Sources in a block, terms in a dense tile, postings in a sparse one.
BLOCK, TILE, POSTINGS = 256, 2_048, 65_536


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    clean_worker()
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = room = 0

    def flush() -> pd.DataFrame:
        rows = [(lang, source, t.decode(), n, d) for (lang, source), own in held.items() for t, (n, d) in own.items()]
        rows += [(lang, source, None, 0, 0) for lang, source in held]
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            own = held.setdefault((lang, source), {})
            for term, n in Counter(_TERM.findall(text.encode().lower())).items():  # bytes: only A-Z change
                if term in own:
                    own[term][0] += n
                    own[term][1] += 1
                else:
                    own[term] = [n, 1]
                    size, room = size + 1, room + len(term)
            if size >= HELD or room >= HELD_BYTES or len(held) >= HELD:
                yield flush()
                held, size, room = {}, 0, 0
    if held:
        yield flush()


def share(n: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (n + 1) / total) by long division in base 1,000, which cannot overflow."""
    r0 = f"(({n} + 1) % {total})"
    r1 = f"(({r0} * 1000) % {total})"
    r2 = f"(({r1} * 1000) % {total})"
    return f"1 + ((((({n} + 1) div {total}) * 1000 + ({r0} * 1000) div {total}) * 1000 + ({r1} * 1000) div {total}) * 1000 + ({r2} * 1000) div {total})"


def _away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _rows(lang: str, g: np.ndarray, h: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "g": g, "h": h, "v": v})


def _matrix_rows(lang: str, g: np.ndarray, h: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(g[:, None] != h[None, :])
    return _rows(lang, g[i], h[j], s[i, j])


def _dense(rows: pd.DataFrame) -> pd.DataFrame:
    """Heavy terms of one tile for the sources of one or two blocks. Rows without a term give a source's
    share of what it lacks."""
    lang, a, b = rows["lang"].iloc[0], int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    heads = rows[rows["term"].isna()].drop_duplicates("g").sort_values("g")
    at = pd.Series(np.arange(len(heads)), heads["g"].to_numpy())
    held = rows[rows["term"].notna()]
    term, terms = pd.factorize(held["term"])
    tile = np.repeat(heads["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    tile[at.loc[held["g"]].to_numpy(), term] = held["p"].to_numpy(np.int64)
    g = heads["g"].to_numpy()
    left, right = np.flatnonzero(g // BLOCK == a), np.flatnonzero(g // BLOCK == b)
    there, back = np.zeros((len(left), len(right)), np.int64), np.zeros((len(right), len(left)), np.int64)
    other = tile[right]
    for i, own in enumerate(left):
        d = tile[own][None, :] - other
        d *= d
        there[i] = (d // other).sum(axis=1)
        if a != b:
            back[:, i] = (d // tile[own][None, :]).sum(axis=1)
    out = _matrix_rows(lang, g[left], g[right], there)
    return out if a == b else pd.concat([out, _matrix_rows(lang, g[right], g[left], back)])


def _sparse(rows: pd.DataFrame) -> pd.DataFrame:
    """Corrections for every two sources that both hold a light term, summed over one tile of postings."""
    rows = rows.sort_values(["term", "g"], ignore_index=True)
    term, _ = pd.factorize(rows["term"])
    g, p, p0 = (rows[c].to_numpy(np.int64) for c in ("g", "p", "p0"))
    keys, values = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(rows)):
        i = np.flatnonzero(term[:-step] == term[step:])
        if not len(i):
            break
        j = i + step
        for x, y in ((i, j), (j, i)):
            keys.append(np.stack([g[x], g[y]], axis=1))
            values.append(_away(p[x], p[y]) - _away(p[x], p0[y]) - _away(p0[x], p[y]) + _away(p0[x], p0[y]))
        if sum(map(len, values)) > 1_000_000:
            keys, values = ([k] for k in _summed(keys, values))
    pairs, sums = _summed(keys, values)
    return _rows(rows["lang"].iloc[0], pairs[:, 0], pairs[:, 1], sums)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, of = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, of.reshape(-1), np.concatenate(values))
    return pairs, sums


def _single(rows: pd.DataFrame) -> pd.DataFrame:
    """Shares of light terms of block a's sources, each with its number of terms, against all of block b
    as if these lacked them. Rows without a number give block b's shares of what they lack."""
    lang = rows["lang"].iloc[0]
    heads, own = rows[rows["m"].isna()].sort_values("g"), rows[rows["m"].notna()]
    h, q = heads["g"].to_numpy(np.int64), heads["p"].to_numpy(np.int64)
    out = [_rows(lang, h[:0], h[:0], h[:0])]
    for g, part in own.groupby("g"):
        p, m, p0 = part["p"].to_numpy(np.int64), part["m"].to_numpy(np.int64), int(part["p0"].iloc[0])
        there, back = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for at in range(0, len(p), 4_096):
            x, k = p[at : at + 4_096, None], m[at : at + 4_096, None]
            there += (k * (_away(x, q[None, :]) - _away(np.int64(p0), q)[None, :])).sum(axis=0)
            back += (k * (_away(q[None, :], x) - _away(q, np.int64(p0))[None, :])).sum(axis=0)
        others = h != g
        n = int(others.sum())
        out += [_rows(lang, np.full(n, g), h[others], there[others]), _rows(lang, h[others], np.full(n, g), back[others])]
    return pd.concat(out)


def _blocks(side: str, other: str):
    """Every block that a row's own block is paired with."""
    return F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK).cast("int"))).alias(other), F.floor(F.col("g") / BLOCK).cast("int").alias(side)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs); a row without a term for each group."""
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = read.mapInPandas(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` with each other source of the language, part
    `term` with up to `top` terms that a source uses more than its language does."""
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    groups = counts.filter("term is null").select("lang", "source")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("holders"), F.min("source").alias("first"))
    kept = written(terms.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    # A row a language, with the number of rows that will meet it.
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    rows_of = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    known = hot_split_join(kept, sources.join(rows_of, "lang"), "lang", "kept", kept.count())
    heavy = F.col("holders") * 4 >= F.col("sources")
    of_lang = known.groupBy("lang").agg(
        F.count("*").alias("v"),
        F.sum("total").alias("n_lang"),
        F.count_if(heavy).alias("v_heavy"),
        F.coalesce(F.sum(F.when(~heavy, F.col("holders"))), F.lit(0)).alias("postings"),
    )
    held = written(counts.filter("term is not null").drop("docs").join(kept, ["lang", "term"]), "held-terms")  # read four times
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("rows"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    zero = F.lit(0).cast("long")
    sizes = groups.withColumn("g", number).join(sources, "lang").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    sizes = sizes.fillna(0, ["v", "n_lang", "v_heavy", "postings", "n_group", "rows"])
    sizes = sizes.withColumn("p0", F.when(F.col("v") > 0, F.expr(share("0", "(n_group + v)"))).otherwise(zero))
    sizes = sizes.withColumns({"tiles": F.ceil(F.col("v_heavy") / TILE), "sheets": F.ceil(F.col("postings") / POSTINGS)})
    sizes = written(sizes.withColumn("key", F.struct("lang", "source")), "sizes")

    near = hot_split_join(held.withColumn("key", F.struct("lang", "source")).drop("lang", "source"), sizes, "key", "rows", held.count())
    own = near.withColumn("p", F.expr(share("n", "(n_group + v)"))).withColumn("q", F.expr(share("total", "(n_lang + v)")))
    own = written(own.select("lang", "source", "g", "term", "p", "q", "p0", "sources", "tiles", "sheets", heavy.alias("heavy")), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value"]
    terms_out = own.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms_out = terms_out.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= top)

    schema = "lang string, g long, h long, v long"
    several = own.filter("sources > 1")
    tile = F.pmod(F.xxhash64("term"), F.col("tiles"))
    heads = sizes.filter("sources > 1 and tiles > 0").select("lang", "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "sources", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("tile"))
    dealt = several.filter("heavy").select("lang", "g", "term", "p", "sources", tile.alias("tile")).unionByName(heads)
    other, mine = _blocks("mine", "other")
    dealt = dealt.select("*", other).select("*", mine).select("lang", "g", "term", "p", "tile", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    dense = dealt.groupBy("lang", "a", "b", "tile").applyInPandas(_dense, schema)

    light = several.filter("not heavy")
    sheet = F.pmod(F.xxhash64("term"), F.col("sheets"))
    sparse = light.select("lang", "g", "term", "p", "p0", sheet.alias("sheet")).groupBy("lang", "sheet").applyInPandas(_sparse, schema)
    shares = light.groupBy("lang", "g", "p", "p0", "sources").agg(F.count("*").alias("m"))
    other, mine = _blocks("a", "b")
    left = shares.select("*", other).select("*", mine).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "g", "p", "p0", "m")
    right = sizes.filter("sources > 1 and sheets > 0").select("*", other).select("*", mine).select("lang", "a", "b", "g", F.col("p0").alias("p"), "p0", F.lit(None).cast("long").alias("m"))
    single = left.unionByName(right).groupBy("lang", "a", "b").applyInPandas(_single, schema)
    more = dense.unionByName(sparse).unionByName(single).groupBy("lang", "g", "h").agg(F.sum("v").alias("v"))

    x = sizes.select("lang", "source", "g", "p0", (F.col("v") - F.col("v_heavy")).alias("lacking"))
    y = sizes.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p0").alias("q0"))
    base = x.join(y, "lang").filter("g <> h").withColumn("base", F.expr("if(lacking > 0, lacking * ((p0 - q0) * (p0 - q0) div q0), 0L)"))
    pairs = base.join(more, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("v", zero)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best).cast("int"))
    return pairs.select(*names, "rank").unionByName(terms_out.select(*names, "rank"))
