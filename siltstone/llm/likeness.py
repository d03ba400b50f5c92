"""Near-duplicates by exact likeness: texts whose sets of word shingles have a Jaccard of `least` or more.

Each different text has a fingerprint, 64 bits by the majority of its shingles' hashes. Texts of one
fingerprint, and of fingerprints that op9's grid join finds within DISTANCE bits, are candidates. These are
almost equal texts only: at a likeness of 0.8 fingerprints differ in 4 to 14 of 64 bits, and a grid of cells
around a fingerprint grows with the power of that distance. For what lies beyond the grid each text
has BANDS x ROWS least values of its shingles' hashes as well: two texts are candidates
too if they agree in all values of a band; those whose sketches (four bits of each value)
differ by over four standard deviations more than those of a pair of likeness `least` are left out
inside the join. Of all candidates the likeness is computed from both texts. Both filters of the bands together
lose about one in 10,000 pairs of exactly 0.8. Components are linked by `components`.

Groups of a band with up to SMALL texts give their pairs. In larger groups all texts are first compared
with one of them, their representative, which links those that are near it. 1 - likeness is a metric: a
text at distance e or less from the representative is linked to none that is further from it than e and
the limit together, so texts nearer than all that are not linked leave the group with the representative;
a family of near copies goes whole. What is left after ROUNDS representatives, texts of a group that are
not alike, is cut into blocks, each two blocks are compared in one call, whole against whole, and give a
spanning forest of the links that they hold. Components are the same as with all links. Nothing is capped.

Defined cases: a null, empty or blank text has no words, and all such texts are alike; texts shorter
than a shingle have one, all their words; equal texts are always linked. Rows with null or repeated
ids take part like any other: a row is known by its id and its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, clean_worker, keep_first, written
from .components import components
from .grid import links, majority

_HASH = xxhash.xxh64_intdigest
BANDS, ROWS = 32, 6
DISTANCE, SEGMENTS = 2, 32
SMALL, BLOCK, COLUMNS, ROUNDS = 32, 512, 4_096, 3
_DRAW = np.random.default_rng(20_011)
_XOR = _DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _DRAW.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different hashes of a text's runs of `words` words, in order."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    k = min(words, len(own))
    joined = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(own) - k + 1].tolist()
    return np.unique(np.array([_HASH(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a code of each band, the sketch: four bits of each value in BANDS * ROWS / 16 words)."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    mixed = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(mixed), 512):
        part = (mixed[at : at + 512] ^ _XOR) * _TIMES
        np.minimum(low, (part ^ (part >> np.uint32(15))).min(axis=1), out=low)
    raw = low.reshape(BANDS, ROWS)
    codes = np.array([_HASH(raw[i].tobytes(), i) for i in range(BANDS)], np.uint64)
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return codes.view(np.int64), (bits[::2] << 4 | bits[1::2]).view(np.int64)


def signatures(keyed: DataFrame, words: int) -> DataFrame:
    """(key, fp, codes, sketch) of (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        for batch in batches:
            found = [(majority(own), *signature(own)) for own in (shingles(t, words) for t in batch["text"])]
            fps = np.fromiter((f for f, _, _ in found), np.uint64, len(found)).view(np.int64)
            yield pd.DataFrame({"key": batch["key"], "fp": fps, "codes": [c for _, c, _ in found], "sketch": [s for _, _, s in found]})

    return keyed.mapInPandas(run, "key string, fp long, codes array<long>, sketch array<long>")


def grid_pairs(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) of nodes (key, fp): the least key of a fingerprint with its other keys, and with the least key
    of each fingerprint within `distance` bits."""
    named = written(nodes.groupBy("fp").agg(F.min("key").alias("name"), F.count("*").alias("keys")), "fingerprints")
    near = links(named.select("fp"), distance, segments)
    for c in ("a", "b"):
        near = near.hint("merge").join(named.select(F.col("fp").alias(c), F.col("name").alias(f"name_{c}")), c)
    same = nodes.select("key", "fp").join(named.filter("keys > 1"), "fp").filter("key <> name").select(F.col("name").alias("a"), F.col("key").alias("b"))
    return written(near.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).unionByName(same), "grid-pairs")


def _close(a: str, b: str, least: float) -> Column:
    """Whether two sketches differ in no more values than those of a pair with likeness `least` do."""
    n, p = BANDS * ROWS, (1 - least) * 15 / 16
    low = F.lit(0x1111111111111111).cast("long")
    apart = F.lit(0)
    for i in range(n // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return apart <= int(n * p + 4 * (n * p * (1 - p)) ** 0.5) + 1


def alike(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Those of pairs (a, b) whose texts (key, text; one row a key) have a likeness of `least` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        for batch in batches:
            yes = [likeness(shingles(x, words), shingles(y, words)) >= least for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(yes, bool), ["a", "b"]]

    # Files of repeated keys and texts are far smaller than their rows, so these joins are never left to Spark's
    # sizes of files; both sides are written, and Spark splits a hot key's pairs.
    for key, name in (("a", "x"), ("b", "y")):
        pairs = pairs.hint("merge").join(texts.select(F.col("key").alias(key), F.col("text").alias(name)), key)
    return written(pairs.mapInPandas(run, "a string, b string"), "alike")


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between sets of likeness `least` or more that join what all such links join."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    place = np.cumsum(uses > 1) - 1
    shared = uses[column] > 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    every = sizes[:, None] + sizes[None, :] - both
    near = np.where(every > 0, both / np.maximum(every, 1), 1.0) >= least
    out, new = [], np.ones(n, bool)
    for start in range(n):
        if not new[start]:
            continue
        new[start], todo = False, [start]
        while todo:
            v = todo.pop()
            met = np.flatnonzero(near[v] & new)
            new[met] = False
            todo += met.tolist()
            out += [(v, int(w)) for w in met]
    return out


def block_links(members: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """(a, b): links inside the groups of members (code, key, size), by blocks of about BLOCK texts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        clean_worker()
        keys = rows["key"].tolist()
        return pd.DataFrame([(keys[a], keys[b]) for a, b in forest([shingles(t, words) for t in rows["text"]], least)], columns=["a", "b"]).astype(str)

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = members.withColumns({"n": blocks, "own": F.pmod(F.xxhash64("key"), blocks).cast("int")}).hint("merge").join(texts, "key")
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = dealt.select("code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "text")
    return met.groupBy("code", "i", "j").applyInPandas(run, "a string, b string")


def to_representatives(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(key, rep, like): the likeness of each of pairs (key, rep). A representative's text goes to one of its
    parts of about BLOCK texts, not to each text."""

    def run(rows: pd.DataFrame, rep: pd.DataFrame) -> pd.DataFrame:
        clean_worker()
        if not len(rows) or not len(rep):
            return pd.DataFrame({"key": [], "rep": [], "like": []}).astype({"key": str, "rep": str, "like": float})
        own = shingles(rep["text"].iloc[0], words)
        return pd.DataFrame({"key": rows["key"], "rep": rows["rep"], "like": [likeness(shingles(t, words), own) for t in rows["text"]]})

    sizes = written(pairs.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "representative-parts")
    cut = pairs.join(sizes, "rep").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("key", "rep", "part")
    of = texts.select(F.col("key").alias("rep"), F.col("text").alias("whole"))
    own = sizes.join(of, "rep").select(F.col("rep").alias("for"), F.col("whole").alias("text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth"))
    met = cut.hint("merge").join(texts, "key").groupBy("rep", "part").cogroup(own.groupBy("for", "nth")).applyInPandas(run, "key string, rep string, like double")
    return written(met, "representatives")


def thinned(members: DataFrame, texts: DataFrame, least: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) of the groups of members (code, key, sketch) to their representatives, the members that
    may have further links, with the new `size` of their groups)."""
    # Facts of a group are written, so both sides of each join are shuffled for it and Spark splits hot groups.
    reps = written(members.groupBy("code").agg(F.min("key").alias("rep")), "reps")
    named = written(members.select("code", "key", "sketch").join(reps, "code").filter("key <> rep"), "named")
    likes = to_representatives(written(named.select("key", "rep").distinct(), "asked"), texts, words)
    judged = written(named.join(likes, ["key", "rep"]).select("code", "key", "sketch", "like"), "judged")
    # The nearest that is not linked: what is nearer to the representative by more than the limit has no further link.
    gap = written(judged.groupBy("code").agg(F.min(F.when(F.col("like") < least, 1 - F.col("like"))).alias("gap")), "gaps")
    left = written(judged.join(gap, "code").filter((F.col("like") < least) | ((1 - F.col("like")) + (1 - least) >= F.col("gap") - 1e-9)).select("code", "key", "sketch"), "left")
    sizes = written(left.groupBy("code").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    rest = left.join(sizes, "code")
    links = likes.filter(F.col("like") >= least).select(F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b"))
    return links, written(rest.select("code", "key", "sketch", "size"), "thinned")


def one_of_each(keyed: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """One row of keyed for each key in asked; nodes (key, copies) tells how many rows keyed has of it.

    Copies of a hot key, of which there are at most 1 / HOT_SHARE, become one row a task before they
    are shuffled; all others are shuffled by key.
    """
    least = max(1.0, (nodes.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE)
    wanted = asked.select("key").distinct()
    hot = nodes.filter(F.col("copies") > least).select("key")
    cold = keyed.join(F.broadcast(hot), "key", "left_anti").join(wanted, "key", "left_semi")
    often = keyed.join(F.broadcast(hot.join(wanted, "key", "left_semi")), "key", "left_semi")
    return cold.dropDuplicates(["key"]).unionByName(often.dropDuplicates(["key"]))


def linked(keyed: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """(node, root): the component of every key of keyed (key, text; equal keys have equal texts) with a link."""
    each = written(signatures(keyed, words), "signatures").groupBy("key")
    nodes = written(each.agg(F.first("fp").alias("fp"), F.first("codes").alias("codes"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "sketches")
    cells = nodes.select("key", F.explode("codes").alias("code"))
    groups = cells.groupBy("code").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(cells.join(groups, "code").join(nodes.select("key", "sketch"), "key").select("code", "key", "sketch", "size"), "shared")
    gridded = grid_pairs(nodes)
    asked = shared.select("key").unionByName(gridded.select(F.explode(F.array("a", "b")).alias("key")))
    texts = written(one_of_each(keyed, nodes, asked), "candidates")
    few, large = shared.filter(F.col("size") <= SMALL), shared.filter(F.col("size") > SMALL)
    found = []
    for _ in range(ROUNDS):
        if large.isEmpty():
            break
        near, rest = thinned(large, texts, least, words)
        found.append(near)
        few, large = few.unionByName(rest.filter(F.col("size") <= SMALL)), rest.filter(F.col("size") > SMALL)
    l, r = few.alias("l"), few.alias("r")
    # A text's key and sketch are in up to BANDS rows, of which files hold far less than memory does.
    met = l.hint("merge").join(r, (F.col("l.code") == F.col("r.code")) & (F.col("l.key") < F.col("r.key")) & _close("l.sketch", "r.sketch", least))
    pairs = written(met.select(F.col("l.key").alias("a"), F.col("r.key").alias("b")).unionByName(gridded).distinct(), "pairs")
    many = block_links(large.select("code", "key", "size"), texts, least, words)
    for near in found:
        many = many.unionByName(near)
    several = written(many.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "block-links")
    return components(alike(pairs, texts, least, words).unionByName(several).distinct())


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each component, that with the least id; rows without an id come last."""
    keyed = docs.select(_key(text).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    roots = linked(keyed.select("key", "text"), least, words)
    return keep_first(docs, _key(text), keyed, roots, id_col)
