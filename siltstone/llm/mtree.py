"""Exact top-k by largest inner product: best-first search of a paged M-tree.

Components become whole numbers, floor(scale * x), so scores are whole and exact. Within a band of lengths
(as in `ann`) a vector is raised onto a sphere by one more coordinate; there the angle between a query's
direction and a vector is a metric, and among one query's candidates of a band the smallest angle is the
largest product. The tree has four levels:

    directory   groups of cells: a pivot, the angle that covers all their cells
    cell        a pivot, the angle to its group's pivot, the least and largest angle of its vectors
    page        the same against its cell's pivot; a row of the index table, with its vectors
    entry       a vector, its ids, the angle to its page's pivot

By the triangle inequality the stored angle to the pivot above bounds a product before the pivot itself is
met: |angle(q, above) - stored| is no more than angle(q, pivot). Only pivots and vectors that this leaves
are computed. A query first searches the `first` cells that promise most; its k-th score then prunes all
other cells, groups first. Inside a cell pages are taken best first, each query's next page in every step,
until none promises more than the k-th score. Bounds have a slack for rounding, so nothing is lost.

The directory (`max_cells` pivots and two for each band at most, `sample_rows` sampled rows to fit them)
is all that the driver holds or broadcasts. A cell is cut into blocks of `block_rows` vectors, and its
queries into blocks of `block_queries`, so no group grows with a hot cell. Equal vectors of an Arrow batch
become one with its k + 1 least ids (no result needs more), as do equal queries. Pages and packs of queries hold
their vectors as the narrowest whole numbers that fit. What a task holds of queries against cells is cut at
`HELD` values, a pack at `PACK_BYTES`, so neither grows with the number of cells.

Defined cases: null ids take no part, nor do vectors that are null, of another length than most (ties: the
longer), or hold null or non-finite components (scaled ones included); zero vectors take part; of rows
with one id a result lists the id once with its best score, and a query never finds its own id; ties go
to the smaller id; scores beyond the longs count as the largest or least long; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import fit_balanced, fit_bands
from .common import clean_worker, written

SLACK = 1e-6
LOW, HIGH = -(2**63) + 1, 2**63 - 1
EXACT = 2.0**53
HELD, PACK_BYTES = 1 << 20, 8_192
_PAGES = "cell int, block int, page int, pivot array<double>, up double, inner double, outer double, top double, least long, ids array<long>, of array<int>, vectors binary, far array<double>"
_PACKS = "cell int, blocks int, n int, deal long, qids array<long>, q binary, angle array<double>, kth array<long>, kid array<long>"


def integer_vectors(df: DataFrame, vector: str, id_col: str, scale: float) -> DataFrame:
    """(vec_id, v, size): whole components as doubles; size is the binary logarithm of the length, null for zero."""
    raw = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("v")).filter(F.coalesce(ok, F.lit(False)))
    whole = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))
    most = F.array_max(F.transform("v", F.abs))
    square = F.aggregate(F.transform("v", lambda x: x / F.col("_most")), F.lit(0.0), lambda s, x: s + x * x)
    return whole.withColumn("_most", most).withColumn("size", F.when(F.col("_most") > 0, F.log2("_most") + F.log2(square) / 2)).drop("_most")


def _matrix(column, dim: int) -> np.ndarray:
    rows = list(column)
    return np.stack(rows).astype(np.float64) if rows else np.zeros((0, dim))


def narrow(v: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(kind, components in it): the narrowest numbers that hold all; what is below EXACT is whole."""
    for kind in "bhi":
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return kind.encode(), v.astype(kind)
    return b"d", v.astype(np.float64)


def widened(b: bytes, rows: int, dim: int) -> np.ndarray:
    """Components of a kind and bytes that `narrow` gave."""
    return np.frombuffer(b, chr(b[0]), offset=1).astype(np.float64).reshape(rows, dim)


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a zero vector has no direction and stays zero."""
    most = np.abs(v).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    u = v / safe[:, None]
    n = np.sqrt((u * u).sum(axis=1))
    return u / np.where(n > 0, n, 1.0)[:, None], n * safe


def raised(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors no longer than `top`, over top, on the unit sphere of one more dimension."""
    u, n = directions(v)
    r = np.minimum(n / top, 1.0)
    return np.concatenate([u * r[:, None], np.sqrt(1 - r * r)[:, None]], axis=1)


def unit(points: np.ndarray) -> np.ndarray:
    """Pivots on the sphere; a point without a direction becomes the pole."""
    points = points.astype(np.float64)
    n = np.linalg.norm(points, axis=1, keepdims=True)
    pole = np.zeros(points.shape[1])
    pole[-1] = 1.0
    return np.where(n > 1e-9, points / np.where(n > 1e-9, n, 1.0), pole)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b[:, : a.shape[1]].T, -1.0, 1.0))


def promise(reach: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest whole score at an angle of `low` or more; reach: query length times the band's upper end."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = reach * np.cos(np.clip(low - SLACK, 0.0, np.pi))
        out = np.floor(score + 1e-9 * reach)
    return np.where(np.isfinite(out), np.maximum(out, LOW), np.inf)


def worth(bound: np.ndarray, least: np.ndarray, kth: np.ndarray, kid: np.ndarray) -> np.ndarray:
    """Whether something with that bound and least id may come before the k-th found."""
    return (bound > kth) | ((bound == kth) & ((least <= kid) | (np.abs(bound) >= EXACT)))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact whole products; in doubles where no sum can leave their whole numbers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    with np.errstate(over="ignore"):
        longest = np.sqrt((q * q).sum(axis=1)).max() * np.sqrt((v * v).sum(axis=1)).max()
    if longest < EXACT / 2:
        return (q @ v.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    return np.array([[max(LOW, min(HIGH, sum(a * b for a, b in zip(map(int, own), w, strict=True)))) for w in whole] for own in q], np.int64)


def merge_ids(v: np.ndarray, ids: list, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows of v that stand for equal ones, their `most` least ids)."""
    _, first, of = np.unique(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1) if v.shape[1] else np.zeros((len(v), 1)), axis=0, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    return first, [np.unique(np.concatenate([np.atleast_1d(ids[i]) for i in p]))[:most] for p in parts]


class Directory:
    """Cells under groups: pivots, covering angles, and the stored angles between levels."""

    def __init__(self, pivots: np.ndarray, tops: np.ndarray):
        self.pivots, self.tops = pivots, tops
        self.inner = self.outer = self.least = self.blocks = np.zeros(0)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []

    def assign(self, v: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle) of vectors of the band that ends at `top`."""
        own = np.flatnonzero(self.tops == top)
        pivots, cell, least = self.pivots[own], np.zeros(len(v), np.int64), np.zeros(len(v))
        step = max(1, HELD // len(own))
        for at in range(0, len(v), step):
            far = angles(raised(v[at : at + step], top), pivots)
            best = far.argmin(axis=1)
            cell[at : at + step], least[at : at + step] = own[best], far[np.arange(len(far)), best]
        return cell, least

    def cover(self, stats: pd.DataFrame, block_rows: int) -> None:
        """stats: (cell, inner, outer, least, n) of every cell with a vector."""
        n = len(self.pivots)
        at = stats["cell"].to_numpy()
        self.inner, self.outer, self.least, self.blocks = np.zeros(n), np.full(n, -1.0), np.full(n, HIGH), np.zeros(n, np.int64)
        self.inner[at], self.outer[at], self.least[at] = stats["inner"], stats["outer"], stats["least"]
        self.blocks[at] = -(-stats["n"].to_numpy() // block_rows)
        for top in np.unique(self.tops[at]):
            cells = at[self.tops[at] == top]
            k = max(1, int(len(cells) ** 0.5))
            heads = unit(fit_balanced(self.pivots[cells].astype(np.float32), k, rounds=4))
            far = angles(self.pivots[cells], heads)
            of = far.argmin(axis=1)
            for g in np.unique(of):
                mine, up = cells[of == g], far[of == g, g]
                self.groups.append((heads[g], mine, up, float((up + self.outer[mine]).max())))

    def bounds(self, u: np.ndarray, length: np.ndarray, kth: np.ndarray, kid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each cell promises each query, the angle to its pivot); cells that groups or stored
        angles rule out promise nothing and are not computed."""
        out, far = np.full((len(u), len(self.pivots)), -np.inf), np.zeros((len(u), len(self.pivots)))
        for head, cells, up, cover in self.groups:
            reach = length * self.tops[cells[0]]
            above = angles(u, head[None, :])[:, 0]
            rows = np.flatnonzero(worth(promise(reach, above - cover), self.least[cells].min(), kth, kid))
            if not len(rows):
                continue
            stored = promise(reach[rows, None], np.abs(above[rows, None] - up[None, :]) - self.outer[cells][None, :])
            may = worth(stored, self.least[cells][None, :], kth[rows, None], kid[rows, None])
            some = np.flatnonzero(may.any(axis=0))
            if not len(some):
                continue
            met = angles(u[rows], self.pivots[cells[some]])
            low = np.maximum(met - self.outer[cells[some]][None, :], self.inner[cells[some]][None, :] - met)
            far[np.ix_(rows, cells[some])] = met
            out[np.ix_(rows, cells[some])] = np.where(may[:, some], promise(reach[rows, None], low), -np.inf)
        return out, far


def build_pages(rows: pd.DataFrame, pivots: np.ndarray, tops: np.ndarray, page_rows: int, most: int) -> pd.DataFrame:
    """The pages of one block of a cell: clusters of about page_rows vectors, cut by their angle into rings."""
    cell, block = int(rows["cell"].iloc[0]), int(rows["block"].iloc[0])
    v = _matrix(rows["v"], 0)
    first, ids = merge_ids(v, rows["ids"].tolist(), most)
    v, top = v[first], float(tops[cell])
    x = raised(v, top)
    k = -(-len(v) // page_rows)
    points = unit(fit_balanced(x.astype(np.float32), k, rounds=4)) if k > 1 else unit(x.mean(axis=0, keepdims=True))
    far = angles(x, points)
    of, out = far.argmin(axis=1), []
    for c in np.unique(of):
        mine = np.flatnonzero(of == c)
        mine = mine[np.argsort(far[mine, c], kind="stable")]
        up = float(angles(points[c : c + 1], pivots[cell : cell + 1])[0, 0])
        for at in range(0, len(mine), 2 * page_rows):
            part = mine[at : at + 2 * page_rows]
            kind, thin = narrow(v[part])
            own = far[part, c]
            flat = np.concatenate([ids[i] for i in part])
            of_id = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
            out.append((cell, block, len(out), points[c], up, float(own[0]), float(own[-1]), top, int(flat.min()), flat, of_id.astype(np.int32), kind + thin.tobytes(), own))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PAGES.split(", ")])


def packs(tree: Directory, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, kid: np.ndarray, visited: list | None, first: int) -> Iterator[pd.DataFrame]:
    """Queries dealt to the `first` cells that promise most or, where `visited` tells the cells of each that
    were searched, to all others that may hold something; about HELD values at a time."""
    u, length = directions(q)
    bound, far = tree.bounds(u, length, kth, kid)
    if visited is None:
        n = min(first, bound.shape[1])
        best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        go = np.zeros(bound.shape, bool)
        np.put_along_axis(go, best, True, axis=1)
        go &= bound > -np.inf
    else:
        go = worth(bound, tree.least[None, :], kth[:, None], kid[:, None]) & (bound > -np.inf)
        for i, cells in enumerate(visited):
            go[i, cells] = False
    kind, thin = narrow(q)
    pack = max(1, PACK_BYTES // max(1, thin.itemsize * q.shape[1]))
    names, out, held = [c.split()[0] for c in _PACKS.split(", ")], [], 0
    for cell in np.flatnonzero(go.any(axis=0)):
        asking = np.flatnonzero(go[:, cell])
        for at in range(0, len(asking), pack):
            r = asking[at : at + pack]
            out.append((cell, tree.blocks[cell], len(r), qid[r[0]], qid[r], kind + thin[r].tobytes(), far[r, cell], kth[r], kid[r]))
            held += len(r) * (q.shape[1] + 4)
            if held >= HELD:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
    yield pd.DataFrame(out, columns=names)


class Found:
    """The best (score, id) pairs of each query so far, best first; one a different id."""

    def __init__(self, kth: np.ndarray, kid: np.ndarray, most: int):
        self.score, self.id = np.full((len(kth), most), LOW), np.full((len(kth), most), HIGH)
        self.kth, self.kid = kth.copy(), kid.copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        most = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        named = np.sort(np.where(s == LOW, HIGH, i), axis=1)
        for r in np.flatnonzero(((named[:, 1:] == named[:, :-1]) & (named[:, 1:] != HIGH)).any(axis=1)):
            keep = np.sort(np.unique(i[r], return_index=True)[1])
            n = len(keep)
            s[r, :n], i[r, :n], s[r, n:], i[r, n:] = s[r, keep], i[r, keep], LOW, HIGH
        self.score[rows], self.id[rows] = s[:, :most], i[:, :most]
        last, at = s[:, most - 1], i[:, most - 1]
        better = (last > self.kth[rows]) | ((last == self.kth[rows]) & (at < self.kid[rows]))
        self.kth[rows[better]], self.kid[rows[better]] = last[better], at[better]


def search_pages(pages: pd.DataFrame, packs: pd.DataFrame, dim: int, most: int) -> pd.DataFrame:
    """(qid, vec_id, score): for each query what one block of a cell adds to its best."""
    empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    if not len(pages) or not len(packs):
        return empty
    qid, above, kth, kid = (np.concatenate(packs[c].tolist()) for c in ("qids", "angle", "kth", "kid"))
    q = np.concatenate([widened(b, len(ids), dim) for b, ids in zip(packs["q"], packs["qids"], strict=True)])
    u, length = directions(q)
    pivots = np.stack(pages["pivot"].tolist())
    up, inner, outer, least = (pages[c].to_numpy() for c in ("up", "inner", "outer", "least"))
    reach = length * pages["top"].iloc[0]
    found = Found(kth, kid, most)
    # Pages that the stored angle to the cell's pivot rules out are never met.
    may = worth(promise(reach[:, None], np.abs(above[:, None] - up[None, :]) - outer[None, :]), least[None, :], kth[:, None], kid[:, None])
    some = np.flatnonzero(may.any(axis=0))
    if not len(some):
        return empty
    pivots, inner, outer, least, may, pages = pivots[some], inner[some], outer[some], least[some], may[:, some], pages.iloc[some]
    met = angles(u, pivots)
    bound = np.where(may, promise(reach[:, None], np.maximum(met - outer[None, :], inner[None, :] - met)), -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    held = [(widened(p.vectors, len(p.far), dim), np.asarray(p.ids, np.int64), np.asarray(p.of), np.asarray(p.far, np.float64)) for p in pages.itertuples()]
    live = np.arange(len(qid))
    for step in range(len(pages)):
        page = order[live, step]
        promised = bound[live, page]
        # A page of equal bound may still hold a smaller id, so only a lesser bound ends a query.
        live = live[promised >= found.kth[live]]
        if not len(live):
            break
        page = order[live, step]
        go = worth(bound[live, page], least[page], found.kth[live], found.kid[live])
        for p in np.unique(page[go]):
            rows = live[go & (page == p)]
            v, ids, of, far = held[p]
            near = worth(promise(reach[rows, None], np.abs(met[rows, p, None] - far[None, :])), least[p], found.kth[rows, None], found.kid[rows, None])
            cols = np.flatnonzero(near.any(axis=0))
            if not len(cols):
                continue
            scores = products(q[rows], v[cols])
            place = np.full(len(v), -1)
            place[cols] = np.arange(len(cols))
            own = np.flatnonzero(place[of] >= 0)
            scores = scores[:, place[of[own]]]
            better = (scores >= found.kth[rows, None]).any(axis=1)
            if better.any():
                found.add(rows[better], scores[better], ids[own][None, :])
    real = (found.id != HIGH) | (found.score != LOW)
    real &= (found.score > kth[:, None]) | ((found.score == kth[:, None]) & (found.id <= kid[:, None]))
    r, c = np.nonzero(real)
    return pd.DataFrame({"qid": qid[r], "vec_id": found.id[r, c], "score": found.score[r, c]})


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vector: str = "embedding",
    id_col: str = "vec_id",
    scale: float = 64.0,
    cell_rows: int = 1_024,
    page_rows: int = 64,
    max_cells: int = 16_384,
    sample_rows: int = 20_000,
    first: int = 4,
    block_rows: int = 4_096,
    block_queries: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest whole inner products."""
    spark, most = vectors.sparkSession, k + 1
    schema = "query_id long, rank int, vec_id long, score long"
    # read several times; whole numbers are made once
    good, asked = (written(integer_vectors(df, vector, id_col, scale), "mtree-whole") for df in (vectors, queries))
    shape = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dim = shape["dim"]
    good, asked = good.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    long = good.filter("size is not null")
    bands, top = ({}, 0.0) if long.isEmpty() else fit_bands(long, dim, cell_rows, max_cells, sample_rows)
    # A band ends at a power of two over `top`; zero vectors are a cell of their own. A length whose rounded
    # logarithm crosses the end of its band is still no longer than the end with this margin.
    ends = {b: float(np.exp2(min(1023.0, band.top)) * (1 + 1e-9)) for b, band in bands.items()}
    pivots = np.concatenate([*(unit(band.centroids.points) for band in bands.values()), unit(np.zeros((1, dim + 1)))])
    tops = np.concatenate([*(np.full(band.lists, ends[b]) for b, band in bands.items()), [0.0]])
    directory, zero_cell = Directory(pivots, np.where(tops > 0, tops, 1.0)), len(pivots) - 1
    directory.tops[zero_cell] = np.finfo(float).tiny  # of no band, and of no length
    plan = spark.sparkContext.broadcast((directory, ends, top))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        tree, ends, top = plan.value
        dealt = 0
        for batch in batches:
            v = _matrix(batch["v"], dim)
            if not len(v):
                continue
            rows, ids = merge_ids(v, batch["vec_id"].tolist(), most)
            v, size = v[rows], batch["size"].to_numpy(np.float64)[rows]
            cell, far = np.full(len(v), zero_cell), np.zeros(len(v))
            band = np.where(np.isnan(size), -(10**6), np.ceil(np.nan_to_num(size) - top)).astype(np.int64)
            for b in np.unique(band[~np.isnan(size)]).tolist():
                at = np.flatnonzero(band == b)
                cell[at], far[at] = tree.assign(v[at], ends[b])
            yield pd.DataFrame({"cell": cell, "v": list(v), "ids": ids, "far": far, "deal": dealt + np.arange(len(v))})
            dealt += len(v)

    posted = written(long.unionByName(good.filter("size is null")).mapInPandas(assign, "cell int, v array<double>, ids array<long>, far double, deal long"), "mtree-vectors")
    stats = posted.groupBy("cell").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.min(F.col("ids")[0]).alias("least"), F.count("*").alias("n"))
    known = stats.toPandas()  # a row a cell
    directory.cover(known, block_rows)
    plan.unpersist()
    tree = spark.sparkContext.broadcast(directory)
    counts = F.broadcast(stats.select("cell", F.ceil(F.col("n") / block_rows).alias("_blocks")))
    cut = posted.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("deal"), F.col("_blocks")).cast("int"))
    pages = written(cut.select("cell", "block", "v", "ids").groupBy("cell", "block").applyInPandas(lambda rows: build_pages(rows, tree.value.pivots, tree.value.tops, page_rows, most), _PAGES), "mtree-pages")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"], dim)
            if len(v):
                rows, ids = merge_ids(v, batch["vec_id"].tolist(), len(v))
                yield pd.DataFrame({"q": list(v[rows]), "asking": ids})

    each = asked.mapInPandas(once, "q array<double>, asking array<long>").withColumn("qid", F.monotonically_increasing_id())
    each = written(each, "mtree-queries")
    # A step's queries, and those of one of `parts` tasks, against all cells are about HELD numbers.
    step = max(64, min(1_024, HELD // len(pivots)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), each.count() * len(pivots) // HELD)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                again = "visited" in part
                kth = part["kth"].to_numpy(np.int64) if again else np.full(len(part), LOW)
                kid = part["kid"].to_numpy(np.int64) if again else np.full(len(part), HIGH)
                yield from packs(tree.value, part["qid"].to_numpy(), _matrix(part["q"], dim), kth, kid, [np.asarray(x, int) for x in part["visited"]] if again else None, first)

    def meet(routed: DataFrame) -> DataFrame:
        shares = F.broadcast(routed.groupBy("cell").agg(F.ceil(F.sum("n") / block_queries).cast("int").alias("_shares")))  # a row a cell
        left = pages.join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
        right = routed.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("deal"), F.col("_shares")).cast("int"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("_shares", "blocks", "n", "deal")
        return left.groupBy("cell", "block", "share").cogroup(right.groupBy("cell", "block", "share")).applyInPandas(lambda p, q: search_pages(p, q, dim, most), "qid long, vec_id long, score long")

    def best(found: DataFrame, by: str, keep: int) -> DataFrame:
        one = found.groupBy(by, "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= keep)

    routed = written(each.select("qid", "q").mapInPandas(route, _PACKS), "mtree-first")
    start = written(best(meet(routed), "qid", most), "mtree-found")
    last = start.filter(F.col("rank") == most).select("qid", F.col("score").alias("kth"), F.col("vec_id").alias("kid"))
    visited = routed.select("cell", F.explode("qids").alias("qid")).groupBy("qid").agg(F.collect_list("cell").alias("visited"))
    later = each.select("qid", "q").join(last, "qid", "left").join(visited, "qid", "left")
    later = later.select("qid", "q", F.coalesce("kth", F.lit(LOW)).alias("kth"), F.coalesce("kid", F.lit(HIGH)).alias("kid"), F.coalesce("visited", F.array().cast("array<int>")).alias("visited"))
    rest = meet(written(later.repartition(parts, "qid").mapInPandas(route, _PACKS), "mtree-rest"))
    top_rows = best(start.drop("rank").unionByName(rest), "qid", most).drop("rank")
    named = each.select("qid", F.explode("asking").alias("query_id")).join(top_rows, "qid").filter("query_id <> vec_id").drop("qid")
    return best(named, "query_id", k).select("query_id", "rank", "vec_id", "score")
