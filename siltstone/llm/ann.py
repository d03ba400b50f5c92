"""Approximate nearest neighbours by balanced posting lists.

Vectors are clustered into lists of about `list_rows`. The centroids, about `max_centroids` at
most, are fitted on a bounded sample with a charge on full clusters, so that lists come out even,
and are held in every worker's memory with a neighbour graph that a beam search walks. A vector near
a boundary is put into up to `replicas` lists (within `replica_ratio` of its nearest centroid's
distance). A query visits the lists within `probe_ratio` of its nearest centroid's distance, but
`least_lists` (or the root of the number of lists, if that is more) at least, as a query may lie on
a centroid, and twice as many at most, which sets recall against work.

Vectors are told apart by length first: a band holds lengths within a factor of two, and each band
has lists of its own. Within a band a vector is scaled by the band's upper end and gets one more
coordinate that makes all of one length, so nearness in space is largeness of the product; a single
very long vector is a band of its own and changes nothing for the others. Lengths are measured in
logarithms and only directions are clustered, so no component is too large or too small.

Every vector is indexed. A list that outgrows `block_rows`, or is asked by more than `block_queries`
queries, is split into blocks that are searched apart, so no group grows with a hot list. Scores are
recomputed on the original vectors in double precision, pair by pair. Queries that found fewer than
`k` in their lists are compared with every row, in blocks.

Defined cases: vectors that are null, zero, of another length than most (ties: the longer), or hold
null or non-finite components take no part, nor do null ids; of rows with one id, each result lists
the id once with its best score, and a query never finds its own id; ties go to the smaller id; a
product beyond the doubles is infinite, and one that has no value (infinities of both signs) comes
last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


class Centroids:
    """Centroids and a graph of their nearest neighbours."""

    def __init__(self, points: np.ndarray, degree: int = 24):
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        self.square = np.einsum("ij,ij->i", self.points, self.points)
        degree = min(degree, max(1, n - 1))
        graph = np.zeros((n, degree), np.int32)
        for at in range(0, n, 1024):
            d = self.square[None] - 2 * self.points[at : at + 1024] @ self.points.T
            own = np.arange(len(d))
            d[own, own + at] = np.inf
            graph[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if n > 1 else 0
        rng = np.random.default_rng(5)
        far = rng.integers(0, n, (n, max(1, degree // 4)))
        self.graph = np.concatenate([graph, far], axis=1).astype(np.int32)
        self.entries = rng.permutation(n)[: min(n, 16)].astype(np.int32)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, by a beam search over the graph of all queries in step."""
        q = np.ascontiguousarray(queries, np.float32)
        rows, n = len(q), len(self.points)
        beam = min(beam, n)
        seen = np.zeros((rows, n), bool)
        first = np.broadcast_to(self.entries, (rows, len(self.entries)))
        seen[:, self.entries] = True
        ids = np.full((rows, beam), -1, np.int64)
        far = np.full((rows, beam), np.inf, np.float32)
        done = np.zeros((rows, beam), bool)
        ids, far, done = self._merge(ids, far, done, first, self._distance(q, first), beam)
        own = np.arange(rows)
        while True:
            waiting = np.where(done | ~np.isfinite(far), np.inf, far)
            best = waiting.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(waiting[own, best]))
            if not len(live):
                break
            done[live, best[live]] = True
            near = self.graph[ids[live, best[live]]]
            d = self._distance(q[live], near)
            d[seen[live[:, None], near]] = np.inf
            order = np.sort(near, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():  # a far link may repeat a near one
                for c in range(1, near.shape[1]):
                    d[(near[:, :c] == near[:, c : c + 1]).any(axis=1), c] = np.inf
            seen[live[:, None], near] = True
            ids[live], far[live], done[live] = self._merge(ids[live], far[live], done[live], near, d, beam)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0))

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.square[ids] - 2 * np.einsum("ij,ikj->ik", q, self.points[ids]), 0)

    @staticmethod
    def _merge(ids, far, done, more, d, beam):
        ids, far = np.concatenate([ids, more], 1), np.concatenate([far, d], 1)
        done = np.concatenate([done, np.zeros(more.shape, bool)], 1)
        if ids.shape[1] > beam:
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            ids, far, done = (np.take_along_axis(x, best, 1) for x in (ids, far, done))
        return ids, far, done


def fit_balanced(sample: np.ndarray, k: int, rounds: int = 16, charge: float = 0.02) -> np.ndarray:
    """k-means in which a cluster over its fair share costs more, a little more each round that it
    stays so; the charge is small against distances, so centroids stay in the midst of their points."""
    rng = np.random.default_rng(11)
    points = sample[rng.permutation(len(sample))[:k]].astype(np.float32)
    cost = np.zeros(len(points), np.float32)
    for _ in range(rounds):
        owner = np.empty(len(sample), np.int64)
        spread = 0.0
        for at in range(0, len(sample), 4096):
            part = sample[at : at + 4096]
            d = (points**2).sum(1)[None] - 2 * part @ points.T
            owner[at : at + 4096] = (d + cost[None]).argmin(1)
            spread += float((np.take_along_axis(d, owner[at : at + 4096, None], 1)[:, 0] + (part**2).sum(1)).sum())
        sizes = np.bincount(owner, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, owner, sample)
        full = sizes > 0
        points[full] = sums[full] / sizes[full, None]
        if (~full).any():
            points[~full] = sample[rng.integers(0, len(sample), int((~full).sum()))]
        fair = len(sample) / len(points)
        step = charge * max(spread, 0) / len(sample)
        cost = (0.7 * cost + step * np.clip(sizes / fair - 1, 0, 4)).astype(np.float32)
    return points


def valid_vectors(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """(vec_id, v, size): size is the binary logarithm of the length."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda s, x: s + x * x)
    return rows.withColumn("size", F.when(square.between(1e-250, 1e250), F.log2(square) / 2).otherwise(F.log2(largest) + F.log2(scaled) / 2))


def _unit(v: np.ndarray) -> np.ndarray:
    u = v / np.abs(v).max(axis=1, keepdims=True)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _lifted(v: np.ndarray, below_top: np.ndarray) -> np.ndarray:
    """Directions at 2 ** below_top of the unit sphere's radius, raised onto the sphere."""
    r = np.exp2(np.minimum(below_top, 0.0))
    return np.concatenate([_unit(v) * r[:, None], np.sqrt(1 - r * r)[:, None]], axis=1).astype(np.float32)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def _blocks(rows: DataFrame, name: str, most: int) -> DataFrame:
    return rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("long").alias(name))


def _best(vs: pd.DataFrame, qs: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The k best ids of vs for each query of qs; values without an order count as the least."""
    if not len(vs) or not len(qs):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    vs = vs.sort_values("vec_id", ignore_index=True)
    v, q, ids = _matrix(vs["v"], dim), _matrix(qs["q"], dim), vs["vec_id"].to_numpy()
    different, starts, of = np.unique(ids, return_index=True, return_inverse=True)
    single = len(different) == len(ids)
    longest = np.abs(v).max() * dim
    asked, picked, scores, sizes = qs["query_id"].to_numpy(), [], [], []
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            rough = part @ v.T
            slack = 1e-13 * longest * np.abs(part).max(axis=1)  # what the order of additions may change
            sure = np.isfinite(rough).all(axis=1) & np.isfinite(slack)
            for i, row in enumerate(rough):
                others = different != asked[at + i]
                if sure[i] and others.sum() > k:
                    best = row if single else np.maximum.reduceat(row, starts)  # the best row of each id
                    kth = np.partition(best[others], others.sum() - k)[others.sum() - k]
                    others &= best >= kth - slack[i]
                keep = np.flatnonzero(others if single else others[of])
                score = (v[keep] * part[i]).sum(axis=1)
                order = np.lexsort((ids[keep], -score, np.isnan(score)))
                if not single:
                    order = order[np.sort(np.unique(ids[keep][order], return_index=True)[1])]
                order = order[:k]
                picked.append(ids[keep[order]])
                scores.append(score[order])
                sizes.append(len(order))
    return pd.DataFrame({"query_id": np.repeat(asked, sizes), "vec_id": np.concatenate(picked), "score": np.concatenate(scores)})


class Band:
    """The lists of one band of lengths: `first` is the number of its first list, `top` its upper end."""

    def __init__(self, points: np.ndarray, first: int, top: float):
        self.centroids, self.first, self.top = Centroids(points), first, top
        self.lists = len(points)

    def least(self, least_lists: int) -> int:
        return min(self.lists, max(least_lists, int(self.lists**0.5)))


def fit_bands(good: DataFrame, dim: int, list_rows: int, max_centroids: int, sample_rows: int) -> tuple[dict[int, Band], float]:
    """(bands by number, the upper end of band 0 as a binary logarithm)."""
    top = good.agg(F.percentile_approx("size", 0.99, 10_000)).first()[0] + 0.001
    band = F.ceil(F.col("size") - F.lit(top)).cast("int")
    sizes = {r.band: r["count"] for r in good.groupBy(band.alias("band")).count().collect()}  # a double has about 2,100 at most
    rows = sum(sizes.values())
    limit = max(1, min(sample_rows, 4_000_000 // dim))
    drawn = F.xxhash64("vec_id", "v")
    bands, first = {}, 0
    for b, n in sorted(sizes.items()):
        own = max(1, limit * n // rows, min(1_024, limit // len(sizes)))
        lists = max(1, min(max(1, max_centroids * n // rows), -(-n // list_rows), own))
        if lists == 1:
            points = np.zeros((1, dim + 1), np.float32)
        else:
            near = good.filter(band == b).withColumn("h", drawn).filter(F.col("h") <= int(-(2**63) + 2**64 * min(1.0, 2 * own / n)) - 1)
            sample = near.orderBy("h", "vec_id").limit(own).select("v", "size").toPandas()
            points = fit_balanced(_lifted(_matrix(sample["v"], dim), sample["size"].to_numpy() - top - b), min(lists, len(sample)))
        bands[b] = Band(points, first, top + b)
        first += bands[b].lists
    return bands, top


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vector: str = "embedding",
    id_col: str = "vec_id",
    list_rows: int = 256,
    max_centroids: int = 16_384,
    sample_rows: int = 20_000,
    replica_ratio: float = 1.15,
    replicas: int = 6,
    probe_ratio: float = 1.35,
    least_lists: int = 16,
    beam: int = 96,
    block_rows: int = 4_096,
    block_queries: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good, asked = valid_vectors(vectors, vector, id_col), valid_vectors(queries, vector, id_col)
    shape = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dim = shape["dim"]
    good, asked = good.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    bands, top = fit_bands(good, dim, list_rows, max_centroids, sample_rows)
    shared = spark.sparkContext.broadcast(bands)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealt = 0
        for batch in batches:
            number = np.ceil(batch["size"].to_numpy() - top).astype(np.int64)
            for b in np.unique(number).tolist():
                band, rows = shared.value[b], batch[number == b]
                for at in range(0, len(rows), 1024):
                    part = rows.iloc[at : at + 1024]
                    ids, far = band.centroids.search(_lifted(_matrix(part["v"], dim), part["size"].to_numpy() - band.top), 32)
                    ids, far = ids[:, :replicas], far[:, :replicas]
                    take = np.isfinite(far) & (far <= replica_ratio * far[:, :1])
                    take[:, 0] = True
                    r, c = np.nonzero(take)
                    yield pd.DataFrame({"list": band.first + ids[r, c], "vec_id": part["vec_id"].to_numpy()[r], "v": part["v"].to_numpy()[r], "deal": dealt + r})
                    dealt += len(part)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealt = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                flat = np.concatenate([_unit(_matrix(part["v"], dim)), np.zeros((len(part), 1))], axis=1)
                for band in shared.value.values():
                    least = band.least(least_lists)
                    ids, far = band.centroids.search(flat, max(beam, 3 * least))
                    ids, far = ids[:, : 2 * least], far[:, : 2 * least]
                    near = far <= probe_ratio * far[:, :1]
                    near[:, :least] = True
                    r, c = np.nonzero(np.isfinite(far) & near)
                    yield pd.DataFrame({"list": band.first + ids[r, c], "query_id": part["vec_id"].to_numpy()[r], "q": part["v"].to_numpy()[r], "deal": dealt + r})
                dealt += len(part)

    def in_blocks(rows: DataFrame, own: str, most: int, other: DataFrame, across: str) -> DataFrame:
        """rows in blocks of their own list, repeated for each block of the other side. They are dealt
        by a number from the task that wrote them, so rows of one id do not meet."""
        mine = F.broadcast(_blocks(rows, "_own", most))  # a row a list, as is the other
        both = rows.join(mine, "list").join(F.broadcast(other.withColumnRenamed("blocks", "_other")), "list")
        both = both.withColumn(own, F.pmod(F.xxhash64("deal"), F.col("_own"))).withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1)))
        return both.drop("_own", "_other", "deal")

    def meet(postings: DataFrame, routed: DataFrame) -> DataFrame:
        """The k best of every query over its lists."""
        left = in_blocks(postings, "vb", block_rows, _blocks(routed, "blocks", block_queries), "qb")
        right = in_blocks(routed, "qb", block_queries, _blocks(postings, "blocks", block_rows), "vb")
        found = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInPandas(lambda v, q: _best(v, q, dim, k), "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max_by("score", F.struct(~F.isnan("score"), "score")).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # written, because each is read twice: for its blocks and for the join
    postings = written(good.mapInPandas(post, "list int, vec_id long, v array<double>, deal long"), "postings")
    routed = written(asked.mapInPandas(route, "list int, query_id long, q array<double>, deal long"), "routed")
    found = meet(postings, routed)
    if all(b.lists <= b.least(least_lists) for b in bands.values()):
        return found  # every list was visited
    found = written(found, "found")
    full = found.filter(F.col("rank") == k).select("query_id")
    short = asked.select(F.lit(0).alias("list"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.monotonically_increasing_id().alias("deal")).join(full, "query_id", "left_anti")
    short = written(short, "short")
    if short.isEmpty():
        return found
    every = written(good.select(F.lit(0).alias("list"), "vec_id", "v", F.monotonically_increasing_id().alias("deal")), "every")
    rest = meet(every, short)
    return found.join(full, "query_id", "left_semi").unionByName(rest)
