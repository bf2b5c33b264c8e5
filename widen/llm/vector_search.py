"""Approximate nearest neighbours with balanced posting lists.

Centroids come from k-means on a bounded sample; clusters that are too large
are halved, so lists are of like size. Every vector is posted to its nearest
list and, when it lies near a boundary, to the next ones too. Centroids are
found through a neighbour graph held in memory by each task; a query reads the
lists whose centroids are at most a ratio further than its nearest one. Lists
are stored in blocks of bounded size and queries in chunks of bounded size, so
a popular list or a popular query is work for many tasks.

Equal vectors are posted once, with the k + 1 least ids: no query can return
more of them, so this loses nothing however many copies there are.

Defined results: vectors that are null, zero or of another length than
most, or that hold a null, NaN or infinity, take no part, as queries neither; a
null id takes no part; repeated ids with different vectors count once, with the
nearer one; with fewer than k candidates all are returned; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most centroids: bounds what tasks hold and what the driver computes.
MAX_LISTS = 4096


@dataclass
class Centroids:
    """Centres and their neighbour graph."""

    points: np.ndarray  # list x dimension
    graph: np.ndarray  # list x degree

    def distances(self, x: np.ndarray, ratio: float, beam: int, width: int = 8) -> np.ndarray:
        """Distances to the centres met by a best-first walk of the graph,
        infinity elsewhere. The walk of a row ends when its nearest open centre
        is beyond ``ratio`` times the nearest one and beyond the ``beam``-th."""
        k, n = len(self.points), len(x)
        beam, width = min(beam, k), min(width, k)
        norms = (self.points ** 2).sum(1)
        rows = np.arange(n)[:, None]
        found = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)

        def measure(on, cols):
            y = x[on]
            d = (y ** 2).sum(1)[:, None] - 2 * (self.points[cols] @ y[:, :, None])[:, :, 0] + norms[cols]
            found[on[:, None], cols] = np.sqrt(np.maximum(d, 0))

        measure(np.arange(n), np.tile(np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int)), (n, 1)))
        while True:
            limit = np.maximum(found.min(1) * (1 + ratio), np.partition(found, beam - 1, axis=1)[:, beam - 1])
            open_ = np.where(done, np.inf, found)
            pick = np.argpartition(open_, width - 1, axis=1)[:, :width]
            near = open_[rows, pick]
            take = np.isfinite(near) & (near <= limit[:, None])
            if not take.any():
                return found
            done[rows, pick] |= take
            on = np.flatnonzero(take.any(1))
            # a place that is not taken repeats the best one of its row
            best = np.where(take, pick, pick[np.arange(n), near.argmin(1)][:, None])[on]
            measure(on, self.graph[best].reshape(len(on), -1))


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 8, degree: int = 16, seed: int = 5) -> Centroids:
    """k-means of ``lists`` centres, large clusters halved, and their graph."""
    x = sample.astype(np.float64)  # squares of single precision components overflow
    rng = np.random.default_rng(seed)
    k = max(1, min(lists, len(x), MAX_LISTS))
    c = x[rng.choice(len(x), k, replace=False)].copy()

    def nearest(c):
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            out[s:s + 4096] = ((c ** 2).sum(1) - 2 * x[s:s + 4096] @ c.T).argmin(1)
        return out

    for r in range(rounds):
        own = nearest(c)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        # balance: the smallest centres move beside the largest clusters
        large = np.argsort(-size)[:max(1, k // 16)]
        large = large[size[large] > 2 * len(x) / k]
        if r < rounds - 2 and len(large):
            small = np.argsort(size)[:len(large)]
            for a, b in zip(large, small):
                members = np.flatnonzero(own == a)
                c[b] = x[rng.choice(members)] * 0.5 + c[a] * 0.5
    c = np.unique(c, axis=0)
    k = len(c)
    degree = min(degree, k)
    graph = np.empty((k, degree + 4), np.int64)
    for s in range(0, k, 1024):
        d = (c ** 2).sum(1) - 2 * c[s:s + 1024] @ c.T
        graph[s:s + 1024, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    # links to the next centres in a fixed order and to far ones keep the graph in one piece
    graph[:, degree:] = (np.arange(k)[:, None] + np.array([1, 7, 61, 509])) % k
    return Centroids(c, graph)


def _near_lists(vectors: DataFrame, ids: list[str], centroids: Centroids, ratio: float, beam: int, most: int | None,
                least: int = 1, batch: int = 256) -> DataFrame:
    """One row per vector and list that is near enough: ids, vector, list."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                s = b.slice(at, batch)
                x = s.column(s.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)
                d = centroids.distances(x.astype(np.float64), ratio, beam)
                hit = d <= d.min(1, keepdims=True) * (1 + ratio)
                if least > 1:
                    n = min(least, d.shape[1])
                    hit |= d <= np.partition(d, n - 1, axis=1)[:, n - 1:n]
                hit &= np.isfinite(d)
                if most is not None and most < d.shape[1]:
                    hit &= d <= np.partition(d, most - 1, axis=1)[:, most - 1:most]
                rows, lists = np.nonzero(hit)
                out = s.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.astype(np.int32))],
                                                 [*ids, "vec", "list"])

    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in [*ids, "vec"])
    return vectors.select(*ids, "vec").mapInArrow(run, f"{fields}, list int")


def _blocks(rows: DataFrame, key: str, columns: list[str], size: int, name: str) -> DataFrame:
    """Rows of a list gathered in blocks of about ``size`` by the hash of
    ``key``. The block counts are a row a list, MAX_LISTS at most."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("__blocks"))
    dealt = rows.join(F.broadcast(counts), "list").withColumn(
        "__block", F.pmod(F.xxhash64(key), F.col("__blocks")))
    return dealt.groupBy("list", "__block").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("__block")


def usable(vector: str) -> Column:
    """Not null, not zero, and every component finite."""
    v = F.col(vector)
    return (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
            sample: int = 20_000, spread: float = 0.08, replicas: int = 4, ratio: float = 0.2, least: int = 16, beam: int = 32,
            lists: int | None = None, block: int = 1024, chunk: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row where
    ``queries`` (a condition on column ``id``) holds; never the row's own id.

    ``sample`` bounds the vectors that train centroids (about so many are drawn); ``lists`` is their
    number (the root of the number of vectors unless given); a vector is posted
    to up to ``replicas`` lists within 1 + ``spread`` of its nearest; a query
    reads the lists within 1 + ``ratio``, and ``least`` lists in any case (all
    lists of a small table, so that few candidates are all returned).
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"))
    widths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    rows = rows.where(F.size("vec") == widths[0]["n"])
    order = W.partitionBy("vec").orderBy("id")
    posted = (rows.distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1)
              .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
              .withColumn("id", F.col("ids")[0]).checkpoint())
    n = posted.count()
    # about ``sample`` hashes in n fall below it; tasks send only what is drawn
    drawn = posted.where(F.pmod(F.xxhash64("vec"), F.lit(max(n, 1))) < sample).select("id", "vec").toArrow().sort_by("id")
    x = np.stack([np.asarray(v, np.float64) for v in drawn.column(1).to_pylist()])
    centroids = train_centroids(x, lists or int(np.clip(np.sqrt(n), 16, MAX_LISTS)))

    posting = _near_lists(posted, ["id", "ids"], centroids, spread, 2 * replicas, replicas)
    wanted = rows.where(queries).withColumnRenamed("id", "query_id")
    asked = _near_lists(wanted, ["query_id"], centroids, ratio, beam, None, least)
    pairs = (_blocks(asked, "query_id", ["query_id", "vec"], chunk, "asked")
             .join(_blocks(posting, "id", ["ids", "vec"], block, "posted"), "list").select("asked", "posted"))

    def best(batches):
        held, count = [], 0

        def compact():
            q, v, d = (np.concatenate(c) for c in zip(*held))
            o = np.lexsort((v, d, q))
            q, v, d = q[o], v[o], d[o]
            # a vector posted to several lists comes several times, always at the same distance
            same = np.r_[False, (q[1:] == q[:-1]) & (v[1:] == v[:-1]) & (d[1:] == d[:-1])]
            q, v, d = q[~same], v[~same], d[~same]
            first = np.r_[True, q[1:] != q[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            keep = np.arange(len(q)) - start < 2 * k
            return q[keep], v[keep], d[keep]

        def batch():
            q, v, d = compact()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(d)], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                a, p = b.column(0)[i].values, b.column(1)[i].values
                q, ids = a.field(0).to_numpy(), p.field(0)
                qx = a.field(1).flatten().to_numpy().astype(np.float64).reshape(len(a), -1)
                px = p.field(1).flatten().to_numpy().astype(np.float64).reshape(len(p), -1)
                qq, pp = (qx ** 2).sum(1)[:, None], (px ** 2).sum(1)
                rough = qq - 2 * qx @ px.T + pp
                # all that may be as near as the k-th, the query itself not counted: ties too
                m = min(k + 1, len(px))
                limit = np.partition(rough, m - 1, axis=1)[:, m - 1:m] + 1e-11 * (qq + pp.max())
                asked_at, near = np.nonzero(rough <= limit)
                exact = np.concatenate([np.empty(0), *(
                    np.sqrt(((qx[asked_at[j:j + 8192]] - px[near[j:j + 8192]]) ** 2).sum(1)) for j in range(0, len(near), 8192))])
                counts = np.diff(ids.offsets.to_numpy())
                starts = np.r_[0, np.cumsum(counts)[:-1]]
                flat = ids.flatten().to_numpy()
                times = counts[near]
                at = np.repeat(starts[near] - np.cumsum(times) + times, times) + np.arange(times.sum())
                qs, vs, exact = np.repeat(q[asked_at], times), flat[at], np.repeat(exact, times)
                own = qs != vs
                held.append((qs[own], vs[own], exact[own]))
                count += len(vs)
                if count > 400_000:
                    held = [compact()]
                    count = len(held[0][0])
                    if count > 200_000:
                        yield batch()
                        held, count = [], 0
        if held:
            yield batch()

    found = pairs.mapInArrow(best, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


QUERIES = {"op2_vector_search": op2_vector_search}
ORACLES: dict[str, str] = {}
