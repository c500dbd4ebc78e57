"""Approximate nearest neighbours: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distances, and exact reranking.

Centroids and codebooks are trained on a bounded sample; every vector is put
into the list of its nearest centroid with the codes of its residual.  There are
about as many lists as the square root of the vectors.  How many lists a query
looks into is measured on the sample: the fewest that hold the wanted share of
true neighbours, few for vectors in clusters and most for vectors without any.

A query first looks into its nearest list, which bounds how far its neighbours
can be.  Other lists are left out if all of their vectors are farther than that.
In a list, tables of distances between the queries' residuals and all codewords
give the approximate distances by lookups, for many queries at once.  The
quantisation error of each entry is stored: its true distance can't be less than
the approximate one by more than that, so only entries that can't be among the
nearest are left out, and all others are ranked by their true distance.

A query that has found too few neighbours then, or only ones farther than nearly all of
the sample's are, lies outside what the probes were measured on.  It goes on down all
its other lists, until what it has found excludes them; its answers are exact.

Equal vectors are one entry: of a vector's copies only the k + 1 with the
smallest ids can ever be among the k nearest of any query, so each copy keeps
its list, but no list holds more than that of one vector.  Long lists are split
into shards and many queries into slices, searched apart, and merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import saved

#: Lists at most, rows of the sample for each, and rows at least; vectors to a shard of a list, queries to a slice.
LISTS, ROWS_A_LIST, TRAIN_ROWS, SHARD_ROWS, SLICE = 8192, 16, 8192, 4000, 4000
#: Rows of the sample whose neighbours are looked for to measure probes.
MEASURED = 400


@dataclass
class Index:
    """Coarse centroids (lists, dim) and codebooks (parts, codes, dim / parts)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def assign(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        n = min(n, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Codes of the residuals, one byte a part."""
        rest = (x - self.centroids[lists]).reshape(len(x), len(self.codebooks), -1)
        out = np.empty(rest.shape[:2], np.uint8)
        for k, book in enumerate(self.codebooks):
            out[:, k] = ((book**2).sum(axis=1) - 2 * rest[:, k] @ book.T).argmin(axis=1)
        return out

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of the rows from what their codes stand for."""
        rest = (x - self.centroids[lists]).reshape(len(x), len(self.codebooks), -1)
        return np.sqrt(((rest - self.codebooks[np.arange(codes.shape[1]), codes]) ** 2).sum(axis=(1, 2)))

    def tables(self, queries: np.ndarray, which: int) -> np.ndarray:
        """(queries, parts, codes) squared distances of the queries' residuals in a list."""
        rest = (queries - self.centroids[which]).reshape(len(queries), len(self.codebooks), -1)
        out = -2 * np.matmul(rest.transpose(1, 0, 2), self.codebooks.transpose(0, 2, 1)).transpose(1, 0, 2)
        out += (rest**2).sum(axis=2)[:, :, None]
        out += (self.codebooks**2).sum(axis=2)[None]
        return np.maximum(out, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; a centroid without rows moves to a random row."""
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(axis=1) - 2 * x[a : a + 2048] @ c.T).argmin(axis=1) for a in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        total = np.zeros_like(c)
        total[found] = np.add.reduceat(x[order], first)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[r.integers(0, len(x), k)])
    return c


def train(x: np.ndarray, lists: int, parts: int = 8, codes: int = 256) -> Index:
    centroids = kmeans(x, lists)
    bare = Index(centroids, np.empty((0, 0, 0)))
    rest = (x - centroids[bare.assign(x)[:, 0]]).reshape(len(x), parts, -1)
    return Index(centroids, np.stack([kmeans(rest[:, p], codes, rounds=8) for p in range(parts)]))


def measured(index: Index, x: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(lists, distance): the fewest lists of a query that hold ``recall`` of its k
    nearest rows of the sample, and how far the k-th of them is at most for as many of the
    sample's rows.  The whole table is denser than the sample, so its neighbours lie closer."""
    lists = len(index.centroids)
    if recall >= 1 or len(x) <= k:
        return lists, np.inf
    asked = x[:MEASURED]
    d = (x**2).sum(axis=1) - 2 * asked @ x.T
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), lists), np.int64)
    np.put_along_axis(place, index.assign(asked, lists), np.arange(lists)[None], axis=1)
    needed = np.sort(np.take_along_axis(place, index.assign(x)[:, 0][near], axis=1).ravel())
    at = lambda n: min(n - 1, int(np.ceil(recall * n)) - 1)
    last = np.sort(np.sqrt(np.maximum(np.take_along_axis(d, near, axis=1).max(axis=1) + (asked**2).sum(axis=1), 0)))
    return int(needed[at(len(needed))]) + 1, float(last[at(len(last))])


def measured_probes(index: Index, x: np.ndarray, k: int, recall: float) -> int:
    return measured(index, x, k, recall)[0]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that aren't null, empty or zero and whose components are
    all finite, one of each vec_id (of several the smallest, component by component)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def closest(index: Index, which: int, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, errors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, true distance) of the ``most`` rows of a shard that
    are nearest to each query and within its bound, ties by id: rows are left out
    only by their distance's lower bound."""
    tables = index.tables(queries, which)
    near = np.zeros((len(queries), len(x)))
    for part in range(codes.shape[1]):
        near += tables[:, part][:, codes[:, part]]
    near = np.sqrt(near)
    limit = bounds
    if len(x) > most:
        first = np.argpartition(near, most - 1, axis=1)[:, :most]
        limit = np.minimum(bounds, np.sqrt(((x[first] - queries[:, None]) ** 2).sum(axis=2)).max(axis=1))
    room = np.abs(queries).sum(axis=1) + np.abs(index.centroids[which]).sum() + np.abs(x).sum(axis=1).max()
    near -= errors[None]
    kept = ~(near > (limit + 1e-7 * room)[:, None])
    # the true distances by a product, in which rounding may hide ties; then term by term
    rough = np.einsum("ij,ij->i", x, x) - 2 * queries @ x.T + np.einsum("ij,ij->i", queries, queries)[:, None]
    rough[~kept] = np.inf
    last = np.minimum(np.partition(rough, most - 1, axis=1)[:, most - 1], limit**2) if len(x) > most else limit**2
    asked, row = np.nonzero(kept & ~(rough > (last + 1e-9 * room**2)[:, None]))
    score = np.sqrt(np.add.accumulate((x[row] - queries[asked]) ** 2, axis=1)[:, -1]) if len(row) else np.empty(0)
    order = np.lexsort((ids[row], score, asked))
    asked, row, score = asked[order], row[order], score[order]
    rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
    fine = (rank < most) & (score <= bounds[asked])
    return asked[fine], ids[row[fine]], score[fine]


ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = 0.97) -> DataFrame:
    """The ``k`` nearest vectors of each query (rows whose vec_id is divisible by
    ``every``): query_id, rank, vec_id, score (the true Euclidean distance).

    Ties go to the smaller vec_id.  Unusable vectors (null, zero, with null or
    non-finite components) take no part; of a repeated id the smallest vector
    counts; vectors of different lengths have no distance and are never each
    other's answers; an empty table gives no rows; further columns are not read.
    As many lists are looked into as hold ``recall`` of a sample's neighbours, and all
    that may hold nearer ones by queries far from everything; 1 means every list, and
    then all answers are exact.  A query has k answers wherever there are k candidates."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors).withColumn("dim", F.size("v")), "ann-rows")
    lengths = [r["dim"] for r in rows.select("dim").distinct().collect()]
    out = spark.createDataFrame([], ANSWER)
    for dim in sorted(lengths):
        out = out.union(_nearest_of_length(rows.where(F.col("dim") == dim).select("vec_id", "v"), dim, k, every, recall))
    return out


def _nearest_of_length(rows: DataFrame, dim: int, k: int, every: int, recall: float) -> DataFrame:
    digest = F.sha2(F.to_json(F.struct("v")), 256)
    # a vector's copies: the window's limit is applied before rows are shuffled
    order = Window.partitionBy("digest").orderBy("vec_id")
    few = rows.withColumn("digest", digest).withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    distinct = few.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    distinct = saved(distinct.withColumn("key", F.element_at("ids", 1)), "ann-vectors")  # key: the smallest id of equal vectors
    count = distinct.count()
    lists = max(1, min(int(np.sqrt(count)), LISTS))
    sample = distinct.orderBy(F.xxhash64("key")).limit(max(TRAIN_ROWS, ROWS_A_LIST * lists)).select("v").collect()
    x = np.array([r["v"] for r in sample])
    index = train(x, lists, next(p for p in (16, 8, 4, 2, 1) if dim % p == 0))
    probes, far = measured(index, x, k, recall)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.stack(f["v"].to_numpy())
                which = index.assign(v)[:, 0]
                codes = index.encode(v, which)
                far = np.sqrt(((v - index.centroids[which]) ** 2).sum(axis=1))
                yield pd.DataFrame({"key": f["key"], "list": which, "codes": [c.tobytes() for c in codes], "error": index.errors(v, which, codes), "far": far, "v": f["v"]})

    entries = saved(distinct.select("key", "v").mapInPandas(place, "key long, list int, codes binary, error double, far double, v array<double>"), "ann-index")
    stats = entries.groupBy("list").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"), F.max("far").alias("radius")).collect()  # LISTS rows at most
    shards, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in stats:
        shards[r["list"]], radius[r["list"]] = r["shards"], r["radius"]

    # queries: each distinct vector once
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", digest.alias("digest"))
    asked = saved(asked.join(distinct.select("digest", "key"), "digest").select("vec_id", "key"), "ann-asked")
    queries = saved(distinct.join(asked.select("key").distinct(), "key").select("key", "v"), "ann-queries")
    slices = max(1, -(-queries.count() // SLICE))
    number = F.lit(int(shards.max()))
    if len(set(shards.tolist())) > 1:
        of_list = rows.sparkSession.createDataFrame([(k, int(n)) for k, n in enumerate(shards)], "list int, number int")
        entries, number = entries.join(F.broadcast(of_list), "list"), F.greatest("number", F.lit(1))  # LISTS rows at most
    entries = entries.withColumn("shard", F.pmod(F.xxhash64("key"), number).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    entries = entries.select("key", "list", "shard", "slice", "codes", "error", "v")

    def probe(begin: int, end: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for f in (whole.iloc[a : a + 1024] for a in range(0, len(whole), 1024)):
                    v, bounds = np.stack(f["v"].to_numpy()), f["bound"].to_numpy(float, na_value=np.inf)
                    near = index.assign(v, end)[:, begin:]
                    away = (index.centroids**2).sum(axis=1) - 2 * v @ index.centroids.T + (v**2).sum(axis=1)[:, None]
                    gap = np.sqrt(np.maximum(np.take_along_axis(away, near, axis=1), 0)) - radius[near]
                    room = 1e-7 * (np.abs(v).sum(axis=1) + np.abs(index.centroids).sum(axis=1).max())  # rounding
                    who, at = np.nonzero((shards[near] > 0) & ~(gap > (bounds + room)[:, None]))
                    which = near[who, at]
                    shard = np.concatenate([np.arange(n) for n in shards[which]]) if len(which) else np.empty(0, int)
                    who, which = np.repeat(who, shards[which]), np.repeat(which, shards[which])
                    yield pd.DataFrame({"key": f["key"].to_numpy()[who], "v": f["v"].to_numpy()[who], "bound": bounds[who], "list": which, "shard": shard})

        return run

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest of one shard of a list, by their true distance."""
        keys, ids, scores = [], [], []
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
            own, errors, rows = right["key"].to_numpy(), right["error"].to_numpy(), np.stack(right["v"].to_numpy())
            step = max(1, (1 << 18) // len(right))
            for a in range(0, len(left), step):
                some = left.iloc[a : a + step]
                who, found, score = closest(index, int(right["list"].iloc[0]), np.stack(some["v"].to_numpy()), some["bound"].to_numpy(), own, rows, codes, errors, k + 1)
                keys.append(some["key"].to_numpy()[who])
                ids.append(found)
                scores.append(score)
        return pd.DataFrame({"key": np.concatenate(keys), "found": np.concatenate(ids), "score": np.concatenate(scores)} if keys else {"key": [], "found": [], "score": []})

    def look(queries: DataFrame, begin: int, end: int) -> DataFrame:
        """What queries (key, v, bound) find in their lists of some ranks."""
        wanted = queries.select("key", "v", "bound").mapInPandas(probe(begin, end), "key long, v array<double>, bound double, list int, shard int")
        wanted = wanted.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(slices)).cast("int"))
        place = ["list", "shard", "slice"]
        return wanted.groupBy(*place).cogroup(entries.groupBy(*place)).applyInPandas(search, "key long, found long, score double")

    near = Window.partitionBy("key").orderBy("score", "found")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("k", F.row_number().over(near)).where(F.col("k") <= k + 1)

    def bounds(found: DataFrame) -> DataFrame:
        return queries.join(found.where(F.col("k") == k + 1).select("key", F.col("score").alias("bound")), "key", "left")

    start = saved(best(look(queries.withColumn("bound", F.lit(None).cast("double")), 0, 1)), "ann-first")
    scored = best(start.drop("k").union(look(bounds(start), 1, probes)))
    if probes < len(index.centroids):
        scored = saved(scored, "ann-second")
        alone = bounds(scored).where(F.col("bound").isNull() | (F.col("bound") > far))
        scored = best(scored.drop("k").union(look(alone, probes, len(index.centroids))))
    scored = scored.join(distinct.select(F.col("key").alias("found"), "ids"), "found")  # copies by their ids
    lists = scored.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))))).alias("near"))
    answers = asked.join(lists, "key").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
