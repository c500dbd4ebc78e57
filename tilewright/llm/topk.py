"""Exact top-k search by inner product: branch and bound over vertical blocks.

Vectors are put on an integer grid and stored in blocks of vertical layout: the
dimensions in falling order of their mass, cut into ranges, and for each range its
values column by column and the norm of what each vector has beyond it.  A block's
scores are accumulated range by range.  After each, what a pair can still gain is at
most the product of both remaining norms; pairs that can't reach the query's k-th
score any more go, and rows and columns without pairs are compacted away.

Blocks hold vectors of about the same norm.  Each query first meets the block of
the largest norms, whose answers bound all others; groups of blocks whose norms
can't reach the bounds of a slice of queries are not even sent to it.  Nothing is
left out for another reason, so answers are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import saved
from tilewright.llm.whitening import grid

#: Values of a block of vectors and of a slice of queries; pairs of them at a time; dimensions to a range.
BLOCK_VALUES, SLICE_VALUES, PAIRS, RANGE = 1 << 20, 1 << 18, 1 << 20, 16
#: Bands of norms: each is so many times the one below.
BAND = 1.02
_EXACT = float(1 << 53)
_LONG = 1 << 63


def ranges(dim: int) -> list[tuple[int, int]]:
    """Where ranges of dimensions begin and end."""
    return [(a, min(a + RANGE, dim)) for a in range(0, dim, RANGE)]


def vertical(x: np.ndarray) -> tuple[list[bytes], bytes]:
    """Ranges of the columns of x (rows, dim), and the norms that remain after each range."""
    squares = x.astype(np.float64) ** 2
    columns, rest = [], np.zeros((len(ranges(x.shape[1])), len(x)))
    for k, (a, b) in enumerate(ranges(x.shape[1])):
        columns.append(np.ascontiguousarray(x[:, a:b].T).tobytes())
        rest[k] = np.sqrt(squares[:, b:].sum(axis=1))
    return columns, rest.tobytes()


class Best:
    """The best rows of each of n queries so far, ties to smaller ids."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.who, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.n = n

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Puts pairs in; gives the score that a pair of each query must reach from now on."""
        who, ids, scores = np.concatenate([self.who, who]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        self.who, self.ids, self.scores = who[rank < self.most], ids[rank < self.most], scores[rank < self.most]
        bound = np.full(self.n, -np.inf)
        last = rank == self.most - 1
        bound[who[last]] = scores[last]
        return bound


def surviving(queries: np.ndarray, bounds: np.ndarray, columns: list[np.ndarray], rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs that reach the query's bound, ``most`` best of a
    query and their ties at least.  columns: (range, rows) of each range."""
    n, rows = len(queries), rest.shape[1]
    remaining = np.sqrt(np.stack([(queries[:, b:] ** 2).sum(axis=1) for _, b in ranges(queries.shape[1])], axis=1)) * (1 + 1e-12) if rest.shape[0] else None
    who, row = np.arange(n), np.arange(rows)
    scores: np.ndarray = np.zeros((n, rows))
    dense = True
    for k, (a, b) in enumerate(ranges(queries.shape[1])):
        if dense:
            scores += queries[who, a:b] @ columns[k][:, row]
            if k + 1 < len(columns) and np.isneginf(bounds[who]).all():
                continue
            alive = scores + remaining[who, k][:, None] * rest[k][row] >= bounds[who][:, None]
            if alive.mean() < 0.125:  # few are left: pair by pair from here
                at, to = np.nonzero(alive)
                who, row, scores, dense = who[at], row[to], scores[at, to], False
            else:
                lines, kept = alive.any(axis=1), alive.any(axis=0)
                if lines.mean() * kept.mean() < 0.75:
                    who, row, scores = who[lines], row[kept], scores[np.ix_(lines, kept)]
        else:
            scores = scores + np.einsum("ij,ji->i", queries[who, a:b], columns[k][:, row])
            fine = scores + remaining[who, k] * rest[k][row] >= bounds[who]
            who, row, scores = who[fine], row[fine], scores[fine]
    if dense:
        if scores.shape[1] > most:  # only what is among the best of this block
            bounds = bounds.copy()
            bounds[who] = np.maximum(bounds[who], np.partition(scores, -most, axis=1)[:, -most])
        at, to = np.nonzero(scores >= bounds[who][:, None])
        who, row, scores = who[at], row[to], scores[at, to]
    return who, row, scores


def best_of_block(queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, columns: list[np.ndarray], rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query, id, score) of the ``most`` best rows of a block for each query, of those that reach its bound."""
    own = float(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    all_norms = np.sqrt(sum((c.astype(np.float64) ** 2).sum(axis=0) for c in columns)) if columns else np.zeros(len(ids))
    if own * float(all_norms.max(initial=0)) >= _EXACT:  # beyond what a double holds: Python's integers, pair by pair
        x = np.concatenate(columns).astype(object)
        found = [(q, i, s) for q in range(len(queries)) for s, i in sorted(zip((queries[q].astype(object) @ x).tolist(), ids.tolist(), strict=True), key=lambda p: (-p[0], p[1]))[:most]]
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), [f[2] for f in found]
    values, columns = queries.astype(np.float64), [c.astype(np.float64) for c in columns]
    best, bounds = Best(len(queries), most), bounds.copy()
    order = np.argsort(-all_norms, kind="stable")
    wide = max(most, 4096)
    high = max(1, PAIRS // wide)
    for a in range(0, len(ids), wide):  # the largest norms first
        some = order[a : a + wide]
        part = [c[:, some] for c in columns]
        who, row, scores = [], [], []
        for q in range(0, len(queries), high):
            w, r, s = surviving(values[q : q + high], bounds[q : q + high], part, rest[:, some], most)
            who.append(w + q)
            row.append(r)
            scores.append(s)
        if who:
            bounds = np.maximum(bounds, best.add(np.concatenate(who), ids[some[np.concatenate(row)]], np.concatenate(scores)))
    return best.who, best.ids, [int(s) for s in best.scores]


ANSWER = "query_id long, rank int, vec_id long, score long"


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` vectors with the highest integer inner product with each query (rows
    whose vec_id is divisible by ``every``): query_id, rank, vec_id, score.

    A component x counts as floor(64 * x).  Ties go to the smaller vec_id.  Null vectors
    and those with null or non-finite components (or of 2^50 and more) take no part; of
    a repeated id the smallest vector counts, rows without an id don't; zero vectors
    score 0; vectors of different lengths are never each other's answers, empty ones
    score 0 with each other; a score that isn't a long is null; an empty table gives no
    rows; further columns are not read and may have any name."""
    spark = vectors.sparkSession
    rows = grid(vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull())).withColumn("x", F.transform("x", lambda v: v - F.lit(1_000_000).cast("long")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    band = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(BAND)).cast("int")).otherwise(-1)
    rows = saved(rows.withColumn("norm", norm).withColumn("band", band), "topk-rows")

    # bands of norms that together fill a block are one; a band of many vectors is cut by the ids' hash
    counts = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asked"), F.max("norm").alias("most")).orderBy("dim", F.desc("band")).collect()  # a few thousand at most for a length
    bands: list[dict] = []
    slices: dict[int, int] = {}
    for r in counts:
        size = max(1024, BLOCK_VALUES // max(r["dim"], 1))
        if not bands or bands[-1]["dim"] != r["dim"] or bands[-1]["n"] + r["n"] > size:
            bands.append({"dim": r["dim"], "group": len(bands), "n": 0, "most": r["most"], "bands": []})
        bands[-1]["n"] += r["n"]
        bands[-1]["bands"].append(r["band"])
        bands[-1]["parts"] = -(-bands[-1]["n"] // size)
        slices[r["dim"]] = slices.get(r["dim"], 0) + r["asked"]
    slices = {d: max(1, -(-n // max(256, SLICE_VALUES // max(d, 1)))) for d, n in slices.items()}
    if not bands:
        return spark.createDataFrame([], ANSWER)
    groups = spark.createDataFrame([(b["dim"], b["group"], b["parts"], float(b["most"])) for b in bands], "dim int, group int, parts int, most double")
    place = spark.createDataFrame([(b["dim"], band, b["group"], b["parts"]) for b in bands for band in b["bands"]], "dim int, band int, group int, parts int")

    order: dict[int, np.ndarray] = {}
    pieces = rows.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("mass"))
    for r in pieces.collect():  # a number for each dimension
        order.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mass"]
    order = {d: np.argsort(-m, kind="stable") for d, m in order.items()}

    def matrix(f: pd.DataFrame) -> np.ndarray:
        dim = int(f["dim"].iloc[0])
        x = np.stack(f["x"].to_numpy()).astype(np.int64) if dim else np.zeros((len(f), 0), np.int64)
        return x[:, order[dim]] if dim else x

    def block(f: pd.DataFrame) -> pd.DataFrame:
        columns, rest = vertical(matrix(f))
        return pd.DataFrame({"dim": f["dim"].iloc[:1], "group": f["group"].iloc[:1], "part": f["part"].iloc[:1], "ids": [f["vec_id"].to_numpy(np.int64).tobytes()], "columns": [columns], "rest": [rest]})

    def slice_of(f: pd.DataFrame) -> pd.DataFrame:
        x, bounds = matrix(f), f["bound"].to_numpy(float, na_value=-np.inf)
        norms = f["norm"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(bounds > 0, bounds / norms, 0).min()  # the least norm that some query can use
        return pd.DataFrame({"dim": f["dim"].iloc[:1], "slice": f["slice"].iloc[:1], "queries": [f["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "bounds": [bounds.tobytes()], "needed": [float(needed) * (1 - 1e-12)]})

    cut = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = rows.join(F.broadcast(place), ["dim", "band"]).withColumn("part", cut)  # a few thousand rows for a length
    blocks = placed.groupBy("dim", "group", "part").applyInPandas(block, "dim int, group int, part int, ids binary, columns array<binary>, rest binary")
    blocks = saved(blocks, "topk-blocks")
    number = F.lit(1)
    for d, n in slices.items():
        number = F.when(F.col("dim") == d, n).otherwise(number)
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(3)), number).cast("int"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "digits": []})
        a, b, dim = left.iloc[0], right.iloc[0], int(left["dim"].iloc[0])
        queries, ids = np.frombuffer(a["queries"], np.int64), np.frombuffer(b["ids"], np.int64)
        columns = [np.frombuffer(c, np.int64).reshape(-1, len(ids)) for c in b["columns"]]
        who, found, scores = best_of_block(np.frombuffer(a["x"], np.int64).reshape(len(queries), dim), np.frombuffer(a["bounds"]), ids, columns, np.frombuffer(b["rest"]).reshape(len(columns), len(ids)), k + 1)
        far = any(abs(s) >= _LONG for s in scores)
        return pd.DataFrame({"query_id": queries[who], "vec_id": found, "score": pd.array([None if far and abs(s) >= _LONG else s for s in scores], dtype="Int64"), "digits": [str(s) if far else None for s in scores]})

    cell = ["dim", "slice", "group", "part"]

    def look(queries: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        packed = queries.select("dim", "slice", "vec_id", "x", "norm", "bound").groupBy("dim", "slice").applyInPandas(slice_of, "dim int, slice int, queries binary, x binary, bounds binary, needed double")
        met = packed.join(F.broadcast(groups), "dim").where(F.col("most") >= F.col("needed"))  # as many rows as there are groups of bands
        met = keep(met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).select(*cell, "queries", "x", "bounds")
        met = saved(met, "topk-cells")
        sent = blocks.join(met.select(*(F.col(c).alias(c) for c in cell)), ["dim", "group", "part"]).select(*cell, "ids", "columns", "rest")
        return met.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInPandas(best, "query_id long, vec_id long, score long, digits string")

    top = {b["dim"]: b["group"] for b in reversed(bands)}  # of each length the group of the largest norms
    is_first = F.lit(False)
    for d, g in top.items():
        is_first = is_first | ((F.col("dim") == d) & (F.col("group") == g) & (F.col("part") == 0))
    rank = F.coalesce(F.col("digits").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    near = Window.partitionBy("query_id").orderBy(F.desc("sort"), "vec_id")
    start = saved(look(asked.withColumn("bound", F.lit(None).cast("double")), lambda c: c.where(is_first)), "topk-first")
    of_first = start.withColumn("sort", rank).withColumn("k", F.row_number().over(near)).where(F.col("k") == k + 1).select(F.col("query_id").alias("vec_id"), F.col("sort").cast("double").alias("bound"))
    rest = look(asked.join(of_first, "vec_id", "left"), lambda c: c.where(~is_first))
    found = start.union(rest).where(F.col("query_id") != F.col("vec_id")).withColumn("sort", rank)
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql() -> str:
    return """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20"""
