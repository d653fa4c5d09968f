"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, each known by its mean and deviation. The inner
product of two segments of length n is at most n (mean mean + dev dev), so the
distance, its negative, is at least the negative of the sum. Levels go from few
segments of the whole vector to ones where a growing first part is taken as it
is and only the rest by its segments. A pair goes on to the next level while its
bound may still enter the query's best k; survivors get their exact product.

Queries and vectors are dealt into blocks that fit a task, and every block of
queries meets every block of vectors on an executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches

#: Coarse to fine: share of a vector taken as it is, and segments of the rest.
LEVELS = ((0.0, 4), (0.0, 16), (0.5, 8), (0.75, 4))
#: Bytes of a block of vectors as doubles, and sides of a tile.
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS = 16 << 20, 256, 512
#: Vectors that a block has at least where more blocks would only give more tasks.
BLOCK_ROWS = 4096
#: Share of a tile's pairs up to which survivors are worked out one by one.
FEW = 0.25
SCALE = 256
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Scaled integer vectors as rows of doubles; short ones end in zeros."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lens), max(dim, 1)))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that products of rows bound inner products."""
    length = -(-x.shape[1] // segments)
    cut = np.pad(x, ((0, 0), (0, length * segments - x.shape[1]))).reshape(len(x), segments, length)
    return np.hstack([cut.mean(2), cut.std(2)]) * np.sqrt(length)


def level(x: np.ndarray, share: float, segments: int) -> np.ndarray:
    """A level's view of vectors: the first part as it is, the statistics of the rest."""
    first = int(x.shape[1] * share)
    return np.hstack([x[:, :first], statistics(x[:, first:], segments)])


def exact(q: np.ndarray, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Inner products as 64-bit integers, of all pairs or of some; beyond their range, the range's end."""
    top_q, top_x = np.abs(q).max(1, initial=0), np.abs(x).max(1, initial=0)
    if pairs is None:
        large = top_q[:, None] * top_x[None] * q.shape[1] >= 2.0**53
        out = np.where(large, 0, q @ x.T)
    else:
        large = top_q[pairs[0]] * top_x[pairs[1]] * q.shape[1] >= 2.0**53
        out = np.where(large, 0, np.einsum("ij,ij->i", q[pairs[0]], x[pairs[1]]))
    out = out.astype(np.int64)
    for at in zip(*np.nonzero(large), strict=True):
        i, j = at if pairs is None else (pairs[0][at[0]], pairs[1][at[0]])
        product = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True) if a and b)
        out[at] = min(max(product, LOWEST), HIGHEST)
    return out


class Best:
    """The k best of each query so far: score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LOWEST - 1, np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge (query, score, id) entries."""
        touched, place = np.unique(at, return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        scores = np.concatenate([self.score[touched].ravel(), score])
        names = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((names, ~scores, who))
        who, scores, names = who[order], scores[order], names[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        self.score[touched[who[keep]], rank[keep]] = scores[keep]
        self.id[touched[who[keep]], rank[keep]] = names[keep]


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple = LEVELS, told: list | None = None) -> Best:
    """Each query's k best among the vectors of a block. ``told`` gets the pairs that each level left."""
    best = Best(len(query_ids), k)
    q_levels = [level(q, *v) for v in levels]
    q_norm = np.linalg.norm(q, axis=1)
    for lo in range(0, len(ids), TILE_ROWS):
        names, rows = ids[lo : lo + TILE_ROWS], x[lo : lo + TILE_ROWS]
        x_levels, x_norm = [level(rows, *v) for v in levels], np.linalg.norm(rows, axis=1)
        for first in range(0, len(query_ids), TILE_QUERIES):
            at = np.arange(first, min(first + TILE_QUERIES, len(query_ids)))
            slack = 1e-9 * q_norm[at][:, None] * x_norm[None] + 1e-6
            alive = query_ids[at][:, None] != names[None]
            counts = [int(alive.sum())]
            least = best.score[at, -1].astype(float)[:, None]
            for qs, xs in zip(q_levels, x_levels, strict=True):
                if not alive.any():
                    counts.append(0)
                    continue
                if alive.mean() > FEW:
                    alive &= qs[at] @ xs.T + slack >= least
                else:
                    i, j = np.nonzero(alive)
                    alive[i, j] = np.einsum("ij,ij->i", qs[at[i]], xs[j]) + slack[i, j] >= least[i, 0]
                counts.append(int(alive.sum()))
            if told is not None:
                told.append(counts)
            i, j = np.nonzero(alive)
            if not len(i):
                continue
            score = exact(q[at], rows)[i, j] if alive.mean() > FEW else exact(q, rows, (at[i], j))
            # of a tile only a query's k best scores, ties included, can matter
            order = np.lexsort((~score, i))
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            floor = np.full(len(at), LOWEST - 1, np.int64)
            last = order[rank == k - 1]
            floor[i[last]] = score[last]
            use = score >= np.maximum(floor, best.score[at, -1])[i]
            best.add(at[i[use]], score[use], names[j[use]])
    return best


def search(k: int, dim: int, levels: tuple):
    """Cogroup map: each query's best k of one block of vectors."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return kinds.empty_table()
        q = queries.sort_by("vec_id").combine_chunks()
        ids = q["vec_id"].to_numpy()
        take = lambda t: matrix(pa.concat_arrays(t["embedding"].chunks), dim)
        best = best_of(ids, take(q), vectors["vec_id"].to_numpy(), take(vectors), k, levels)
        row, rank = np.nonzero(best.score >= LOWEST)
        return pa.table([ids[row], best.id[row, rank], best.score[row, rank]], schema=kinds)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scratch: Scratch | None = None, levels: tuple = LEVELS) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, embedding) with the highest inner product to each query.

    Components x count as floor(256 x). Returns query_id, rank (from 1), vec_id,
    score; equal scores go by smaller vec_id. Queries are the rows that fulfil
    ``is_query``.

    Vectors that are null or hold a null or non-finite component (or one that
    256 times is not finite), and rows without an id, take no part. Vectors of
    different length: the shorter one ends in zeros. Repeated ids: a query's
    rows are never its own candidates; other repeated rows are ranked each; of
    different vectors of a query id the smallest is the query. Empty table or no
    query: no rows. Other columns are ignored. Products are exact at every size;
    a score that 64 bits cannot hold is the nearest one that they can.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(finite)
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.count_if(is_query).alias("queries")).first()
    dim = max(1, size["dim"] or 1)
    block = max(1, BLOCK_BYTES // (8 * dim))
    columns = max(1, -(-size["queries"] // block))
    # as many blocks of vectors as their size asks for, or as give every task of a shuffle one
    rows = max(1, -(-size["n"] // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")) // columns, size["n"] // BLOCK_ROWS))
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "embedding", place(1, columns).alias("column"), every(rows).alias("row"))
    right = usable.select("vec_id", "embedding", every(columns).alias("column"), place(2, rows).alias("row"))
    found = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(search(k, dim, levels), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 5 of all vectors for each vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from s qualify rank <= 5
"""
