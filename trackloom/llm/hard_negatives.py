"""Hard-negative mining by branch and bound over ball trees.

Rows are dealt into blocks. A task builds, over its block, a ball tree for each
label: nodes know the centre and the radius of their rows, so that the inner
product of a query with any of them lies between q c - |q| r and q c + |q| r.
Going down from the roots, a node is left out when that range misses the query's
score window, or lies strictly beneath the query's current k-th score. Leaves that
remain are scored exactly, the most promising first, in whole numbers.

Positives are the first search (same label, no window), negatives the second
(other labels, a window for each positive). Spark merges the blocks' bests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches
from .topk import BLOCK_BYTES, BLOCK_ROWS, HIGHEST, LOWEST, SCALE, Best, exact, matrix

#: Rows of a leaf, and anchors that go through a tree together.
LEAF, TILE_ANCHORS = 64, 64


class BallTrees:
    """Ball trees of a block's rows, one a label, as arrays of nodes; parents come before their children."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = 0):
        leaf = leaf or LEAF
        self.order = np.argsort(labels, kind="stable")
        sorted_labels = labels[self.order]
        starts = np.flatnonzero(np.r_[True, sorted_labels[1:] != sorted_labels[:-1]]) if len(x) else np.zeros(0, int)
        self.span, self.parent, self.label, self.depth = [], [], [], []
        centres, radii, inner = [], [], []
        todo = [(a, b, -1, 0) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True)]
        for a, b, parent, depth in todo:  # grows while it is read
            rows = self.order[a:b]
            points = x[rows]
            centre = points.mean(0)
            away = np.linalg.norm(points - centre, axis=1)
            inner.append(b - a > leaf)
            if inner[-1]:
                # halves on both sides of the line between two far points; equal points are halved too, so trees are never deep
                far = points[away.argmax()]
                along = (points - far) @ (points[np.linalg.norm(points - far, axis=1).argmax()] - far)
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(along, half)]
                todo += [(a, a + half, len(self.span), depth + 1), (a + half, b, len(self.span), depth + 1)]
            self.span.append((a, b))
            self.parent.append(parent)
            self.depth.append(depth)
            self.label.append(int(sorted_labels[a]))
            centres.append(centre)
            radii.append(away.max())
        self.parent, self.depth, self.label, self.leaf = np.array(self.parent, int), np.array(self.depth, int), np.array(self.label, np.int64), ~np.array(inner, bool)
        self.centre, self.radius = np.array(centres).reshape(len(self.span), x.shape[1]), np.array(radii)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with each node's rows, rounding included."""
        middle, norm = q @ self.centre.T, np.linalg.norm(q, axis=1)[:, None]
        reach = norm * self.radius * (1 + 1e-9) + 1e-9 * norm * np.linalg.norm(self.centre, axis=1) + 1e-6
        # scores that 64 bits cannot hold are the nearest that they can, and so are their bounds
        return np.clip(middle - reach, LOWEST, HIGHEST), np.clip(middle + reach, LOWEST, HIGHEST)


def mine_block(anchors: dict, rows: dict, same: bool, k: int, told: list | None = None) -> tuple[np.ndarray, ...]:
    """Each window's k best rows of a block: anchor's place, window's number, row's id, score.

    ``anchors``: id, label, x, and windows, a list of (least, most) score each.
    ``told`` gets, for each tile, the pairs of anchor and row that were scored.
    """
    trees = BallTrees(rows["x"], rows["label"])
    ids, x = rows["id"][trees.order], rows["x"][trees.order]
    out = []
    for first in range(0, len(anchors["id"]), TILE_ANCHORS):
        at = np.arange(first, min(first + TILE_ANCHORS, len(anchors["id"])))
        q = anchors["x"][at]
        windows = [(i, w, lo, hi) for i, a in enumerate(at) for w, (lo, hi) in enumerate(anchors["windows"][a])]
        if not windows:
            continue
        owner, number = np.array([w[:2] for w in windows]).T
        lo, hi = np.array([w[2:] for w in windows], np.int64).T
        best = Best(len(windows), k)
        lower, upper = trees.bounds(q)
        # not "greater or equal": a bound that is no number rules nothing out
        alive = ~(upper[owner] < lo[:, None]) & ~(lower[owner] > hi[:, None])
        alive &= (trees.label[None] == anchors["label"][at][owner][:, None]) == same
        for depth in range(1, int(trees.depth.max(initial=0)) + 1):
            here = np.flatnonzero(trees.depth == depth)
            alive[:, here] &= alive[:, trees.parent[here]]
        leaves = np.flatnonzero(trees.leaf & alive.any(0))
        leaves = leaves[np.argsort(-np.nan_to_num(np.where(alive[:, leaves], upper[owner][:, leaves], -np.inf).max(0)), kind="stable")]
        scored = 0
        for leaf in leaves:
            a, b = trees.span[leaf]
            use = np.flatnonzero(alive[:, leaf] & ~(upper[owner, leaf] < best.score[:, -1]))
            if not len(use):
                continue
            asked, place = np.unique(owner[use], return_inverse=True)
            score = exact(q[asked], x[a:b])[place]
            scored += len(asked) * (b - a)
            fits = (score >= np.maximum(lo[use], best.score[use, -1])[:, None]) & (score <= hi[use][:, None]) & (ids[None, a:b] != anchors["id"][at][owner[use]][:, None])
            i, j = np.nonzero(fits)
            if len(i):
                best.add(use[i], score[i, j], ids[a:b][j])
        if told is not None:
            told.append(scored)
        w, rank = np.nonzero(best.score >= LOWEST)
        out.append((at[owner[w]], number[w], best.id[w, rank], best.score[w, rank]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 s <= high * score, as far as 64 bits hold them."""
    return max(-(-low * score // 100), LOWEST), min(high * score // 100, HIGHEST)


def miner(dim: int, same: bool, k: int, low: int, high: int):
    """Cogroup map: a block of anchors meets a block of rows."""
    kinds = pa.schema([("anchor_id", pa.int64()), ("pair", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def read(t: pa.Table) -> dict:
        return {"id": t["vec_id"].to_numpy(), "label": t["label"].to_numpy(), "x": matrix(pa.concat_arrays(t["embedding"].chunks), dim)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        anchors = read(left := left.sort_by("vec_id").combine_chunks())
        anchors["windows"] = [[(LOWEST, HIGHEST)] if same else [window(s, low, high) for s in scores] for scores in left["scores"].to_pylist()]
        with np.errstate(all="ignore"):  # overflows are looked after where they matter
            who, number, ids, score = mine_block(anchors, read(right), same, k)
        return pa.table([anchors["id"][who], number.astype(np.int32), ids, score], schema=kinds)

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within the score window.

    ``vectors``: vec_id, embedding, label. Components x count as floor(256 x);
    scores are whole inner products with the anchor. An anchor's positives are its
    ``positives`` best other rows of the same label; its negatives for one of them
    are the ``negatives`` best rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score. Higher scores come first,
    ties by smaller id. Anchors are the rows that fulfil ``is_anchor``. Returns
    anchor_id, positive_id, rank (from 1 among those returned), negative_id,
    positive_score, negative_score; pairs without a negative have no row.

    Rows whose id, label or vector is null, or whose vector holds a null or
    non-finite component (or one that 256 times is not finite), take no part.
    Vectors of different length: the shorter one ends in zeros. Repeated ids: an
    anchor's rows are never its own positives or negatives; of different rows of an
    anchor id the one with the smallest label, then vector, is the anchor; other
    repeated rows each count, as positives too. Empty table, no anchor, one label
    only: no rows. Other columns are ignored. A score that 64 bits cannot hold is
    the nearest one that they can.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "negatives")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    usable = usable.where("vec_id is not null and embedding is not null and label is not null").where(finite)
    anchors = usable.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("vec_id", "a.label", "a.embedding")
    anchors = scratch.write(anchors, "anchors")
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.count_if(is_anchor).alias("anchors")).first()
    dim = max(1, size["dim"] or 1)
    block = max(1, BLOCK_BYTES // (8 * dim))
    columns = max(1, -(-size["anchors"] // block))
    rows = max(1, -(-size["n"] // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")) // columns, size["n"] // BLOCK_ROWS))
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = usable.select("vec_id", "embedding", "label", every(columns).alias("column"), place(2, rows).alias("row")).groupBy("row", "column")

    def meet(left: DataFrame, same: bool, k: int) -> DataFrame:
        left = left.select("vec_id", "embedding", "label", "scores", place(1, columns).alias("column"), every(rows).alias("row"))
        found = left.groupBy("row", "column").cogroup(right).applyInArrow(miner(dim, same, k, low, high), "anchor_id long, pair int, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "pair").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = meet(anchors.withColumn("scores", F.array().cast("array<long>")), True, positives)
    first = scratch.write(first.select("anchor_id", (F.col("rank") - 1).alias("pair"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asked = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("pair", "positive_score"))).alias("s"))
    asked = anchors.join(asked.select(F.col("anchor_id").alias("vec_id"), F.col("s.positive_score").alias("scores")), "vec_id")
    return (
        meet(asked, False, negatives)
        .withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(first, ["anchor_id", "pair"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives between 30 and 90% of each of five positives, for each vector whose id is divisible by 100; ids divisible by 7 are first labelled anew."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as pair
  from s where same qualify pair <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, pair order by score desc, vec_id))::integer as rank, vec_id as negative_id,
       positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
