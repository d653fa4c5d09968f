"""Near copies among vectors, found by a forest of random projection trees.

A tree splits its rows by their projection on a random direction, at the middle,
and rows near the middle go to both sides. Nodes too large for a task are split by
Spark (approximate quantiles of the projections, a round a level); the others are
split on inside a task, down to leaves whose rows are all compared. Pairs that a
leaf verifies are united, a few edges a leaf; components are found on all edges.

Links are then counted inside components, exactly. Rows within half the angle of
their component's mean all link with each other, so that a component of near
copies is counted without looking at its pairs; the rows outside meet all of their
component, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected_components, shards_for

#: Trees, and the share of a node's rows on either side of its middle that go to both halves.
TREES, SPILL = 10, 0.05
#: Rows of a leaf, of a node that one task splits on, and of a side of a block that is compared.
LEAF, NODE, BLOCK = 64, 1 << 15, 4096
#: Steps, up to 2 ** 20 of them, by which projections are moved, so that equal rows can be split.
JITTER = 1e-13
SEED = 0x7EE5


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length one as rows of doubles; short ones end in zeros."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lens), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def direction(tree: int, path: int, dim: int) -> np.ndarray:
    """The random direction of a node, the same wherever it is asked for."""
    return np.random.default_rng([SEED, tree, path]).normal(size=dim)


def leaves(x: np.ndarray, tree: int, path: int) -> Iterator[np.ndarray]:
    """Rows of each leaf below a node."""
    todo = [(np.arange(len(x)), path)]
    while todo:
        rows, path = todo.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        order = rows[np.argsort(x[rows] @ direction(tree, path, x.shape[1]), kind="stable")]
        half = int(len(rows) * (0.5 + SPILL))  # by rank, so that equal rows are split too
        todo += [(order[:half], 2 * path), (order[-half:], 2 * path + 1)]


def united(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row that it is united with, by links among these rows."""
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, True)
    low = np.arange(len(x))
    if linked.sum() == len(x):
        return low
    while True:
        lower = np.where(linked, low, len(x)).min(1)
        if (lower == low).all():
            return low
        low = lower


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of successive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and any(held[-1].column(k)[0].as_py() != c[a] for k, c in zip(keys, columns, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def project(dim: int):
    """Add p, each row's projection on its node's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, p = units(batch.column("embedding"), dim), np.empty(batch.num_rows)
            nodes, which = np.unique(np.stack([batch.column("tree").to_numpy(), batch.column("path").to_numpy()]), axis=1, return_inverse=True)
            for k, (tree, path) in enumerate(nodes.T.tolist()):
                p[which == k] = x[which == k] @ direction(tree, path, dim)
            ids = batch.column("cid").to_numpy().astype(np.uint64)
            p += JITTER * ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.float64)
            yield batch.append_column("p", pa.array(p))

    return run


def nodes_of(classes: DataFrame, scratch: Scratch, trees: int, dim: int) -> list[DataFrame]:
    """Rows by label, tree and node, split by Spark until each node fits a task."""
    columns = ["cid", "label", "embedding", "tree", "path"]
    state = classes.select("cid", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("path"))
    kind = "cid long, label long, embedding array<double>, tree int, path long, p double"
    done, step, node = [], 0, ["label", "tree", "path"]
    sizes = scratch.write(classes.groupBy("label").count().select("label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("path"), "count"), "sizes-0")
    while not sizes.where(F.col("count") > NODE).isEmpty():
        sized = state.join(sizes, node)
        done.append(sized.where(F.col("count") <= NODE).select(*columns))
        large = scratch.write(sized.where(F.col("count") > NODE).select(*columns).mapInArrow(project(dim), kind), f"large-{step}")
        middle = scratch.write(large.groupBy(*node).agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL], 10_000).alias("middle")), f"middle-{step}")
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("middle")[1], F.col("path") * 2), F.when(F.col("p") >= F.col("middle")[0], F.col("path") * 2 + 1)))
        step += 1
        state = scratch.write(large.join(middle, node).select("cid", "label", "embedding", "tree", F.explode(sides).alias("path")), f"state-{step}")
        sizes = scratch.write(state.groupBy(*node).count(), f"sizes-{step}")
    return [*done, state]


def edges_of(nodes: DataFrame, parts: int, threshold: float, dim: int) -> DataFrame:
    """Edges that unite what the leaves below each node verify: a and b, numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["label", "tree", "path"]):
            x, ids = units(pa.concat_arrays(table["embedding"].chunks), dim), table["cid"].to_numpy()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows in leaves(x, table["tree"][0].as_py(), table["path"][0].as_py()):
                low = united(x[rows], threshold)
                some = np.flatnonzero(low != np.arange(len(rows)))
                a.append(ids[rows[some]])
                b.append(ids[rows[low[some]]])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    node = ["label", "tree", "path"]
    return nodes.repartition(parts, *node).sortWithinPartitions(*node).mapInArrow(run, "a long, b long").distinct()


def with_core(linked: DataFrame, scratch: Scratch, threshold: float, dim: int) -> DataFrame:
    """Say of each row of a component whether it is within half the angle of the component's mean.

    Any two such rows are within the angle of each other. Means are a table, so
    that Spark can split a large component's rows when they meet its mean.
    """
    near = float(np.sqrt((1 + threshold) / 2)) + 1e-12
    unit = F.transform("embedding", lambda v: v / F.col("size"))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    sums = linked.withColumn("size", size).select("component", F.posexplode(unit).alias("at", "v")).groupBy("component", "at").agg(F.sum("v").alias("v"))
    mean = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("mean"))
    mean = scratch.write(mean, "means")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(all="ignore"):  # a mean may be zero: nothing is near it
                cosine = np.einsum("ij,ij->i", units(batch.column("embedding"), dim), units(batch.column("mean"), dim))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "component", "n", "first", "embedding")), pa.array(cosine >= near)], names=["cid", "component", "n", "first", "embedding", "core"])

    return linked.join(mean, "component").mapInArrow(run, "cid long, component long, n long, first long, embedding array<double>, core boolean")


def compared(threshold: float, dim: int):
    """Cogroup map: rows outside of the core meet rows of their components; links of both, the core's with these only."""
    kinds = pa.schema([("cid", pa.int64()), ("links", pa.int64())])

    def run(outer: pa.Table, rows: pa.Table) -> pa.Table:
        if not outer.num_rows or not rows.num_rows:
            return kinds.empty_table()
        out, all_ = (t.sort_by("component").combine_chunks() for t in (outer, rows))
        x, y = (units(pa.concat_arrays(t["embedding"].chunks), dim) for t in (out, all_))
        out_id, out_n, out_of = (out[c].to_numpy() for c in ("cid", "n", "component"))
        id_, n, of, core = (all_[c].to_numpy() for c in ("cid", "n", "component", "core"))
        links, back = np.zeros(len(out_id), np.int64), np.zeros(len(id_), np.int64)
        for c in np.unique(out_of):
            i, j = slice(*np.searchsorted(out_of, [c, c + 1])), slice(*np.searchsorted(of, [c, c + 1]))
            link = (x[i] @ y[j].T >= threshold) & (out_id[i][:, None] != id_[j][None])
            links[i] += link @ n[j]
            back[j] += np.where(core[j], out_n[i] @ link, 0)
        some = np.flatnonzero(back)
        return pa.table([np.concatenate([out_id, id_[some]]), np.concatenate([links, back[some]])], schema=kinds)

    return run


def link_counts(members: DataFrame, scratch: Scratch, threshold: float, dim: int) -> DataFrame:
    """Links of each row of a component (copies counted), and the component's smallest id: cid, links, component_id."""
    whole = members.groupBy("component").agg(
        F.min("first").alias("component_id"), F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.count("*").alias("rows"), F.count_if(~F.col("core")).alias("outer")
    )
    whole = scratch.write(whole, "components")
    uneven = whole.where("outer > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    total = uneven.agg(F.sum("rows")).first()[0] or 0
    some = members.join(uneven.select("component", blocks("outer").alias("lefts"), blocks("rows").alias("rights")), "component")
    # small components share a bucket, large ones are dealt into blocks besides
    some = some.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // BLOCK)))))
    place = lambda salt, n: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = some.where(~F.col("core")).select("cid", "n", "component", "embedding", "bucket", place(1, "lefts").alias("left"), every("rights").alias("right"))
    left = scratch.write(left, "outer")
    right = some.select("cid", "n", "component", "embedding", "core", "bucket", every("lefts").alias("left"), place(2, "rights").alias("right"))
    cell = ["bucket", "left", "right"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compared(threshold, dim), "cid long, links long")
    found = found.groupBy("cid").agg(F.sum("links").alias("more"))
    own = F.when(F.col("core"), F.col("core_n")).otherwise(F.col("n")) - 1
    rows = members.select("cid", "component", "n", "core").join(whole.select("component", "component_id", "core_n"), "component").join(found, "cid", "left")
    return rows.select("cid", (own + F.coalesce("more", F.lit(0))).cast("long").alias("links"), "component_id")


def near_copies(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, scratch: Scratch | None = None) -> DataFrame:
    """Links and components of vectors of equal label whose cosine reaches a threshold.

    ``vectors``: vec_id, embedding, label. Returns a row for each row: vec_id,
    n_links (other rows linked directly), component_id (smallest vec_id reachable
    by links, its own included), kept (it is that one).

    Components unite the pairs that the forest finds, all verified in doubles;
    links are all pairs at or above the threshold inside a component.

    Rows with a null id, label or vector, or a vector that is zero or holds a null
    or non-finite component: no links, their own component, kept; a null id's
    component is null. Vectors of different length: the shorter one ends in zeros.
    Equal vectors are one until links are counted. Repeated ids: each row is a
    vector of its own. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "forest")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable, F.lit(False))
    # 96 bits stand for a vector
    rows = rows.withColumn("h1", F.when(takes_part, F.xxhash64("embedding"))).withColumn("h2", F.when(takes_part, F.hash("embedding")))
    key = ["label", "h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.min("embedding").alias("embedding"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = max(1, size[1] or 1)
    nodes = nodes_of(classes, scratch, trees, dim)
    parts = shards_for(spark, size[0] * trees, NODE)
    edges = edges_of(nodes[0], parts, threshold, dim)
    for more in nodes[1:]:
        edges = edges.unionByName(edges_of(more, parts, threshold, dim))
    components = connected_components(scratch, edges, "edges").select(F.col("vertex").alias("cid"), "component")
    linked = classes.select("cid", "n", "first", "embedding").join(components, "cid")
    members = scratch.write(with_core(linked, scratch, threshold, dim), "members")
    counted = link_counts(members, scratch, threshold, dim)
    known = classes.select(*key, "cid", "n", "first").join(counted, "cid", "left")
    known = known.select(*key, F.coalesce("links", F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    told = rows.select("vec_id", *key).join(known, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return told.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op12_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors of equal label, at a cosine of 0.93."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP12_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as size from v),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)
"""
