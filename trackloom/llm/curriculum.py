"""Mixing sources to target weights along a curriculum.

Targets come from water-filling: sources share a budget of words by weight,
and none takes more than a multiple of its size. A source's documents stand in
a fixed shuffled order; its demand grows with training time as its weight
schedule says. Inverting the schedule's integral turns a document's place in
its source into a time, and the demand of all sources together up to that time
is its position: the tokens that training has taken by then. Documents are
range-sorted by it. Only DataFrame functions are used, and a source is dealt
over buckets, so that a hot source is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, with_global_index

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words, and the most that a document repeats.
BUDGET, REPEATS = 1.5, 2
#: Times of a schedule's knots, and for each rank, repeating, its weights there.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def fill_targets(sources: DataFrame, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Add target to source_size and weight: shares by weight, none above the cap.

    Each round deals what capped sources leave to the others; the capped set
    only grows, so one number, the words a unit of weight gets, is all that a
    round hands to the next.
    """
    cap = F.col("source_size") * float(repeats)
    level = 0.0
    while True:
        capped = F.col("weight") * level > cap
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, cap)).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("weights")
        ).first()
        if not row["weights"]:
            break
        deeper = (budget * float(row["all"]) - (row["held"] or 0.0)) / row["weights"]
        if deeper <= level:
            break
        level = deeper
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def training_time(demand: Column, rank: Column, knots: tuple = KNOTS, schedules: tuple = SCHEDULES) -> Column:
    """Time at which a source's cumulative demand reaches a share of the whole.

    A schedule is linear between knots, so its integral is quadratic there, and
    the inverse takes a square root.
    """
    out = F.lit(None).cast("double")
    for k, weights in enumerate(schedules):
        pieces = _pieces(knots, weights)
        total, time = pieces[-1][3] + pieces[-1][4], F.lit(knots[-1])
        for start, first, slope, before, area in reversed(pieces):
            rest = demand * total - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(first * first) + rest * (2 * slope)))
            here = F.when(rest <= 0, F.lit(start)).otherwise(F.lit(start) + rest * 2.0 / (F.lit(first) + root))
            time = F.when(demand * total <= before + area, here).otherwise(time)
        out = F.when(rank % len(schedules) == k, time).otherwise(out)
    return out


def _pieces(knots: tuple, weights: tuple) -> list[tuple[float, float, float, float, float]]:
    """Of each linear piece of a schedule: start, weight there, slope, area before it, area of it."""
    out, before = [], 0.0
    for j in range(len(knots) - 1):
        wide = knots[j + 1] - knots[j]
        area = wide * (weights[j] + weights[j + 1]) / 2
        out.append((knots[j], weights[j], (weights[j + 1] - weights[j]) / wide, before, area))
        before += area
    return out


def demand_share(time: Column, weights: tuple, knots: tuple = KNOTS) -> Column:
    """Share of its whole demand that a source with this schedule has made by a time."""
    pieces = _pieces(knots, weights)
    total, out = pieces[-1][3] + pieces[-1][4], F.lit(None).cast("double")
    for start, first, slope, before, _ in pieces:
        here = (F.lit(before) + (time - start) * first + (time - start) * (time - start) * (slope / 2)) / total
        out = here if start == knots[0] else F.when(time <= start, out).otherwise(here)
    return out


def curriculum_mix(
    docs: DataFrame, scratch: Scratch | None = None, budget: float = BUDGET, repeats: int = REPEATS, schedules: tuple = SCHEDULES, knots: tuple = KNOTS
) -> DataFrame:
    """Words that a mix takes of each document, and where in training it does.

    Returns doc_id, source, size, source_size, target (its source's), taken
    (words, repeats counted) and positions (words that training has taken before,
    to a thousandth, one for each pass that takes words of the document),
    range-sorted by first position. Schedules go by rank of the source, repeating. Passes go through a source in md5 order of the id; the document
    at which a target ends is taken in part.

    Null text: size 0. Null source: a source of its own, the last. Null doc_id:
    kept, null. Repeated rows: each is a document. Sizes of 0: taken 0. Empty
    table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = scratch.write(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_global_index(scratch, sources, [F.col("source").isNull(), F.col("source")], "sources", "rank")
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    targets = scratch.write(fill_targets(scratch.write(ranked, "weights"), budget, repeats).withColumnRenamed("source", "_source"), "targets")

    placed = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", F.substring("key", 1, 3))
    inner = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("begin", F.sum("size").over(inner) - F.col("size"))
    # at most 4,096 buckets a source
    over = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.withColumn("bucket", F.substring("key", 1, 3)).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.join(targets.select("_source", "rank"), F.col("source").eqNullSafe(F.col("_source")))
    buckets = buckets.select("rank", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    placed = placed.join(buckets, ["rank", "bucket"]).withColumn("begin", F.col("begin") + F.col("before"))

    whole = F.floor("target")
    passes = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.lit(0), F.least(F.col("size"), whole - p * F.col("source_size") - F.col("begin"))).alias("words")) for p in range(repeats)))
    placed = placed.withColumn("passes", F.filter(passes, lambda x: x["words"] > 0))
    # one row a schedule: what all sources that follow it ask for
    asked = {r["k"]: r["words"] for r in targets.groupBy((F.col("rank") % len(schedules)).alias("k")).agg(F.sum("target").alias("words")).collect()}

    # each value that later expressions use often is a lambda's variable, worked out once
    shares = lambda x: (x["p"] * F.col("source_size") + F.col("begin")).cast("double") / F.col("target")
    times = F.transform(F.transform("passes", shares), lambda share: training_time(share, F.col("rank"), knots, schedules))
    place = lambda time: F.round(sum((demand_share(time, w, knots) * asked.get(k, 0.0) for k, w in enumerate(schedules)), F.lit(0.0)), 3)

    mixed = placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.transform(times, place).alias("positions"),
        "key",
    )
    order = [F.element_at(F.concat("positions", F.array(F.lit(None).cast("double"))), 1).asc_nulls_last(), F.col("key")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key")


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = curriculum_mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"))


OP4_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from d group by source),
r as (
  select *, row_number() over (order by 2.0::double * source_size / weight, source nulls last) as k,
         sum(source_size) over () as all_size from s),
c as (
  select *, coalesce(sum(2.0::double * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as held,
         sum(weight) over (order by k rows between current row and unbounded following) as weights from r),
l as (
  select (1.5::double * all_size - held) / weights as level from c
  where (1.5::double * all_size - held) / weights * weight <= 2.0::double * source_size order by k limit 1),
t as (
  select source, source_size, least(weight * coalesce((select level from l), 1e300), 2.0::double * source_size) as target,
         (row_number() over (order by source nulls last) - 1) % 3 as k from s),
a as (
  select coalesce(sum(target) filter (k = 0), 0) as a0, coalesce(sum(target) filter (k = 1), 0) as a1, coalesce(sum(target) filter (k = 2), 0) as a2 from t),
b as (
  select d.*, t.source_size, t.target, t.k,
         sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows unbounded preceding) - size as begun
  from d join t on d.source is not distinct from t.source),
p as (
  select *, greatest(0, least(size, floor(target)::bigint - begun)) as once, greatest(0, least(size, floor(target)::bigint - source_size - begun)) as again from b),
y as (select *, (case when once > 0 then begun when again > 0 then begun + source_size end)::double / target as y from p),
-- schedules: 1 all the time; 1.5 falling to 0.5; 0.5 rising to 1.5; linear, so that a share y of the demand is reached at time u
u as (
  select *, case k when 0 then y
                   when 1 then 2 * y / (1.5 + sqrt(greatest(0, 2.25 - 2 * y)))
                   else case when y <= 0 then 0 else 2 * y / (0.5 + sqrt(0.25 + 2 * y)) end end as u from y)
select doc_id, size, source_size, target, (once + again)::bigint as taken,
       round(a0 * u + a1 * (1.5 * u - u * u / 2) + a2 * (0.5 * u + u * u / 2), 3) as first_position
from u, a
"""
