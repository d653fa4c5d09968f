"""State of a run: progress, versions of a table, stops, change detection, clean-up."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def progress(videos: DataFrame, fresh: int, seconds: float) -> DataFrame:
    """Progress rows from frames_done and frame_count; the rate counts frames of this run only."""
    rest = F.col("frame_count") - F.col("frames_done")
    rate = fresh / seconds
    return videos.select(
        "video_id", F.lit("running").alias("status"), F.col("frames_done").alias("framesCompleted"), F.col("frame_count").alias("framesTarget"),
        F.least(F.lit(1.0), F.col("frames_done") / F.col("frame_count")).alias("percent"), F.lit(rate).alias("fps"), F.when(rest > 0, rest / rate).alias("etaSeconds"),
    )


def publish(rows: DataFrame, root: str, version: int) -> None:
    """Write a version of a table; readers see it once its folder is committed."""
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")


class Conflict(Exception):
    """Another writer has committed since the version that a change was made from."""


def _versions(spark: SparkSession, root: str):
    """File system, what makes a path, the committed versions of a table by number, and the highest number that any folder has."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = {int(p.getName().split("=")[1]): p for p in there if p.getName().startswith("version=")}
    return fs, make, {n: p for n, p in numbers.items() if fs.exists(make(p, "_SUCCESS"))}, max(numbers, default=-1)


def newest(spark: SparkSession, root: str) -> int | None:
    """Number of the newest committed version, None where there is none."""
    return max(_versions(spark, root)[2], default=None)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version; one that was broken off has no marker and is passed over."""
    done = _versions(spark, root)[2]
    return spark.read.parquet(done[max(done)].toString())


def commit(rows: DataFrame, root: str, expected: int | None) -> int:
    """Write the next version unless another than ``expected`` (None: none) is the newest; its number, or Conflict.

    Rows are written aside and become the version by one rename. Where the version
    is there already, a rename leads into it instead: then another writer was
    first, and what was written is deleted. Stores whose rename is not one step
    (object stores) need a committer of their own. A writer that is broken off
    leaves a folder aside that no reader sees; numbers of folders without a marker
    are left out. Writers that use ``publish`` don't look at others and may not
    run at the same time.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    aside = f"{root}/.aside/{name}"
    rows.write.parquet(aside)
    fs, make, done, highest = _versions(spark, root)
    number = highest + 1
    target = make(f"{root}/version={number}")
    if max(done, default=None) != expected or not fs.rename(make(aside), target) or fs.exists(make(target, name)):
        for lost in (make(aside), make(target, name)):
            fs.delete(lost, True)
        raise Conflict(f"{root}: version {expected} is not the newest any more")
    return number


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20, pause: float = 0.015) -> int:
    """Commit what ``change`` makes of the newest version (None where there is none), again from the newest on a conflict; the number."""
    for k in range(tries):
        base = newest(spark, root)
        try:
            return commit(change(None if base is None else spark.read.parquet(f"{root}/version={base}")), root, base)
        except Conflict:
            time.sleep(random.uniform(0, pause * 2 ** min(k, 8)))
    raise Conflict(f"{root}: no turn after {tries} tries")


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    """Required columns that a table does not have."""
    return [c for c in required if c not in rows.columns]


def trial(rallies: DataFrame, most: int) -> DataFrame:
    """The first rallies of each video, between one and ten."""
    held = min(max(most, 1), 10)
    order = Window.partitionBy("video_id").orderBy("rally")
    return rallies.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= held).drop("_n")


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the rows of each key differ, in any order."""
    mark = lambda rows, name: rows.groupBy(*keys).agg(F.bit_xor(F.xxhash64(*rows.columns)).alias(name), F.count("*").alias(f"n_{name}"))
    both = mark(old, "a").join(mark(new, "b"), keys, "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("n_a").eqNullSafe(F.col("n_b"))
    return both.select(*keys, (~same).alias("changed"))


def collectable(listing: DataFrame, in_use: DataFrame, key: str) -> DataFrame:
    """Files whose run is not in use any more."""
    return listing.join(in_use, key, "left_anti")


def cancelled(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """State of every chunk of runs that were asked to stop (video_id, chunk): before that chunk nothing more was begun.

    The wish is looked at before each chunk. Chunks before it are complete and
    are kept; the others are pending, and their video is paused, not complete. A
    wish beyond the last chunk changes nothing.
    """
    stop = asked.groupBy("video_id").agg(F.min("chunk").alias("_stop"))
    done = F.col("_stop").isNull() | (F.col("chunk") < F.col("_stop"))
    rows = chunks.join(stop, "video_id", "left").withColumn("state", F.when(done, "complete").otherwise("pending"))
    status = F.when(F.bool_and(F.col("state") == "complete").over(Window.partitionBy("video_id")), "complete").otherwise("paused")
    return rows.withColumn("status", status).drop("_stop")
