"""Chunk plans of resumable runs: grids, windows, samples, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_grid(videos: DataFrame, chunk_seconds: float = 6.0, overlap_seconds: float = 0.5, sequence: int = 8) -> DataFrame:
    """Chunks of each video (frame_count): core range, and the range to read around it.

    Reading begins on the grid of sequences, so that results do not depend on
    the chunk size.
    """
    fps, total = F.col("fps"), F.col("frame_count")
    core = F.greatest(F.lit(8), F.round(chunk_seconds * fps).cast("int")).cast("long")
    halo = F.greatest(F.lit(7), F.round(overlap_seconds * fps).cast("int")).cast("long")
    n = F.ceil(total / core)
    rows = videos.where("frame_count > 0").withColumn("core", core).withColumn("halo", halo).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("chunk") * F.col("core")
    end = F.least(total, start + F.col("core"))
    read = F.greatest(F.lit(0).cast("long"), start - F.col("halo"))
    return rows.select("video_id", "chunk", start.alias("core_start"), end.alias("core_end"), (read - read % sequence).alias("read_start"), F.least(total, end + F.col("halo")).alias("read_end"))


def core_filter(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows of a chunk that lie in its core."""
    cores = grid.select("video_id", "chunk", "core_start", "core_end")
    return rows.join(cores, ["video_id", "chunk"]).where("frame >= core_start and frame < core_end").drop("core_start", "core_end")


def keep_last(chunks: DataFrame) -> DataFrame:
    """One row a frame: that of the highest chunk."""
    order = Window.partitionBy("video_id", "frame").orderBy(F.col("chunk").desc())
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Planned chunks that are not completed."""
    return grid.join(done.select("video_id", "chunk"), ["video_id", "chunk"], "left_anti")


def windows(videos: DataFrame, length: int, step: int, pad: bool = True) -> DataFrame:
    """Windows of frame indexes; a short last one repeats its last frame, or without pad is left out.

    The first window that reaches the end is the last.
    """
    total = F.col("frame_count")
    last = F.greatest(F.lit(0).cast("long"), F.ceil((total - length) / step))
    rows = videos.where("frame_count > 0").withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("window") * step
    valid = F.least(F.lit(length).cast("long"), total - start)
    frames = F.transform(F.sequence(start, start + length - 1), lambda i: F.least(i, total - 1))
    out = rows.select("video_id", "window", valid.alias("valid_length"), frames.alias("frames"))
    return out if pad else out.where(F.col("valid_length") == length)


def spread_sample(total: Column, samples: int) -> Column:
    """Frame indexes spread evenly from first to last, at least three; one frame has index 0."""
    k = max(3, samples)
    step = (total - 1).cast("double") / (k - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total == 1, F.array(F.lit(0).cast("long"))).otherwise(spread)


def window_weights(length: int) -> Column:
    """Weight of each place of a window: small at its ends."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.least(i + 1, F.lit(length) - i))


def upper_median(values: Column) -> Column:
    """Middle of the sorted values, the upper one of two."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def same_run(a: Column, b: Column) -> Column:
    """Whether two run fingerprints (structs) agree; nulls equal nulls."""
    return a.eqNullSafe(b)


def whole_prefix(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of the chunks of each video before its first one that is not done."""
    order = Window.partitionBy("video_id").orderBy("chunk")
    kept = done.select("video_id", "chunk").distinct().withColumn("_n", F.row_number().over(order) - 1).where("chunk = _n").drop("_n")
    return rows.join(kept, ["video_id", "chunk"], "left_semi")
