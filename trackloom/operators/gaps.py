"""Visibility: runs, gaps, and the gaps that end a rally.

All windows share one partitioning (video_id) and one order (frame), so a
trajectory is shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..params import DEFAULTS, RallyParameters


def by_frame() -> WindowSpec:
    """A video in order of frames."""
    return Window.partitionBy("video_id").orderBy("frame")


def by_pos() -> WindowSpec:
    """A video in order of places."""
    return Window.partitionBy("video_id").orderBy("pos")


def diagonal() -> Column:
    return F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))


def positions(trajectory: DataFrame) -> DataFrame:
    """Add pos, the row's place in its video from 0; frames may be missing, places are not."""
    return trajectory.withColumn("pos", (F.row_number().over(by_frame()) - 1).cast("long"))


def invisible_gaps(trajectory: DataFrame) -> DataFrame:
    """Gaps between successive visible rows: video_id, left, right, size, and both ends' points."""
    shown = positions(trajectory).where("visible")
    ahead = [F.lead(c).over(by_pos()).alias(f"right_{c}") for c in ("pos", "x", "y")]
    return (
        shown.select("video_id", F.col("pos").alias("left_pos"), F.col("x").alias("left_x"), F.col("y").alias("left_y"), *ahead)
        .where("right_pos > left_pos + 1")
        .withColumn("size", F.col("right_pos") - F.col("left_pos") - 1)
    )


def hidden_runs(trajectory: DataFrame) -> DataFrame:
    """All runs of invisible rows, those at the ends too: first and last place, length, and
    whether the run lies between two visible rows."""
    rows = positions(trajectory)
    hidden = rows.where("not visible").withColumn("island", F.col("pos") - F.row_number().over(by_pos()))
    runs = hidden.groupBy("video_id", "island").agg(F.min("pos").alias("run_start"), F.max("pos").alias("run_end"), F.count("*").alias("length"))
    shown = rows.where("visible").groupBy("video_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    inner = (F.col("run_start") >= F.col("lo")) & (F.col("run_end") <= F.col("hi"))
    return runs.join(shown, "video_id", "left").select("video_id", "run_start", "run_end", "length", F.coalesce(inner, F.lit(False)).alias("inner"))


def run_length_of_rows(trajectory: DataFrame) -> DataFrame:
    """Each row with the length of the invisible run that it is in, 0 for visible rows."""
    rows = positions(trajectory).withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("video_id", "visible").orderBy("pos")))
    size = F.count("*").over(Window.partitionBy("video_id", "visible", "island"))
    return rows.select("video_id", "frame", F.when(F.col("visible"), 0).otherwise(size).cast("long").alias("gap_length"))


def candidate_gaps(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Gaps long enough to be looked at, with the rules that need no context."""
    fps = F.col("fps")
    top = F.lit(p.top_edge_fraction)
    clear = (F.col("left_y") / F.col("height") >= top) & (F.col("right_y") / F.col("height") >= top)
    return (
        invisible_gaps(trajectory)
        .join(videos, "video_id")
        .where(F.col("size") >= p.restart_gap(fps))
        .withColumn("below_top", clear)
        .withColumn("interior_restart", (F.col("size") >= p.split_gap(fps)) & clear)
        .withColumn("very_long", F.col("size") >= p.long_gap(fps))
    )


def gap_context(trajectory: DataFrame, gaps: DataFrame) -> DataFrame:
    """Visible rows in the 0.30 s before and 0.45 s after each gap (side "before" or "after").

    A range join, made an equi-join on blocks of places: a context covers two
    blocks at most, so no gap meets all rows of its video.
    """
    span = F.greatest(F.lit(1), (F.lit(0.45) * F.col("fps")).cast("int"))
    sides = F.array(
        F.struct(F.lit("before").alias("side"), (F.col("left_pos") - (F.lit(0.30) * F.col("fps")).cast("int")).alias("low"), F.col("left_pos").alias("high")),
        F.struct(F.lit("after").alias("side"), F.col("right_pos").alias("low"), (F.col("right_pos") + (F.lit(0.45) * F.col("fps")).cast("int")).alias("high")),
    )
    asked = gaps.select("video_id", "left_pos", span.alias("span"), F.explode(sides).alias("s")).select("video_id", "left_pos", "span", "s.*")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / F.col("span")), F.floor(F.col("high") / F.col("span")))))
    spans = gaps.select("video_id", span.alias("span")).distinct()
    shown = positions(trajectory).where("visible").join(spans, "video_id").withColumn("block", F.floor(F.col("pos") / F.col("span")))
    near = shown.select("video_id", "block", "pos", "frame", "x", "y").join(asked, ["video_id", "block"])
    return near.where(F.col("pos").between(F.col("low"), F.col("high"))).select("video_id", "left_pos", "side", "pos", "frame", "x", "y")


def context_speeds(context: DataFrame) -> DataFrame:
    """Speeds between successive rows of each context, in pixels a frame.

    The first row of a context has no speed: the row before it is outside.
    """
    order = Window.partitionBy("video_id", "left_pos", "side").orderBy("pos")
    before = {c: F.lag(c).over(order) for c in ("frame", "x", "y")}
    moved = F.hypot(F.col("x") - before["x"], F.col("y") - before["y"])
    speed = moved / F.greatest(F.lit(1.0), (F.col("frame") - before["frame"]).cast("double"))
    return context.select("video_id", "left_pos", "side", "pos", speed.alias("speed")).where("speed is not null")


def tail_median(sorted_values: Column, n: int = 3) -> Column:
    """Median of the last n entries of an array, or of all if it is shorter."""
    tail = F.array_sort(F.slice(sorted_values, F.greatest(F.lit(1), F.size(sorted_values) - n + 1), F.lit(n)))
    k = F.size(tail)
    return F.when(k > 0, (F.get(tail, ((k - 1) / 2).cast("int")) + F.get(tail, (k / 2).cast("int"))) / 2)


def marked_rows(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """All rows, each visible one with the gap after it, that gap's context and the split rules.

    All windows keep the one partitioning by video.
    """
    return marks(positions(trajectory).join(videos, "video_id"), ("video_id", "visible"), p)


def marks(rows: DataFrame, keys: tuple[str, ...], p: RallyParameters = DEFAULTS) -> DataFrame:
    """marked_rows of rows with places, where rows of equal keys are what windows see.

    The three speeds before a gap are those of the row itself and the two
    visible rows before it; the speeds after it are a range of places, in units
    of the video's own look-ahead. So windows suffice.
    """
    fps = F.col("fps")
    behind, ahead = (F.lit(0.30) * fps).cast("int"), (F.lit(0.45) * fps).cast("int")
    shown = Window.partitionBy(*keys).orderBy("pos")
    moved = F.hypot(F.col("x") - F.lag("x").over(shown), F.col("y") - F.lag("y").over(shown))
    rows = rows.withColumn("_prev", F.lag("pos").over(shown)).withColumn("_key", F.col("pos") / F.greatest(ahead, F.lit(1)))
    rows = rows.withColumn("_speed", moved / F.greatest(F.lit(1.0), (F.col("frame") - F.lag("frame").over(shown)).cast("double")))
    reach = f"over (partition by {", ".join(keys)} order by _key range between 0.000001D following and 1.000001D following)"
    rows = rows.withColumn("_fastest", F.expr(f"max(_speed) {reach}")).withColumn("_after", F.expr(f"count(_speed) {reach}"))
    lately = [F.when(F.lag("_prev", k).over(shown) >= F.col("pos") - behind, F.lag("_speed", k).over(shown)) for k in range(3)]
    rows = rows.select(
        "*", F.array_compact(F.array(*lately)).alias("_lately"), *(F.lead(c).over(shown).alias(f"right_{c}") for c in ("pos", "x", "y")),
        F.lead("_fastest").over(shown).alias("after_max"), F.when(ahead > 0, F.lead("_after").over(shown)).otherwise(0).alias("n_after"),
    )
    rows = rows.withColumn("size", F.when(F.col("visible"), F.col("right_pos") - F.col("pos") - 1)).withColumn("before_median", tail_median(F.col("_lately")))
    top = F.lit(p.top_edge_fraction)
    clear = (F.col("y") / F.col("height") >= top) & (F.col("right_y") / F.col("height") >= top)
    jump = F.hypot(F.col("right_x") - F.col("x"), F.col("right_y") - F.col("y"))
    slow = (
        clear
        & (F.size("_lately") >= 2)
        & (F.col("n_after") >= 2)
        & (F.col("before_median") <= 0.004 * diagonal())
        & (F.col("after_max") >= 0.01 * diagonal())
        & (jump >= 0.03 * diagonal())
    )
    rows = rows.withColumn("below_top", clear).withColumn("candidate", F.coalesce(F.col("size") >= p.restart_gap(fps), F.lit(False)))
    rows = rows.withColumn("interior_restart", (F.col("size") >= p.split_gap(fps)) & clear).withColumn("very_long", F.col("size") >= p.long_gap(fps))
    rows = rows.withColumn("low_speed", F.coalesce(slow, F.lit(False)))
    split = F.col("candidate") & (F.col("interior_restart") | F.col("very_long") | F.col("low_speed"))
    return rows.withColumn("is_split", F.coalesce(split, F.lit(False))).drop("_prev", "_key", "_speed", "_fastest", "_after", "_lately")


def split_gaps(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Gaps long enough to be looked at, with the three rules' verdicts and is_split."""
    found = marked_rows(trajectory, videos, p).where("candidate")
    return found.withColumnsRenamed({"pos": "left_pos", "x": "left_x", "y": "left_y"})


def segment_rows(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Rows of segments: from the first visible row after a split to the last before the next.

    Invisible rows count where the visible rows on both sides are in the same
    segment. Adds pos and segment_id from 0.
    """
    rows = marked_rows(trajectory, videos, p).select("video_id", "frame", "visible", "x", "y", "pos", F.col("is_split").cast("int").alias("cut"))
    before = by_pos().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.when(F.col("visible"), F.coalesce(F.sum("cut").over(before), F.lit(0))))
    last = F.last("own", ignorenulls=True).over(by_pos().rowsBetween(Window.unboundedPreceding, 0))
    # backwards: a frame that ends at the last row is gone through again for every row
    following = F.last("own", ignorenulls=True).over(Window.partitionBy("video_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("segment_id", last).withColumn("_next", following).where("segment_id = _next").drop("own", "cut", "_next")


def segments(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Bounds of every segment."""
    return segment_rows(trajectory, videos, p).groupBy("video_id", "segment_id").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_rows")
    )
