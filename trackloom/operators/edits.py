"""Edit lists and cut lists of rallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed


def clip_window(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of a single clip: half a second before, 0.8 after, 0.1 long at least."""
    begin = F.greatest(F.lit(0.0), start - 0.5)
    return begin, F.greatest(F.lit(0.1), end + 0.8 - begin)


def edit_rows(rallies: DataFrame) -> DataFrame:
    """A fresh edit list: all rallies selected, in order."""
    order = Window.partitionBy("video_id").orderBy("rally")
    return rallies.select(
        "video_id", "rally", (F.row_number().over(order) - 1).cast("long").alias("position"), F.col("start_seconds"), F.col("end_seconds"),
        F.col("start_seconds").alias("original_start"), F.col("end_seconds").alias("original_end"), "hit_count", F.lit("").alias("remark"), F.lit(True).alias("selected"),
    )


def sync(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edited rows that are still there, in their order and as edited, then new ones in theirs."""
    fresh = edit_rows(incoming)
    kept = old.join(fresh.select("video_id", "rally"), ["video_id", "rally"], "left_semi").withColumn("_new", F.lit(0))
    added = fresh.join(old.select("video_id", "rally"), ["video_id", "rally"], "left_anti").withColumn("_new", F.lit(1))
    order = Window.partitionBy("video_id").orderBy("_new", "position")
    both = kept.unionByName(added)
    return both.withColumn("position", (F.row_number().over(order) - 1).cast("long")).drop("_new")


def cut_list(edits: DataFrame, videos: DataFrame) -> DataFrame:
    """Selected rows as cuts: held to the video, tiny ones dropped, with their place in the output.

    ``videos`` has duration in seconds; no padding is added.
    """
    most = F.greatest(F.lit(0.1), F.col("duration"))
    rows = edits.where("selected").join(videos.select("video_id", "duration"), "video_id")
    hold = lambda c: F.least(F.greatest(c, F.lit(0.0)), most)
    rows = rows.withColumn("cut_start", hold(F.col("start_seconds"))).withColumn("cut_end", hold(F.col("end_seconds"))).where("cut_end > cut_start + 0.05")
    rows = rows.withColumn("length_ms", F.round((F.col("cut_end") - F.col("cut_start")) * 1000).cast("long"))
    before = Window.partitionBy("video_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("video_id", "rally", "position", "cut_start", "cut_end", "length_ms", F.coalesce(F.sum("length_ms").over(before), F.lit(0)).alias("output_ms"))


def filter_graph(cuts: DataFrame, audio: bool = True, height: int | None = None) -> DataFrame:
    """Text of the filter that cuts and joins each video's parts, ``height`` pixels high.

    ``cuts`` comes from cut_list; with a height, a column source_height must be
    there, and only higher sources are scaled.
    """
    order = Window.partitionBy("video_id").orderBy("position")
    rows = cuts.withColumn("k", (F.row_number().over(order) - 1).cast("string"))
    span = F.concat(F.lit("start="), fixed(F.col("cut_start"), 3), F.lit(":end="), fixed(F.col("cut_end"), 3))
    kinds = (("v", "", "0:v:0"), ("a", "a", "0:a:0")) if audio else (("v", "", "0:v:0"),)
    part = F.concat_ws(";", *(F.concat(F.lit(f"[{c}src"), F.col("k"), F.lit(f"]{p}trim="), span, F.lit(f",{p}setpts=PTS-STARTPTS[{c}"), F.col("k"), F.lit("]")) for c, p, _ in kinds))
    pads = F.concat(*(x for c, _, _ in kinds for x in (F.lit(f"[{c}"), F.col("k"), F.lit("]"))))
    sources = [F.concat(F.lit(f"[{c}src"), F.col("k"), F.lit("]")).alias(f"{c}src") for c, _, _ in kinds]
    row = F.struct("position", part.alias("part"), pads.alias("pads"), *sources)
    extra = [F.max("source_height").alias("source_height")] if height else []
    held = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("r"), *extra)
    n = F.size("r").cast("string")
    splits = [F.concat(F.lit(f"[{src}]{p}split="), n, F.array_join(F.col(f"r.{c}src"), "")) for c, p, src in kinds]
    joined = F.concat(F.array_join(F.col("r.pads"), ""), F.lit("concat=n="), n, F.lit(":v=1:a=1[vcat][acat]" if audio else ":v=1:a=0[vcat]"))
    scale = F.when(F.col("source_height") > height, f"[vcat]scale=-2:{height}:flags=lanczos[vout]") if height else F.lit(None).cast("string")
    return held.select("video_id", F.concat_ws(";", *splits, F.array_join(F.col("r.part"), ";"), joined, scale).alias("graph"))


def set_start(start: Column, end: Column) -> Column:
    """A start moved by hand: not before 0, 0.1 before the end at least."""
    return F.least(F.greatest(start, F.lit(0.0)), end - 0.1)


def set_end(start: Column, end: Column, duration: Column) -> Column:
    """An end moved by hand: 0.1 after the start at least, not past the video."""
    return F.least(F.greatest(end, start + 0.1), duration)


def nudge(edits: DataFrame, start_by: Column, end_by: Column, videos: DataFrame) -> DataFrame:
    """Rows with their bounds moved; amounts that are not finite change nothing."""
    usable = lambda by: F.when(by.isNull() | F.isnan(by) | (F.abs(by) == float("inf")), F.lit(0.0)).otherwise(by)
    rows = edits.join(videos.select("video_id", "duration"), "video_id")
    start = set_start(F.col("start_seconds") + usable(start_by), F.col("end_seconds"))
    rows = rows.withColumn("start_seconds", start)
    return rows.withColumn("end_seconds", set_end(F.col("start_seconds"), F.col("end_seconds") + usable(end_by), F.col("duration"))).drop("duration")


def restore(edits: DataFrame) -> DataFrame:
    """Rows with their original bounds."""
    return edits.withColumn("start_seconds", F.col("original_start")).withColumn("end_seconds", F.col("original_end"))


def move_row(edits: DataFrame, source: int, target: int) -> DataFrame:
    """Take the row at one position out and put it in at another."""
    p = F.col("position")
    if source < target:
        moved = F.when(p == source, target).when((p > source) & (p <= target), p - 1).otherwise(p)
    else:
        moved = F.when(p == source, target).when((p >= target) & (p < source), p + 1).otherwise(p)
    return edits.withColumn("position", moved.cast("long"))


def selected_totals(edits: DataFrame) -> DataFrame:
    """Selected rows and their duration."""
    length = F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds"))
    return edits.groupBy("video_id").agg(F.count_if("selected").alias("n_selected"), F.sum(F.when(F.col("selected"), length).otherwise(0.0)).alias("seconds"))


def neighbour(edits: DataFrame) -> DataFrame:
    """The next and the previous selected row of each row."""
    order = Window.partitionBy("video_id").orderBy("position")
    chosen = F.when(F.col("selected"), F.col("rally"))
    ahead = F.last(chosen, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last(chosen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return edits.select("video_id", "rally", ahead.alias("next_selected"), behind.alias("previous_selected"))


def qualities(source_height: Column) -> Column:
    """Export sizes on offer."""
    return F.array_compact(F.array(F.lit("720p"), F.when(source_height > 1080, F.lit("1080p")), F.lit("source")))


def export_decision(quality: Column, source_height: Column, has_clip: Column) -> Column:
    """Whether a clip is copied or encoded, and at which rate factor."""
    copied = (quality == "720p") & (source_height >= 720) & has_clip
    return F.when(copied, "copy").when(quality == "source", "crf16").otherwise("crf18")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or touching intervals."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col(start) <= reach, 0).otherwise(1)
    marked = rows.withColumn("_open", opened).withColumn("_island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
