"""Quality and parity of trajectories: coverage, jumps, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gaps import by_frame, diagonal, hidden_runs, positions

KEYS = ["video_id", "frame"]


def coverage(trajectory: DataFrame) -> DataFrame:
    """Rows, visible rows and their percentage, first and last visible frame of each video."""
    shown = F.col("visible")
    return trajectory.groupBy("video_id").agg(
        F.count("*").alias("n_rows"), F.count_if(shown).alias("visible_frames"), F.round(100.0 * F.count_if(shown) / F.count("*"), 2).alias("visible_percent"),
        F.min(F.when(shown, F.col("frame"))).alias("first_visible"), F.max(F.when(shown, F.col("frame"))).alias("last_visible"),
    )


def gap_stats(trajectory: DataFrame, videos: DataFrame) -> DataFrame:
    """Longest inner gap, and inner gaps of half a second and a second or more."""
    runs = hidden_runs(trajectory).where("inner").join(videos, "video_id")
    found = runs.groupBy("video_id").agg(F.max("length").alias("longest"), F.count_if(F.col("length") >= F.col("fps") * 0.5).alias("half_second"), F.count_if(F.col("length") >= F.col("fps")).alias("one_second"))
    return videos.select("video_id").join(found, "video_id", "left").na.fill(0, ["longest", "half_second", "one_second"])


def longest_gaps(trajectory: DataFrame, n: int = 20) -> DataFrame:
    """The n longest inner gaps of each video; of equal ones the earliest."""
    order = Window.partitionBy("video_id").orderBy(F.col("length").desc(), "run_start")
    return hidden_runs(trajectory).where("inner").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("inner")


def adjacent_jumps(trajectory: DataFrame, videos: DataFrame, share: float = 0.15) -> DataFrame:
    """Moves between successive visible frames longer than a share of the diagonal."""
    before = {c: F.lag(c).over(by_frame()) for c in ("frame", "visible", "x", "y")}
    rows = trajectory.select("*", *(c.alias(f"_{n}") for n, c in before.items())).join(videos, "video_id")
    moved = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return rows.where(F.col("visible") & F.col("_visible") & (F.col("frame") == F.col("_frame") + 1)).withColumn("distance", moved).where(F.col("distance") > share * diagonal())


def compare(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Full outer join of two trajectories by frame.

    mismatch: visibility differs, or a side has no row; distance where both are visible.
    """
    a = reference.select(*KEYS, *(F.col(c).alias(f"{c}_ref") for c in ("visible", "x", "y")))
    b = candidate.select(*KEYS, *(F.col(c).alias(f"{c}_new") for c in ("visible", "x", "y")))
    both = F.coalesce(F.col("visible_ref") & F.col("visible_new"), F.lit(False))
    away = F.hypot(F.col("x_ref") - F.col("x_new"), F.col("y_ref") - F.col("y_new"))
    mismatch = ~F.col("visible_ref").eqNullSafe(F.col("visible_new"))
    return a.join(b, KEYS, "full_outer").withColumn("both_visible", both).withColumn("mismatch", mismatch).withColumn("distance", F.when(both, away))


def comparison_report(compared: DataFrame) -> DataFrame:
    """Counts, distances and shares of a comparison, per video."""
    d = F.col("distance")
    return compared.groupBy("video_id").agg(
        F.count("*").alias("n_rows"), F.count_if("both_visible").alias("both_visible"), F.count_if("mismatch").alias("mismatches"),
        F.count_if(F.col("visible_ref").isNotNull() & F.col("visible_new").isNull()).alias("only_reference"),
        (F.count("visible_ref") - F.count("visible_new")).alias("row_difference"),
        *(F.percentile(d, p).alias(f"p{n}") for n, p in (("50", 0.5), ("95", 0.95), ("999", 0.999))), F.max(d).alias("worst"),
        (F.count_if(d == 0) / F.count(d)).alias("identical_share"),
    )


def percentile_floor(values: Column, p: float) -> Column:
    """Element floor(p n) of the sorted array, the last at most."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * p).cast("int"), F.size(ordered) - 1))


def mismatch_sample(compared: DataFrame, n: int = 20) -> DataFrame:
    """First n mismatching frames of each video."""
    order = Window.partitionBy("video_id").orderBy("frame")
    return compared.where("mismatch").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("video_id", "rank", "frame")


def golden_lookup(candidate: DataFrame, golden: DataFrame) -> DataFrame:
    """Candidate rows against golden ones: differing or missing visibility, distance where both are visible."""
    g = golden.select(*KEYS, F.col("visible").alias("g_visible"), F.col("x").alias("g_x"), F.col("y").alias("g_y"))
    rows = candidate.join(g, KEYS, "left")
    bad = ~F.col("visible").eqNullSafe(F.col("g_visible"))
    away = F.when(~bad & F.col("visible"), F.hypot(F.col("x") - F.col("g_x"), F.col("y") - F.col("g_y")))
    return rows.select(*KEYS, bad.alias("mismatch"), away.alias("distance"))


def compare_rallies(a: DataFrame, b: DataFrame, tolerance: Column | None = None) -> DataFrame:
    """i-th rally of one run against the i-th of another; a missing one differs.

    With a tolerance in frames, bounds may differ by it.
    """
    left = a.select("video_id", "rally", *(F.col(c).alias(f"{c}_a") for c in ("start_frame", "end_frame", "hit_count")))
    right = b.select("video_id", "rally", *(F.col(c).alias(f"{c}_b") for c in ("start_frame", "end_frame", "hit_count")))
    slack = F.lit(0) if tolerance is None else tolerance
    near = [F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= slack for c in ("start_frame", "end_frame")]
    same = near[0] & near[1] & (F.col("hit_count_a") == F.col("hit_count_b"))
    return left.join(right, ["video_id", "rally"], "full_outer").withColumn("equal", F.coalesce(same, F.lit(False)))


def quality_verdict(mismatch: Column, p95: Column, p999: Column, worst: Column, half: bool = False) -> Column:
    """Reasons for which a run is not good enough; an empty array passes."""
    tight, wide = (5e-3, 2e-2) if half else (1e-3, 1e-2)
    reasons = F.array(
        F.when(mismatch > 0.005, "visibility"), F.when(p95 > 1.5, "p95"), F.when(p999 > tight, "p999"), F.when(worst > wide, "max")
    )
    return F.array_compact(reasons)


def trailing_points(trajectory: DataFrame, n: int) -> DataFrame:
    """Last n visible points up to each frame, the newest first."""
    shown = positions(trajectory).withColumn("k", F.sum(F.col("visible").cast("int")).over(Window.partitionBy("video_id").orderBy("pos")))
    window = Window.partitionBy("video_id").orderBy("k").rangeBetween(-n + 1, 0)
    listed = F.sort_array(F.collect_list(F.when(F.col("visible"), F.col("frame"))).over(window), asc=False)
    return shown.select("video_id", "frame", listed.alias("frames"))


#: Seconds of a block of the interval join, and what acceptance allows at a boundary.
BLOCK_SECONDS, BOUNDARY_SECONDS = 60.0, 0.3


def overlapping(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of rallies of one video that overlap in time, made an equi-join on blocks of a minute."""

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        reach = F.sequence(F.floor(F.col("start_seconds") / BLOCK_SECONDS), F.floor(F.greatest("start_seconds", "end_seconds") / BLOCK_SECONDS))
        return rows.select("video_id", F.explode(reach).alias("block"), F.struct("rally", "start_seconds", "end_seconds", "hit_count").alias(name))

    a, b = F.col("found"), F.col("truth")
    begin = F.greatest(a["start_seconds"], b["start_seconds"])
    pairs = blocks(found, "found").join(blocks(truth, "truth"), ["video_id", "block"])
    pairs = pairs.where((a["start_seconds"] < b["end_seconds"]) & (b["start_seconds"] < a["end_seconds"]))
    # both stand in every block of the overlap; it counts in the first
    return pairs.where(F.col("block") == F.floor(begin / BLOCK_SECONDS)).drop("block")


def acceptance(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of figures for rallies (video_id, rally, start_seconds, end_seconds, hit_count) against true ones.

    A true rally is matched with the found one that it overlaps longest, the
    earliest of equals. recall: true rallies matched; precision: found rallies
    that some true one is matched with; boundary_share: matches with both ends
    within 0.3 s; boundary_error: mean seconds off an end; hits_share: matches
    within one hit. Without rallies or matches, shares are null.
    """
    a, b = F.col("found"), F.col("truth")
    length = F.least(a["end_seconds"], b["end_seconds"]) - F.greatest(a["start_seconds"], b["start_seconds"])
    best = overlapping(found, truth).groupBy("video_id", b["rally"].alias("rally")).agg(F.max_by(F.struct("found", "truth"), F.struct(length.alias("length"), (-a["rally"]).alias("order"))).alias("m"))
    starts, ends = (F.abs(F.col(f"m.found.{c}") - F.col(f"m.truth.{c}")) for c in ("start_seconds", "end_seconds"))
    hits = F.abs(F.col("m.found.hit_count") - F.col("m.truth.hit_count"))
    told = best.agg(
        F.count("*").alias("matched"), F.count_distinct("video_id", "m.found.rally").alias("right"), F.count_if((starts <= BOUNDARY_SECONDS) & (ends <= BOUNDARY_SECONDS)).alias("near"),
        F.avg((starts + ends) / 2).alias("boundary_error"), F.count_if(hits <= 1).alias("alike"),
    )
    sizes = found.agg(F.count("*").alias("_f")), truth.agg(F.count("*").alias("_t"))
    row = told.join(F.broadcast(sizes[0])).join(F.broadcast(sizes[1]))  # one row each
    share = lambda part, of: F.try_divide(F.col(part), F.col(of))
    return row.select("matched", share("matched", "_t").alias("recall"), share("right", "_f").alias("precision"), share("near", "matched").alias("boundary_share"), "boundary_error", share("alike", "matched").alias("hits_share"))
