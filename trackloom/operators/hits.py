"""Hits and rallies: fill, smooth, find turns, merge them, and keep whole rallies.

Window functions fill the gaps; what needs a width that differs by video, or a
fold over the turns so far, runs on one array a segment with higher-order
functions. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULTS, RallyParameters
from .gaps import diagonal, segment_rows

SERVE, TURN = "serve_or_open_start", "trajectory_turn"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as values.

    A plain projection is merged into the next one, and an array expression
    inside another's lambda is then worked out again for every element; a
    generator of one row keeps it apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def interpolate(rows: DataFrame, keys: tuple[str, ...] = ("video_id", "segment_id")) -> DataFrame:
    """Add x_filled and y_filled: linear in place between visible rows, the nearest one at the ends."""
    order = Window.partitionBy(*keys).orderBy("pos")
    point = F.when(F.col("visible"), F.struct("pos", "x", "y"))
    a = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # backwards: a frame that ends at the last row is gone through again for every row
    b = F.last(point, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    for c in ("x", "y"):
        step = (F.col(f"_b.{c}") - F.col(f"_a.{c}")) / (F.col("_b.pos") - F.col("_a.pos"))
        between = F.col(f"_a.{c}") + step * (F.col("pos") - F.col("_a.pos"))
        inside = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b.pos") > F.col("_a.pos"))
        rows = rows.withColumn(f"{c}_filled", F.when(inside, between).otherwise(F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}"))))
    return rows.drop("_a", "_b")


def smooth(values: Column, window: Column) -> Column:
    """Box mean with the end values repeated; the window shrinks to the largest odd one that fits."""
    n = F.size(values)
    fits = F.least(window, n - F.when(n % 2 == 0, 1).otherwise(0))
    half = F.floor(fits / 2).cast("int")

    def mean(i: Column) -> Column:
        around = F.sequence(i - half, i + half)
        total = F.aggregate(around, F.lit(0.0), lambda a, o: a + F.get(values, F.least(F.greatest(o, F.lit(0)), n - 1)))
        return total * (F.lit(1.0) / fits)

    return F.when((n >= 3) & (window > 1) & (fits >= 3), F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(values)


def axis_turns(values: Column, window: Column, prominence: Column) -> Column:
    """Turning points of one axis, highs and lows: array of (at, strength).

    A turn is not below any of the ``window`` values before it and above all of
    those after it, so of equal neighbours the last counts; places without full
    windows have none.
    """

    def strength(i: Column, sign: float) -> Column:
        v = F.get(values, i) * sign
        before = F.transform(F.slice(values, i - window + 1, window), lambda u: u * sign)
        after = F.transform(F.slice(values, i + 2, window), lambda u: u * sign)
        turns = (v >= F.array_max(before)) & (v > F.array_max(after))
        return F.when(turns, F.least(v - F.array_min(before), v - F.array_min(after)))

    def side(sign: float) -> Column:
        places = F.sequence(window, F.size(values) - window - 1)
        marked = F.transform(places, lambda i: F.struct(i.alias("at"), strength(i, sign).alias("strength")))
        return F.filter(marked, lambda e: e["strength"] >= prominence)

    none = F.array().cast("array<struct<at:int,strength:double>>")
    return F.when(F.size(values) > 2 * window, F.array_sort(F.concat(side(1.0), side(-1.0)))).otherwise(none)


def greedy_merge(events: Column, gap: Column, kind: str) -> Column:
    """Fold of sorted events: one nearer than ``gap`` to the last kept replaces it if stronger.

    The replacement moves the place that later events are measured from. An
    event that far behind the one before it is kept whatever came before, so the
    fold runs apart on each stretch between such events, and is linear but for
    the length of a stretch.
    """
    n = F.size(events)
    at = lambda i: F.get(events, i)["at"]
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: (i == 0) | (at(i) - at(i - 1) >= gap))
    ends = F.filter(places, lambda i: (i == n - 1) | (at(i + 1) - at(i) >= gap))
    stretches = F.zip_with(starts, ends, lambda i, j: F.slice(events, i + 1, j - i + 1))

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)
        apart = (F.size(kept) == 0) | (e["at"] - F.get(kept, F.size(kept) - 1)["at"] >= gap)
        stronger = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(e))
        return F.when(apart, F.concat(kept, F.array(e))).when(e["strength"] > last["strength"], stronger).otherwise(kept)

    none = F.array().cast(kind)
    return F.when(n > 0, F.flatten(F.transform(stretches, lambda s: F.aggregate(s, none, step)))).otherwise(none)


def segment_signals(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """One row a segment: its rows as arrays, in order, with filled and smoothed axes."""
    return signals_of(segment_rows(trajectory, videos, p), videos, p)


def signals_of(rows: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """segment_signals of rows that are in segments already."""
    rows = interpolate(rows)
    fields = F.struct("pos", "frame", "visible", "x_filled", "y_filled")
    whole = rows.groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(fields)).alias("rows")).join(videos, "video_id")
    window = p.smooth_window(F.col("fps"))
    axes = staged(whole, x_values=F.col("rows.x_filled"), y_values=F.col("rows.y_filled"), window=window)
    return staged(axes, x_smooth=smooth(F.col("x_values"), F.col("window")), y_smooth=smooth(F.col("y_values"), F.col("window"))).drop("x_values", "y_values", "window")


def turns(signals: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Add raw (turns of both axes, sorted), merged, and events (serve added, merged again)."""
    window, gap = p.turn_window(F.col("fps")), p.merge_gap(F.col("fps"))
    prominence = F.lit(p.min_turn_diagonal_fraction) * diagonal()
    plain, named = "array<struct<at:int,strength:double>>", "array<struct<at:int,strength:double,rule:string>>"
    out = staged(signals, turn_window=window, prominence=prominence, merge_gap=gap)
    window, gap, prominence = F.col("turn_window"), F.col("merge_gap"), F.col("prominence")
    out = staged(out, raw=F.array_sort(F.concat(axis_turns(F.col("x_smooth"), window, prominence), axis_turns(F.col("y_smooth"), window, prominence))))
    out = staged(out, merged=greedy_merge(F.col("raw"), gap, plain))
    first = (F.array_position(F.col("rows.visible"), True) - 1).cast("int")
    serve = F.struct(first.alias("at"), prominence.alias("strength"), F.lit(SERVE).alias("rule"))
    ruled = F.transform("merged", lambda e: F.struct(e["at"].alias("at"), e["strength"].alias("strength"), F.lit(TURN).alias("rule")))
    out = staged(out, marked=F.array_sort(F.concat(F.array(serve), ruled)))
    return staged(out, events=greedy_merge(F.col("marked"), gap, named)).drop("marked")


def with_hits(found: DataFrame) -> DataFrame:
    """Add hits: what each event says, with its row's frame and filled point."""

    def hit(e: Column) -> Column:
        row = F.get(F.col("rows"), e["at"])
        return F.struct(
            row["frame"].alias("frame"), (row["frame"] / F.col("fps")).alias("seconds"), row["x_filled"].alias("x"), row["y_filled"].alias("y"),
            row["visible"].alias("observed"), e["rule"].alias("rule"), F.least(F.lit(0.95), F.lit(0.55) + e["strength"] / diagonal()).alias("confidence"),
        )

    return staged(found, hits=F.transform("events", hit))


def qualify(found: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Segments with enough hits that last long enough."""
    start, end = F.get(F.col("rows.frame"), F.lit(0)), F.element_at(F.col("rows.frame"), -1)
    held = found.withColumn("start_frame", start).withColumn("end_frame", end)
    return held.where((F.size("hits") >= p.min_rally_hits) & ((F.col("end_frame") - F.col("start_frame")) / F.col("fps") >= p.min_rally_seconds))


def number_rallies(kept: DataFrame) -> DataFrame:
    """Qualifying segments as rallies 1, 2, .. of each video, with counts of observed and inferred hits."""
    order = Window.partitionBy("video_id").orderBy("start_frame")
    observed = F.size(F.filter("hits", lambda h: h["observed"])).cast("long")
    return kept.select(
        "video_id", F.row_number().over(order).cast("long").alias("rally"), "start_frame", "end_frame",
        (F.col("start_frame") / F.col("fps")).alias("start_seconds"), (F.col("end_frame") / F.col("fps")).alias("end_seconds"),
        F.size("hits").cast("long").alias("hit_count"), observed.alias("observed_hits"), (F.size("hits") - observed).alias("inferred_gap_hits"), "hits",
    )


def rallies_of(rows: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Rallies, hits nested, of rows that are in segments already; numbered within these rows."""
    return number_rallies(qualify(with_hits(turns(signals_of(rows, videos, p), p)), p))


def analyze(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Rallies (hits nested) and hits (one row each) of all videos.

    ``trajectory``: video_id, frame, visible, x, y, one row a frame; ``videos``:
    video_id, fps, width, height. Videos without a positive rate have none.
    """
    known = videos.where("fps > 0")
    rallies = rallies_of(segment_rows(trajectory, known, p), known, p)
    hits = rallies.select("video_id", "rally", F.posexplode("hits").alias("hit", "h")).select("video_id", "rally", (F.col("hit") + 1).cast("long").alias("hit"), "h.*")
    return rallies, hits
