"""The analysis with every video dealt over many tasks, however long it is.

A video is cut into blocks of places. What a row needs from all rows before or
after it (its place, the last and next visible row, the number of cuts) is found
by a scan in two levels: inside its block by a window, and across blocks by one
row a block that carries what the blocks before or after it hold. What a row needs
from its neighbours (speeds, smoothing, turns) is found by windows over its block
with copies of the neighbours' edge rows. Only turning points, not rows, are
gathered by segment.

Results equal those of ``gaps`` and ``hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULTS, RallyParameters
from .gaps import diagonal, marks
from .hits import SERVE, TURN, greedy_merge, number_rallies, staged

#: Places of a block.
BLOCK = 1 << 16
PAYLOAD = "frame:bigint,x:double,y:double,observed:boolean"


def block_of(place: Column, size: int) -> Column:
    return F.floor(place / size)


def scanned(rows: DataFrame, order: str, last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Scans along each video of rows with video_id and block.

    ``last``: the latest value that is not null, at the row or before it;
    ``following``: the first one at the row or behind it; ``sums``: the sum of a
    whole number over all rows before.
    """
    last, following, sums = last or {}, following or {}, sums or {}
    here = Window.partitionBy("video_id", "block").orderBy(order)
    known = lambda v: F.when(v.isNotNull(), F.col(order))
    whole = rows.groupBy("video_id", "block").agg(
        *(F.max_by(v, known(v)).alias(f"_{n}") for n, v in last.items()), *(F.min_by(v, known(v)).alias(f"_{n}") for n, v in following.items()), *(F.sum(v).alias(f"_{n}") for n, v in sums.items()), F.count("*").alias("_rows")
    )
    blocks = Window.partitionBy("video_id").orderBy("block")  # a row a block
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("video_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        "video_id", "block", *(F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}") for n in last), *(F.last(f"_{n}", ignorenulls=True).over(behind).alias(f"_{n}") for n in following),
        *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums),
    )
    upto, past = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    # backwards: a frame that ends at the last row is gone through again for every row
    onward = Window.partitionBy("video_id", "block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, ["video_id", "block"]).select(
        *rows.columns, *(F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_{n}")).alias(n) for n, v in last.items()),
        *(F.coalesce(F.last(v, ignorenulls=True).over(onward), F.col(f"_{n}")).alias(n) for n, v in following.items()),
        *((F.col(f"_{n}") + F.coalesce(F.sum(v).over(past), F.lit(0))).cast("long").alias(n) for n, v in sums.items()),
    )


def with_edges(rows: DataFrame, place: Column, before: Column, behind: Column, size: int, least: Column | None = None, most: Column | None = None) -> DataFrame:
    """Copy each row into all blocks that have a row at most ``before`` behind it or ``behind`` ahead of it; core says which copy is its own."""
    low, high = block_of(place - behind, size), block_of(place + before, size)
    low, high = F.greatest(low, block_of(F.lit(0) if least is None else least, size)), high if most is None else F.least(high, block_of(most, size))
    return rows.withColumn("block", F.explode(F.sequence(low, high))).withColumn("core", F.col("block") == block_of(place, size))


def positions(trajectory: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add pos and rank, the rows and the visible rows of the video before a row."""
    rows = trajectory.withColumn("block", block_of(F.col("frame"), size))
    return scanned(rows, "frame", sums={"pos": F.lit(1), "rank": F.col("visible").cast("int")}).drop("block")


def marked(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows with places, and the visible ones with split marks, starts and ends of segments."""
    rows = positions(trajectory, size).join(videos, "video_id")
    ahead = (F.lit(0.45) * F.col("fps")).cast("int")
    # a mark needs the three visible rows before and those that its gap looks ahead at; a start, the mark before
    edged = with_edges(rows.where("visible"), F.col("rank"), F.lit(4), ahead + 1, size)
    keys = ("video_id", "block")
    shown = marks(edged, keys, p)
    first = F.coalesce(F.lag("is_split").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(True))
    shown = shown.withColumn("starts", first).withColumn("ends", F.col("is_split") | F.col("right_pos").isNull())
    return rows, shown.where("core").drop("core")


def invisible_gaps(trajectory: DataFrame, videos: DataFrame, size: int = BLOCK) -> DataFrame:
    """Gaps between successive visible rows."""
    shown = marked(trajectory, videos, size=size)[1].where("right_pos > pos + 1")
    return shown.select("video_id", F.col("pos").alias("left_pos"), F.col("x").alias("left_x"), F.col("y").alias("left_y"), "right_pos", "right_x", "right_y", "size")


def hidden_runs(trajectory: DataFrame, size: int = BLOCK) -> DataFrame:
    """All runs of invisible rows, those at the ends too."""
    rows = positions(trajectory, size)
    # rows of a run have the same number of visible rows before them
    runs = rows.where("not visible").groupBy("video_id", "rank").agg(F.min("pos").alias("run_start"), F.max("pos").alias("run_end"), F.count("*").alias("length"))
    shown = rows.groupBy("video_id").agg(F.count_if("visible").alias("shown"))
    return runs.join(shown, "video_id").select("video_id", "run_start", "run_end", "length", ((F.col("rank") > 0) & (F.col("rank") < F.col("shown"))).alias("inner"))


def segment_rows(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> DataFrame:
    """Rows of segments with segment_id, its first and last place, and filled points."""
    rows, shown = marked(trajectory, videos, p, size)
    shown = scanned(shown, "pos", sums={"own": F.col("is_split").cast("int")})
    columns = ["video_id", "frame", "pos", "fps", "width", "height"]
    blank = lambda kind: F.lit(None).cast(kind)
    seen = shown.select(*columns, F.struct("own", "pos", "x", "y", F.when(F.col("starts"), F.col("pos")).alias("start"), F.when(F.col("ends"), F.col("pos")).alias("end")).alias("point"))
    hidden = rows.where("not visible").select(*columns, blank("struct<own:bigint,pos:bigint,x:double,y:double,start:bigint,end:bigint>").alias("point"))
    every = seen.unionByName(hidden).withColumn("block", block_of(F.col("pos"), size))
    point = F.col("point")
    every = scanned(every, "pos", last={"a": point, "start": point["start"]}, following={"b": point, "end": point["end"]})
    filled = []
    for c in ("x", "y"):
        step = (F.col(f"b.{c}") - F.col(f"a.{c}")) / (F.col("b.pos") - F.col("a.pos"))
        between = F.col(f"a.{c}") + step * (F.col("pos") - F.col("a.pos"))
        filled.append(F.when(F.col("b.pos") > F.col("a.pos"), between).otherwise(F.col(f"a.{c}")).alias(f"{c}_filled"))
    return every.where("a.own = b.own").select(*columns, F.col("point").isNotNull().alias("visible"), F.col("a.own").alias("segment_id"), "start", "end", *filled)


def segments(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> DataFrame:
    """Bounds of every segment."""
    return segment_rows(trajectory, videos, p, size).groupBy("video_id", "segment_id").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_rows")
    )


def smoothed(rows: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> DataFrame:
    """Rows of segments, dealt into blocks with edges, with smoothed axes; values at the very edges of a block are not whole."""
    n, window, turn = F.col("end") - F.col("start") + 1, p.smooth_window(F.col("fps")), p.turn_window(F.col("fps"))
    fits = F.least(window, n - F.when(n % 2 == 0, 1).otherwise(0))
    rows = rows.withColumn("half", F.when((n >= 3) & (window > 1) & (fits >= 3), F.floor(fits / 2)).otherwise(0)).withColumn("turn_window", turn).withColumn("n", n)
    reach = F.col("half") + F.col("turn_window")
    rows = with_edges(rows, F.col("pos"), reach, reach, size, F.col("start"), F.col("end"))
    # places in units of a half window, counted from the block's edge, so that one range serves all videos
    rows = rows.withColumn("_key", (F.col("pos") - F.col("block") * size) / F.greatest(F.col("half"), F.lit(1)))
    missing = [F.greatest(F.lit(0), F.col("half") - (F.col("pos") - F.col("start"))).cast("int"), F.greatest(F.lit(0), F.col("half") - (F.col("end") - F.col("pos"))).cast("int")]
    around = "over (partition by video_id, segment_id, block order by _key range between 1.000001D preceding and 1.000001D following)"
    rows = rows.select("*", *(F.expr(f"collect_list({c}_filled) {around}").alias(f"_{c}") for c in ("x", "y")))
    for c in ("x", "y"):
        # end values are repeated; added up in order of places, as on arrays
        values = F.concat(F.array_repeat(F.get(f"_{c}", F.lit(0)), missing[0]), F.col(f"_{c}"), F.array_repeat(F.element_at(f"_{c}", -1), missing[1]))
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) * (F.lit(1.0) / (2 * F.col("half") + 1))
        rows = rows.withColumn(f"{c}_smooth", F.when(F.col("half") > 0, mean).otherwise(F.col(f"{c}_filled")))
    return rows.drop("_key", "_x", "_y")


def turning_rows(rows: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> DataFrame:
    """First and last rows of segments, and rows at which an axis turns: with raw, an array of (at, strength)."""
    rows = smoothed(rows, p, size).withColumn("prominence", F.lit(p.min_turn_diagonal_fraction) * diagonal())
    rows = rows.withColumn("_key", (F.col("pos") - F.col("block") * size) / F.col("turn_window"))
    sides = {"before": "1.000001D preceding and 0.000001D preceding", "after": "0.000001D following and 1.000001D following"}
    over = lambda side: f"over (partition by video_id, segment_id, block order by _key range between {sides[side]})"
    rows = rows.select("*", *(F.expr(f"{f}({c}_smooth) {over(side)}").alias(f"_{f}_{c}_{side}") for c in ("x", "y") for f in ("min", "max") for side in sides))
    at, whole = F.col("pos") - F.col("start"), F.col("core")
    whole &= (F.col("n") > 2 * F.col("turn_window")) & (at >= F.col("turn_window")) & (at <= F.col("n") - F.col("turn_window") - 1)
    found = []
    for c in ("x", "y"):
        v = F.col(f"{c}_smooth")
        side = {(f, s): F.col(f"_{f}_{c}_{s}") for f in ("min", "max") for s in sides}
        high = F.when((v >= side["max", "before"]) & (v > side["max", "after"]), F.least(v - side["min", "before"], v - side["min", "after"]))
        low = F.when((v <= side["min", "before"]) & (v < side["min", "after"]), F.least(side["max", "before"] - v, side["max", "after"] - v))
        found += [F.when(whole & (s >= F.col("prominence")), F.struct(at.cast("int").alias("at"), s.alias("strength"))) for s in (high, low)]
    rows = rows.withColumn("raw", F.array_compact(F.array(*found))).where("core and (pos in (start, end) or size(raw) > 0)")
    return rows.select("video_id", "segment_id", "frame", "pos", "start", "end", "visible", "x_filled", "y_filled", "fps", "width", "height", "prominence", "raw")


def segment_events(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> DataFrame:
    """One row a segment: raw turns, turns after merging, and events (serve added, merged again)."""
    rows = turning_rows(segment_rows(trajectory, videos, p, size), p, size)
    row = F.struct("frame", F.col("x_filled").alias("x"), F.col("y_filled").alias("y"), F.col("visible").alias("observed"))
    plain = f"array<struct<at:int,strength:double,{PAYLOAD}>>"
    rows = rows.withColumn("row", row).withColumn("raw", F.transform("raw", lambda e: F.struct(e["at"], e["strength"], *(F.col("row")[c] for c in ("frame", "x", "y", "observed")))).cast(plain))
    whole = rows.groupBy("video_id", "segment_id").agg(
        F.array_sort(F.flatten(F.collect_list("raw"))).alias("raw"), F.min_by("row", "pos").alias("first"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        *(F.any_value(c).alias(c) for c in ("fps", "width", "height", "prominence")),
    )
    whole = staged(whole, merge_gap=p.merge_gap(F.col("fps")))
    whole = staged(whole, merged=greedy_merge(F.col("raw"), F.col("merge_gap"), plain))
    named = f"array<struct<at:int,strength:double,rule:string,{PAYLOAD}>>"
    of = lambda e: [e[c].alias(c) for c in ("frame", "x", "y", "observed")]
    serve = F.struct(F.lit(0).alias("at"), F.col("prominence").alias("strength"), F.lit(SERVE).alias("rule"), *of(F.col("first")))
    ruled = F.transform("merged", lambda e: F.struct(e["at"].alias("at"), e["strength"].alias("strength"), F.lit(TURN).alias("rule"), *of(e)))
    whole = staged(whole, marked=F.array_sort(F.concat(F.array(serve), ruled)))
    return staged(whole, events=greedy_merge(F.col("marked"), F.col("merge_gap"), named)).drop("marked", "first", "merge_gap")


def analyze(trajectory: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rallies (hits nested) and hits of all videos, as ``hits.analyze`` finds them; no task has more than about ``size`` rows of a video.

    Frames of a video are unique. Null frames or ids, and videos without a
    positive rate, have no part; null visible is invisible.
    """
    rows = trajectory.where("video_id is not null and frame is not null").withColumn("visible", F.coalesce("visible", F.lit(False)))
    found = segment_events(rows, videos.where("fps > 0"), p, size)
    confidence = lambda e: F.least(F.lit(0.95), F.lit(0.55) + e["strength"] / diagonal())
    hit = lambda e: F.struct(e["frame"].alias("frame"), (e["frame"] / F.col("fps")).alias("seconds"), e["x"].alias("x"), e["y"].alias("y"), e["observed"].alias("observed"), e["rule"].alias("rule"), confidence(e).alias("confidence"))
    found = staged(found, hits=F.transform("events", hit))
    kept = found.where((F.size("hits") >= p.min_rally_hits) & ((F.col("end_frame") - F.col("start_frame")) / F.col("fps") >= p.min_rally_seconds))
    rallies = number_rallies(kept)
    hits = rallies.select("video_id", "rally", F.posexplode("hits").alias("hit", "h")).select("video_id", "rally", (F.col("hit") + 1).cast("long").alias("hit"), "h.*")
    return rallies, hits
