"""Plans of the analysis itself: gaps, splits, segments, signals, hits, rallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dealt as D
from ..operators import gaps as G
from ..operators import hits as H
from ..params import DEFAULTS
from ..sources.files import shared
from ..sources.tables import RATES, event_trajectories, event_videos
from .chain import CHAIN

#: Frames of a task of the analysis, about.
TASK_ROWS = 100_000

PLANS: dict = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str):
    """Register a plan and the SQL, over the chain's tables, that its rows must equal."""

    def put(f):
        PLANS[name] = f
        SQL[name] = CHAIN + sql
        return f

    return put


def r6(c: str | Column) -> Column:
    """A double rounded for comparison, under its own name."""
    return F.round(c, 6).alias(c) if isinstance(c, str) else F.round(c, 6)


def tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return event_trajectories(s, d), event_videos(s, d)


def parts(s: SparkSession, d: str) -> int:
    """Tasks for the windows of an analysis: as many as keep each to about TASK_ROWS frames."""
    frames = s.read.parquet(f"{d}/events.parquet").count() * len(RATES)
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-frames // TASK_ROWS))


def dealt_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """tables, frames dealt by video over tasks whose number grows with them; left alone, Spark joins what it deals to as many tasks as there are cores."""
    t, v = tables(s, d)
    return t.repartition(parts(s, d), "video_id"), v


def signals(s: SparkSession, d: str) -> DataFrame:
    return H.segment_signals(*dealt_tables(s, d))


def rallies(s: SparkSession, d: str) -> DataFrame:
    return H.analyze(*dealt_tables(s, d))[0]


def stored_rallies(s: SparkSession, d: str) -> DataFrame:
    """rallies without their hits, worked out once and written: what reads them twice, or joins them, would else run the analysis in the same tasks."""
    path = shared(s, "rallies")
    rallies(s, d).drop("hits").write.parquet(path)
    return s.read.parquet(path)


def hits(s: SparkSession, d: str) -> DataFrame:
    return H.analyze(*dealt_tables(s, d))[1]


@plan("f1_invisible_gaps", "select video_id, left_pos, right_pos, size from gaps")
def f1(s, d):
    return G.invisible_gaps(tables(s, d)[0]).select("video_id", "left_pos", "right_pos", "size")


@plan("f2_false_runs", "select video_id, run_start, run_end, length from runs")
def f2(s, d):
    return G.hidden_runs(tables(s, d)[0]).select("video_id", "run_start", "run_end", "length")


@plan("f3_inner_runs", 'select video_id, run_start, run_end, length from marked where "inner"')
def f3(s, d):
    return G.hidden_runs(tables(s, d)[0]).where("inner").select("video_id", "run_start", "run_end", "length")


@plan("f4_gap_length", "select t.video_id, frame, coalesce(length, 0)::bigint as gap_length from traj t left join runs r on r.video_id = t.video_id and pos between run_start and run_end")
def f4(s, d):
    return G.run_length_of_rows(tables(s, d)[0])


@plan("c9_top_band", "select video_id, left_pos, below_top from cand")
def c9(s, d):
    return G.candidate_gaps(*tables(s, d)).select("video_id", "left_pos", "below_top")


@plan("d8_gap_context", "select video_id, left_pos, side, pos from ctx")
def d8(s, d):
    t, v = tables(s, d)
    return G.gap_context(t, G.candidate_gaps(t, v).where("below_top")).select("video_id", "left_pos", "side", "pos")


@plan("f5_visible_speed", "select video_id, left_pos, side, pos, round(speed, 6) as speed from spd")
def f5(s, d):
    t, v = tables(s, d)
    return G.context_speeds(G.gap_context(t, G.candidate_gaps(t, v).where("below_top"))).select("video_id", "left_pos", "side", "pos", r6("speed"))


@plan("e5_tail_median", "select video_id, left_pos, round(before_median, 6) as before_median from judged where before_median is not null")
def e5(s, d):
    return G.split_gaps(*tables(s, d)).where("below_top and before_median is not null").select("video_id", "left_pos", r6("before_median"))


@plan("f14_split_rules", "select video_id, left_pos, right_pos, interior_restart, very_long, low_speed, is_split from splits")
def f14(s, d):
    return G.split_gaps(*tables(s, d)).select("video_id", "left_pos", "right_pos", "interior_restart", "very_long", "low_speed", "is_split")


@plan("f15_segment_ranges", "select video_id, segment_id::bigint as segment_id, start_pos, end_pos, start_frame, end_frame, n_rows from segs")
def f15(s, d):
    return G.segments(*tables(s, d)).withColumn("segment_id", F.col("segment_id").cast("long"))


@plan("f7_interpolate_both", "select video_id, pos, round(x_filled, 6) as x_filled, round(y_filled, 6) as y_filled from filled")
def f7(s, d):
    return H.interpolate(G.segment_rows(*tables(s, d))).select("video_id", "pos", r6("x_filled"), r6("y_filled"))


@plan("f8_smooth", "select video_id, pos, round(max(s) filter (axis = 'x'), 6) as x_smooth, round(max(s) filter (axis = 'y'), 6) as y_smooth from smoothed group by 1, 2")
def f8(s, d):
    rows = signals(s, d).select("video_id", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), "x_smooth", "y_smooth")).alias("r"))
    return rows.select("video_id", F.col("r.pos").alias("pos"), r6(F.col("r.x_smooth")).alias("x_smooth"), r6(F.col("r.y_smooth")).alias("y_smooth"))


def _events(s, d, column: str, *names: str) -> DataFrame:
    return H.turns(signals(s, d)).select("video_id", F.col("segment_id").cast("long").alias("segment_id"), F.explode(column).alias("e")).select(
        "video_id", "segment_id", F.col("e.at").cast("long").alias("place"), r6(F.col("e.strength")).alias("strength"), *(F.col(f"e.{n}").alias(n) for n in names)
    )


@plan("f10_axis_extrema", "select video_id, segment_id::bigint as segment_id, place::bigint as place, round(strength, 6) as strength from raw")
def f10(s, d):
    return _events(s, d, "raw")


@plan("f11_merge_extrema", "select video_id, segment_id::bigint as segment_id, place::bigint as place, round(strength, 6) as strength from merged")
def f11(s, d):
    return _events(s, d, "merged")


@plan("f12_serve_event", "select video_id, segment_id::bigint as segment_id, place::bigint as place, round(strength, 6) as strength, rule from kept")
def f12(s, d):
    return _events(s, d, "events", "rule")


@plan("f13_hit_rows", "select video_id, rally, hit, frame, round(seconds, 6) as seconds, round(x, 6) as x, round(y, 6) as y, observed, rule, round(confidence, 6) as confidence from hits")
def f13(s, d):
    return hits(s, d).select("video_id", "rally", "hit", "frame", r6("seconds"), r6("x"), r6("y"), "observed", "rule", r6("confidence"))


@plan("c6_rally_qualify", "select video_id, start_frame, end_frame, hit_count from qual")
def c6(s, d):
    kept = H.qualify(H.with_hits(H.turns(signals(s, d))))
    return kept.select("video_id", "start_frame", "end_frame", F.size("hits").cast("long").alias("hit_count"))


RALLY_SQL = "select video_id, rally, start_frame, end_frame, round(start_seconds, 6) as start_seconds, round(end_seconds, 6) as end_seconds, hit_count, observed_hits, inferred_gap_hits from rallies"


@plan("f16_number_rallies", RALLY_SQL)
def f16(s, d):
    return rallies(s, d).select("video_id", "rally", "start_frame", "end_frame", r6("start_seconds"), r6("end_seconds"), "hit_count", "observed_hits", "inferred_gap_hits")


@plan("f1_dealt_gaps", "select video_id, left_pos, right_pos, size from gaps")
def f1_dealt(s, d):
    """f1 with every video dealt into blocks of places."""
    t, v = tables(s, d)
    return D.invisible_gaps(t, v).select("video_id", "left_pos", "right_pos", "size")


@plan("f15_dealt_segments", "select video_id, segment_id::bigint as segment_id, start_pos, end_pos, start_frame, end_frame, n_rows from segs")
def f15_dealt(s, d):
    return D.segments(*tables(s, d))


@plan("f16_dealt_rallies", RALLY_SQL)
def f16_dealt(s, d):
    found = D.analyze(*tables(s, d))[0]
    return found.select("video_id", "rally", "start_frame", "end_frame", r6("start_seconds"), r6("end_seconds"), "hit_count", "observed_hits", "inferred_gap_hits")


PLANS["analyze"], SQL["analyze"] = f16, SQL["f16_number_rallies"]


@plan("e2_observed_inferred", "select video_id, rally, observed_hits, inferred_gap_hits from rallies")
def e2(s, d):
    return hits(s, d).groupBy("video_id", "rally").agg(F.count_if("observed").alias("observed_hits"), F.count_if(~F.col("observed")).alias("inferred_gap_hits"))


@plan("e3_totals", "select video_id, count(*) as rally_count, sum(hit_count)::bigint as total_hits, array_to_string(list(hit_count order by rally), ',') as hit_counts from rallies group by 1")
def e3(s, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rally", "hit_count"))), lambda r: r["hit_count"].cast("string")), ",")
    return rallies(s, d).groupBy("video_id").agg(F.count("*").alias("rally_count"), F.sum("hit_count").alias("total_hits"), listed.alias("hit_counts"))


@plan("e10_hit_lists", "select video_id, rally, string_agg(frame::varchar, ';' order by hit) as hit_frames from hits group by 1, 2")
def e10(s, d):
    return rallies(s, d).select("video_id", "rally", F.array_join(F.col("hits.frame").cast("array<string>"), ";").alias("hit_frames"))


@plan("f18_running_hits", "select video_id, rally, frame, count(*) over (partition by video_id, rally order by frame)::bigint as hits_so_far from hits")
def f18(s, d):
    return hits(s, d).select("video_id", "rally", "frame", F.count("*").over(Window.partitionBy("video_id", "rally").orderBy("frame")).alias("hits_so_far"))


@plan("d5_frame_in_rally", "select t.video_id, t.frame, r.rally from traj t left join rallies r on r.video_id = t.video_id and t.frame between start_frame and end_frame")
def d5(s, d):
    # rallies of a video are disjoint: the last one begun is the only one that can hold the frame
    t, r = tables(s, d)[0], stored_rallies(s, d)
    marks = t.select("video_id", "frame", F.lit(1).alias("kind"), F.lit(None).cast("struct<rally:bigint,end_frame:bigint>").alias("r"))
    marks = marks.unionByName(r.select("video_id", F.col("start_frame").alias("frame"), F.lit(0).alias("kind"), F.struct("rally", "end_frame").alias("r")))
    marks = marks.repartition(parts(s, d), "video_id")
    seen = F.last("r", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("r", seen).where("kind = 1").select("video_id", "frame", F.when(F.col("frame") <= F.col("r.end_frame"), F.col("r.rally")).alias("rally"))


@plan("d10_near_hit", "select t.video_id, t.frame, count(*) as n_hits from traj t join hits h on h.video_id = t.video_id and abs(h.frame - t.frame) <= 4 group by 1, 2")
def d10(s, d):
    near = hits(s, d).select("video_id", F.explode(F.sequence(F.col("frame") - 4, F.col("frame") + 4)).alias("frame"))
    return tables(s, d)[0].select("video_id", "frame").join(near, ["video_id", "frame"]).groupBy("video_id", "frame").agg(F.count("*").alias("n_hits"))


@plan("d11_next_visible", "select video_id, pos, (select min(pos) from traj u where u.video_id = t.video_id and u.pos > t.pos and u.visible) as next_pos from traj t")
def d11(s, d):
    shown = F.when(F.col("visible"), F.col("pos"))
    ahead = F.last(shown, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    return G.positions(tables(s, d)[0]).select("video_id", "pos", ahead.alias("next_pos"))


@plan("b4_write_rallies", "select video_id, rally, start_frame, end_frame, round(start_seconds, 3) as start_seconds, round(end_seconds, 3) as end_seconds, hit_count, observed_hits, inferred_gap_hits, (select string_agg(frame::varchar, ';' order by hit) from hits h where h.video_id = r.video_id and h.rally = r.rally) as hit_frames, 'provisional' as confidence from rallies r")
def b4(s, d):
    return rallies(s, d).select(
        "video_id", "rally", "start_frame", "end_frame", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"),
        "hit_count", "observed_hits", "inferred_gap_hits", F.array_join(F.col("hits.frame").cast("array<string>"), ";").alias("hit_frames"), F.lit("provisional").alias("confidence"),
    )


@plan("b5_write_hits", "select video_id, rally, hit, frame, round(seconds, 6) as seconds, round(x, 6) as x, round(y, 6) as y, case when observed then 'observed' else 'inferred_gap' end as source, rule, round(confidence, 6) as confidence from hits")
def b5(s, d):
    source = F.when(F.col("observed"), "observed").otherwise("inferred_gap").alias("source")
    return hits(s, d).select("video_id", "rally", "hit", "frame", r6("seconds"), r6("x"), r6("y"), source, "rule", r6("confidence"))


@plan("b3_write_rally_index", "select video_id, rally, start_frame, end_frame, hit_count as auto_hit_count, null::bigint as manual_hit_count, hit_count as effective_hit_count, 'unreviewed' as review_status, observed_hits, inferred_gap_hits from rallies")
def b3(s, d):
    manual = F.lit(None).cast("long")
    return rallies(s, d).select(
        "video_id", "rally", "start_frame", "end_frame", F.col("hit_count").alias("auto_hit_count"), manual.alias("manual_hit_count"),
        F.coalesce(manual, "hit_count").alias("effective_hit_count"), F.lit("unreviewed").alias("review_status"), "observed_hits", "inferred_gap_hits",
    )


@plan("b2_write_feed", "select video_id, count(*) as n, min(rally) as first_rally, sum(hit_count)::bigint as hits from rallies group by 1")
def b2(s, d):
    from ..sources.files import feed_json, parse_feed

    parsed = parse_feed(feed_json(rallies(s, d)))
    return parsed.groupBy("video_id").agg(F.count("*").alias("n"), F.min("rally").alias("first_rally"), F.sum("hitCount").alias("hits"))


@plan("b6_write_summary", "select v.video_id, (select count(*) from traj t where t.video_id = v.video_id) as trajectory_rows, (select count(*) from traj t where t.video_id = v.video_id and visible) as visible_frames, (select count(*) from rallies r where r.video_id = v.video_id) as rally_count, coalesce((select sum(hit_count) from rallies r where r.video_id = v.video_id), 0)::bigint as hit_count from videos v")
def b6(s, d):
    t, v = tables(s, d)
    rows = t.groupBy("video_id").agg(F.count("*").alias("trajectory_rows"), F.count_if("visible").alias("visible_frames"))
    found = stored_rallies(s, d).groupBy("video_id").agg(F.count("*").alias("rally_count"), F.sum("hit_count").alias("hit_count"))
    return v.select("video_id").join(rows, "video_id", "left").join(found, "video_id", "left").na.fill(0, ["trajectory_rows", "visible_frames", "rally_count", "hit_count"])


@plan("c4_to_seconds", "select t.video_id, frame, round(frame / fps, 3) as seconds from traj t join videos v on v.video_id = t.video_id")
def c4(s, d):
    t, v = tables(s, d)
    return t.join(v, "video_id").select("video_id", "frame", F.round(F.col("frame") / F.col("fps"), 3).alias("seconds"))


@plan("c2_visible_filter", "select video_id, pos from traj where visible")
def c2(s, d):
    return G.positions(tables(s, d)[0]).where("visible").select("video_id", "pos")


@plan("f9_odd_frames", "select fps, smooth, split, restart, turn, merge from (values (4.0::double, 3, 1, 2, 2, 1), (10.0::double, 3, 4, 2, 2, 3)) t(fps, smooth, split, restart, turn, merge)")
def f9(s, d):
    fps, p = F.col("fps"), DEFAULTS
    return tables(s, d)[1].select("fps").distinct().select("fps", p.smooth_window(fps).alias("smooth"), p.split_gap(fps).alias("split"), p.restart_gap(fps).alias("restart"), p.turn_window(fps).alias("turn"), p.merge_gap(fps).alias("merge"))


@plan("k2_incremental_emit", "select video_id, start_frame, end_frame, hit_count from rallies")
def k2(s, d):
    """Chunks of 40 frames as a stream: each batch costs its chunk, and the rest comes from the state."""
    from ..sources.files import shared
    from ..sources.tables import TRAJECTORY
    from ..streaming.rallies import RallyStream

    root = shared(s, "stream")
    t, v = tables(s, d)
    stream = RallyStream(s, f"{root}/run", v)
    for half, rows in enumerate((t.where("frame < 40"), t.where("frame >= 40"))):
        rows.write.parquet(f"{root}/input/{half}")
        stream.run(s.readStream.schema(TRAJECTORY).parquet(f"{root}/input/*"))  # the second goes on where the first has stopped
    return stream.finish().select("video_id", "start_frame", "end_frame", "hit_count")
