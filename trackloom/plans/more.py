"""Plans around the analysis: quality, chunks, edit lists, scalars, grids, match rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunks as K
from ..operators import edits as M
from ..operators import games as B
from ..operators import gaps as G
from ..operators import grid as J
from ..operators import points as P
from ..operators import quality as Q
from ..operators import runs as R
from ..sources import files as S
from .chain import CHAIN
from .core import r6, rallies, stored_rallies, tables

PLANS: dict = {}
SQL: dict[str, str] = {}

#: A second run of the same videos: rows missing, visibility flipped, points moved.
SECOND = """, cand2 as (
  select video_id, frame, case when (video_id + frame) % 41 = 0 then not visible else visible end as visible,
         x + ((frame % 5) - 2) * 0.5::double as x, y + ((frame % 3) - 1) * 0.25::double as y
  from traj where (video_id + frame) % 37 <> 0
  union all select video_id, frame + 100000, visible, x, y from traj where frame = 0 and video_id % 4 = 0),
ref2 as (select * from traj),
comp as (
  select coalesce(r.video_id, c.video_id) as video_id, coalesce(r.frame, c.frame) as frame, r.visible as v, c.visible as w,
         coalesce(r.visible and c.visible, false) as both_visible, r.visible is distinct from c.visible as mismatch,
         case when r.visible and c.visible then sqrt((r.x - c.x) ** 2 + (r.y - c.y) ** 2) end as distance
  from ref2 r full join cand2 c on r.video_id = c.video_id and r.frame = c.frame)
"""
TOTALS = ", totals as (select v.video_id, fps, count(*) as frame_count, count(*) / fps as duration from videos v join traj t on t.video_id = v.video_id group by 1, 2)"
GRID = TOTALS + """, grid as (
  select *, c * core as core_start, least(frame_count, c * core + core) as core_end from (
    select video_id, frame_count, greatest(8, round(6.0::double * fps))::bigint as core, greatest(7, round(0.5::double * fps))::bigint as halo from totals) t,
    lateral (select unnest(range(0, ceil(frame_count / core)::bigint)) as c) u)
"""
EDIT = TOTALS + """, edits as (
  select video_id, rally, rally - 1 as position, start_seconds, end_seconds, hit_count, (video_id + rally) % 3 <> 0 as selected from rallies)
"""


def plan(name: str, sql: str | None = None):
    def put(f):
        PLANS[name] = f
        if sql:
            SQL[name] = CHAIN + sql
        return f

    return put


def second(s, d) -> tuple[DataFrame, DataFrame]:
    t = tables(s, d)[0]
    c = t.where("(video_id + frame) % 37 <> 0").select(
        "video_id", "frame", F.when((F.col("video_id") + F.col("frame")) % 41 == 0, ~F.col("visible")).otherwise(F.col("visible")).alias("visible"),
        (F.col("x") + ((F.col("frame") % 5) - 2) * 0.5).alias("x"), (F.col("y") + ((F.col("frame") % 3) - 1) * 0.25).alias("y"),
    )
    extra = t.where("frame = 0 and video_id % 4 = 0").withColumn("frame", F.col("frame") + 100000)
    return t, c.unionByName(extra.select(*c.columns))


def totals(s, d) -> DataFrame:
    t, v = tables(s, d)
    n = t.groupBy("video_id").agg(F.count("*").alias("frame_count"))
    return v.join(n, "video_id").withColumn("duration", F.col("frame_count") / F.col("fps"))


def edits(s, d) -> DataFrame:
    return edits_of(stored_rallies(s, d))


def edits_of(found: DataFrame) -> DataFrame:
    return M.edit_rows(found).withColumn("selected", (F.col("video_id") + F.col("rally")) % 3 != 0)


# ---------------------------------------------------------------- quality


@plan("e1_coverage", " select video_id, count(*) as n_rows, count(*) filter (visible) as visible_frames, round(100.0::double * count(*) filter (visible) / count(*), 2) as visible_percent, min(frame) filter (visible) as first_visible, max(frame) filter (visible) as last_visible from traj group by 1")
def e1(s, d):
    return Q.coverage(tables(s, d)[0])


@plan("e14_gap_stats", ' select v.video_id, coalesce(max(length), 0)::bigint as longest, count(*) filter (length >= fps * 0.5::double) as half_second, count(*) filter (length >= fps) as one_second from videos v left join marked m on m.video_id = v.video_id and "inner" group by 1')
def e14(s, d):
    return Q.gap_stats(*tables(s, d))


@plan("g2_longest_gaps", ' select * from (select video_id, run_start, run_end, length, (row_number() over (partition by video_id order by length desc, run_start))::integer as rank from marked where "inner") where rank <= 20')
def g2(s, d):
    return Q.longest_gaps(tables(s, d)[0])


@plan("f6_adjacent_jumps", " select video_id, frame, round(distance, 6) as distance from (select t.video_id, t.frame, t.visible, lag(t.visible) over w as pv, t.frame - lag(t.frame) over w as df, sqrt((t.x - lag(t.x) over w) ** 2 + (t.y - lag(t.y) over w) ** 2) as distance from traj t window w as (partition by t.video_id order by t.frame)) j where visible and pv and df = 1 and distance > 0.15::double * sqrt(640.0::double * 640 + 720.0::double * 720)")
def f6(s, d):
    return Q.adjacent_jumps(*tables(s, d)).select("video_id", "frame", r6("distance"))


@plan("d1_compare_trajectories", SECOND + "select video_id, frame, both_visible, mismatch, round(distance, 6) as distance from comp")
def d1(s, d):
    return Q.compare(*second(s, d)).select("video_id", "frame", "both_visible", "mismatch", r6("distance"))


@plan("e7_comparison_report", SECOND + "select video_id, count(*) as n_rows, count(*) filter (both_visible) as both_visible, count(*) filter (mismatch) as mismatches, count(*) filter (v is not null and w is null) as only_reference, count(v) - count(w) as row_difference, round(quantile_cont(distance, 0.5), 6) as p50, round(quantile_cont(distance, 0.95), 6) as p95, round(quantile_cont(distance, 0.999), 6) as p999, round(max(distance), 6) as worst, round(count(*) filter (distance = 0) / count(distance), 6) as identical_share from comp group by 1")
def e7(s, d):
    return Q.comparison_report(Q.compare(*second(s, d))).select("video_id", "n_rows", "both_visible", "mismatches", "only_reference", "row_difference", *(r6(c) for c in ("p50", "p95", "p999", "worst", "identical_share")))


@plan("e7_percentile_floor", SECOND + ", l as (select video_id, list(distance order by distance) as v from comp where distance is not null group by 1) select video_id, round(v[least(len(v), 1 + floor(0.95::double * len(v))::bigint)], 6) as p95 from l")
def e7f(s, d):
    rows = Q.compare(*second(s, d)).where("distance is not null").groupBy("video_id").agg(F.collect_list("distance").alias("v"))
    return rows.select("video_id", r6(Q.percentile_floor(F.col("v"), 0.95)).alias("p95"))


@plan("e8_min_max_mean", SECOND + "select video_id, round(min(distance), 6) as least, round(max(distance), 6) as most, round(avg(distance), 6) as mean from comp group by 1")
def e8(s, d):
    return Q.compare(*second(s, d)).groupBy("video_id").agg(r6(F.min("distance")).alias("least"), r6(F.max("distance")).alias("most"), r6(F.avg("distance")).alias("mean"))


@plan("e9_diff_stats", SECOND + "select video_id, count(*) filter (distance > 0) as changed, count(*) filter (distance > 0.5::double) as over_half, round(max(abs(distance)), 6) as worst from comp group by 1")
def e9(s, d):
    return Q.compare(*second(s, d)).groupBy("video_id").agg(F.count_if(F.col("distance") > 0).alias("changed"), F.count_if(F.col("distance") > 0.5).alias("over_half"), r6(F.max(F.abs(F.col("distance")))).alias("worst"))


@plan("g6_mismatch_sample", SECOND + "select * from (select video_id, (row_number() over (partition by video_id order by frame))::integer as rank, frame from comp where mismatch) where rank <= 20")
def g6(s, d):
    return Q.mismatch_sample(Q.compare(*second(s, d)))


@plan("g7_leaderboard", SECOND + "select video_id, n from (select video_id, count(*) filter (mismatch) as n from comp group by 1) order by n desc, video_id limit 14")
def g7(s, d):
    return Q.compare(*second(s, d)).groupBy("video_id").agg(F.count_if("mismatch").alias("n")).orderBy(F.col("n").desc(), "video_id").limit(14)


@plan("d2_golden_lookup", SECOND + "select c.video_id, c.frame, c.visible is distinct from r.visible as mismatch, round(case when c.visible and r.visible then sqrt((r.x - c.x) ** 2 + (r.y - c.y) ** 2) end, 6) as distance from cand2 c left join ref2 r on r.video_id = c.video_id and r.frame = c.frame")
def d2(s, d):
    ref, cand = second(s, d)
    return Q.golden_lookup(cand, ref).select("video_id", "frame", "mismatch", r6("distance"))


@plan("d6_point_lookup", SECOND + "select c.video_id, c.frame, r.x, r.y from cand2 c left join ref2 r on r.video_id = c.video_id and r.frame = c.frame")
def d6(s, d):
    ref, cand = second(s, d)
    return cand.select("video_id", "frame").join(ref.select("video_id", "frame", "x", "y"), ["video_id", "frame"], "left")


@plan("d3_ordinal_rally_compare", ", b as (select video_id, row_number() over (partition by video_id order by rally) as rally, start_frame, end_frame, hit_count + (rally % 5 = 0)::int as hit_count from rallies where (video_id + rally) % 7 <> 0) select coalesce(a.video_id, b.video_id) as video_id, coalesce(a.rally, b.rally) as rally, coalesce(a.start_frame = b.start_frame and a.end_frame = b.end_frame and a.hit_count = b.hit_count, false) as equal from rallies a full join b on a.video_id = b.video_id and a.rally = b.rally")
def d3(s, d):
    a = stored_rallies(s, d)
    order = Window.partitionBy("video_id").orderBy("rally")
    b = a.where("(video_id + rally) % 7 <> 0").withColumn("hit_count", F.col("hit_count") + (F.col("rally") % 5 == 0).cast("int")).withColumn("rally", F.row_number().over(order).cast("long"))
    return Q.compare_rallies(a, b).select("video_id", "rally", "equal")


@plan("d4_emit_anti", " select video_id, rally, start_frame from rallies where rally % 2 = 0")
def d4(s, d):
    r = stored_rallies(s, d)
    return r.join(r.where("rally % 2 = 1").select("video_id", "start_frame"), ["video_id", "start_frame"], "left_anti").select("video_id", "rally", "start_frame")


@plan("d9_timestamp_zip", SECOND + ", a as (select video_id, frame * 1.0::double as ts, row_number() over (partition by video_id order by frame) as i from ref2), b as (select video_id, frame * 1.0::double as ts, row_number() over (partition by video_id order by frame) as i from cand2 where frame < 100000) select a.video_id, max(abs(a.ts - b.ts)) as worst, round(avg(abs(a.ts - b.ts)), 6) as mean, count(*) as n from a join b on a.video_id = b.video_id and a.i = b.i group by 1")
def d9(s, d):
    ref, cand = second(s, d)
    order = Window.partitionBy("video_id").orderBy("frame")
    a, b = (x.select("video_id", F.col("frame").cast("double").alias(n), F.row_number().over(order).alias("i")) for x, n in ((ref, "a"), (cand.where("frame < 100000"), "b")))
    off = F.abs(F.col("a") - F.col("b"))
    return a.join(b, ["video_id", "i"]).groupBy("video_id").agg(F.max(off).alias("worst"), r6(F.avg(off)).alias("mean"), F.count("*").alias("n"))


@plan("c11_quality_gate", SECOND + ", q as (select video_id, count(*) filter (mismatch) / count(*) as m, quantile_cont(distance, 0.95) as p95, max(distance) as worst from comp group by 1) select video_id, array_to_string(list_filter([case when m > 0.005::double then 'visibility' end, case when p95 > 1.5::double then 'p95' end, case when worst > 0.01::double then 'max' end], lambda r: r is not null), ',') as reasons from q")
def c11(s, d):
    q = Q.compare(*second(s, d)).groupBy("video_id").agg((F.count_if("mismatch") / F.count("*")).alias("m"), F.percentile("distance", 0.95).alias("p95"), F.max("distance").alias("worst"))
    return q.select("video_id", F.array_join(Q.quality_verdict(F.col("m"), F.col("p95"), F.lit(0.0), F.col("worst")), ",").alias("reasons"))


@plan("c3_visibility_from_xy", " select video_id, frame, x <> 0 or y <> 0 as visible from traj")
def c3(s, d):
    return tables(s, d)[0].select("video_id", "frame", ((F.col("x") != 0) | (F.col("y") != 0)).alias("visible"))


@plan("c7_inpaint_provenance", SECOND + "select r.video_id, r.frame, r.visible as raw_visible, c.visible as final_visible, not r.visible and c.visible as inpainted from ref2 r join cand2 c on r.video_id = c.video_id and r.frame = c.frame")
def c7(s, d):
    ref, cand = second(s, d)
    rows = ref.select("video_id", "frame", F.col("visible").alias("raw_visible")).join(cand.select("video_id", "frame", F.col("visible").alias("final_visible")), ["video_id", "frame"])
    return rows.withColumn("inpainted", ~F.col("raw_visible") & F.col("final_visible"))


@plan("e18_inpaint_stats", SECOND + "select r.video_id, count(*) filter (r.visible) as raw, count(*) filter (c.visible) as final, count(*) filter (not r.visible and c.visible) as inpainted, count(*) as total from ref2 r join cand2 c on r.video_id = c.video_id and r.frame = c.frame group by 1")
def e18(s, d):
    return c7(s, d).groupBy("video_id").agg(F.count_if("raw_visible").alias("raw"), F.count_if("final_visible").alias("final"), F.count_if("inpainted").alias("inpainted"), F.count("*").alias("total"))


@plan("c8_roi_predicate", " select video_id, frame, case when not visible then 'hidden' when x >= 20 then 'accepted' else 'rejected' end as kind from traj")
def c8(s, d):
    return tables(s, d)[0].select("video_id", "frame", F.when(~F.col("visible"), "hidden").when(F.col("x") >= 20, "accepted").otherwise("rejected").alias("kind"))


@plan("c14_normalize_xy", " select video_id, frame, round(x / 640, 9) as x, round(y / 720, 9) as y from traj")
def c14(s, d):
    t, v = tables(s, d)
    return t.join(v, "video_id").select("video_id", "frame", F.round(F.col("x") / F.col("width"), 9).alias("x"), F.round(F.col("y") / F.col("height"), 9).alias("y"))


@plan("f17_trailing_history", ", k as (select video_id, list(frame order by pos) as l from traj where visible group by 1), g as (select video_id, frame, count(*) filter (visible) over (partition by video_id order by pos) as m from traj) select g.video_id, g.frame, coalesce(array_to_string(list_reverse(list_slice(l, greatest(1, m - 11), m)), ','), '') as frames from g left join k on k.video_id = g.video_id")
def f17(s, d):
    return Q.trailing_points(tables(s, d)[0], 12).select("video_id", "frame", F.array_join("frames", ",").alias("frames"))


@plan("f23_sample_ids", TOTALS + ", ids as (select t.video_id, floor(i * ((frame_count - 1)::double / 11))::bigint as id from totals t, range(0, 12) r(i) union select video_id, ((run_start + run_end) // 2)::bigint from (select *, row_number() over (partition by video_id order by length desc, run_start) as k from marked where \"inner\") where k <= 8) select video_id, id from ids")
def f23(s, d):
    spread = totals(s, d).select("video_id", F.explode(K.spread_sample(F.col("frame_count"), 12)).alias("id"))
    middles = Q.longest_gaps(tables(s, d)[0], 8).select("video_id", F.floor((F.col("run_start") + F.col("run_end")) / 2).alias("id"))
    return spread.unionByName(middles).distinct()


# ---------------------------------------------------------------- chunks


@plan("k1_chunk_grid", GRID + "select video_id, c as chunk, core_start, core_end, greatest(0, core_start - halo) // 8 * 8 as read_start, least(frame_count, core_end + halo) as read_end from grid")
def k1(s, d):
    return K.chunk_grid(totals(s, d))


def chunked(s, d) -> DataFrame:
    """Rows of every chunk as read, halo included."""
    grid = K.chunk_grid(totals(s, d))
    t = tables(s, d)[0]
    reads = grid.select("video_id", "chunk", F.explode(F.sequence("read_start", F.col("read_end") - 1)).alias("frame"))
    return t.join(reads, ["video_id", "frame"])


READS = GRID + ", reads as (select g.video_id, c as chunk, t.frame, t.visible, core_start, core_end from grid g join traj t on t.video_id = g.video_id and t.frame >= greatest(0, core_start - halo) // 8 * 8 and t.frame < least(frame_count, core_end + halo)) "


@plan("c1_core_filter", READS + "select video_id, chunk, frame from reads where frame >= core_start and frame < core_end")
def c1(s, d):
    return K.core_filter(chunked(s, d), K.chunk_grid(totals(s, d))).select("video_id", "chunk", "frame")


@plan("h1_union_chunks", READS + "select video_id, chunk, frame, visible from reads")
def h1(s, d):
    rows = chunked(s, d)
    return rows.where("chunk % 2 = 0").unionByName(rows.where("chunk % 2 = 1")).select("video_id", "chunk", "frame", "visible")


@plan("h2_dedup_keep_last", READS + "select video_id, frame, max(chunk) as chunk from reads group by 1, 2")
def h2(s, d):
    return K.keep_last(chunked(s, d)).select("video_id", "frame", "chunk")


@plan("h3_pending_chunks", GRID + "select video_id, c as chunk from grid where (video_id + c) % 3 <> 0")
def h3(s, d):
    grid = K.chunk_grid(totals(s, d))
    return K.pending(grid, grid.where("(video_id + chunk) % 3 = 0")).select("video_id", "chunk")


@plan("k8_rebuild_prefix", READS + ", gone as (select video_id, min(c) as stop from grid where (video_id + c) % 5 = 4 group by 1) select r.video_id, frame, max(chunk) as chunk from reads r left join gone g on g.video_id = r.video_id where stop is null or chunk < stop group by 1, 2")
def k8(s, d):
    done = K.chunk_grid(totals(s, d)).where("(video_id + chunk) % 5 <> 4").select("video_id", "chunk")
    return K.keep_last(K.whole_prefix(chunked(s, d), done)).select("video_id", "frame", "chunk")


@plan("f22_build_windows", TOTALS + "select video_id, w as window, least(8, frame_count - w * 4) as valid_length, array_to_string(list_transform(range(w * 4, w * 4 + 8), lambda i: least(i, frame_count - 1)), ',') as frames from totals, lateral (select unnest(range(0, greatest(0, ceil((frame_count - 8) / 4.0::double)::bigint) + 1)) as w) u")
def f22(s, d):
    return K.windows(totals(s, d), 8, 4).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@plan("f20_linspace_sample", TOTALS + "select video_id, floor(i * ((frame_count - 1)::double / 40))::bigint as frame from totals, range(0, 41) r(i)")
def f20(s, d):
    return totals(s, d).select("video_id", F.explode(K.spread_sample(F.col("frame_count"), 41)).alias("frame"))


@plan("f21_stride_sample", " select video_id, frame from traj where pos % 10 = 0 and pos < 50")
def f21(s, d):
    order = Window.partitionBy("video_id").orderBy("pos")
    rows = G.positions(tables(s, d)[0]).where("pos % 10 = 0").withColumn("k", F.row_number().over(order))
    return rows.where("k <= 5").select("video_id", "frame")


@plan("e13_weighted_mean", ", w as (select t.video_id, t.frame // 4 as cell, least(i + 1, 8 - i) as wt, x * (i + 1) as v from traj t, range(0, 8) r(i)) select video_id, cell, round(sum(wt * v) / sum(wt), 6) as v from w group by 1, 2")
def e13(s, d):
    rows = tables(s, d)[0].select("video_id", F.floor(F.col("frame") / 4).alias("cell"), "x", F.posexplode(K.window_weights(8)).alias("i", "wt"))
    return J.weighted_mean(rows.withColumn("v", F.col("x") * (F.col("i") + 1)), ["video_id", "cell"], "v", "wt").select("video_id", "cell", r6("v"))


@plan("e6_pixel_median", ", p as (select vec_id // 7 as sample, i as pixel, list(embedding[i + 1] order by embedding[i + 1]) as v from embeddings, range(0, 64) r(i) group by 1, 2) select sample, pixel, v[len(v) // 2 + 1] as v from p")
def e6(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 7).alias("sample"), F.posexplode("embedding").alias("pixel", "v"))
    return rows.groupBy("sample", F.col("pixel").cast("long").alias("pixel")).agg(K.upper_median(F.collect_list("v")).alias("v"))


@plan("e4_median", " select video_id, round(median(x) filter (visible), 6) as median_x from traj group by 1")
def e4(s, d):
    return tables(s, d)[0].groupBy("video_id").agg(r6(F.median(F.when(F.col("visible"), F.col("x")))).alias("median_x"))


@plan("e11_mode", ", n as (select user_id, event_type, count(*) as k from events group by 1, 2) select user_id, event_type from n qualify row_number() over (partition by user_id order by k desc, event_type) = 1")
def e11(s, d):
    n = s.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("k")).alias("k"), "event_type")).alias("event_type"))


@plan("e12_argmax", " select video_id, max(frame) filter (x = m) as frame from (select *, max(x) over (partition by video_id) as m from traj) group by 1")
def e12(s, d):
    return tables(s, d)[0].groupBy("video_id").agg(F.max_by("frame", F.struct("x", "frame")).alias("frame"))


@plan("j4_decode_heatmap")
def j4(s, d):
    grids = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return grids.select("vec_id", J.decode_heatmap(F.col("g"), 8, 8, 0.15, 640.0, 720.0).alias("p")).select("vec_id", "p.*")


SQL["j4_decode_heatmap"] = """
with recursive c as (
  select vec_id, i, i % 8 as x, i // 8 as y from embeddings, range(0, 64) r(i) where embedding[i + 1]::double > 0.15::double),
reach(vec_id, i, low) as (
  select vec_id, i, i from c
  union
  select r.vec_id, b.i, r.low from reach r join c a on a.vec_id = r.vec_id and a.i = r.i
  join c b on b.vec_id = a.vec_id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1),
l as (select vec_id, i, min(low) as low from reach group by 1, 2),
b as (select l.vec_id, low, count(*) as cells, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from l join c on c.vec_id = l.vec_id and c.i = l.i group by 1, 2),
t as (select * from b qualify row_number() over (partition by vec_id order by cells desc, low) = 1)
select e.vec_id, coalesce(cells, 0)::bigint as cells, coalesce((x0 + x1 + 1) / 2.0::double * 80, 0) as x, coalesce((y0 + y1 + 1) / 2.0::double * 90, 0) as y, cells is not null as visible
from embeddings e left join t on t.vec_id = e.vec_id
"""


@plan("d12_heatmap_pair", " select a.vec_id, round(max(abs(a.v - b.v)), 6) as worst from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) a join (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) b on b.vec_id = a.vec_id + 1 and a.i = b.i group by 1")
def d12(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", r6(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))).alias("worst"))


# ---------------------------------------------------------------- edit lists


@plan("m1_clip_window", " select video_id, rally, round(greatest(0, start_seconds - 0.5::double), 6) as clip_start, round(greatest(0.1::double, end_seconds + 0.8::double - greatest(0, start_seconds - 0.5::double)), 6) as clip_length from rallies")
def m1(s, d):
    begin, length = M.clip_window(F.col("start_seconds"), F.col("end_seconds"))
    return rallies(s, d).select("video_id", "rally", r6(begin).alias("clip_start"), r6(length).alias("clip_length"))


PLANS["b9_clip"], SQL["b9_clip"] = m1, SQL["m1_clip_window"]


@plan("c12_selected_only", EDIT + "select video_id, rally, position from edits where selected")
def c12(s, d):
    return edits(s, d).where("selected").select("video_id", "rally", "position")


CUTS = EDIT + ", cuts as (select *, round((e - b) * 1000)::bigint as length_ms from (select e.video_id, rally, position, least(greatest(start_seconds, 0), greatest(0.1::double, duration)) as b, least(greatest(end_seconds, 0), greatest(0.1::double, duration)) as e from edits e join totals t on t.video_id = e.video_id where selected) where e > b + 0.05::double) "


@plan("m2_assembly_cutlist", CUTS + "select video_id, rally, position, round(b, 6) as cut_start, round(e, 6) as cut_end, length_ms, coalesce(sum(length_ms) over (partition by video_id order by position rows between unbounded preceding and 1 preceding), 0)::bigint as output_ms from cuts")
def m2(s, d):
    return M.cut_list(edits(s, d), totals(s, d)).select("video_id", "rally", "position", r6("cut_start"), r6("cut_end"), "length_ms", "output_ms")


@plan("m3_filter_graph")
def m3(s, d):
    cuts = M.cut_list(edits(s, d), totals(s, d)).withColumn("source_height", F.lit(2160))
    return M.filter_graph(cuts, audio=True, height=720)


SQL["m3_filter_graph"] = CHAIN + CUTS + """, k as (select *, row_number() over (partition by video_id order by position) - 1 as i, format('start={:.3f}:end={:.3f}', b, e) as span from cuts)
select video_id, '[0:v:0]split=' || count(*) || string_agg('[vsrc' || i || ']', '' order by i) || ';[0:a:0]asplit=' || count(*) || string_agg('[asrc' || i || ']', '' order by i) || ';'
  || string_agg('[vsrc' || i || ']trim=' || span || ',setpts=PTS-STARTPTS[v' || i || '];[asrc' || i || ']atrim=' || span || ',asetpts=PTS-STARTPTS[a' || i || ']', ';' order by i) || ';'
  || string_agg('[v' || i || '][a' || i || ']', '' order by i) || 'concat=n=' || count(*) || ':v=1:a=1[vcat][acat];[vcat]scale=-2:720:flags=lanczos[vout]' as graph
from k group by 1"""


@plan("m4_nudge_boundary", EDIT + ", n as (select e.video_id, rally, duration, end_seconds, greatest(0, least(end_seconds - 0.1::double, start_seconds + 0.5::double)) as s from edits e join totals t on t.video_id = e.video_id) select video_id, rally, round(s, 6) as start_seconds, round(least(duration, greatest(s + 0.1::double, end_seconds - 0.5::double)), 6) as end_seconds from n")
def m4(s, d):
    return M.nudge(edits(s, d), F.lit(0.5), F.lit(-0.5), totals(s, d)).select("video_id", "rally", r6("start_seconds"), r6("end_seconds"))


@plan("m5_apply_boundary", EDIT + "select e.video_id, rally, round(case when rally % 3 = 0 then start_seconds else greatest(0, least(end_seconds - 0.1::double, rally * 2.5::double)) end, 6) as start_seconds from edits e")
def m5(s, d):
    wanted = F.expr("try_cast(case when rally % 3 = 0 then 'x' else cast(rally * 2.5d as string) end as double)")
    return edits(s, d).select("video_id", "rally", r6(F.when(wanted.isNull(), F.col("start_seconds")).otherwise(M.set_start(wanted, F.col("end_seconds")))).alias("start_seconds"))


@plan("m6_restore_boundary", EDIT + "select video_id, rally, round(start_seconds, 6) as start_seconds, round(end_seconds, 6) as end_seconds from edits")
def m6(s, d):
    moved = M.nudge(edits(s, d), F.lit(0.5), F.lit(0.5), totals(s, d))
    return M.restore(moved).select("video_id", "rally", r6("start_seconds"), r6("end_seconds"))


@plan("m7_snapshot", EDIT + "select video_id, count(*) as n, bool_or(rally = 1) as dirty from edits group by 1")
def m7(s, d):
    pushed = edits(s, d)
    now = pushed.withColumn("remark", F.when(F.col("rally") == 1, "seen").otherwise(F.col("remark")))
    old = pushed.select("video_id", "rally", F.xxhash64("position", "start_seconds", "end_seconds", "remark", "selected").alias("h"))
    new = now.select("video_id", "rally", F.xxhash64("position", "start_seconds", "end_seconds", "remark", "selected").alias("g"))
    return old.join(new, ["video_id", "rally"], "full_outer").groupBy("video_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("h").eqNullSafe(F.col("g"))).alias("dirty"))


@plan("m8_export_single", EDIT + "select video_id, rally, case when rally % 2 = 0 then 'copy' else 'crf18' end as decision from edits")
def m8(s, d):
    return edits(s, d).select("video_id", "rally", M.export_decision(F.lit("720p"), F.lit(1080), F.col("rally") % 2 == 0).alias("decision"))


@plan("d7_sync_edit_list", EDIT + ", o as (select video_id, rally, position, true as old from edits where rally % 2 = 1), a as (select video_id, rally, 0 as new, -rally as p from o union all select video_id, rally, 1, rally from rallies r where rally % 2 = 0) select video_id, rally, row_number() over (partition by video_id order by new, p) - 1 as position, case when new = 0 then 'old' else '' end as remark from a")
def d7(s, d):
    found = stored_rallies(s, d)
    old = edits_of(found).where("rally % 2 = 1").withColumn("position", 1000 - F.col("position")).withColumn("remark", F.lit("old"))
    gone = old.where("rally = 1").withColumn("rally", F.lit(999).cast("long"))
    return M.sync(old.unionByName(gone), found).select("video_id", "rally", "position", "remark")


@plan("e15_selected_duration", EDIT + "select video_id, count(*) filter (selected) as n_selected, round(sum(case when selected then greatest(0, end_seconds - start_seconds) else 0 end), 6) as seconds from edits group by 1")
def e15(s, d):
    return M.selected_totals(edits(s, d)).select("video_id", "n_selected", r6("seconds"))


@plan("f19_neighbour_selected", EDIT + "select video_id, rally, (select min(rally) from edits o where o.video_id = e.video_id and o.selected and o.rally > e.rally) as next_selected, (select max(rally) from edits o where o.video_id = e.video_id and o.selected and o.rally < e.rally) as previous_selected from edits e")
def f19(s, d):
    return M.neighbour(edits(s, d))


@plan("g4_restore_order", EDIT + "select video_id, rally, rally - 1 as position from edits")
def g4(s, d):
    mixed = edits(s, d).withColumn("position", 500 - F.col("position"))
    order = Window.partitionBy("video_id").orderBy("rally")
    return mixed.select("video_id", "rally", (F.row_number().over(order) - 1).cast("long").alias("position"))


@plan("g5_move_row", EDIT + "select video_id, rally, case position when 0 then 2 when 1 then 0 when 2 then 1 else position end as position from edits")
def g5(s, d):
    return M.move_row(edits(s, d), 0, 2).select("video_id", "rally", "position")


@plan("g3_max_rallies", " select video_id, rally from rallies where rally <= 2")
def g3(s, d):
    return rallies(s, d).where("rally <= 2").select("video_id", "rally")


@plan("g1_sort_frames", " select video_id, frame from traj")
def g1(s, d):
    return tables(s, d)[0].select("video_id", "frame").repartition("video_id").sortWithinPartitions("video_id", "frame")


@plan("c5_effective_hits", " select video_id, rally, coalesce(case when rally % 2 = 0 then 9 end, hit_count)::bigint as effective from rallies")
def c5(s, d):
    return rallies(s, d).select("video_id", "rally", F.coalesce(F.when(F.col("rally") % 2 == 0, 9).cast("long"), "hit_count").alias("effective"))


@plan("c10_frame_cap", TOTALS + "select video_id, least(frame_count, 60) as target from totals")
def c10(s, d):
    return totals(s, d).select("video_id", F.least("frame_count", F.lit(60).cast("long")).alias("target"))


@plan("c13_quality_options", " select h::integer as height, case when h > 1080 then '720p,1080p,source' else '720p,source' end as options from (values (480), (720), (1080), (1440), (2160)) t(h)")
def c13(s, d):
    return s.createDataFrame([(480,), (720,), (1080,), (1440,), (2160,)], "height int").select("height", F.array_join(M.qualities(F.col("height")), ",").alias("options"))


# ---------------------------------------------------------------- sets, match rules


@plan("h5_intersect", " select video_id, start_frame from rallies where rally in (2, 3)")
def h5(s, d):
    r = stored_rallies(s, d).select("video_id", "start_frame", "rally")
    return r.where("rally >= 2").join(r.where("rally <= 3").select("video_id", "start_frame"), ["video_id", "start_frame"], "left_semi").select("video_id", "start_frame")


@plan("h6_distinct_ordered", " select user_id, array_to_string(list(event_type order by f), ',') as kinds from (select user_id, event_type, min(event_id) as f from events group by 1, 2) group by 1")
def h6(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return rows.select("user_id", F.array_join(F.array_distinct(F.col("e.event_type")), ",").alias("kinds"))


@plan("h7_listing_diff", " select distinct user_id from events where event_type = 'error' except select user_id from events where event_type = 'view' and user_id % 2 = 0")
def h7(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.where("event_type = 'error'").select("user_id").subtract(e.where("event_type = 'view' and user_id % 2 = 0").select("user_id"))


@plan("p1_quiet_periods", " select r.video_id, run_start, run_end, round(length / fps, 6) as seconds from runs r join videos v on v.video_id = r.video_id where length / fps >= 1.0::double")
def p1(s, d):
    return P.quiet_periods(*tables(s, d), seconds=1.0).select("video_id", "run_start", "run_end", r6("seconds"))


PAD = ", pad as (select video_id, rally, greatest(start_seconds - 2.0::double, coalesce(lag(end_seconds) over (partition by video_id order by rally) + 0.2::double, 0)) as s, end_seconds + 1.5::double as e from rallies) "


@plan("p2_padded_bounds", PAD + 'select video_id, rally, round(s, 6) as start, round(e, 6) as "end" from pad')
def p2(s, d):
    return P.padded_bounds(rallies(s, d)).select("video_id", "rally", r6("start"), r6("end"))


@plan("p3_out_of_frame", " select m.video_id, run_start, case when length / fps <= 3 then 'transient' else 'terminal' end as kind from marked m join videos v on v.video_id = m.video_id")
def p3(s, d):
    t, v = tables(s, d)
    return G.hidden_runs(t).join(v, "video_id").select("video_id", "run_start", P.absence_kind(F.col("length") / F.col("fps")).alias("kind"))


@plan("p4_compact_cut", PAD + ", m as (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) as reach from pad), i as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by video_id order by s, e rows unbounded preceding) as k from m) select video_id, round(min(s), 6) as start, round(max(e), 6) as \"end\" from i group by video_id, k")
def p4(s, d):
    return M.merge_intervals(P.padded_bounds(rallies(s, d)).drop("rally"), ["video_id"]).select("video_id", r6("start"), r6("end"))


POINTS = ", points as (select video_id, rally, ['A_POINT', 'B_POINT', 'NON_RALLY', 'PENDING'][1 + ((video_id // 4 + rally * rally) % 4)::int] as outcome from rallies) "


def outcomes(s, d) -> DataFrame:
    kinds = F.array(*map(F.lit, ("A_POINT", "B_POINT", "NON_RALLY", "PENDING")))
    which = (F.floor(F.col("video_id") / 4) + F.col("rally") * F.col("rally")) % 4
    return rallies(s, d).select("video_id", "rally", F.get(kinds, which.cast("int")).alias("outcome"))


@plan("p5_score_fold", POINTS + "select video_id, rally, outcome, count(*) filter (outcome = 'A_POINT') over w as a, count(*) filter (outcome = 'B_POINT') over w as b, left(last_value(case when outcome in ('A_POINT', 'B_POINT') then outcome end ignore nulls) over w, 1) as server from points window w as (partition by video_id order by rally rows between unbounded preceding and current row)")
def p5(s, d):
    return P.running_score(outcomes(s, d))


@plan("p5_game_fold")
def p5_games(s, d):
    """Games of every user's events, taken for outcomes in a row, in blocks of 16."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    point = F.when((F.col("event_id") * 7 + F.floor("value")) % 5 < 3, "A_POINT").otherwise("B_POINT")
    outcome = F.when(F.col("event_type") == "error", "NON_RALLY").when(F.col("event_type") == "signup", F.when(F.col("event_id") % 3 == 0, "PENDING").otherwise(point)).otherwise(point)
    rows = s.read.parquet(f"{d}/events.parquet").select("user_id", F.row_number().over(order).alias("rally"), outcome.alias("outcome"))
    return B.game_scores(rows, "user_id", block=16)


SQL["p5_game_fold"] = """with recursive points as (
  select user_id, row_number() over (partition by user_id order by event_id) as rally,
    case when event_type = 'error' then 'NON_RALLY' when event_type = 'signup' and event_id % 3 = 0 then 'PENDING'
      when (event_id * 7 + floor(value)::bigint) % 5 < 3 then 'A_POINT' else 'B_POINT' end as outcome
  from events),
played as (
  select user_id, rally, outcome, 1::bigint as game, (outcome = 'A_POINT')::integer as a, (outcome = 'B_POINT')::integer as b,
    0::bigint as games_a, 0::bigint as games_b, false as ends, case when outcome in ('A_POINT', 'B_POINT') then left(outcome, 1) end as server
  from points where rally = 1
  union all
  select user_id, rally, outcome, game, a, b, games_a + (ends and a > b)::integer, games_b + (ends and b > a)::integer, ends, case when not ends then server end
  from (select *, (greatest(a, b) >= 21 and abs(a - b) >= 2) or greatest(a, b) >= 30 as ends from (
    select p.user_id, p.rally, p.outcome, g.game + g.ends::integer as game, case when g.ends then 0 else g.a end + (p.outcome = 'A_POINT')::integer as a,
      case when g.ends then 0 else g.b end + (p.outcome = 'B_POINT')::integer as b, g.games_a, g.games_b,
      case when p.outcome in ('A_POINT', 'B_POINT') then left(p.outcome, 1) else g.server end as server
    from played g join points p on p.user_id = g.user_id and p.rally = g.rally + 1)))
select * from played"""


@plan("p6_structure_checks", ", l as (select *, start_seconds - lag(end_seconds) over (partition by video_id order by rally) as pause from rallies) select video_id, rally, array_to_string(list_filter([case when end_seconds - start_seconds < 1.5::double then 'short' end, case when end_seconds - start_seconds > 60 then 'long' end, case when pause < 2.5::double then 'no_quiet' end], lambda c: c is not null), ',') as checks from l")
def p6(s, d):
    return P.structure_checks(rallies(s, d)).withColumn("checks", F.array_join("checks", ","))


@plan("p7_score_reconcile", POINTS + "select video_id, count(*) filter (outcome = 'A_POINT') as a, count(*) filter (outcome = 'B_POINT') as b, count(*) filter (outcome = 'A_POINT') = 2 as agrees from points group by 1")
def p7(s, d):
    a = F.count_if(F.col("outcome") == "A_POINT")
    return outcomes(s, d).groupBy("video_id").agg(a.alias("a"), F.count_if(F.col("outcome") == "B_POINT").alias("b"), (a == 2).alias("agrees"))


@plan("p8_coalesce_non_rally", POINTS + ', m as (select *, case when outcome = \'NON_RALLY\' and lag(outcome) over (partition by video_id order by rally) = \'NON_RALLY\' then 0 else 1 end as o from points), k as (select *, sum(o) over (partition by video_id order by rally rows unbounded preceding) as run from m) select video_id, min(rally) as "first", max(rally) as "last", min(outcome) as outcome from k group by video_id, run')
def p8(s, d):
    return P.coalesce_runs(outcomes(s, d))


# ---------------------------------------------------------------- scalars


def numbers(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") * 37 % 8000 + 0.25).alias("t"), (F.col("event_id") * F.col("event_id") * 7919).alias("n"))


NUMBERS = "with q as (select event_id, event_id * 37 % 8000 + 0.25::double as t, event_id * event_id * 7919 as n from events) "


@plan("s1_format_seconds")
def s1(s, d):
    return numbers(s, d).select("event_id", T.clock(F.col("t")).alias("c"), T.clock_hundredths(F.col("t")).alias("h"), T.duration_ms(F.col("t").cast("long") * 1000 + 999).alias("m"))


SQL["s1_format_seconds"] = NUMBERS + """, p as (select event_id, t, round(t)::bigint as s, floor(t)::bigint as f from q)
select event_id, case when s >= 3600 then format('{:02d}:', s // 3600) else '' end || format('{:02d}:{:02d}', s % 3600 // 60, s % 60) as c,
  lpad((f // 60)::varchar, greatest(2, length((f // 60)::varchar))::integer, '0') || ':' || lpad(format('{:.2f}', t - f // 60 * 60), 5, '0') as h,
  case when f >= 3600 then format('{:02d}:', f // 3600) else '' end || format('{:02d}:{:02d}', f % 3600 // 60, f % 60) as m from p"""


@plan("s2_format_bytes")
def s2(s, d):
    return numbers(s, d).select("event_id", T.byte_size(F.col("n")).alias("b"), T.folder_size(F.col("n")).alias("f"))


SQL["s2_format_bytes"] = NUMBERS + """select event_id, case when n < 1024 then n || ' B' when n < 1048576 then format('{:.2f} KB', n / 1024.0::double) when n < 1073741824 then format('{:.2f} MB', n / 1048576.0::double) else format('{:.2f} GB', n / 1073741824.0::double) end as b,
  case when n >= 1073741824 then format('{:.2f} GB', n / 1073741824.0::double) else format('{:.1f} MB', n / 1048576.0::double) end as f from q"""


@plan("s3_safe_names")
def s3(s, d):
    docs = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    return docs.select("page_id", T.cache_name(F.col("url")).alias("folder"), T.export_name(F.col("url")).alias("file"), T.cache_key(F.col("url"), F.col("page_id"), F.col("page_id") * 1000).alias("key"))


SQL["s3_safe_names"] = r"""select page_id, left(regexp_replace(url, '[^\p{L}\p{N}._-]+', '_', 'g'), 48) as folder, left(regexp_replace(trim(url), '[\\/:*?"<>|]+', '_', 'g'), 80) as file, left(sha1(url || page_id || page_id * 1000), 10) as key from pages"""


@plan("s4_import_filter")
def s4(s, d):
    names = s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("C:/v/20240"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("10_101112."), F.get(F.array(*map(F.lit, ("MP4", "txt", "mkv", "webm", "jpg"))), (F.col("event_id") % 5).cast("int"))).alias("p"))
    return names.select("event_id", S.is_media(F.col("p")).alias("media"), F.date_format(T.name_date(F.regexp_extract("p", r"([^/]+)$", 1)), "yyyy-MM-dd HH:mm:ss").alias("taken"))


SQL["s4_import_filter"] = "select event_id, event_id % 5 in (0, 2, 3) as media, '2024-0' || (event_id % 9 + 1) || '-10 10:11:12' as taken from events"


@plan("s5_log_lines")
def s5(s, d):
    lines = s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("PROGRESS percent="), (F.col("event_id") % 130).cast("string"), F.when(F.col("event_id") % 2 == 0, " eta=None").otherwise(" eta=12.5s")).alias("a"), F.concat(F.lit("out_time_us="), (F.col("event_id") * 1000).cast("string")).alias("b"))
    p = T.progress_line(F.col("a"))
    return lines.select("event_id", r6(p["share"]).alias("share"), p["eta"].alias("eta"), r6(T.encoder_share(F.col("b"), F.lit(5000.0))).alias("written"))


SQL["s5_log_lines"] = "select event_id, round(least(1, (event_id % 130) / 100.0::double), 6) as share, case when event_id % 2 = 1 then 12.5::double end as eta, round(least(0.99::double, event_id / 5000.0::double), 6) as written from events"


MEDIA = """, media as (
  select *, r + case when video_id % 5 = 0 then 0.5::double else 0 end as nominal, 0.5::double + (video_id % 7) / 4.0::double as realtime from (
    select *, case when video_id % 3 = 0 then 3840 else 640 end as w, case when video_id % 3 = 0 then 2160 else 720 end as h, case when video_id % 4 < 2 then 60.0::double else fps end as r from videos))
"""


@plan("c15_media_profile", MEDIA + "select video_id, array_to_string(list_filter([case when w <> 3840 or h <> 2160 then 'size' end, case when abs(r - 60) > 0.5::double then 'rate' end, case when abs(r - nominal) >= 0.001::double then 'variable' end], lambda t: t is not null), ',') as warnings, case when realtime < 1 then 'FAIL' when w = 3840 and h = 2160 and abs(r - 60) <= 0.5::double then 'PASS' else 'PASS_WITH_WARNING' end as verdict from media")
def c15(s, d):
    v, k = tables(s, d)[1], F.col("video_id")
    w, h = F.when(k % 3 == 0, 3840).otherwise(F.col("width")), F.when(k % 3 == 0, 2160).otherwise(F.col("height"))
    fps = F.when(k % 4 < 2, 60.0).otherwise(F.col("fps"))
    nominal = fps + F.when(k % 5 == 0, 0.5).otherwise(0.0)
    return v.select("video_id", F.array_join(T.media_warnings(w, h, fps, nominal, F.lit(0.0)), ",").alias("warnings"), T.media_verdict(w, h, fps, 0.5 + k % 7 / 4).alias("verdict"))


@plan("a1_probe_video")
def a1(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat((F.col("event_id") * 1000).cast("string"), F.lit("/"), (F.col("event_id") % 3 * 1001).cast("string")).alias("rate_text"))
    return rows.select("event_id", r6(S.rate(F.col("rate_text"))).alias("fps"))


SQL["a1_probe_video"] = "select event_id, case when event_id % 3 > 0 and event_id > 0 then round(event_id * 1000.0::double / (event_id % 3 * 1001), 6) end as fps from events"


@plan("a6_scan_progress_json")
def a6(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct(F.lit("running").alias("status"), (F.col("event_id") % 15 / 10).alias("percent"), F.when(F.col("event_id") % 2 == 0, 3.5).alias("etaSeconds"))).alias("j"))
    return rows.select("event_id", S.parse_progress(F.col("j")).alias("p")).select("event_id", "p.*")


SQL["a6_scan_progress_json"] = "select event_id, 'running' as status, least(1, (event_id % 15) / 10.0::double) as percent, case when event_id % 2 = 0 then 3.5::double else -1 end as eta_seconds from events"


@plan("a11_frame_timestamps")
def a11(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 7 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("v"))
    return rows.select("event_id", F.expr("try_cast(v as double)").alias("ts")).where("ts is not null")


SQL["a11_frame_timestamps"] = "select event_id, value as ts from events where event_id % 7 <> 0 and value is not null"


@plan("e17_throughput", TOTALS + "select video_id, round(frame_count / (1.5::double + video_id % 7), 6) as rate, round(frame_count / fps / (1.5::double + video_id % 7), 6) as realtime from totals")
def e17(s, d):
    spent = 1.5 + F.col("video_id") % 7
    return totals(s, d).select("video_id", r6(F.col("frame_count") / spent).alias("rate"), r6(F.col("duration") / spent).alias("realtime"))


@plan("k7_progress_eta", TOTALS + "select video_id, round(least(1, 40 / frame_count), 6) as percent, round((frame_count - least(40, frame_count)) / (30 / 2.0::double), 6) as eta from totals")
def k7(s, d):
    done, fresh, spent = 40, 30, 2.0  # frames done, of which made in this run, and its seconds
    return totals(s, d).select("video_id", r6(F.least(F.lit(1.0), done / F.col("frame_count"))).alias("percent"), r6((F.col("frame_count") - F.least(F.lit(done), F.col("frame_count"))) / (fresh / spent)).alias("eta"))


@plan("k4_fingerprint_guard", " select video_id, not (video_id % 3 = 0 or video_id % 4 = 1 or video_id % 5 = 2) as same from videos")
def k4(s, d):
    v, k = tables(s, d)[1], F.col("video_id")
    model = F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string")))  # without a model for every other video
    a = F.struct(F.col("fps"), F.col("width"), model.alias("model"))
    b = F.struct((F.col("fps") + F.when(k % 5 == 2, 1).otherwise(0)).alias("fps"), F.when(k % 3 == 0, 1).otherwise(F.col("width")).alias("width"), F.when(k % 4 == 1, "new").otherwise(model).alias("model"))
    return v.select("video_id", K.same_run(a, b).alias("same"))


@plan("k5_cancel", GRID + "select video_id, c as chunk, case when c < 2 + video_id % 4 then 'complete' else 'pending' end as state, case when ceil(frame_count / core) <= 2 + video_id % 4 then 'complete' else 'paused' end as status from grid")
def k5(s, d):
    """Every video but those that end before is cancelled after some chunks; these stay, the others wait."""
    grid = K.chunk_grid(totals(s, d)).select("video_id", "chunk")
    asked = grid.select("video_id").distinct().select("video_id", (2 + F.col("video_id") % 4).alias("chunk"))
    return R.cancelled(grid, asked)


TRUTH = """, truth as (
  select video_id, rally, start_seconds + (rally % 4) * 0.1::double as s, end_seconds - (rally % 3) * 0.2::double as e, hit_count + rally % 3 as hits from rallies where (video_id + rally) % 9 <> 0),
pairs as (
  select t.video_id, t.rally, r.rally as found, abs(t.s - r.start_seconds) as ds, abs(t.e - r.end_seconds) as de, abs(t.hits - r.hit_count) as dh,
         row_number() over (partition by t.video_id, t.rally order by least(t.e, r.end_seconds) - greatest(t.s, r.start_seconds) desc, r.rally) as k
  from truth t join rallies r on r.video_id = t.video_id and r.start_seconds < t.e and t.s < r.end_seconds where (r.video_id + r.rally) % 11 <> 0),
best as (select * from pairs where k = 1),
n as (select (select count(*) from truth) as t, (select count(*) from rallies where (video_id + rally) % 11 <> 0) as p)
"""


@plan("p10_acceptance", TRUTH + "select count(*)::bigint as matched, round(count(*) / any_value(n.t), 6) as recall, round(count(distinct (video_id, found)) / any_value(n.p), 6) as precision, round(count(*) filter (ds <= 0.3::double and de <= 0.3::double) / count(*), 6) as boundary_share, round(avg((ds + de) / 2), 6) as boundary_error, round(count(*) filter (dh <= 1) / count(*), 6) as hits_share from best, n")
def p10(s, d):
    r = stored_rallies(s, d)
    truth = r.where("(video_id + rally) % 9 <> 0").select("video_id", "rally", (F.col("start_seconds") + F.col("rally") % 4 * 0.1).alias("start_seconds"), (F.col("end_seconds") - F.col("rally") % 3 * 0.2).alias("end_seconds"), (F.col("hit_count") + F.col("rally") % 3).alias("hit_count"))
    return Q.acceptance(r.where("(video_id + rally) % 11 <> 0"), truth).select("matched", *(r6(c) for c in ("recall", "precision", "boundary_share", "boundary_error", "hits_share")))


@plan("k12_restore_state", " select event_id, case event_id % 4 when 0 then 'complete' when 1 then 'paused' when 2 then 'paused' else 'sample_complete' end as state from events")
def k12(s, d):
    told = F.get(F.array(*map(F.lit, ("complete", "paused", "running", "sample_complete"))), (F.col("event_id") % 4).cast("int"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(told == "running", "paused").otherwise(told).alias("state"))
