"""Plans that write files or tables and read them back, and the state of a run."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import grid as J
from ..operators import runs as R
from ..operators import shapes as H
from ..sources import files as S
from ..sources import folders as D
from ..sources import frames as V
from ..sources.files import shared
from .chain import CHAIN
from .core import r6, rallies, stored_rallies, tables
from .more import GRID, READS, TOTALS, chunked, totals

PLANS: dict = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def put(f):
        PLANS[name] = f
        if sql:
            SQL[name] = CHAIN + sql
        return f

    return put


def cells(embedding: str) -> Column:
    """A grid of whole numbers from an embedding: each value 200 times, in 32 bits, cut."""
    return F.transform(embedding, lambda v: (F.abs(v) * F.lit(200).cast("float")).cast("int"))


@plan("a3_scan_trajectory_csv", " select video_id, frame, visible, x, y from traj")
def a3(s, d):
    path = shared(s, "csv")
    S.write_trajectories_csv(tables(s, d)[0], path)
    return S.read_trajectories_csv(s, path)


@plan("b1_write_chunk", READS + "select video_id, chunk, frame, visible from reads")
def b1(s, d):
    """A file for every chunk number, halo rows included, and all of them read again."""
    path = shared(s, "chunks")
    S.write_chunks(chunked(s, d), path)
    return S.read_written_chunks(s, path).select("video_id", "chunk", "frame", "visible")


@plan("a4_scan_chunk_dir", " select event_id, case when event_id % 2 = 0 then event_id::integer end as chunk from events")
def a4(s, d):
    names = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 2 == 0, F.format_string("chunk-%05d.csv", "event_id")).otherwise(F.format_string("chunk-%d.tmp", "event_id")).alias("name"))
    return names.select("event_id", S.chunk_number(F.col("name")).alias("chunk"))


@plan("a5_scan_feed_json", " select video_id, rally, hit_count, round(start_seconds, 3) as start_seconds from rallies where rally <= 2")
def a5(s, d):
    path = shared(s, "feed")
    S.feed_json(rallies(s, d)).write.json(path)
    feeds = s.read.schema("video_id long, feed string").json(path)
    return S.parse_feed(feeds, most=2).select("video_id", "rally", F.col("hitCount").alias("hit_count"), F.col("startSeconds").alias("start_seconds"))


@plan("a7_scan_quoted_csv", " select event_id, event_type, props from events")
def a7(s, d):
    path = shared(s, "quoted")
    s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "props").write.option("header", True).option("escape", '"').csv(path)
    return S.read_quoted_csv(s, path).select(F.col("event_id").cast("long").alias("event_id"), "event_type", "props")


@plan("a9_scan_token_text", " select video_id, frame, x from traj")
def a9(s, d):
    path = shared(s, "tokens")
    tables(s, d)[0].select(F.concat_ws("  ", "video_id", "frame", "x").alias("value")).write.text(path)
    return S.read_tokens(s, path, "video_id long, frame long, x double")


@plan("a8_scan_raw_tensor")
def a8(s, d):
    """Every embedding as raw bytes of 32-bit numbers, decoded again."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", S.encode_floats(F.col("embedding")).alias("content"))
    back = e.select("vec_id", F.posexplode(S.decode_floats(F.col("content"), 64)).alias("place", "value"))
    return back.select("vec_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


SQL["a8_scan_raw_tensor"] = "select vec_id, i::integer as place, round(embedding[i + 1]::double, 6) as value from embeddings, range(0, 64) r(i)"


@plan("b7_write_progress", TOTALS + "select video_id, 'running' as status, round(least(1, 40 / frame_count), 6) as percent, case when frame_count > 40 then round((frame_count - 40) / 15.0::double, 6) else -1 end as eta_seconds from totals")
def b7(s, d):
    rows = R.progress(totals(s, d).withColumn("frames_done", F.least("frame_count", F.lit(40).cast("long"))), fresh=30, seconds=2.0)
    path = shared(s, "progress")
    rows.write.json(path)
    p = S.parse_progress(F.col("value"))
    back = s.read.text(path).select(F.get_json_object("value", "$.video_id").cast("long").alias("video_id"), p.alias("p"))
    return back.select("video_id", "p.status", r6(F.col("p.percent")).alias("percent"), r6(F.col("p.eta_seconds")).alias("eta_seconds"))


@plan("b8_atomic_replace", " select video_id, rally, hit_count from rallies")
def b8(s, d):
    root = shared(s, "versions")
    found = rallies(s, d).select("video_id", "rally", "hit_count")
    R.publish(found.where("rally = 1"), root, 0)
    R.publish(found, root, 1)
    return R.latest(s, root)


@plan("b8_compare_and_set", " select video_id, rally, hit_count + (video_id % 2 = 0)::integer + (rally % 2 = 0)::integer as hit_count from rallies")
def b8_compared(s, d):
    """Two changes made from one version: the second is told of the first, and made again from its rows."""
    root = shared(s, "compared")
    add = lambda rows, where: rows.withColumn("hit_count", F.col("hit_count") + F.when(where, 1).otherwise(0))
    base = R.commit(rallies(s, d).select("video_id", "rally", "hit_count"), root, None)
    stale = R.latest(s, root)
    R.commit(add(stale, F.col("video_id") % 2 == 0), root, base)
    odd = F.col("rally") % 2 == 0
    try:
        R.commit(add(stale, odd), root, base)
    except R.Conflict:
        R.update(s, root, lambda rows: add(rows, odd))
    return R.latest(s, root)


@plan("b10_reports", " select video_id, count(*) as n_rows, count(*) filter (visible) as visible_frames from traj group by 1")
def b10(s, d):
    from ..operators.quality import coverage

    report = coverage(tables(s, d)[0]).select("video_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "n_rows", "visible_frames")).alias("report"))
    read = lambda k: F.get_json_object("report", f"$.{k}").cast("long").alias(k)
    return report.select("video_id", read("n_rows"), read("visible_frames"))


@plan("e16_dir_size", " select user_id, sum(octet_length(encode(props)))::bigint as bytes from events group by 1")
def e16(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.sum(F.octet_length("props")).alias("bytes"))


def put_props(s, d, root: str) -> None:
    """A folder of text files for each of 32 groups of users."""
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("props").alias("value"), (F.col("user_id") % 32).alias("part"))
    rows.write.partitionBy("part").text(root)


def part(folder):
    return F.regexp_extract(folder, r"^part=(\d+)$", 1).cast("long").alias("part")


@plan("e16_listed_size", " select user_id % 32 as part, sum(octet_length(encode(props)) + 1)::bigint as bytes from events group by 1")
def e16_listed(s, d):
    """Bytes of the files in each folder, a line's end behind each text."""
    root = shared(s, "sizes")
    put_props(s, d, root)
    return D.folder_sizes(D.listing(s, root)).select(part("folder"), "bytes").where("part is not null")


@plan("k11_listed_clear", " select user_id % 32 as part, case when user_id % 32 % 3 = 0 then 'deleted' else 'in use' end as state, sum(octet_length(encode(props)) + 1)::bigint as bytes, case when user_id % 32 % 3 = 0 then 0 else sum(octet_length(encode(props)) + 1) end::bigint as bytes_left from events group by user_id % 32")
def k11_listed(s, d):
    """Folders of every third group are cleared; what each held, and what a listing finds afterwards."""
    root = shared(s, "clear")
    put_props(s, d, root)
    before = shared(s, "before")
    D.folder_sizes(D.listing(s, root)).where("folder is not null").write.parquet(before)
    sizes = s.read.parquet(before)
    cleared = D.clear(s, root, lambda: sizes.where(part("folder") % 3 != 0))
    left = D.folder_sizes(D.listing(s, root)).select("folder", F.col("bytes").alias("bytes_left"))
    told = sizes.join(cleared.select("folder", "state"), "folder", "left").join(left, "folder", "left")
    return told.select(part("folder"), F.coalesce("state", F.lit("in use")).alias("state"), "bytes", F.coalesce("bytes_left", F.lit(0).cast("long")).alias("bytes_left"))


@plan("h4_missing_columns", " select 'Y' as missing union all select 'Visibility'")
def h4(s, d):
    present = tables(s, d)[0].select(F.col("frame").alias("Frame"), F.col("x").alias("X"))
    return s.createDataFrame([(c,) for c in R.missing_columns(present, S.CSV_TRAJECTORY.names)], "missing string")


@plan("k3_resume", GRID + "select video_id, c as chunk, (video_id + c) % 3 = 0 as reused from grid")
def k3(s, d):
    grid = K.chunk_grid(totals(s, d))
    done = grid.where("(video_id + chunk) % 3 = 0")
    todo = K.pending(grid, done)
    return done.select("video_id", "chunk", F.lit(True).alias("reused")).unionByName(todo.select("video_id", "chunk", F.lit(False).alias("reused")))


@plan("k6_trial_stop", " select video_id, rally from rallies where rally <= 3")
def k6(s, d):
    return R.trial(rallies(s, d), 3).select("video_id", "rally")


@plan("k9_change_detect", " select video_id, video_id % 5 = 0 as changed from rallies group by 1")
def k9(s, d):
    old = stored_rallies(s, d).select("video_id", "rally", "hit_count")
    new = old.withColumn("hit_count", F.col("hit_count") + F.when(F.col("video_id") % 5 == 0, 1).otherwise(0))
    return R.changed(old, new, ["video_id"])


@plan("k11_cache_gc", " select user_id, count(*) as files, sum(octet_length(encode(props)))::bigint as freed from events where user_id % 3 = 0 group by 1")
def k11(s, d):
    listing = s.read.parquet(f"{d}/events.parquet").select("user_id", F.octet_length("props").alias("length"))
    in_use = listing.where("user_id % 3 <> 0").select("user_id").distinct()
    return R.collectable(listing, in_use, "user_id").groupBy("user_id").agg(F.count("*").alias("files"), F.sum("length").alias("freed"))


@plan("k10_session_baseline", ", s as (select *, case when frame - lag(frame) over (partition by video_id order by frame) > 3 * fps then 1 else 0 end as o from traj t join videos v using (video_id) where visible), g as (select *, sum(o) over (partition by video_id order by frame rows unbounded preceding) as k from s) select video_id, min(frame) as start_frame, max(frame) as end_frame from g group by video_id, k")
def k10(s, d):
    t, v = tables(s, d)
    at = F.timestamp_millis((F.col("frame") * 1000 / F.col("fps")).cast("long"))
    rows = t.where("visible").join(v, "video_id").withColumn("ts", at)
    return rows.groupBy("video_id", F.session_window("ts", "3001 milliseconds")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("session_window")


@plan("j1_resize_bilinear")
def j1(s, d):
    grids = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", cells("embedding").alias("g"))
    return grids.select("vec_id", F.array_join(J.resize_column(F.col("g"), 8, 8, 16, 16).cast("array<string>"), ",").alias("g"))


SQL["j1_resize_bilinear"] = """
with p as (select vec_id, i % 8 as x, i // 8 as y, trunc(abs(embedding[i + 1])::float * 200::float)::integer as v from embeddings, range(0, 64) r(i)),
a as (select k, floor(greatest(0, least(7, (k + 0.5::double) * 0.5::double - 0.5::double)))::int as lo, greatest(0, least(7, (k + 0.5::double) * 0.5::double - 0.5::double)) as pos from range(0, 16) r(k)),
b as (select k, least(lo, 6) as lo, pos - least(lo, 6) as f from a),
o as (
  select p00.vec_id, bv.k * 16 + bx.k as i,
    (p00.v * (1 - bx.f) + p10.v * bx.f) * (1 - bv.f) + (p01.v * (1 - bx.f) + p11.v * bx.f) * bv.f as v
  from b bx, b bv, p p00, p p10, p p01, p p11
  where p00.x = bx.lo and p00.y = bv.lo and p10.vec_id = p00.vec_id and p10.x = bx.lo + 1 and p10.y = bv.lo
    and p01.vec_id = p00.vec_id and p01.x = bx.lo and p01.y = bv.lo + 1 and p11.vec_id = p00.vec_id and p11.x = bx.lo + 1 and p11.y = bv.lo + 1)
select vec_id, string_agg(round_even(v, 0)::integer::varchar, ',' order by i) as g from o group by 1"""


@plan("j2_model_input")
def j2(s, d):
    """A background and one frame of 4 by 4 points, from each embedding, as the planes of a model's input."""
    grid = cells("embedding")
    images = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.slice(grid, 1, 48).alias("a"), F.slice(grid, 17, 48).alias("b"))
    planes = images.select("vec_id", F.posexplode(J.model_input_column(F.array("a", "b"), 4, 4, 8, 8)).alias("i", "v"))
    return planes.select("vec_id", F.floor(F.col("i") / 64).alias("plane"), (F.col("i") % 64).cast("long").alias("cell"), r6(F.col("v").cast("double")).alias("v"))


SQL["j2_model_input"] = """
with p as (
  select vec_id, m, i % 3 as c, i // 3 % 4 as x, i // 12 as y, trunc(abs(embedding[m * 16 + i + 1])::float * 200::float)::integer as v
  from embeddings, range(0, 48) r(i), (values (0), (1)) k(m)),
a as (select k, floor(greatest(0, least(3, (k + 0.5::double) * 0.5::double - 0.5::double)))::int as lo, greatest(0, least(3, (k + 0.5::double) * 0.5::double - 0.5::double)) as pos from range(0, 8) r(k)),
b as (select k, least(lo, 2) as lo, pos - least(lo, 2) as f from a),
o as (
  select p00.vec_id, p00.m * 3 + 2 - p00.c as plane, bv.k * 8 + bx.k as cell,
    (p00.v * (1 - bx.f) + p10.v * bx.f) * (1 - bv.f) + (p01.v * (1 - bx.f) + p11.v * bx.f) * bv.f as v
  from b bx, b bv, p p00, p p10, p p01, p p11
  where p00.x = bx.lo and p00.y = bv.lo
    and p10.vec_id = p00.vec_id and p10.m = p00.m and p10.c = p00.c and p10.x = bx.lo + 1 and p10.y = bv.lo
    and p01.vec_id = p00.vec_id and p01.m = p00.m and p01.c = p00.c and p01.x = bx.lo and p01.y = bv.lo + 1
    and p11.vec_id = p00.vec_id and p11.m = p00.m and p11.c = p00.c and p11.x = bx.lo + 1 and p11.y = bv.lo + 1)
select vec_id, plane::bigint as plane, cell::bigint as cell, round((round_even(v, 0)::float / 255::float)::double, 6) as v from o"""


@plan("j8_resize_sweep")
def j8(s, d):
    """Formulations of the resize ranked by the cells in which they differ from the one in use, on every grid."""
    grids = s.read.parquet(f"{d}/embeddings.parquet").select(cells("embedding").alias("grid"))
    return H.resize_sweep(grids.withColumn("wanted", J.resize_column(F.col("grid"), 8, 8, 5, 7)), 8, 8, 5, 7).withColumn("worst", r6(F.col("worst")))


SQL["j8_resize_sweep"] = """
with e as (select vec_id, list_transform(embedding, lambda v: trunc(abs(v)::float * 200::float)::bigint) as g from embeddings),
tx as (select k, least(7, greatest(0, (k + 0.5::double) * 8 / 5 - 0.5::double)) as pos from range(0, 5) r(k)),
ty as (select k, least(7, greatest(0, (k + 0.5::double) * 8 / 7 - 0.5::double)) as pos from range(0, 7) r(k)),
ax as (select k, least(6, floor(pos))::bigint as lo, pos - least(6, floor(pos)) as f from tx),
ay as (select k, least(6, floor(pos))::bigint as lo, pos - least(6, floor(pos)) as f from ty),
c as (
  select vec_id, g[y.lo * 8 + x.lo + 1] as p, g[y.lo * 8 + x.lo + 2] as q, g[y.lo * 8 + x.lo + 9] as r, g[y.lo * 8 + x.lo + 10] as s, x.f as fx, y.f as fy from e, ax x, ay y),
t as (select *, round_even((p * (1 - fx) + q * fx) * (1 - fy) + (r * (1 - fx) + s * fx) * fy, 0)::bigint as wanted from c),
floats as (
  select passes, 0 as bits, '' as "first", 0 as "add", how, vec_id, wanted,
    case how when 'even' then round_even(v, 0) when 'up' then floor(v + 0.5::double) else trunc(v) end::bigint as got
  from (
    select *, case when passes = 1 then a else case how when 'even' then round_even(a, 0) when 'up' then floor(a + 0.5::double) else trunc(a) end end * (1 - fy)
            + case when passes = 1 then b else case how when 'even' then round_even(b, 0) when 'up' then floor(b + 0.5::double) else trunc(b) end end * fy as v
    from (select *, p * (1 - fx) + q * fx as a, r * (1 - fx) + s * fx as b from t, (values (1), (2)) n(passes), (values ('even'), ('up'), ('down')) h(how)))),
w as (
  select *, case "first" when 'far' then round_even(fx * (1 << bits), 0)::bigint else (1 << bits) - round_even((1 - fx) * (1 << bits), 0)::bigint end as u,
            case "first" when 'far' then round_even(fy * (1 << bits), 0)::bigint else (1 << bits) - round_even((1 - fy) * (1 << bits), 0)::bigint end as z,
            half * (1::bigint << (bits - 1)) as "add"
  from t, (values (1), (2)) n(passes), (values (8), (10), (11), (12), (14), (15), (16)) b(bits), (values ('near'), ('far')) f("first"), (values (0), (1)) h(half)),
m as (
  select *, p * ((1 << bits) - u) + q * u as a, r * ((1 << bits) - u) + s * u as b from w),
k as (
  select *, case when passes = 1 then a else greatest(0, least(255, (a + "add") >> bits)) end as top, case when passes = 1 then b else greatest(0, least(255, (b + "add") >> bits)) end as low from m),
whole as (
  select passes, bits, "first", "add", '' as how, vec_id, wanted,
    greatest(0, least(255, (top * ((1 << bits) - z) + low * z + "add") >> (bits * (3 - passes)))) as got from k),
every as (select passes, bits, "first", "add", how, vec_id, wanted, got from floats union all select passes, bits, "first", "add", how, vec_id, wanted, got from whole),
n as (select passes, bits, "first", "add", how, vec_id, count(*) filter (where got <> wanted) as wrong from every group by all),
o as (select passes, bits, "first", "add", how, sum(wrong)::bigint as mismatch, round(max(wrong) * 100.0::double / 35, 6) as worst from n group by 1, 2, 3, 4, 5)
select passes::integer as passes, bits::integer as bits, "first", "add"::integer as "add", how, mismatch, worst,
  (row_number() over (order by mismatch, passes, bits, "first", "add", how))::integer as rank from o"""


@plan("j7_court_roi")
def j7(s, d):
    """The floor in the median of 15 images for each label; an image is a grid enlarged, with a colour that follows its values."""
    from pyspark.sql.window import Window

    grids = s.read.parquet(f"{d}/embeddings.parquet").where("label is not null").select("vec_id", F.col("label").cast("long").alias("video_id"), cells("embedding").alias("g"))
    whole = Window.partitionBy("video_id")
    grids = grids.withColumn("n", F.count("*").over(whole)).withColumn("k", F.row_number().over(whole.orderBy("vec_id")))
    spread = grids.where(F.expr("(k * 15) div n <> ((k - 1) * 15) div n"))  # evenly over the video, all if it has fewer
    colour = F.transform(J.resize_column(F.col("g"), 8, 8, 48, 32), lambda v: F.substring(F.concat(*(F.unhex(F.lpad(F.hex(c), 2, "0")) for c in (v, 255 - v, F.floor(v / 2).cast("int")))), 1, 3))
    images = spread.select("video_id", F.unhex(F.array_join(F.transform(colour, lambda b: F.hex(b)), "")).alias("image"))
    return H.court_regions(images, 48, 32, closing=3, opening=1)


@plan("e12_largest_component", None)
def e12(s, d):
    grids = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return grids.select("vec_id", J.decode_heatmap(F.col("g"), 8, 8, 0.15, 640.0, 720.0)["cells"].alias("cells"))


SQL["e12_largest_component"] = ""


def _largest() -> str:
    from .more import SQL as more

    return more["j4_decode_heatmap"].replace("select e.vec_id, coalesce(cells, 0)::bigint as cells, coalesce((x0 + x1 + 1) / 2.0::double * 80, 0) as x, coalesce((y0 + y1 + 1) / 2.0::double * 90, 0) as y, cells is not null as visible", "select e.vec_id, coalesce(cells, 0)::bigint as cells")


SQL["e12_largest_component"] = _largest()


@plan("j3_predict_windows", TOTALS + ", w as (select video_id, w as window, least(8, frame_count - w * 8) as valid from totals, lateral (select unnest(range(0, ceil(frame_count / 8.0::double)::bigint)) as w) u) select w.video_id, w.\"window\", t.frame, round(t.x + t.y, 6) as value from w join traj t on t.video_id = w.video_id and t.frame between w.\"window\" * 8 and w.\"window\" * 8 + valid - 1")
def j3(s, d):
    """Windows through a stand-in for a model, then its valid places only."""
    import pandas as pd

    t = tables(s, d)[0]
    places = K.windows(totals(s, d), 8, 8).select("video_id", "window", "valid_length", F.posexplode("frames").alias("place", "frame"))
    filled = places.join(t, ["video_id", "frame"]).groupBy("video_id", "window", "valid_length")
    windows = filled.agg(F.array_sort(F.collect_list(F.struct("place", "frame", "x", "y"))).alias("r")).select(
        "video_id", "window", "valid_length", F.col("r.frame").alias("frames"), F.col("r.x").alias("xs"), F.col("r.y").alias("ys")
    )

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        values = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(batch["xs"], batch["ys"], strict=True)]
        return batch[["video_id", "window", "valid_length", "frames"]].assign(values=values)

    made = J.predict(windows, model, "video_id long, window long, valid_length long, frames array<long>, values array<double>")
    rows = made.select("video_id", "window", "valid_length", F.posexplode(F.arrays_zip("frames", "values")).alias("place", "r"))
    return rows.where("place < valid_length").select("video_id", "window", F.col("r.frames").alias("frame"), r6(F.col("r.values")).alias("value"))


PLANS["j5_predict_chunk"], SQL["j5_predict_chunk"] = j3, SQL["j3_predict_windows"]


@plan("j4_decode_by_area")
def j4_area(s, d):
    """Heat maps by the outline that encloses the largest area, not by cells."""
    grids = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return grids.select("vec_id", H.decode_by_area(F.col("g"), 8, 8, 0.05, 640.0, 720.0).alias("p")).select("vec_id", "p.*")


SQL["j4_decode_by_area"] = """
with recursive wide as (
  select vec_id, x, y, x between 0 and 7 and y between 0 and 7 and coalesce(embedding[greatest(0, least(7, y)) * 8 + greatest(0, least(7, x)) + 1]::double > 0.05::double, false) as hit
  from embeddings, range(-1, 9) a(x), range(-1, 9) b(y)),
out(vec_id, x, y) as (
  select vec_id, x, y from wide where x = -1 and y = -1
  union
  select w.vec_id, w.x, w.y from out o join wide w on w.vec_id = o.vec_id and abs(w.x - o.x) + abs(w.y - o.y) = 1 where not w.hit),
c as (select w.vec_id, w.x, w.y, w.y * 8 + w.x as i from wide w anti join out o on o.vec_id = w.vec_id and o.x = w.x and o.y = w.y),
reach(vec_id, i, low) as (
  select vec_id, i, i from c
  union
  select r.vec_id, b.i, r.low from reach r join c a on a.vec_id = r.vec_id and a.i = r.i
  join c b on b.vec_id = a.vec_id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1),
l as (select vec_id, i, min(low) as low from reach group by 1, 2),
p as (select c.*, l.low from c join l using (vec_id, i)),
q as (  -- squares of four cells count one, of three a half
  select vec_id, low, sum(case n when 4 then 1 when 3 then 0.5 else 0 end)::double as area
  from (select vec_id, low, x + dx as sx, y + dy as sy, count(*) as n from p, (values (0), (1)) u(dx), (values (0), (1)) v(dy) group by 1, 2, 3, 4) group by 1, 2),
b as (select vec_id, low, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by 1, 2),
t as (select * from b join q using (vec_id, low) qualify row_number() over (partition by vec_id order by area desc, low) = 1)
select e.vec_id, coalesce(area, 0) as area, coalesce((x0 + x1 + 1) / 2.0::double * 80, 0) as x, coalesce((y0 + y1 + 1) / 2.0::double * 90, 0) as y, area is not null as visible
from embeddings e left join t on t.vec_id = e.vec_id
"""


@plan("a2_scan_frames", ", p as (select video_id, frame, visible, unnest(range(0, 12)) as i from traj) select video_id, frame, string_agg(printf('%02X', ((frame * 7 + video_id + i * 31 + visible::int * 101) % 256)::int), '' order by i) as image from p group by 1, 2")
def a2(s, d):
    """Images of 2 by 2 points that follow from each frame, written as raw chunks of 64 and read again, small chunks by one task together."""
    t = tables(s, d)[0]
    points = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.lpad(F.hex((F.col("frame") * 7 + F.col("video_id") + i * 31 + F.col("visible").cast("int") * 101) % 256), 2, "0"))
    path = shared(s, "frames")
    V.write_frames(t.select("video_id", "frame", F.unhex(F.array_join(points, "")).alias("image")), path, 64).write.format("noop").mode("overwrite").save()
    video, frame = V.place_of(F.col("path"), F.col("frame"), 64)
    return V.read_frames(s, path, 2, 2, chunk=64, together=1 << 25).select(video.alias("video_id"), frame.alias("frame"), F.hex("image").alias("image"))
