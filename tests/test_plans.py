"""Registered plans against their SQL, files, edit lists and the stream."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.operators import chunks as K
from trackloom.operators import edits as M
from trackloom.operators import grid as J
from trackloom.plans import registry
from trackloom.sources import files as S
from trackloom.sources.tables import TRAJECTORY, event_trajectories, event_videos

DATA = "/root/testdata/sf0.001"
CHECKED = ("b8_compare_and_set", "e16_listed_size", "k11_listed_clear", "p5_game_fold", "a3_scan_trajectory_csv", "a8_scan_raw_tensor", "a9_scan_token_text", "b1_write_chunk", "c11_quality_gate", "c15_media_profile", "d2_golden_lookup", "d9_timestamp_zip", "e17_throughput", "f17_trailing_history", "j2_model_input", "k4_fingerprint_guard", "k5_cancel", "k8_rebuild_prefix", "p10_acceptance", "f4_gap_length", "f14_split_rules", "f8_smooth", "f13_hit_rows", "analyze", "e7_comparison_report", "h2_dedup_keep_last", "m2_assembly_cutlist", "m3_filter_graph", "d7_sync_edit_list", "j4_decode_heatmap", "p4_compact_cut", "s1_format_seconds", "s3_safe_names")


@pytest.mark.parametrize("name", CHECKED)
def test_plan_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.register("got", registry.queries()[name](spark, DATA).toArrow())
    con.sql(f"create table want as {registry.oracle_sql()[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    assert con.sql("select count(*) from want").fetchall()[0][0] > 0
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []


def test_every_plan_but_the_clusters_has_sql():
    """Clusters are held against planted courts in test_shapes."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"j7_court_roi"}
    assert set(registry.oracle_sql()) < set(registry.queries()) and len(registry.queries()) > 110


def test_acceptance_and_cancelling(spark):
    from trackloom.operators import quality as Q
    from trackloom.operators import runs as R

    schema = "video_id long, rally long, start_seconds double, end_seconds double, hit_count long"
    truth = spark.createDataFrame([(1, 1, 0.0, 10.0, 5), (1, 2, 100.0, 200.0, 9), (1, 3, 300.0, 301.0, 2), (2, 1, 50.0, 70.0, 4)], schema)
    found = spark.createDataFrame([(1, 1, 0.2, 10.0, 6), (1, 2, 101.0, 150.0, 3), (1, 3, 150.0, 199.5, 9), (2, 1, 80.0, 90.0, 1)], schema)
    got = Q.acceptance(found, truth).first()
    assert (got.matched, got.recall, got.precision, got.boundary_share, got.hits_share) == (2, 0.5, 0.5, 0.5, 1.0)
    assert got.boundary_error == pytest.approx((0.1 + (50 + 0.5) / 2) / 2)
    none = Q.acceptance(found.limit(0), truth).first()
    assert (none.matched, none.recall, none.precision) == (0, 0.0, None)
    chunks = spark.createDataFrame([(v, c) for v in (1, 2, 3) for c in range(3)], "video_id long, chunk long")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "video_id long, chunk long")
    rows = {(r.video_id, r.chunk): (r.state, r.status) for r in R.cancelled(chunks, asked).collect()}
    assert rows == {(v, c): (("complete" if c < 1 else "pending", "paused") if v == 1 else ("complete", "complete")) for v in (1, 2, 3) for c in range(3)}


def test_raw_floats_from_files(spark, tmp_path):
    import struct

    for k in range(3):
        (tmp_path / f"t{k}.bin").write_bytes(struct.pack("<4f", *(k + i / 2 for i in range(4))))
    rows = S.read_raw(spark, f"{tmp_path}/*.bin", 16).select("path", S.decode_floats(F.col("content"), 4).alias("v")).orderBy("path").collect()
    assert [list(r.v) for r in rows] == [[k + i / 2 for i in range(4)] for k in range(3)]
    with pytest.raises(Exception, match="bytes"):
        S.read_raw(spark, f"{tmp_path}/*.bin").select(S.decode_floats(F.col("content"), 5)).collect()


def test_trajectory_files(spark, tmp_path):
    t = spark.createDataFrame([(0, k, k % 3 > 0, k * 1.5, 2.0) for k in range(10)], TRAJECTORY)
    S.write_trajectory_csv(t.coalesce(1), str(tmp_path / "t"))
    back = S.read_trajectory_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    (tmp_path / "c").mkdir()
    for name, body in (("chunk-00000.csv", "0,1,1,1\n1,1,2,2\n"), ("chunk-00001.csv", "1,0,0,0\n2,1,3,3\n"), ("notes.csv", "9,1,1,1\n")):
        (tmp_path / "c" / name).write_text("Frame,Visibility,X,Y\n" + body)
    last = K.keep_last(S.read_chunks(spark, str(tmp_path / "c"))).orderBy("frame").collect()
    assert [(r.frame, r.visible, r.chunk) for r in last] == [(0, True, 0), (1, False, 1), (2, True, 1)]
    (tmp_path / "bad.csv").write_text("Frame,Visibility,X,Y\n1,x,2,3\n")
    with pytest.raises(Exception):
        S.read_trajectory_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_other_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert [tuple(r) for r in S.read_quoted_csv(spark, str(tmp_path / "q.csv")).collect()] == [("1", 'x, "y"')]
    (tmp_path / "g.txt").write_text("0 1 2.5\n\n 3  4 5\n")
    assert [tuple(r) for r in S.read_tokens(spark, str(tmp_path / "g.txt"), "w long, p int, x double").collect()] == [(0, 1, 2.5), (3, 4, 5.0)]
    (tmp_path / "r.bin").write_bytes(b"\x01\x02")
    assert S.read_raw(spark, str(tmp_path / "r.bin"), 2).count() == 1
    with pytest.raises(Exception):
        S.read_raw(spark, str(tmp_path / "r.bin"), 3).collect()


def test_a_broken_feed_has_no_entries(spark):
    feeds = spark.createDataFrame([(1, "not json"), (2, '[{"rally":1,"hitCount":4},{"rally":2,"hitCount":5}]')], "video_id long, feed string")
    assert [(r.video_id, r.rally, r.hitCount) for r in S.parse_feed(feeds, most=1).collect()] == [(2, 1, 4)]


def test_windows_pad_or_stop(spark):
    v = spark.createDataFrame([(1, 10), (2, 8), (3, 3)], "video_id long, frame_count long")
    rows = {(r.video_id, r.window): (r.valid_length, r.frames) for r in K.windows(v, 8, 8).collect()}
    assert rows == {(1, 0): (8, list(range(8))), (1, 1): (2, [8, 9] + [9] * 6), (2, 0): (8, list(range(8))), (3, 0): (3, [0, 1, 2, 2, 2, 2, 2, 2])}
    assert {(r.video_id, r.window) for r in K.windows(v, 8, 8, pad=False).collect()} == {(1, 0), (2, 0)}


def test_cut_list_drops_tiny_parts(spark):
    e = spark.createDataFrame([(1, 1, 0, -1.0, 2.0, True), (1, 2, 1, 3.0, 3.04, True), (1, 3, 2, 9.0, 99.0, True), (1, 4, 3, 1.0, 2.0, False)], "video_id long, rally long, position long, start_seconds double, end_seconds double, selected boolean")
    v = spark.createDataFrame([(1, 10.0)], "video_id long, duration double")
    assert [(r.rally, r.cut_start, r.cut_end, r.output_ms) for r in M.cut_list(e, v).orderBy("position").collect()] == [(1, 0.0, 2.0, 0), (3, 9.0, 10.0, 2000)]


def test_resize_keeps_constants_and_size():
    import numpy as np

    grey = np.full((7, 5, 3), 9, np.uint8)
    assert (J.resize_bilinear(grey, 16, 4) == 9).all() and J.resize_bilinear(grey, 16, 4).shape == (4, 16, 3)
    assert J.model_input([grey] * 8, grey, 16, 8).shape == (27, 8, 16)


def test_a_rate_is_of_the_column_it_is_given(spark):
    df = spark.createDataFrame([("30000/1001", "60/1"), ("25", "1/1"), ("0/1", "2"), ("5/0", "2"), ("x", "2"), (None, "2")], "a string, rate_text string")
    assert [r[0] for r in df.select(S.rate(F.col("a"))).collect()] == [30000 / 1001, 25.0, None, None, None, None]


@pytest.mark.parametrize("name", ("j1_resize_bilinear", "j8_resize_sweep", "j2_model_input"))
def test_grids_are_cut_from_products_of_32_bits(spark, tmp_path, name):
    """Values whose product is whole in 32 bits and just below in 64."""
    import numpy as np

    v = np.array([k / 200 for k in range(1, 200)], np.float32)
    near = np.unique(np.concatenate([v, np.nextafter(v, np.float32(0)), np.nextafter(v, np.float32(1))]))
    near = near[(near * np.float32(200)).astype(int) != (near.astype(float) * 200).astype(int)]
    assert len(near) > 20
    rows = [(k, [float(x) for x in np.roll(near, k)[np.arange(64) % len(near)]], 1) for k in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    con.register("got", registry.queries()[name](spark, str(tmp_path)).toArrow())
    con.sql(f"create table want as {registry.oracle_sql()[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []


def test_sizes_round_by_their_exact_value(spark):
    """Halves to even, as the SQL does."""
    from trackloom.functions import text as T

    values = [0, 1023, 1024, 1152, 1160, 1280, 1536, 5248, 1048576 + 131072 * 5, 1073741824 + 134217728, 79188000000000, None, *(k * 128 for k in range(8, 400)), *(k * 131072 for k in range(8, 400)), *(k * 52428 for k in range(20, 400))]
    got = spark.createDataFrame([(v,) for v in values], "n long").select(T.byte_size(F.col("n")), T.folder_size(F.col("n"))).collect()

    def size(n):
        return None if n is None else f"{n} B" if n < 1 << 10 else f"{n / (1 << 10):.2f} KB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MB" if n < 1 << 30 else f"{n / (1 << 30):.2f} GB"

    assert [r[0] for r in got] == [size(v) for v in values]
    assert [r[1] for r in got] == [None if v is None else f"{v / (1 << 30):.2f} GB" if v >= 1 << 30 else f"{v / (1 << 20):.1f} MB" for v in values]


def test_trajectories_of_many_videos_share_files(spark, tmp_path):
    rows = [(v, k, k % 3 > 0, k * 1.5 if k else None, -2.0) for v in (-1, *range(300)) for k in range(4)]
    t = spark.createDataFrame(rows, TRAJECTORY)
    S.write_trajectories_csv(t, str(tmp_path / "t"))
    files = list((tmp_path / "t").rglob("*.csv"))
    assert 0 < len(files) <= 4  # a folder for each of 301 videos before
    assert sorted(map(str, map(tuple, S.read_trajectories_csv(spark, str(tmp_path / "t")).collect()))) == sorted(map(str, rows))
    (tmp_path / "t" / "bad.csv").write_text("video_id,Frame,Visibility,X,Y\n1,1,x,2,3\n")
    with pytest.raises(Exception):
        S.read_trajectories_csv(spark, str(tmp_path / "t")).collect()


@pytest.mark.parametrize("name", ("d7_sync_edit_list", "k9_change_detect", "m7_snapshot", "d4_emit_anti"))
def test_joined_rallies_are_worked_out_once(spark, name):
    """What joins rallies reads them from a table, and has no analysis beside it."""
    read = registry.queries()[name](spark, DATA).inputFiles()
    assert read and all("trackloom-rallies" in f for f in read)


def test_tasks_of_an_analysis_grow_with_the_frames(spark, monkeypatch):
    from trackloom.plans import core

    monkeypatch.setattr(core, "TASK_ROWS", 100)
    for rows in (core.rallies(spark, DATA), core.PLANS["d5_frame_in_rally"](spark, DATA)):
        assert rows.rdd.getNumPartitions() == 20  # 2,000 frames


@pytest.mark.parametrize("name", ("b6_write_summary", "d5_frame_in_rally", "k9_change_detect", "k2_incremental_emit", "m7_snapshot", "d3_ordinal_rally_compare", "d4_emit_anti", "h5_intersect"))
def test_plans_of_stored_rallies_equal_their_sql(spark, name):
    test_plan_equals_its_sql(spark, name)
