"""The analysis dealt over blocks against the one that has a video in a task."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import dealt as D
from trackloom.operators import gaps as G
from trackloom.operators import hits as H
from trackloom.sources.tables import TRAJECTORY


@pytest.fixture(scope="module")
def tracks(spark):
    """Long and short tracks with runs of all lengths, missing frames, slow stretches, and steps between equal heights."""
    rng, rows = random.Random(7), []
    for video in range(7):
        x, y, f = 300.0, 500.0, rng.randrange(20)
        while f < (900 if video < 5 else 3):
            for _ in range(rng.choice([1, 2, 3, 5, 30, 90])):
                slow = 0.02 if rng.random() < 0.3 else 1
                x, y = x + rng.choice([-40, 0, 40]) * slow, min(700.0, max(5.0, y + rng.uniform(-80, 80) * slow))
                rows.append((video, f, True, x, y))
                f += 1
            for _ in range(rng.choice([1, 2, 3, 4, 6, 12, 130])):
                if rng.random() < 0.9:
                    rows.append((video, f, False, None, None))
                f += 1
    rows += [(10, f, False, None, None) for f in range(50)] + [(11, 5, True, 1.0, 600.0)]
    t = spark.createDataFrame(rows, TRAJECTORY).cache()
    v = [(k, fps, 640, 720) for k, fps in enumerate((4.0, 8.0, 10.0, 25.0, 60.0, 10.0, 10.0, 0.0, None))] + [(10, 10.0, 640, 720), (11, 10.0, 640, 720)]
    return t, spark.createDataFrame(v, "video_id long, fps double, width int, height int")


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("size", [5, 64, 1 << 16])
def test_blocks_of_any_size_change_nothing(spark, tracks, size):
    t, v = tracks
    known = v.where("fps > 0")
    assert rows(D.positions(t, size), ["video_id", "frame", "pos"]) == rows(G.positions(t), ["video_id", "frame", "pos"])
    runs = ["video_id", "run_start", "run_end", "length", "inner"]
    whole = t.where("video_id <> 10")  # a video that is never visible has no rank to lie between
    assert rows(D.hidden_runs(whole, size), runs) == rows(G.hidden_runs(whole), runs)
    gaps = ["video_id", "left_pos", "right_pos", "size", "left_x", "right_y"]
    assert rows(D.invisible_gaps(t, known, size), gaps) == rows(G.invisible_gaps(t).join(known, "video_id"), gaps)
    bounds = ["video_id", "segment_id", "start_pos", "end_pos", "start_frame", "end_frame", "n_rows"]
    assert rows(D.segments(t, known, size=size), bounds) == rows(G.segments(t, known), bounds)


@pytest.mark.parametrize("size", [9, 1 << 16])
def test_rallies_and_hits_are_the_same(spark, tracks, size):
    t, v = tracks
    for mine, want in zip(D.analyze(t, v, size=size), H.analyze(t, v), strict=True):
        assert rows(mine, want.columns) == rows(want, want.columns) != []


def test_odd_rows_have_no_part(spark):
    hops = [(1, f, True, 100.0 + 200 * (f % 2), 600.0) for f in range(20)]
    t = spark.createDataFrame([*hops, (None, 1, True, 1.0, 1.0), (1, None, True, 1.0, 1.0), (1, 20, None, 1.0, 1.0)], TRAJECTORY).withColumn("block", F.lit("k")).withColumn("pos", F.lit(3))
    v = spark.createDataFrame([(1, 10.0, 640, 720)], "video_id long, fps double, width int, height int")
    got = D.analyze(t.select(*TRAJECTORY.names), v, size=4)[0].collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 19)]
    assert D.analyze(t.select(*TRAJECTORY.names).limit(0), v)[0].collect() == []


def test_a_long_video_is_many_tasks(spark):
    """Blocks of one video are partitions of their own in every step that has rows."""
    t = spark.range(20_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"), (F.pmod("id", F.lit(50)) < 30).alias("visible"), (F.pmod("id", F.lit(7)) * 90.0).alias("x"), F.lit(600.0).alias("y"))
    v = spark.createDataFrame([(1, 10.0, 640, 720)], "video_id long, fps double, width int, height int")
    spread = D.turning_rows(D.segment_rows(t, v, size=500), size=500).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark puts so few rows into one task
    try:
        assert spread.groupBy("task").count().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread.drop("task").count() == D.turning_rows(D.segment_rows(t, v)).count() > 0
