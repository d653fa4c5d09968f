"""The stream of rallies against the analysis of the whole table."""

import random

import pytest

from trackloom.operators.hits import analyze
from trackloom.sources.tables import TRAJECTORY, event_trajectories, event_videos
from trackloom.streaming.rallies import RallyStream

DATA = "/root/testdata/sf0.001"
COLUMNS = ["video_id", "rally", "start_frame", "end_frame", "hit_count"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def source(spark, folder):
    return spark.readStream.schema(TRAJECTORY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def chunk(t, folder, k, size):
    t.where(f"frame >= {k * size} and frame < {(k + 1) * size}").coalesce(1).write.parquet(f"{folder}/in/{k}")


@pytest.fixture(scope="module")
def tracks(spark):
    """Tracks whose gaps fall on all kinds of chunk edges."""
    rng = random.Random(11)
    rows = []
    for video in range(6):
        x, y, f = 300.0, 500.0, 0
        while f < 400:
            for _ in range(rng.choice([1, 3, 20, 40])):
                slow = rng.random() < 0.3
                x, y = x + rng.uniform(-60, 60) * (0.02 if slow else 1), min(700.0, max(5.0, y + rng.uniform(-80, 80) * (0.02 if slow else 1)))
                rows.append((video, f, True, x, y))
                f += 1
            for _ in range(rng.choice([1, 2, 3, 4, 6, 12, 40])):
                if rng.random() < 0.9:
                    rows.append((video, f, False, None, None))
                f += 1
    t = spark.createDataFrame(rows, TRAJECTORY).cache()
    v = spark.createDataFrame([(k, fps, 640, 720) for k, fps in enumerate((4.0, 8.0, 10.0, 12.0, 25.0, 0.0))], "video_id long, fps double, width int, height int")
    return t, v


def test_stream_equals_batch(spark, tracks, tmp_path):
    t, v = tracks
    edges = [0, 7, 60, 61, 180, 300, 1000]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        t.where(f"frame >= {a} and frame < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = RallyStream(spark, f"{tmp_path}/run", v)
    told = stream.run(source(spark, tmp_path))
    want = rows_of(analyze(t, v)[0])
    before = rows_of(stream.rallies())
    assert set((r[0], *r[2:]) for r in before) <= set((r[0], *r[2:]) for r in want) and before  # what is published never changes
    assert rows_of(stream.finish()) == rows_of(stream.finish()) == want and len(want) > 5
    assert [r[0] for r in told] == list(range(6)) and sum(r[1] for r in told) == t.count()


def test_a_restart_without_input_keeps_what_is_stored(spark, tmp_path):
    t, v = event_trajectories(spark, DATA).where("video_id < 4"), event_videos(spark, DATA)
    chunk(t, tmp_path, 0, 30)
    assert RallyStream(spark, f"{tmp_path}/run", v).run(source(spark, tmp_path))
    want = rows_of(analyze(t.where("frame < 30"), v)[0])
    for _ in range(2):
        stream = RallyStream(spark, f"{tmp_path}/run", v)
        assert stream.run(source(spark, tmp_path)) == []
        assert rows_of(stream.finish()) == want and want
    # and goes on after it was finished
    chunk(t, tmp_path, 1, 30)
    t.where("frame >= 60").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = RallyStream(spark, f"{tmp_path}/run", v)
    stream.run(source(spark, tmp_path))
    assert rows_of(stream.finish()) == rows_of(analyze(t, v)[0])


def test_rallies_of_another_run_are_not_written_over(spark, tmp_path):
    (tmp_path / "run/rallies/batch=0").mkdir(parents=True)
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="another run"):
        RallyStream(spark, f"{tmp_path}/run", event_videos(spark, DATA)).run(source(spark, tmp_path))


def test_a_stopped_stream_goes_on_where_it_stopped(spark, tracks, tmp_path):
    t, v = tracks
    for k in range(5):
        chunk(t, tmp_path, k, 100)
    stream = RallyStream(spark, f"{tmp_path}/run", v)
    told = stream.run(source(spark, tmp_path), most=2)
    assert 2 <= stream.published == stream.rallies().count()
    assert 0 < len(told) <= 5
    told += RallyStream(spark, f"{tmp_path}/run", v).run(source(spark, tmp_path), cancelled=lambda: True)
    stream = RallyStream(spark, f"{tmp_path}/run", v)
    stream.run(source(spark, tmp_path))
    assert rows_of(stream.finish()) == rows_of(analyze(t, v)[0])


def test_late_and_odd_frames(spark, tmp_path):
    hops = [(1, f, True, 100.0 + 200 * (f % 2), 600.0) for f in range(20)]
    v = spark.createDataFrame([(1, 10.0, 640, 720)], "video_id long, fps double, width int, height int")
    odd = [hops[3], (None, 1, True, 1.0, 1.0), (1, None, True, 1.0, 1.0), (9, 1, True, 1.0, 1.0)]
    for k, rows in enumerate((hops + odd, [(1, 4, False, None, None), (1, 20, True, 100.0, 600.0)])):
        spark.createDataFrame(rows, TRAJECTORY).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = RallyStream(spark, f"{tmp_path}/run", v)
        stream.run(source(spark, tmp_path))
    scan = stream._state("scan").select("value.rows", "value.late", "value.last_frame").collect()
    assert [tuple(r) for r in scan] == [(21, 1 + 1, 20)]  # a repeated row and a late one
    assert [(r.start_frame, r.end_frame) for r in stream.finish().collect()] == [(0, 20)]


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """Over ten batches the state holds open segments only, and does not grow with what has been taken."""
    rows, size = [], 50
    for f in range(10 * size):
        shown = f % size < 30
        rows.append((1, f, shown, 100.0 + 200 * (f % 2) if shown else None, 600.0 if shown else None))
    v = spark.createDataFrame([(1, 10.0, 640, 720)], "video_id long, fps double, width int, height int")
    t = spark.createDataFrame(rows, TRAJECTORY)
    for k in range(10):
        chunk(t, tmp_path, k, size)
    stream = RallyStream(spark, f"{tmp_path}/run", v)
    told = stream.run(source(spark, tmp_path))
    assert [r[1] for r in told] == [size] * 10
    assert stream._state("open").count() <= 2 * size
    assert len(stream._state("scan").first().value.pos) <= 40
    assert rows_of(stream.finish()) == rows_of(analyze(t, v)[0])


def test_a_batch_of_a_video_costs_few_calls_of_the_state():
    """One read and one write of the scan, and one frame out for all segments that the batch closes."""
    import pandas as pd

    from trackloom.streaming.segments import Segments

    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *_: calls.append((self.name, call)) or (iter(()) if self.name == "open" else None)

    class Handle:
        def getListState(self, name, _):  # noqa: N802
            return State(name)

        getValueState = getListState  # noqa: N815

    s = Segments()
    s.init(Handle())
    shown = [k % 40 < 20 for k in range(121)]
    limit = {"restart": 2, "split": 1, "long": 12, "behind": 1, "ahead": 1, "diag": 963.0, "top": 158.0}
    rows = pd.DataFrame({"video_id": 1, "frame": range(121), "visible": shown, "x": 1.0, "y": None, **limit})
    out = list(s.handleInputRows((1,), iter([rows]), None))
    assert [len(o) for o in out] == [60] and out[0]["segment_id"].tolist() == [0] * 20 + [1] * 20 + [2] * 20
    assert calls == [("scan", "get"), ("open", "get"), ("open", "put"), ("scan", "update")]
