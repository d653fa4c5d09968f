"""Raw frames in files."""

import pytest
from pyspark.sql import functions as F

from trackloom.sources import frames as V


def test_frames_come_back_by_index(spark, tmp_path):
    rows = [(v, f, bytearray([v, f % 256] * 6)) for v in (1, 2) for f in range(37)]
    df = spark.createDataFrame(rows, "video_id long, frame long, image binary")
    told = V.write_frames(df, f"file://{tmp_path}/raw", 16).collect()
    assert sorted(map(tuple, told)) == [(v, c, n) for v in (1, 2) for c, n in ((0, 16), (1, 16), (2, 5))]
    read = V.read_frames(spark, f"{tmp_path}/raw", 2, 2, chunk=4)
    assert read.rdd.getNumPartitions() == 2 * (4 + 4 + 2)  # a partition a chunk
    video, frame = V.place_of(F.col("path"), F.col("frame"), 16)
    assert sorted((r[0], r[1], r[2]) for r in read.select(video, frame, "image").collect()) == [(v, f, i) for v, f, i in rows]
    one = f"{tmp_path}/raw/video-1-chunk-00000001.raw"
    assert [(r.frame, bytes(r.image)) for r in V.read_frames(spark, one, 2, 2, first=3, count=2).collect()] == [(k, bytes([1, 16 + k] * 6)) for k in (3, 4)]


def test_exact_bytes_or_an_error(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"x" * 25)
    with pytest.raises(Exception, match="no whole number"):
        V.read_frames(spark, f"{tmp_path}/a.raw", 2, 2).collect()
    (tmp_path / "a.raw").write_bytes(b"x" * 24)
    with pytest.raises(Exception, match="asked for"):
        V.read_frames(spark, f"{tmp_path}/a.raw", 2, 2, first=1, count=2).collect()
    assert V.read_frames(spark, f"{tmp_path}/a.raw", 2, 2).count() == 2
    reader = V.FrameReader({"path": str(tmp_path / "a.raw"), "width": 2, "height": 2})
    part = reader.partitions()[0]
    (tmp_path / "a.raw").write_bytes(b"x" * 13)  # shorter by the time that it is read
    with pytest.raises(ValueError, match="frame 1 has 1 bytes"):
        list(reader.read(part))


def test_holes_and_no_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, bytearray(12)), (1, 2, bytearray(12))], "video_id long, frame long, image binary")
    with pytest.raises(Exception, match="missing"):
        V.write_frames(df, f"{tmp_path}/raw", 16).collect()
    (tmp_path / "none").mkdir()
    assert V.read_frames(spark, f"{tmp_path}/none", 2, 2).collect() == []


def test_small_files_share_a_task(spark, tmp_path):
    rows = [(v, f, bytearray([v, f % 256] * 6)) for v in range(40) for f in range(20)]
    df = spark.createDataFrame(rows, "video_id long, frame long, image binary")
    assert V.write_frames(df, f"{tmp_path}/raw", 16).count() == 80
    read = V.read_frames(spark, f"{tmp_path}/raw", 2, 2, chunk=16, together=1 << 21)
    assert read.rdd.getNumPartitions() == 3  # 80 files, one with 31 others
    video, frame = V.place_of(F.col("path"), F.col("frame"), 16)
    assert sorted((r[0], r[1], r[2]) for r in read.select(video, frame, "image").collect()) == rows


def test_a_file_over_several_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame([(1, f, bytearray([f] * 12)) for f in range(37)], "video_id long, frame long, image binary")
        assert sorted(map(tuple, V.write_frames(df, f"{tmp_path}/raw", 16).collect())) == [(1, 0, 16), (1, 1, 16), (1, 2, 5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (tmp_path / "raw" / "video-1-chunk-00000001.raw").read_bytes() == b"".join(bytes([f] * 12) for f in range(16, 32))
