"""The trajectory table, and how driver tables become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: One row a frame of a video.
TRAJECTORY = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("frame", T.LongType()),
        T.StructField("visible", T.BooleanType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
#: What a probe of a video knows.
VIDEOS = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)
#: Frame rates under which each user's events are read as a video.
RATES = (4.0, 10.0)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order, as frames: an error is an invisible object."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        "user_id",
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        (F.col("event_type") != "error").alias("visible"),
        F.col("value").alias("x"),
        (F.get_json_object("props", "$.k").cast("int") * 7.2).alias("y"),
    )


def event_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory table: every user's events as one video for each rate."""
    rates = F.explode(F.array(*(F.lit(k) for k in range(len(RATES))))).alias("k")
    frames = event_frames(spark, sf_dir).select("*", rates)
    return frames.select((F.col("user_id") * len(RATES) + F.col("k")).alias("video_id"), "frame", "visible", "x", "y")


def event_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the videos of event_trajectories."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    rates = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("fps")) for k, r in enumerate(RATES)))).alias("r")
    return users.select("user_id", rates).select(
        (F.col("user_id") * len(RATES) + F.col("r.k")).alias("video_id"), F.col("r.fps").alias("fps"), F.lit(640).alias("width"), F.lit(720).alias("height")
    )
